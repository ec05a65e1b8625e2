import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callspark.llm.packing import CapacityTree, SumOfSquares, best_fit_decreasing, pack_online, pack_token_matrix, write_token_matrix
from callspark.llm.textbytes import slices
from callspark.llm.tokens import default_vocabulary, reader

PLAIN = Tokenizer.from_file(default_vocabulary())
NASTY = ["", "a", "It's the dog's <|endoftext|> end", "x<|ENDOFTEXT|>y.z", "é ́a.b,c!!d", "Σας ΣΑΣ", "a b　c", "'S 'll don't'll", "12.5% (ab)-c K İ", "<|x", "日本語.abc。", "\x00\x1f \x85 a"]


def _ids(texts):
    out = []
    for piece in slices(pa.array(texts, pa.string()), 64):
        ids, offsets = reader(default_vocabulary()).read(piece)
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def test_ids_equal_the_tokenizers():
    texts = [*NASTY, "".join(NASTY), "\n".join(NASTY)]
    assert _ids(texts) == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAsSzZ'.,!-:\"()<|> \t\n09é́ßΣ"), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_ids_equal_the_tokenizers_on_any_text(texts):
    assert _ids(texts) == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def _docs():
    rng = random.Random(4)
    return [(k, " ".join(rng.choice(["word", "été", "x1,", "tion"]) for _ in range(rng.choice([0, 1, 5, 60, 700, 3000])))) for k in range(120)] + [(500, None), (None, "no id"), (800, "again"), (800, "again")]


def _expected(docs, end):
    return sorted((str(i), tuple(PLAIN.encode(t or "", add_special_tokens=False).ids + [end])) for i, t in docs)


def test_matrix_round_trip(spark, tmp_path):
    docs, size = _docs(), 256
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, ids int")
    write_token_matrix(pack_token_matrix(df.repartition(3), size=size), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    pieces = []
    for r in rows:
        ids, at = np.frombuffer(r.ids, dtype="<u2"), np.frombuffer(r.positions, dtype="<u2")
        assert len(ids) == len(at) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            assert at[a:b].tolist() == list(range(b - a))
            pieces.append((str(doc), start, ids[a:b].tolist()))
    assert sum(len(p[2]) for p in pieces) > 0.95 * size * (len(rows) - 3)
    assert sorted(_join(pieces)) == _expected(docs, 49407)


def _join(pieces):
    """Documents from their pieces; of documents with one id, pieces at one start are dealt out in order."""
    by = defaultdict(list)
    for doc, start, ids in pieces:
        by[doc].append((start, ids))
    for doc, parts in by.items():
        heads = [ids for start, ids in parts if start == 0]
        if len(heads) > 1:  # short ones only, in these tests
            assert all(start == 0 for start, _ in parts)
            yield from ((doc, tuple(x)) for x in heads)
        else:
            out = []
            for start, ids in sorted(parts):
                assert start == len(out)
                out += ids
            yield doc, tuple(out)


def test_online(spark):
    docs, size = _docs(), 512
    rows = pack_online(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), size=size).collect()
    fills = defaultdict(list)
    for r in rows:
        fills[r.sequence_id].append((r.offset, r.length))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    texts = {str(i): PLAIN.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    covered = defaultdict(int)
    for r in rows:
        ids = texts[str(r.doc_id)]
        part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        covered[str(r.doc_id)] += r.length
    assert covered == {k: len(v) * (2 if k == "800" else 1) for k, v in texts.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_online(df).count() == 0 and pack_token_matrix(df).count() == 0


@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_is_the_plain_best_fit(lengths):
    bins = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [b for b in bins if sum(lengths[i] for i in b) + lengths[k] <= 30]
        if fits:
            max(fits, key=lambda b: sum(lengths[i] for i in b)).append(k)
        else:
            bins.append([k])
    got = best_fit_decreasing(np.array(lengths, dtype=np.int64), 30)
    assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(sum(lengths[i] for i in b) for b in bins)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))


@given(st.lists(st.integers(1, 40), max_size=80))
def test_sum_of_squares_choice(lengths):
    """Each placement ends with the least sum of squares that any placement has."""
    packer = SumOfSquares(20, lambda window: None)
    for n in lengths:
        before = packer.level.copy()
        packer.add(0, np.zeros(n, dtype=np.uint32))
        need = n % 20
        if need:
            options = []
            for fill in [0, *np.flatnonzero(before)]:
                if fill + need <= 20:
                    after = before.copy()
                    after[fill] -= fill > 0
                    after[fill + need] += fill + need < 20
                    options.append((after[1:20] ** 2).sum())
            assert (packer.level[1:20] ** 2).sum() == min(options)


def test_capacity_tree():
    tree = CapacityTree(10)
    tree.add(7, 1)
    tree.add(3, 2)
    assert tree.take(4) == (7, 1) and tree.take(4) is None and tree.take(1) == (3, 2) and tree.take(0) is None


def test_overflow_closes_full_windows_only(spark):
    """Documents over half a window: open windows stay bounded, each that closes is full, and few documents are cut."""
    rng, size, out = random.Random(5), 4096, []
    packer = SumOfSquares(size, out.append, max_open=64)
    lengths = [rng.randrange(2100, 4000) for _ in range(1500)]
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype=np.uint32))
        assert packer.n_open <= 64 and packer.n_open == packer.level.sum() == sum(map(len, packer.windows))
    assert all(sum(len(p[2]) for p in w) == size for w in out)
    packer.close()
    fills = [sum(len(p[2]) for p in w) for w in out]
    assert all(f == size or f & (f - 1) == 0 for f in fills) and sum(f < size for f in fills) <= 12
    pieces = defaultdict(list)
    for w in out:
        for doc, start, ids in w:
            assert ids[0] == start
            pieces[doc].append((start, start + len(ids)))
    for k, n in enumerate(lengths):
        ends = sorted(pieces[k])
        assert ends[0][0] == 0 and ends[-1][1] == n and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert sum(len(x) - 1 for x in pieces.values()) <= len(out) + 12
