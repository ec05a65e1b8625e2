"""Fuzzy line deduplication: lines are hashed and pairs verified with numpy on Arrow batches, all else is DataFrame operations.

Method. A line's words are its lower-cased runs of letters and digits (ASCII punctuation and blanks are breaks).
Equal word sequences are one line. A distinct line of ``fuzzy_words`` words and more has a sketch of 12 values: for each
third of its pairs of neighbouring words, and for each of four fixed numbers, the hash of a pair that is nearest to the
number (smallest exclusive or; of triples of words in long lines), so that two lines agree in a value with a probability of about the Jaccard similarity
of that third's pairs. Lines meet where they agree in one of 16 blocks of three values, one of each third (an orthogonal
array: any values of two thirds are in one block). A passage that many lines share seldom reaches over all thirds, and
doesn't bring them together by itself. Lines of fewer than 16 words, whose few pairs change with any word, also meet where
they are equal but for one word in either. Every pair that meets is verified by edit similarity (1 - edit distance /
longer length, of the words joined by blanks, at least ``similarity``), with no other gate; groups are closed by
``link_groups``, and the occurrence with the smallest (doc_id, text hash, line number) of each group stays. Bits of a
SimHash differ too often for this similarity: README has the figures of both. Missed may be similar lines that differ
in many words of one third.

Edit distances are exact for lines of any length. Where a walk over the words shows that the distance is small enough, or
the runs of three characters that both have that it isn't, nothing more is computed; for others ``edit_distance`` is, whose
memory grows with the length.

Cases: lines of fewer than ``min_words`` words are never removed; blank lines stay. A null text stays null. Rows
that repeat doc_id and text are one document: what is removed is removed in each. Null ids come before others.
Extra columns stay, whatever their names, but for ``n_lines`` and ``removed``, which are replaced. A document may
lose all its lines; its text is then empty. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callspark.functions.distance import edit_distance
from callspark.llm.components import link_groups
from callspark.llm.staging import Stage, packed
from callspark.llm.textbytes import ALNUM_WORDS, TextSlice, Words, mix, ragged_positions, slices, window_hash

MIN_WORDS = 3
FUZZY_WORDS = 8
SIMILARITY = 0.85
#: Lines of fewer words have keys without each of their words.
SHORT_WORDS = 16
#: Long lines have many pairs of words in common with any other: lines of so many words have keys of triples, fewer than that of pairs, between the two of both.
LONG_WORDS = (108, 128)
_THIRDS, _EACH = 3, 4
_BLOCKS = [(a, _EACH + b, 2 * _EACH + (a ^ b)) for a in range(_EACH) for b in range(_EACH)]
# spread over the range, so that a pair is seldom nearest to two of them
_RNG = random.Random(20240229)
_NEAR = [(2 * k + 1) * (1 << 63) // _EACH + _RNG.getrandbits(56) - (1 << 63) for k in range(_EACH)]
_SKETCHES = [[f"{of}{k}" for k in range(_THIRDS * _EACH // 2)] for of in "st"]
_SEQUENCES = [s for sketch in _SKETCHES for s in sketch]
_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Lines whose keys one bucket takes its part of, about (16 keys of 17 bytes a line), and buckets at least.
_LINES_A_BUCKET, _LEAST_BUCKETS = 60_000, 24
#: Characters from which counting runs of three is far cheaper than a distance.
_GRAMS_FROM = 1_000
#: Pairs of lines that one task verifies, about.
_PAIRS_A_TASK = 2_000
# an odd number and its inverse among numbers of 64 bits
_ODD = 0x9E3779B97F4A7C15
_POWERS, _BACK = np.array([pow(_ODD, k, 1 << 64) for k in range(SHORT_WORDS)], dtype=np.uint64), np.uint64(pow(_ODD, -1, 1 << 64))


def line_words(line: Column) -> Column:
    """Words of a normalised line; blank lines have none."""
    return F.array_remove(F.split(F.lower(line), _BREAKS), "")


def _far(one: str, two: str, similarity: float) -> int:
    """The edit distance up to which two lines are similar."""
    return math.floor((1 - similarity) * max(len(one), len(two)) + 1e-9)


def _walk(one: list[str], two: list[str], far: int) -> bool:
    """Whether a walk over both lines' words shows that they are similar.

    Where words differ it replaces one, or inserts or drops up to eight to where the lines agree again: one way of
    editing, which never costs less than the distance.
    """
    at = cost = 0
    for k, here in enumerate(one):
        if at < len(two) and two[at] == here:
            at += 1
            continue
        if cost > far:
            return False
        if at >= len(two):
            cost += len(here) + 1
            continue
        there = two[at]
        if k + 1 < len(one) and at + 1 < len(two) and one[k + 1] == two[at + 1]:
            at, cost = at + 1, cost + max(len(here), len(there))
            continue
        next_two, next_one = two[at + 1 : at + 9], one[k + 1 : k + 9]
        ahead = next_two.index(here) + 1 if here in next_two else 0
        back = next_one.index(there) + 1 if there in next_one else 0
        if ahead and (not back or ahead <= back):
            cost += sum(len(w) + 1 for w in two[at : at + ahead])
            at += ahead + 1
        elif back:
            cost += len(here) + 1
        else:
            at, cost = at + 1, cost + max(len(here), len(there))
    return cost + sum(len(w) + 1 for w in two[at:]) <= far


def _share_enough(one: str, two: str, far: int) -> bool:
    """Whether ``far`` edits can lead from one line to the other: an edit changes at most three of its runs of three characters."""
    need = max(len(one), len(two)) - 2 - 3 * far
    if need <= 0 or min(len(one), len(two)) < _GRAMS_FROM:
        return True
    grams = []
    for line in (one, two):
        c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        grams.append(np.unique(c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42), return_counts=True))
    _, here, there = np.intersect1d(grams[0][0], grams[1][0], assume_unique=True, return_indices=True)
    return int(np.minimum(grams[0][1][here], grams[1][1][there]).sum()) >= need


def _similar(one: str, two: str, similarity: float) -> bool:
    far = _far(one, two, similarity)
    if one == two or abs(len(one) - len(two)) > far:
        return one == two
    return _walk(one.split(" "), two.split(" "), far) or _share_enough(one, two, far) and edit_distance(one, two, far) >= 0


def edit_similar(one: str, two: str, similarity: float) -> Column:
    """Whether 1 - edit distance / longer length >= ``similarity``, of words joined by blanks."""

    @F.pandas_udf("boolean")
    def near(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_similar(a or "", b or "", similarity) for a, b in zip(left, right)], dtype=bool)

    return near(one, two)


def _similar_pairs(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of a, b, line_a, line_b: a and b of the pairs that are similar."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [_similar(one, two, similarity) for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return confirmed


def _line_starts(piece: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line begins (and where the last one ends), its row and its number there."""
    feeds = np.flatnonzero(piece.data == 10)
    counts = np.diff(np.searchsorted(feeds, piece.offsets)) + 1
    first = np.cumsum(counts) - counts
    begins = np.empty(int(counts.sum()) + 1, dtype=np.int64)
    inner = np.ones(len(begins), dtype=bool)
    inner[first], inner[-1] = False, False
    begins[first], begins[inner], begins[-1] = piece.offsets[:-1], feeds + 1, len(piece.data)
    number, row = ragged_positions(np.zeros(len(counts), dtype=np.int64), counts)
    return begins, row, number


def _normal(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The lines' words joined by blanks: bytes, and where each line's begin."""
    data, of = words.piece.data.copy(), ALNUM_WORDS[words.piece.data]
    later = np.ones(len(words.starts), dtype=bool)
    later[words.offsets[:-1][words.counts > 0]] = False
    blanks = words.starts[later] - 1
    data[blanks], of[blanks] = 32, True
    at = np.flatnonzero(of)
    return data[at], np.searchsorted(at, words.piece.offsets)


def _sketch(words: Words, hashes: np.ndarray, lines: np.ndarray, size: int) -> np.ndarray:
    """For each of ``lines``: its values of runs of ``size`` words, two of 32 bits to a number."""
    n = words.counts[lines] - (size - 1)
    first, _ = ragged_positions(words.offsets[lines], n)
    if not len(first):
        return np.zeros((0, _THIRDS * _EACH // 2), dtype=np.uint64)
    runs = window_hash(hashes, first, size)
    cuts = ((np.cumsum(n) - n)[:, None] + np.arange(_THIRDS) * n[:, None] // _THIRDS).ravel()
    nearest = np.stack([np.minimum.reduceat(runs ^ np.uint64(x % (1 << 64)), cuts) for x in _NEAR], axis=1)
    values = (nearest & np.uint64(0xFFFFFFFF)).reshape(len(lines), _THIRDS * _EACH // 2, 2)
    return values[:, :, 0] | values[:, :, 1] << np.uint64(32)


def _but_one(words: Words, hashes: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each of ``lines`` without each of its words, then of the whole line; and how many these are."""
    n = words.counts[lines]
    at, line = ragged_positions(words.offsets[lines], n)
    begins = np.cumsum(n) - n
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes[at] * _POWERS[at - words.offsets[lines][line]])])
    left, line = ragged_positions(begins, n + 1)
    end = (begins + n)[line]
    # words behind the one that is left out move up by a place
    total = sums[left] - sums[begins[line]] + (sums[end] - sums[np.minimum(left + 1, end)]) * _BACK
    size = n[line] - (left < end)
    return mix(total + size.astype(np.uint64) * _POWERS[1]), n + 1


def _line_rows(fuzzy_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of doc_id, text_hash and the lower-cased text: the rows of ``_occurrences``."""
    least, most = LONG_WORDS

    def placed(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
        full, none = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        full[of], none[of] = values.view(np.int64), False
        return pa.array(full, mask=none)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(2)):
                begins, row, number = _line_starts(piece)
                words = Words(TextSlice(0, len(row), piece.data, begins), ALNUM_WORDS)
                kept = np.flatnonzero(words.counts >= MIN_WORDS)
                n = words.counts[kept]
                normal, ends = _normal(words)
                chars = ends - np.searchsorted(np.flatnonzero((normal & 0xC0) == 0x80), ends)
                view = memoryview(normal)
                digests = b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in zip(ends[kept].tolist(), ends[kept + 1].tolist()))
                both = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                hashes = words.hashes(False)
                columns = []
                # a third of fewer than three pairs may be empty
                for size, of in ((2, (n >= max(fuzzy_words, 4)) & (n < most)), (3, n >= max(least, fuzzy_words))):
                    at = np.flatnonzero(of)
                    sketch = _sketch(words, hashes, kept[at], size)
                    columns += [placed(np.ascontiguousarray(sketch[:, k]), at, len(kept)) for k in range(sketch.shape[1])]
                short = (n >= fuzzy_words) & (n < SHORT_WORDS)
                keys, counts = _but_one(words, hashes, kept[short])
                sizes = np.zeros(len(kept), dtype=np.int64)
                sizes[short] = counts
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                but_one = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)), mask=pa.array(~short))
                where = pa.array(piece.first + row[kept])
                ints = (number[kept], n, chars[kept + 1] - chars[kept])
                line_no, size, length = (pa.array(x.astype(np.int32)) for x in ints)
                hashed = [pa.array(np.ascontiguousarray(both[:, k])) for k in range(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), line_no, size, *hashed, length, *columns, but_one], names=_OCCURRENCE.names)

    return rows


_OCCURRENCE = T.StructType().add("doc_id", "long").add("text_hash", "long").add("line_no", "integer").add("n", "integer").add("h1", "long").add("h2", "long").add("chars", "integer")
for _name in _SEQUENCES:
    _OCCURRENCE = _OCCURRENCE.add(_name, "long")
_OCCURRENCE = _OCCURRENCE.add("but_one", T.ArrayType(T.LongType()))


def _occurrences(text: DataFrame, fuzzy_words: int) -> DataFrame:
    """A row per line of ``MIN_WORDS`` words and more: where it is, two hashes of its words, their number and length, its sketch, two values of 32 bits to a long, and hashes without each word."""
    return text.select("doc_id", "text_hash", F.lower("text").alias("text")).mapInArrow(_line_rows(fuzzy_words), _OCCURRENCE)


def _keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) of a batch of lines: a key for each block of sketch values, and those without one word."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    ids, keys, of = column("h1").to_numpy(zero_copy_only=False), [], []
    but_one = column("but_one")
    counts = pc.fill_null(pc.list_value_length(but_one), 0).to_numpy(zero_copy_only=False)
    keys.append(pc.list_flatten(but_one).to_numpy(zero_copy_only=False).view(np.uint64))
    of.append(np.repeat(ids, counts))
    for k, sketch in enumerate(_SKETCHES):
        at = np.flatnonzero(column(sketch[0]).is_valid().to_numpy(zero_copy_only=False))
        both = [pc.fill_null(column(s), 0).to_numpy(zero_copy_only=False)[at].view(np.uint64) for s in sketch]
        values = [x for pair in both for x in (pair & np.uint64(0xFFFFFFFF), pair >> np.uint64(32))]
        for i, (x, y, z) in enumerate(_BLOCKS):
            keys.append(mix(mix(values[x] << np.uint64(32) | values[y]) + (values[z] | np.uint64(1 + len(_BLOCKS) * k + i) << np.uint64(32))))
            of.append(ids[at])
    return np.concatenate(keys), np.concatenate(of)


def _dealt_keys(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of lines: packed (key, id) by ranges of keys, those that a batch has once; what it has more often under bucket -1, with a mark in the key's bucket."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = _keys_of(batch)
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            # a line's repeated key stands beside itself
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys, ids = keys[new], ids[new]
            first, many = _shared(keys)
            mark = first & many
            out = [(-1, keys[many], ids[many], mark[many])] if many.any() else []
            keys, ids, mark = keys[first], ids[first], mark[first]
            of = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(buckets + 1))
            out += [(k, keys[x], ids[x], mark[x]) for k in range(buckets) if len(x := order[ends[k] : ends[k + 1]])]
            packed = [[x[j].tobytes() for x in out] for j in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["bucket", "keys", "ids", "marks"])

    return dealt


def _shared(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: which stand first among their equals, and which have equals."""
    first = np.ones(len(keys) + 1, dtype=bool)
    first[1:-1] = keys[1:] != keys[:-1]
    return first[:-1], ~(first[:-1] & first[1:])


def _met_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed keys, sorted by bucket: (key, id) of those that lines of several batches, or of one, share."""

    def members(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], names=["key", "id"])

    def met(parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        keys, ids, marks = (np.concatenate([np.frombuffer(x[j], dtype=kind) for x in parts]) for j, kind in enumerate((np.uint64, np.int64, bool)))
        order = np.argsort(keys, kind="stable")
        keys, ids, marks = keys[order], ids[order], marks[order]
        # what is marked has been sent on by its batch
        of = _shared(keys)[1] & ~marks
        return members(keys[of], ids[of])

    held, at = [], None
    for batch in batches:
        for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket < 0:
                yield members(np.frombuffer(packed[0], dtype=np.uint64), np.frombuffer(packed[1], dtype=np.int64))
                continue
            if bucket != at and held:
                yield met(held)
                held = []
            at = bucket
            held.append(packed)
    if held:
        yield met(held)


def shared_keys(lines: DataFrame, count: int) -> DataFrame:
    """(key, id): the keys that several of ``lines`` (``count``, about) have, each line's once.

    A batch sends each key to its bucket once, however many lines share it there, so that a very common key fills no task.
    """
    buckets = max(_LEAST_BUCKETS, count // _LINES_A_BUCKET)
    dealt = lines.select("h1", *_SEQUENCES, "but_one").mapInArrow(_dealt_keys(buckets), "bucket int, keys binary, ids binary, marks binary")
    # what is sent on lies anywhere
    to = F.when(F.col("bucket") < 0, F.xxhash64("keys")).otherwise(F.col("bucket"))
    return dealt.repartition(buckets, to).sortWithinPartitions("bucket").mapInArrow(_met_keys, "key long, id long")


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, fuzzy_words: int = FUZZY_WORDS, stage: Stage | None = None) -> DataFrame:
    """(doc_id, text_hash, line_no) of the lines to remove from ``docs``, each once or more."""
    stage = stage or Stage(docs.sparkSession, "lines")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    found = stage.write(_occurrences(text, max(fuzzy_words, MIN_WORDS)), "occurrences")
    place = F.struct("doc_id", "text_hash", "line_no")
    lines = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.max("chars").alias("chars"), *(F.max(s).alias(s) for s in _SEQUENCES), F.first("but_one").alias("but_one"))
    lines = stage.write(lines.select("h1", "h2", "first.*", "times", "chars", *_SEQUENCES, "but_one"), "lines")
    fuzzy = lines.where(F.coalesce(*(sketch[0] for sketch in _SKETCHES)).isNotNull())
    members = stage.write(shared_keys(fuzzy, stage.rows(lines)), "shared")
    possible = f"abs(chars_{{0}} - chars_{{1}}) <= floor({1 - similarity} * greatest(chars_{{0}}, chars_{{1}}) + 1e-9)"

    def confirm(pairs: DataFrame) -> DataFrame:
        one, two = (stage.side(lines, fuzzy.select(F.col("h1").alias(k), F.col("chars").alias(f"chars_{k}"))) for k in "ab")
        near = stage.write(pairs.join(one, "a").join(two, "b").where(possible.format("a", "b")).select("a", "b"), "near")
        needed = near.select(F.col("a").alias("h1")).union(near.select("b")).distinct()
        needed = needed.join(stage.side(lines, fuzzy.select("h1", "doc_id", "text_hash", "line_no")), "h1")
        needed = stage.write(needed.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("h1", "line_no")).alias("at")), "needed")
        asked = needed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "at")
        of = text.join(stage.side(needed, asked), text.doc_id.eqNullSafe(F.col("_id")) & (text.text_hash == F.col("_hash")))
        # split once for each document
        said = F.transform(F.array(F.split("text", "\n")), lambda s: F.transform("at", lambda x: F.struct(x["h1"].alias("h1"), s[x["line_no"]].alias("line"))))[0]
        of = of.select(F.explode(said).alias("it")).select("it.h1", F.array_join(line_words(F.col("it.line")), " ").alias("line"))
        of = stage.write(of.groupBy("h1").agg(F.min("line").alias("line")), "texts")
        one, two = (of.select(F.col("h1").alias(k), F.col("line").alias(f"line_{k}")).hint("merge") for k in "ab")
        both = near.join(one, "a").join(two, "b").select("a", "b", "line_a", "line_b")
        # few rows, each of which may take long
        both = both.repartition(1 + stage.rows(near) // _PAIRS_A_TASK, "a", "b")
        return both.mapInArrow(_similar_pairs(similarity), "a long, b long")

    def bound(unsettled: DataFrame) -> tuple[DataFrame, str]:
        facts = unsettled.select("lead", "id").distinct().join(stage.side(lines, fuzzy.select(F.col("h1").alias("id"), "chars")), "id")
        return facts, possible.format("x", "y")

    parts = link_groups(stage, members, confirm, bound)
    where = ["doc_id", "text_hash", "line_no"]
    if parts is None:
        again = lines.where("times > 1").withColumn("component", F.xxhash64("h1", "h2"))
    else:
        part = parts.select(F.col("id").alias("h1"), "component")
        again = lines.join(stage.side(parts, part), "h1", "left").where("times > 1 or component is not null")
        # a line in no group is a group of its own, told apart by both hashes
        again = again.withColumn("component", F.coalesce("component", F.xxhash64("h1", "h2")))
    again = stage.write(again.select("h1", "h2", F.struct(*where).alias("first"), "component"), "again")
    kept = stage.write(again.groupBy("component").agg(F.min("first").alias("kept")), "kept")
    again = stage.write(again.join(stage.side(kept), "component").select("h1", "h2", "kept"), "kept-of")
    return found.select(*where, "h1", "h2").join(stage.side(again), ["h1", "h2"]).where(place != F.col("kept")).select(*where)


def _cleaned(docs: DataFrame, similarity: float, fuzzy_words: int) -> DataFrame:
    """(row, text, n_lines, removed): packed rows, their new texts, and what was removed."""
    stage = Stage(docs.sparkSession, "lines")
    gone = repeated_lines(docs, similarity, fuzzy_words, stage).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    gone = stage.write(gone, "gone")
    stage.drop(*(table for table, *_ in list(stage.paths.values()) if table is not gone))
    rows = packed(docs).join(stage.side(gone), F.col("at_id").eqNullSafe(F.col("doc_id")) & (F.col("at_hash") == F.col("text_hash")), "left")
    kept = lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), "gone"), lambda i: s[i])
    # an array of one, so that a text is split once and not once a line
    left = F.transform(F.array(F.split("text", "\n")), lambda s: F.array_join(kept(s), "\n"))[0]
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    return rows.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), n_lines.alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """``docs`` with new texts, and the columns ``n_lines``, ``removed`` (line numbers from 0, ascending)."""
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "removed")]
    return _cleaned(docs, similarity, fuzzy_words).select(*others, "text", "n_lines", "removed")


def clean_lines(docs: DataFrame, length: str = "n_chars", similarity: float = SIMILARITY, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """``docs`` with new texts; the column ``length``, if there is one, follows the texts that changed. No other column changes."""
    rows, kinds = _cleaned(docs, similarity, fuzzy_words), dict(docs.dtypes)
    new = {"text": F.col("text").cast(kinds["text"])}
    if length in kinds:
        new[length] = F.when(F.size("removed") > 0, F.length("text").cast(kinds[length])).otherwise(F.col(f"row.`{length}`"))
    return rows.select(F.struct(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns)).alias("row")).select("row.*")
