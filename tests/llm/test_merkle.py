import hashlib
import random
import zlib

from pyspark.sql import functions as F

from callspark.llm.merkle import Subtree, dataset_manifest
from callspark.llm.ordering import numbered
from callspark.llm.staging import Stage
from tests.llm import brute

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def _docs(n, sources, seed=1):
    rng = random.Random(seed)
    out = [(k, None if k % 17 == 0 else f"s{min(rng.randrange(3 * sources), sources)}", rng.choice(["en", None, "é"]), rng.choice([None, k]), rng.choice([None, "", "a\nb", f"text\n{k}", "né " * 5])) for k in range(n)]
    rng.shuffle(out)
    return out


def _compare(spark, docs, **options):
    got = sorted(tuple(r) for r in dataset_manifest(spark.createDataFrame(docs, SCHEMA), _tampered(), **options).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == sorted(brute.manifest(docs))


def test_against_brute_force(spark):
    for n, sources in ((1, 1), (4, 1), (90, 40)):
        _compare(spark, _docs(n, sources, n))
    # several tiers of blocks, for sources and for the root
    for n, sources in ((40, 1), (70, 12)):
        _compare(spark, _docs(n, sources, n), levels=1)


def test_subtree_resumes_states():
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 9, 10, 28, 80):
        digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
        tree = Subtree(digests)
        for k in rng.sample(range(n), min(n, 9)):
            other = [*digests]
            other[k] = hashlib.sha256(b"other").hexdigest()
            assert tree.fold(k, digests[k]) == tree.top and tree.fold(k, other[k]) == Subtree(other).top
            lower = Subtree(digests, 7).top
            assert len(Subtree(digests, 7).levels) == 8 and Subtree(digests, 7).fold(k, digests[k]) == lower


def test_positions_within_a_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None, "b", "c", "zz"]), k) for k in range(3000)]
    got = numbered(Stage(spark, "test"), spark.createDataFrame(rows, "key string, v long"), ["v"], "x").collect()
    by = {}
    for key, v in rows:
        by.setdefault(key, []).append(v)
    assert len(got) == len(rows)
    assert {(r.key, r.v): r["at"] for r in got} == {(key, v): k for key, vs in by.items() for k, v in enumerate(sorted(vs))}


def test_odd_rows(spark):
    row = (5, "s", "en", 1, "same")
    odd = spark.createDataFrame([(*row, "x", 1), (*row, "y", 2), (None, "s", None, None, None, "z", 3), (7, None, "en", 1, "a\n" * 30_000, "w", 4)], SCHEMA + ", key string, `at` int")
    got = dataset_manifest(odd, _tampered()).collect()
    assert len(got) == 4 and len({r.root for r in got}) == 1 and len({r.leaf for r in got if r.doc_id == 5}) == 1
    tampered = zlib.crc32(b"7") % 2 == 0
    assert [r.verified for r in got if r.doc_id == 7] == [not tampered] and all(r.verified for r in got if r.doc_id != 7)
    assert dataset_manifest(odd.limit(0), _tampered()).count() == 0
    assert all(r.verified for r in dataset_manifest(odd).collect())
