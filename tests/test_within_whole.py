"""Pairs over the budget of cells are measured all the same where a query asks for each."""

import random

from callspark.operators import verify
from callspark.plans import registry


def _long(rng, n, every):
    """Text with ``tion`` once in ``every`` characters, at both ends, too."""
    return "tion" + "".join("tion" if rng.random() < 1 / every else rng.choice("abcdefghjk") for _ in range(n)) + "tion"


def test_over_the_budget_is_measured(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij") for _ in range(6_600))
    spread = "".join("z" if k % 60 == 0 else c for k, c in enumerate(long))
    moved = "".join(c for k, c in enumerate(long) if k % 50) + "y" * 132
    rows = [("spread", long, spread), ("moved", long, moved), ("other", long, long[::-1]), ("empty", "", "x")]
    got = {r.k: (r.within, r.unverifiable, r.cer) for r in verify.cer_within(spark.createDataFrame(rows, "k string, reference string, hypothesis string"), 0.15, exact=True).collect()}
    assert got["spread"] == (True, True, 110 / 6_600) and got["moved"][:2] == (True, True) and got["other"] == (False, True, None) and got["empty"] == (None, None, None)
    kept = verify.preserve_gate(spark.createDataFrame([(long, spread), (long, long[::-1])], "original string, rewritten string"), exact=True).collect()
    assert [(r.ok, r.kept == spread, r.kept == long) for r in kept] == [(True, True, False), (False, False, True)]


def test_whole_texts_within(spark, tmp_path):
    rng = random.Random(3)
    spark.createDataFrame([(1, "en", _long(rng, 9_000, 200)), (2, "en", _long(rng, 9_000, 8)), (3, "en", "")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.unverifiable, r.within) for r in registry.queries()["e2_cer_within_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, True), 2: (True, False)}
