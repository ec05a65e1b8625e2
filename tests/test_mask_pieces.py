"""Masks of many texts in one Arrow batch: the same as one by one, few strings at a time."""

import pyarrow as pa

from callspark.functions import text as X


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(X, "_STRINGS", 3)
    texts = ["a 010-1234-5678", None, "가 4111 1111 1111 1111", "", "x.y@z.com 900101-1234567", "none", "010-1234-5678 ab@c.de"]
    for some in (texts, texts[:3], texts[:1], []):
        got = X._mask.func(pa.array(some, pa.string())).to_pylist()
        assert [(r["text"], dict(r["hits"]), r["total"]) for r in got] == [X._mask_one(t) for t in some]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    masked = X.mask_pii(rows, "t").orderBy("k").collect()
    assert [(r.masked.text, r.masked.hits, r.masked.total) for r in masked] == [X._mask_one(t) for t in texts]
    assert {r.type: r.n for r in X.pii_audit(X.mask_pii(rows, "t")).collect()} == {"phone": 2, "card": 1, "rrn": 1, "email": 2}
