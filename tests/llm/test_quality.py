import random

import numpy as np
from pyspark.sql import functions as F

from callspark.llm.quality import fit, judge_quality, keep_good
from tests.llm import brute


def _case():
    rng = random.Random(9)
    vocab = ["the", "of", "é", "año", "#x", "a|b", "word", "Tion", "re", "<b>"] + [f"v{k}" for k in range(60)]
    docs = []
    for k in range(300):
        lines = [rng.choice([" ", "\t", "  "]).join(rng.choice(vocab) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 6))]
        lines += rng.sample(lines, rng.randrange(len(lines) + 1))
        text = "\n".join(lines)
        docs.append((k, text if k % 3 else text.upper().replace(" ", "!! ")))
    docs += [(1000, None), (1001, ""), (1002, "\n\n \n"), (1003, "a b c d e " * 4000), (1004, "\r\nx\r\nx\nx")]
    return docs


def test_rules_against_brute_force_and_model_on_held_out(spark):
    docs = _case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300) if k % 2] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = judge_quality(df, labels).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    right = total = 0
    for r in rows:
        want = brute.quality_numbers(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
        if r.doc_id < 300 and r.doc_id % 2 == 0 and not r.base_failed:
            right, total = right + (r.kept == (r.doc_id % 3 != 0)), total + 1
    assert right >= 0.95 * total > 20
    assert {r.doc_id for r in keep_good(df, labels).collect()} == {r.doc_id for r in rows if r.kept}


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(None, "one two three four five six seven eight nine ten", 1)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    row = judge_quality(df, labels).first()
    assert row.p_good is None and row.kept and row.doc_id is None
    assert keep_good(df, labels).first() == df.first() and judge_quality(df.limit(0), labels).count() == 0


def test_repeated_ids_count_once(spark):
    docs = _case()[:300]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(300)], "doc_id long, quality int")
    copies = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.lit(docs[3][1]).alias("text"))
    once, often = fit(df, labels), fit(df.union(copies), labels.union(labels))
    assert np.array_equal(once.weights, often.weights) and (once.slope, once.shift) == (often.slope, often.shift)
