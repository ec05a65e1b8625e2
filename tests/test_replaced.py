"""Texts that differ by replaced characters only are settled in one pass, and texts are cleaned once before they are compared."""

import random
import time

from callspark.functions.distance import edit_distance, replaced
from callspark.operators import verify
from callspark.plans import registry


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_replaced_against_the_table():
    rng, settled = random.Random(8), 0
    for _ in range(3000):
        one = [rng.choice("abcé😀") for _ in range(rng.randrange(1, 12))]
        two = [rng.choice("abxy한") if rng.random() < 0.4 else c for c in one]
        a, b = "".join(one), "".join(two)
        found = replaced(a, b)
        settled += found is not None and found > 0
        assert found in (None, _table(a, b)) and edit_distance(a, b) == _table(a, b)
    assert settled > 300
    assert replaced("ab", "ba") is None and replaced("abc", "ab") is None and replaced("tion", "shun") == 3 and replaced("aa", "aa") == 0


def test_far_texts_by_replacement_are_fast():
    one = "abtioncdefghij" * 20_000
    began = time.process_time()
    assert edit_distance(one, one.replace("tion", "shun")) == 60_000 and edit_distance(one, one.replace("tion", "shun"), 59_999) == -1
    assert time.process_time() - began < 2


def test_texts_are_cleaned_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "the station"), (2, "ko", "가가 nation")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = verify.cer(registry._cer_whole(spark, str(tmp_path)))
    assert rows._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") == 2
    assert sorted((r.distance, r.ref_length) for r in rows.collect()) == [(3, 8), (3, 10)]
