"""Keys that lines share, against a count over all lines."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from callspark.functions.distance import _far
from callspark.llm import line_dedup
from callspark.llm.line_dedup import _SEQUENCES, _keys_of, _occurrences, shared_keys


def test_shared_keys_against_a_count(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    lines = [[rng.choice(vocab) for _ in range(rng.choice([8, 9, 15, 16, 40, 110, 140]))] for _ in range(60)]
    # many near copies of one line, and of a short one that repeats a word
    lines += [lines[0][:3] + [rng.choice(vocab)] + lines[0][4:] for _ in range(200)] + [["no"] * 9 + [rng.choice(vocab)] for _ in range(50)]
    docs = spark.createDataFrame([(k, k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text_hash long, text string")
    distinct = _occurrences(docs, 8).dropDuplicates(["h1"]).repartition(7).localCheckpoint()
    want = defaultdict(set)
    for batch in distinct.select("h1", *_SEQUENCES, "but_one").toArrow().to_batches():
        for key, line in zip(*(x.tolist() for x in _keys_of(batch))):
            want[key].add(line)
    want = {(key, line) for key, of in want.items() for line in of if len(of) > 1}
    got = [((r.key + (1 << 64)) % (1 << 64), r.id) for r in shared_keys(distinct, 1_000_000).collect()]
    assert sorted(got) == sorted(want) and len(want) > 1_000


def test_a_common_key_is_sent_once_by_a_batch(spark):
    lines = spark.range(5_000).select(F.col("id").alias("h1"), *(F.lit(1).cast("long").alias(s) for s in _SEQUENCES), F.lit(None).cast("array<long>").alias("but_one"))
    dealt = lines.repartition(5).mapInArrow(line_dedup._dealt_keys(24), "bucket int, keys binary, ids binary, marks binary")
    sent = dealt.where("bucket >= 0").select(F.sum(F.length("keys") / 8)).first()[0]
    assert sent == 5 * 32
    assert shared_keys(lines.repartition(5), 5_000).count() == 5_000 * 32


def test_far_lines_end_early():
    one, two = "abcdefgh" * 100, "ijklmnop" * 100
    assert _far(one, two) == 800 and 100 < _far(one, two, 100)
    assert [_far(one, one[:700] + two[:100], most) > most for most in (90, 99, 100, 101)] == [True, True, False, False]
