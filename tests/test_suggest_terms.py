"""Suggested terms count words without shuffling the lines they stand in."""

from __future__ import annotations

import random

from callspark.operators import voc


def _shuffled(spark, run) -> int:
    """Bytes that the stages of ``run`` wrote for shuffles."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def _brute(rows, known, stop):
    first = {}
    for call, text in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((text or "").split("\n")):
            for w in line.split():
                w = "".join(c for c in w if c.isalnum())
                if len(w) >= 2 and w not in known and w not in stop:
                    first.setdefault((w, call), (no, line))
    calls = {}
    for w, call in first:
        calls.setdefault(w, []).append(call)
    best = sorted((-len(c), w) for w, c in calls.items() if len(c) >= 2)[:8]
    return sorted((w, -n, [first[w, c][1].strip()[:60] for c in sorted(calls[w])[:2]]) for n, w in best)


def test_lines_are_not_shuffled(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(3000)]
    line = lambda: " ".join(rng.choice(words[: rng.choice((10, 3000))]) for _ in range(40))
    rows = [(k, "\n".join(line() for _ in range(rng.randrange(30)))) for k in range(300)] + [(400, None), (401, ""), (402, " word1, word2!\nword1")]
    df, known = spark.createDataFrame(rows, "call_id int, speech string"), spark.createDataFrame([("word3",), (None,)], "term string")
    found = []
    size = _shuffled(spark, lambda: found.extend(voc.suggest_terms(df, known, stopwords=("word4",), tail="가$").collect()))
    assert sorted((r.term, r.calls, r.examples) for r in found) == _brute(rows, {"word3"}, {"word4"})
    assert size < sum(len(t or "") for _, t in rows) / 5


def test_rows_of_one_call_count_once(spark):
    rows = [(1, "aa bb"), (1, "aa bb"), (2, "aa cc"), (3, "cc dd"), (3, "cc")]
    df, known = spark.createDataFrame(rows, "call_id int, speech string"), spark.createDataFrame([], "term string")
    assert sorted((r.term, r.calls) for r in voc.suggest_terms(df, known).collect()) == [("aa", 2), ("cc", 2)]
