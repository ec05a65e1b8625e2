"""Similar lines against a brute force whose only condition is the edit similarity."""

import random

from callspark.llm.line_dedup import SIMILARITY, drop_repeated_lines, edit_similar
from tests.llm.test_line_dedup import _levenshtein


def test_changed_words_are_found_at_the_stated_similarity(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    lines = [[rng.choice(vocab) for _ in range(rng.choice([8, 12, 20, 40]))] for _ in range(40)]
    for line in list(lines):
        near = list(line)
        for _ in range(max(1, len(near) // 12)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        lines.append(near)
    texts = [" ".join(x) for x in lines]
    similar = [_levenshtein(texts[k], texts[40 + k]) <= (1 - SIMILARITY) * max(len(texts[k]), len(texts[40 + k])) for k in range(40)]
    out = drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = {r.doc_id for r in out if r.removed}
    assert SIMILARITY == 0.85 and sum(similar) >= 30
    assert gone <= {40 + k for k in range(40) if similar[k]}
    assert len(gone) >= 0.95 * sum(similar)


def test_lines_of_eight_short_words_take_part(spark):
    rows = [(1, "we go on up to it as is the day is at an end"), (2, "we go on up to it as is the day is at an eve")]
    out = {r.doc_id: r.removed for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [], 2: [0]}


def test_long_lines_with_an_insertion_near_the_start(spark):
    rng = random.Random(6)
    one = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    two = one[:50] + "".join(rng.choice("klmnopqrst") for _ in range(600)) + one[50:]
    row = spark.createDataFrame([(one, two)], "a string, b string").select(edit_similar("a", "b", 0.9).alias("near"), edit_similar("a", "b", 0.99).alias("same")).first()
    assert row.near and not row.same
