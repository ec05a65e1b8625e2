"""Edit distances of long and short texts against the whole table, and how long close texts may take."""

import random
import time

from callspark.functions.distance import _far, _near, edit_distance
from callspark.operators import verify


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_against_the_table():
    rng = random.Random(3)
    for k in range(4000):
        signs = rng.choice(("ab", "abcé한", "abcdefgh "))
        a = "".join(rng.choice(signs) for _ in range(rng.choice((3, 8, 30, 60))))
        b = "".join(rng.choice(("", c, c, c, c, rng.choice(signs), c + "x")) for c in a) if k % 3 else "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        want = _table(a, b)
        assert edit_distance(a, b) == want and (not a or not b or _far(a, b) == want), (a, b)
        for most in (want - 1, want, want + 2, 200):
            if most >= 0:
                assert edit_distance(a, b, most) == (want if want <= most else -1), (a, b, most)
                if a and b:
                    assert _near(a, b, most) == (want if want <= most else None), (a, b, most)


def test_repeated_pieces_and_nothing():
    assert edit_distance("", "") == 0 and edit_distance("", "abc") == 3 and edit_distance("abc", "abc") == 0
    one = "abtioncdefghij" * 900
    assert edit_distance(one, one.replace("tion", "shun")) == 2700
    assert edit_distance("a" * 3000, "b" * 2000) == 3000


def test_long_pairs_in_a_table(spark):
    rng = random.Random(6)
    one = "".join(rng.choice("abcdé") for _ in range(2500))
    rows = [(1, one, one[:900] + "xyz" + one[910:]), (2, one, one[::-1]), (3, one, ""), (4, "", one), (5, one, None), (6, one[:60], one[3:70]), (7, one, one)]
    got = {r.k: r.distance for r in verify.cer(spark.createDataFrame(rows, "k int, reference string, hypothesis string")).collect()}
    assert got == {k: _table(a, b or "") if a else None for k, a, b in rows}


def test_close_long_texts_are_fast():
    rng = random.Random(5)
    one = "".join(rng.choice("abcdefghijklmnop") for _ in range(120_000))
    two = "".join("xyz" if rng.random() < 0.01 else c for c in one)
    began = time.process_time()
    assert 0 < edit_distance(one, two) < 4000
    assert time.process_time() - began < 10
