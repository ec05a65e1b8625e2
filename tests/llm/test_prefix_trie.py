import random

import numpy as np

from callspark.llm.prefix_trie import SortedTrie, conversation_trie, prefix_trie
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def _turns(n, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        system = [("system", "a shared opening")] if rng.random() < 0.7 else []
        said = system + [(rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "é", None])) for _ in range(rng.randrange(1, 6))]
        out += [(c, k if k else None, *t) for k, t in enumerate(said)]
    for c in range(n, n + 30):  # copies of one conversation
        out += [(5 * c, k, "user", "copy") for k in range(4)]
    rng.shuffle(out)
    return out


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    for seed, size in ((1, 50_000), (2, 60)):  # without and with heavy prefixes below the root
        turns = _turns(220, seed)
        got = _got(conversation_trie(spark.createDataFrame(turns, SCHEMA), bin_size=size))
        assert got == sorted(brute.prefix_trie(brute.rebuilt(turns)), key=str)


def test_heavy_prefixes_in_rounds(spark):
    rng = random.Random(4)
    convs = {k: [("u", rng.choice("abc")) for _ in range(rng.randrange(9))] for k in range(900)}
    key = lambda t: brute.turn_key(*t)
    rows = [(c, b"".join(map(key, turns)), [len(t[1]) for t in turns]) for c, turns in convs.items()]
    got = _got(prefix_trie(spark.createDataFrame(rows, "conv_id long, seq binary, sizes array<long>")))
    assert got == sorted(brute.prefix_trie(convs), key=str)


def test_extents_by_range_minimum():
    rng = random.Random(9)
    for n in (1, 2, 3, 17, 64, 200):
        seqs = sorted({b"".join(bytes([rng.randrange(2)] * 16) for _ in range(rng.randrange(1, 9))) for _ in range(n)})
        trie, n = SortedTrie(seqs), len(seqs)
        for i in range(n):
            for d in range(1, len(seqs[i]) // 16 + 1):
                have = [k for k in range(n) if seqs[k][: 16 * d] == seqs[i][: 16 * d]]
                at, depth = np.array([i]), np.array([d])
                assert (trie.left(at, depth)[0], trie.right(at, depth)[0]) == (have[0], have[-1])
        values = np.array([rng.randrange(50) for _ in range(n)])
        for _ in range(20):
            a, b = sorted((rng.randrange(n), rng.randrange(n)))
            assert SortedTrie.smallest(values, np.array([a]), np.array([b]))[0] == values[a : b + 1].min()


def test_odd_rows(spark):
    rows = [(None, 1, "user", "nobody's", 1, "x"), (0, None, None, None, 2, "y"), (0, 2, "user", "long " * 20_000, 3, "z"), (0, 2, "user", "long " * 20_000, 3, "z"), (3, 1, "b", "tie", 4, ""), (3, 1, "a", "tie", 5, ""), (-7, 1, "u", "t", 6, "")]
    odd = spark.createDataFrame(rows, SCHEMA + ", at int, seq string")
    want = brute.prefix_trie(brute.rebuilt([r[:4] for r in rows if r[0] is not None]))
    assert _got(conversation_trie(odd)) == sorted(want, key=str)
    assert conversation_trie(odd.limit(0)).count() == 0
    assert conversation_trie(odd.where("conv_id IS NULL")).count() == 0
