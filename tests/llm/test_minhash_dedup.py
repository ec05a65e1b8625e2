import random

from callspark.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from tests.llm import brute


def _corpus():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 80, 200]))]
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(words)
            for _ in range(rng.choice([0, 1, 2, len(words) // 20])):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            docs.append("\n".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    # a chain: each differs from the next by one word, the ends are not similar
    chain = [rng.choice(vocab) for _ in range(60)]
    for _ in range(12):
        chain = chain[1:] + [rng.choice(vocab)]
        chain = chain[2:] + [rng.choice(vocab), rng.choice(vocab)]
        docs.append(" ".join(chain))
    docs += ["", None, "   \n\t", "one", "ONE", "é è", "É è", " ", "x" * 50_000]
    return list(enumerate(docs))


def test_against_brute_force(spark):
    docs = _corpus()
    want = brute.near_duplicates(docs)
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == want and len(rows) == len(docs)


def test_one_large_group_of_near_copies(spark):
    """Copies with zero to eight edits: many are linked only to the least edited ones."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for k in range(250):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(9)):
            words[at] = f"e{k}_{at}"
        docs.append((k, " ".join(words)))
    want = brute.near_duplicates(docs)
    assert 1 < len({c for _, c, _ in want.values()}) < 200
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == want


def test_edge_rows(spark):
    rows = [(None, "a b c"), (None, None), (7, "a b c"), (7, "a b c"), (7, "other words here now and then"), (None, "alone in here")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, component string")
    got = sorted([tuple(r)[:4] for r in near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, 1, 7, False), (None, 0, None, True), (7, 1, 7, True), (7, 1, 7, True), (7, 2, 7, True), (None, 1, None, True)], key=str)
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted([(None, None), (7, "a b c"), (7, "other words here now and then"), (None, "alone in here")], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and drop_near_duplicates(df).count() == 0
