import hashlib
import random

from callspark.llm.decontaminate import contamination_report, drop_contaminated
from tests.llm import brute


def _case():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(30)] + ["é", "l'été", "42"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([3, 7, 9, 10, 11, 25, 40]))) for k in range(40)] + [(100, None), (101, "..."), (102, "Single")]
    items.append((7, items[20][1]))
    docs = []
    for k in range(150):
        text = say(rng.randrange(60))
        if rng.random() < 0.6:
            words = brute.alnum_words(rng.choice(items)[1])
            a = rng.randrange(len(words) + 1)
            text = f"{text}\n{'-- '.join(words[a : a + rng.randrange(25)]).upper()}, {say(rng.randrange(20))}"
        docs.append((k, text))
    docs += [(150, None), (151, ""), (152, "!!!"), (153, "single"), (154, (say(30) + " ") * 2000)]
    return docs, items


def _want(docs, items):
    out = {}
    for i, text in docs:
        n, hit, found = brute.contamination(text, items)
        out[i] = (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
    return out


def test_against_brute_force(spark):
    docs, items = _case()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for blocks in (10**9, 400):
        got = {r.doc_id: tuple(r)[1:] for r in contamination_report(df, bench, block_chars=blocks).collect()}
        assert got == _want(docs, items)
    left = {r.doc_id for r in drop_contaminated(df, bench).collect()}
    assert left == {i for i, x in _want(docs, items).items() if not x[4]}


def test_edge_rows(spark):
    long = " ".join(f"v{k}" for k in range(12))
    df = spark.createDataFrame([(None, long, 1), (5, long, 2), (5, "clean", 3), (5, long, 2)], "doc_id long, text string, runs int")
    bench = spark.createDataFrame([(None, long)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in contamination_report(df, bench).collect()) == [("5", 0, 0), ("5", 12, 0), ("5", 12, 0), ("None", 12, 0)]
    assert [tuple(r) for r in drop_contaminated(df, bench).collect()] == [(5, "clean", 3)]
    assert contamination_report(df, bench.limit(0)).where("contaminated").count() == 0
    assert contamination_report(df.limit(0), bench).count() == 0
