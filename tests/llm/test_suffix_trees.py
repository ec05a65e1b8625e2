import random

from callspark.llm.suffix_trees import drop_repeated_passages, repeated_passages
from tests.llm import brute


def _docs():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(60)] + ["é,", "l'été", "42"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [say(rng.choice([12, 13, 14, 30, 70])) for _ in range(12)]
    docs = []
    for k in range(160):
        words = say(rng.randrange(50))
        for _ in range(rng.randrange(3)):
            words += rng.choice(shared) + say(rng.randrange(20))
        docs.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(200 + k, docs[7 * k][1]) for k in range(20)]  # exact copies
    docs += [(-5 + k, docs[k][1]) for k in range(3)]
    docs += [(300 + k, " ".join(shared[4] + [str(k)] + say(3))) for k in range(120)]  # one frequent passage
    docs += [(500, None), (501, ""), (502, "a b"), (503, " ".join(say(9) * 40)), (504, "x " * 50), (505, "x " * 30)]
    rng.shuffle(docs)
    return docs


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def test_against_brute_force(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = sorted(brute.without_repeats(docs), key=str)
    for size in (400_000, 300):  # one bin, and many with heavy prefixes of all lengths and sliced passages
        out = repeated_passages(df, bin_size=size)
        assert _got(out) == want
    assert _got(repeated_passages(df, window=5, gram=3, bin_size=500)) == sorted(brute.without_repeats(docs, 5), key=str)
    assert _got(repeated_passages(df, bin_size=300, plan_rows=50)) == want
    by = dict(docs)
    for r in out.collect():
        words = brute.space_words(by[r.doc_id])
        for span in r.spans:  # each span stands where it says
            other = brute.space_words(by[span.of_id])
            assert span.of_id < r.doc_id and words[span.first : span.last] == other[span.of_first : span.of_first + span.last - span.first]
            longer = span.last < len(words) and span.of_first + span.last - span.first < len(other) and words[span.last] == other[span.of_first + span.last - span.first]
            assert not longer or any(s.first > span.first and s.last > span.last for s in r.spans)


def test_drop_keeps_columns_and_other_texts(spark):
    say = lambda a, n: " ".join(f"w{k}" for k in range(a, a + n))
    rows = [(1, "own\n" + say(0, 40), "p", "q", 1), (2, f"{say(5, 20)}  tail", "p", "q", 2), (3, "own  text\n here", "p", "q", 3), (3, None, "p", "q", 4), (None, say(0, 40), "p", "q", 5), (None, say(0, 40), "p", "q", 6), (2, f"{say(5, 20)}  tail", "p", "q", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string, carried string, k int")
    got = {r.k: r.text for r in drop_repeated_passages(df).collect()}
    assert got == {1: rows[0][1], 2: "tail", 3: rows[2][1], 4: None, 5: "", 6: "", 7: "tail"}
    assert drop_repeated_passages(df).dtypes == df.dtypes
    assert repeated_passages(df.limit(0)).count() == 0
    again = [(1, say(0, 30)), (1, "more " + say(0, 30)), (None, "x " + say(0, 14)), (None, say(100, 20)), (None, "y " + say(100, 20))]
    assert _got(repeated_passages(spark.createDataFrame(again, "doc_id long, text string"))) == sorted(brute.without_repeats(again), key=str)
