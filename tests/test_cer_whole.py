import random
import re

from callspark.operators import verify
from callspark.plans import registry


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def _docs(spark, folder):
    rows = [(1, "fr", "Ététion ça va?\nUne nation, là-bas."), (2, "fr", "né à l'été\n\nrien"), (3, "en", "station\n" + "in motion and so on\n" * 6), (4, "en", ""), (5, "en", None), (6, "en", "a b tion c d e f g h i j " * 900)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_whole_texts(spark, tmp_path):
    rows, flat = _docs(spark, tmp_path), lambda x: re.sub(verify._CER_DROP, "", x or "")
    want = {}
    for i, lang, text in rows:
        one, two = flat(text), flat((text or "").replace("tion", "shun"))
        if one:
            # the long text is the same piece over and over, each with the three changes of its one word
            d = 3 * 900 if i == 6 else _levenshtein(one, two)
            n, dist, length = want.get(lang, (0, 0, 0))
            want[lang] = (n + 1, dist + d, length + len(one))
    got = {r.lang: (r.pairs, r.distance, r.ref_length) for r in registry.queries()["e1_corpus_cer_whole"](spark, str(tmp_path)).collect()}
    assert got == want
    within = {r.doc_id: (r.unverifiable, r.within) for r in registry.queries()["e2_cer_within_whole"](spark, str(tmp_path)).collect()}
    assert within == {1: (False, False), 2: (False, True), 3: (False, False), 6: (True, False)}


def test_distances_of_every_band(spark):
    rng, rows = random.Random(4), [("abc", ""), ("", "abc"), ("a", "b" * 40), ("b" * 40, "a")]
    for n in (3, 15, 16, 17, 40, 90):
        for change in (0, 1, n // 4, n):
            one = [rng.choice("abcdé") for _ in range(n)]
            two = list(one)
            for _ in range(change):
                two[rng.randrange(n)] = rng.choice(["", "x", "yz"])
            rows.append(("".join(one), "".join(two)))
    got = {(r.reference, r.hypothesis): r.distance for r in verify.cer(spark.createDataFrame(rows, "reference string, hypothesis string")).collect()}
    assert got == {(a, b): _levenshtein(a, b) if a else None for a, b in rows}


def test_no_pairs(spark):
    none = verify.cer(spark.createDataFrame([("", "x", "m")], "reference string, hypothesis string, model string"))
    assert verify.corpus_cer(none, "model").count() == 0 and verify.corpus_cer(none).first().pairs == 0


def test_common_ends_are_cut_before_the_budget(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefghij") for _ in range(6_600))
    ten = long[:3_000] + "z" * 10 + long[3_010:]
    spread = "".join("z" if k % 60 == 0 else c for k, c in enumerate(long))
    rows = [("same", long, long), ("one", long, long[:4_000] + "Q" + long[4_001:]), ("ten", long, ten), ("spread", long, spread), ("short", long, long[:3_000]), ("added", long, long + "tail"), ("empty", "", "x"), ("gone", "abc", ""), ("twice", "aaaa", "aaaaa")]
    got = {r.k: (r.within, r.unverifiable, r.cer) for r in verify.cer_within(spark.createDataFrame(rows, "k string, reference string, hypothesis string"), 0.15).collect()}
    assert got["same"] == (True, False, 0.0) and got["one"] == (True, False, 1 / 6_600) and got["ten"] == (True, False, 10 / 6_600) and got["added"] == (True, False, 4 / 6_600)
    assert got["spread"] == (False, True, None) and got["short"] == (False, False, None) and got["empty"] == (None, None, None) and got["gone"] == (False, False, None) and got["twice"] == (False, False, None)
    kept = verify.preserve_gate(spark.createDataFrame([(long, ten), (long, spread)], "original string, rewritten string")).collect()
    assert [(r.ok, r.kept == ten) for r in kept] == [(True, True), (False, False)]


def test_within_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for n in (1, 5, 20, 60):
        for _ in range(25):
            one = [rng.choice("abcé😀") for _ in range(n)]
            two = list(one)
            for _ in range(rng.randrange(5)):
                two[rng.randrange(n)] = rng.choice(["", "x", "yz", "a"])
            rows.append(("".join(one), "".join(two)))
    for r in verify.cer_within(spark.createDataFrame(rows, "reference string, hypothesis string"), 0.2, cells=300).collect():
        a, b = r.reference, r.hypothesis
        k, d = int(0.2 * len(a)), _levenshtein(a, b)
        s, t = list(a), list(b)
        while s and t and s[0] == t[0]:
            s, t = s[1:], t[1:]
        while s and t and s[-1] == t[-1]:
            s, t = s[:-1], t[:-1]
        hard = a != b and abs(len(a) - len(b)) <= k and len(s) * min(len(t), 2 * k + 1) > 300
        assert r.unverifiable == hard and r.within == (not hard and d <= k) and (r.cer == d / len(a) if r.within else r.cer is None)


def test_texts_are_cleaned_once_and_dealt_out_first(spark, tmp_path):
    _docs(spark, tmp_path)
    plan = registry.queries()["e2_cer_within_whole"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert plan.count("regexp_replace(") == 2 and "regexp_replace(" not in below and "pythonUDF" not in below
