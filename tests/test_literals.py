"""Literals that patterns need, words looked up in texts, and patterns of all kinds against each line."""

import random
import re

import pyarrow as pa
import pytest

from callspark.functions.literals import FragmentIndex, contained, fold, folded_literals, mandatory_literals
from callspark.operators import rules


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abc", {"abc"}), ("one.*two", {"two"}), ("a.bcd", {"bcd"}), ("(foo|bars?)x", {"x"}), ("x*", None), ("(?i)abc", None), ("a|", None), ("(ab)+c", {"ab"}), (r"\bword\b", {"word"}), ("(?:no|", None),
        ("[ab]c{2,}", {"c"}), (r"is\s+of", {"is"}), (r"\p{L}abc", None), ("(?=abc)d", {"d"}), (r"(?x) a b", None), ("해지|취소", {"해지", "취소"}), (r"\0101", None), ("a?b?", None), ("", None),
    ],
)
def test_mandatory_literals(pattern, want):
    got = mandatory_literals(pattern)
    assert got is None if want is None else want in got


def test_no_match_without_its_literal():
    rng = random.Random(6)
    pieces = ["a", "bc", "(a|bc)", "[ab]", "c+", "(bc)?", "a{2}", ".", r"\s", "(?:ab|c(d|e))", "d*", r"\b", "^", "$", "(?P<n>ab)"]
    for _ in range(3000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5)))
        if pattern.count("?P<n>") > 1:
            continue
        text = "".join(rng.choice("abcde ") for _ in range(12))
        found = mandatory_literals(pattern)
        if found is not None and re.search(pattern, text):
            assert all(any(x in text for x in option) for option in found), (pattern, text)


def test_contained_words(spark):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abé한\n ") for _ in range(n))
    texts = [(k, say(rng.randrange(60)), "x") for k in range(120)] + [(200, None, "x"), (201, "", "x"), (202, "é" * 5000 + "ab", "x")]
    words = sorted({say(rng.randrange(13)) for _ in range(150)} | {""})
    df, asked = spark.createDataFrame(texts, "n int, text string, other string"), spark.createDataFrame([*((w,) for w in words), (None,)], "word string")
    want = sorted((n, w) for n, t, _ in texts if t is not None for w in words if w in t)
    for block in (100_000, 40):
        assert sorted(tuple(r) for r in contained(df, "text", asked, "word", ["n"], block).collect()) == want
    assert contained(df, "text", asked.limit(0), "word", ["n"]).count() == 0


def test_patterns_of_all_kinds(spark):
    patterns = ["yes", "(?i)YES", "[0-9]{2}", "line 1|no$", r"\bsays\b", "", "x+y", "(yes|no) \\p{L}+", "say.*no", "네+ 알겠", None]
    lines = [(k, f"line {k} says {'yes' if k % 2 else 'no'}{' sir' if k % 3 else ''}") for k in range(40)] + [(50, None), (51, ""), (52, "네네 알겠습니다")]
    df = spark.createDataFrame(lines, "n int, line string")
    asked = spark.createDataFrame([(f"r{k}", k, 0, p) for k, p in enumerate(patterns)], "rule string, ord int, pattern_no int, pattern string")
    plain = df.crossJoin(asked).where("line rlike pattern").select("n", "line", "rule", "ord", "pattern_no")
    want = sorted(tuple(r) for r in plain.collect())
    for block in (100_000, 3):
        assert sorted(tuple(r) for r in rules.match_rules(df, asked, block=block).collect()) == want


def test_words_with_blanks_between_are_one_literal():
    assert folded_literals(r"one[ ,.]+two[ ,.]+(three|[0-3]+x)") == [frozenset({"one two three", "one two 0", "one two 1", "one two 2", "one two 3"})]
    assert folded_literals("a[^b]c") == [frozenset({"a"}), frozenset({"c"})] and folded_literals("(?i)abc") is None and folded_literals("[ab[c]]d") is None


def test_no_match_without_its_folded_literal():
    rng = random.Random(7)
    pieces = ["a", "bc", "(a|bc)", "[ab]", "[ ,]+", ",", "[ ,]", "c+", "(bc)?", "a{2}", ".", "(?:ab|c(d|e))", "d*", r"\b", "^", "( a|,+)", "(, ?)+", "[0-9]+", "[a-z]"]
    for _ in range(20_000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        text = "".join(rng.choice("aabbccde  ,,1") for _ in range(14))
        found = folded_literals(pattern)
        if found is not None and re.search(pattern, text):
            assert all(any(x in fold(text) for x in option) for option in found), (pattern, text, found)


def test_candidates_are_few_and_come_in_bounded_parts():
    """Frequent words that stand together in few lines; a line of 30,000 words meets 5,000 patterns."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    patterns = [[f"{a} {b}, {c}"] for a in words[:50] for b in words[:10] for c in words[:10]]
    lines = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(2000)] + [", ".join(rng.choice(words) for _ in range(30_000)), None, ""]
    index = FragmentIndex([[x] for x in patterns])
    parts = list(index.candidates(pa.array(lines)))
    assert max(len(rows) for rows, _ in parts) <= 210_000
    folded = [None if x is None else fold(x) for x in lines]
    want = {(row, owner) for owner, (p,) in enumerate(patterns) for row, x in enumerate(folded) if x is not None and fold(p) in x}
    found = [pair for rows, owners in parts for pair in zip(rows.tolist(), owners.tolist())]
    assert len(found) == len(set(found)) and set(found) == want
