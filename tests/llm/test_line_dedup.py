import random
import re

from callspark.llm.line_dedup import FUZZY_WORDS, SIMILARITY, drop_repeated_lines, edit_similar


def _words(line):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()) if w]


def _levenshtein(a, b):
    """Bit-parallel: a column of the table of distances is two integers, of its steps up and down."""
    if not a or not b:
        return len(a) + len(b)
    full, places = (1 << len(a)) - 1, {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for ch in b:
        here = places.get(ch, 0)
        diagonal = (((here & up) + up) ^ up) | here | down
        right, left = down | (~(diagonal | up) & full), up & diagonal
        score += (right >> (len(a) - 1) & 1) - (left >> (len(a) - 1) & 1)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (~(here | down | right) & full), right & (here | down)
    return score


def _gone(docs, fuzzy=True):
    """(doc_id, line) of the lines to remove; all pairs of distinct lines are compared, by edit similarity alone."""
    where = {}
    for i, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            words = tuple(_words(line))
            if len(words) >= 3:
                where.setdefault(words, []).append((i, k))
    lines = list(where)
    top = {x: x for x in lines}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(lines) if fuzzy else 0):
        for b in range(a):
            one, two = " ".join(lines[a]), " ".join(lines[b])
            far = (1 - SIMILARITY) * max(len(one), len(two)) + 1e-9
            if min(len(lines[a]), len(lines[b])) >= FUZZY_WORDS and abs(len(one) - len(two)) <= far and _levenshtein(one, two) <= far:
                top[find(lines[a])] = find(lines[b])
    first = {}
    for x in lines:
        first[find(x)] = min([first.get(find(x), where[x][0]), *where[x]])
    return {(i, k) for x in lines for i, k in where[x] if (i, k) != first[find(x)]}


def _case():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 7, 12, 30, 45, 60]))) for _ in range(120)]
    for line in lines[:100]:
        words = line.split()
        for _ in range(rng.randrange(1 + len(words) // 10)):
            words[rng.randrange(len(words))] = rng.choice([rng.choice(vocab), "", words[0] + "zz"])
        lines.append(" ".join(words))
    lines += ["", "  ", "Footer 12 of 90: all rights reserved", "FOOTER, 12 of 90 - all rights reserved.", "abcd efgh ijkl mnop " * 100 + "x", "abcd efgh ijkl mnop " * 100 + "y"]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for k in range(120)]
    return docs + [(200, None), (201, ""), (202, "\n\n")]


def test_against_brute_force(spark):
    docs = _case()
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, key string, id int")
    out = drop_repeated_lines(df)
    assert out.columns == ["doc_id", "key", "id", "text", "n_lines", "removed"]
    rows = out.collect()
    got, want, equal = {(r.doc_id, k) for r in rows for k in r.removed}, _gone(docs), _gone(docs, fuzzy=False)
    assert equal <= got <= want and len(want) > len(equal) and len(got - equal) >= 0.9 * len(want - equal)
    texts = dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        text = texts[r.doc_id]
        assert r.text == (None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in r.removed))
        assert r.n_lines == (None if text is None else text.count("\n") + 1)


def test_clashing_columns(spark):
    names = ["row", "gone", "at_id", "at_hash", "text_hash", "line_no", "removed", "n_lines", "h1", "key", "_id", "_hash"]
    df = spark.createDataFrame([(k, "one two three\nfour", *names) for k in (1, 2)], ["doc_id", "text", *names])
    out = drop_repeated_lines(df)
    assert out.columns == ["doc_id", *(n for n in names if n not in ("removed", "n_lines")), "text", "n_lines", "removed"]
    assert sorted((r.doc_id, r.text, r.row, r.h1) for r in out.collect()) == [(1, "one two three\nfour", "row", "h1"), (2, "four", "row", "h1")]


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(5, "one two three\nfour"), (5, "one two three\nfour"), (None, "one two three"), (4, "ONE, two; three")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in drop_repeated_lines(df).collect())
    # a null id comes first in the order of occurrences
    assert got == [("4", ""), ("5", "four"), ("5", "four"), ("None", "one two three")]
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_edit_similarity_of_long_lines(spark):
    one, two = "ab" * 5000, "ab" * 4990 + "xyzw" * 5
    row = spark.createDataFrame([(one, two)], "a string, b string").select(edit_similar("a", "b", 0.9).alias("near"), edit_similar("a", "b", 0.9999).alias("same")).first()
    assert row.near and not row.same


def test_edit_similarity_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(800):
        vocab = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([3, 8, 30]))]
        one = [rng.choice(vocab) for _ in range(rng.randrange(1, 25))]
        two = list(one)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(two) + 1)
            two[i : i + rng.randrange(3)] = [rng.choice(vocab) for _ in range(rng.randrange(4))]
        rows.append((" ".join(one), " ".join(two)))
    df = spark.createDataFrame(rows, "a string, b string")
    for similarity in (0.6, 0.85):
        got = [(r.a, r.b) for r in df.where(edit_similar("a", "b", similarity)).collect()]
        want = [(a, b) for a, b in rows if _levenshtein(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9]
        assert sorted(got) == sorted(want) and 100 < len(want) < 800
