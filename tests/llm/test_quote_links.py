import random
import re

from callspark.llm.quote_links import format_conversations


def _split(text):
    out = []
    for line in (text or "").split("\n") if text is not None else []:
        marks = re.match(r"(?:[ \t]*>)*", line)[0]
        out.append((marks.count(">"), re.sub(r"\s+", " ", line[len(marks) :].lower()).strip(), line))
    return out


def _want(rows):
    """rows: (conv, turn, role, text), distinct (conv, turn), to the same with reply_to, chain_start, n_quoted, n_linked, content, position."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == conv)
        reply = {}
        for _, turn, _, text in mine:
            votes, n_quoted, n_linked = {}, 0, 0
            for level, said, _ in _split(text):
                if level and said:
                    n_quoted += 1
                    origin = max((t for _, t, _, x in mine if t < turn and any(lv == 0 and s == said for lv, s, _ in _split(x))), default=None)
                    if origin is not None:
                        n_linked += 1
                        votes[level, origin] = votes.get((level, origin), 0) + 1
            best = min(votes, key=lambda k: (k[0], -votes[k], -k[1]), default=None)
            reply[turn] = (best and best[1], n_quoted, n_linked)
        start = {}
        for turn in sorted(reply):
            start[turn] = turn if reply[turn][0] is None else start[reply[turn][0]]
        for position, turn in enumerate(sorted(reply, key=lambda t: (start[t], t))):
            text = next(r[3] for r in mine if r[1] == turn)
            content = text if text is None or ">" not in text else "\n".join(line for lv, _, line in _split(text) if lv == 0).strip(" ")
            out[conv, turn] = (position, reply[turn][0], start[turn], *reply[turn][1:], content)
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(30):
        said = []
        for turn in range(rng.randrange(1, 12)):
            lines = [rng.choice(["Hello there", "a b", "yes", f"point {rng.randrange(40)}", "x > y", ""]) for _ in range(rng.randrange(4))]
            if said and rng.random() < 0.7:
                source = rng.choice(said)
                lines = [rng.choice(["> ", ">", " > "]) + line.upper() for line in source] + ["> not said"] * rng.randrange(2) + lines
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(lines)))
            said.append(lines)
    rows.append((77, 0, "user", None))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, n int, who string")
    got = {(r.conv_id, r.turn): (r.position, r.reply_to, r.chain_start, r.n_quoted, r.n_linked, r.content) for r in format_conversations(df).collect()}
    want = _want(rows)
    assert got == want and any(x[1] is not None for x in want.values()) and max(x[3] for x in want.values()) > 2


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "hi"), (None, 2, "user", ">> hi\n> other\nok"), (3, 0, "user", "same"), (3, 0, "user", "same")], "conv_id long, turn long, role string, text string")
    got = sorted((str(r.conv_id), r.position, str(r.turn), str(r.reply_to), r.content or "") for r in format_conversations(df).collect())
    assert got == [("3", 0, "0", "None", "same"), ("3", 1, "0", "None", "same"), ("None", 0, "None", "None", ""), ("None", 1, "1", "None", "hi"), ("None", 2, "2", "1", "ok")]
    assert format_conversations(df.limit(0)).count() == 0
