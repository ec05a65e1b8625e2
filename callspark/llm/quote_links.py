"""Chat formatting by quotation linking, in DataFrame operations only.

Method. A line's quote level is the number of ``>`` marks before its text (blanks between them don't matter).
The unquoted lines of a message, normalised (case folded, blanks joined), are its passage of level 0; each run of
lines of one level is a quoted passage. Hashes of normalised lines of quoted passages are joined to the unquoted
lines of earlier messages of the same conversation: each quoted line is linked to the latest message before it
that says it. Quoted lines that no message has as a line (re-wrapped, joined, or parts of a line) are linked by their
passage: blanks and line breaks folded, its grams of five words (a passage of three or four words is one gram) are
joined to those of the unquoted texts, each to the latest earlier message that says it; the passage comes from the
message that most of its grams come from (ties to the latest), and so does each such line that one of these grams
touches. Passages of one or two words are linked as lines only.
The message that most lines of level 1 (or of the lowest level quoted) come from is what the
message replies to; ties go to the latest. A message without such a link replies to nothing by quotation.

A conversation is then put in reply order: a message that quotes stands after the message that its chain of
replies begins with, ahead of later messages that begin their own; inside a chain, turns ascend. ``position`` numbers
the messages of a conversation from 0. Contents are the messages without their quoted lines.

Scale. Only unquoted lines whose hash is quoted somewhere are looked up, in one sorted pass per (conversation,
hash) that holds one row at a time; chains are shortened by pointer doubling, in rounds that grow with the logarithm
of the longest chain; positions come from a range-partitioned sort, so one large conversation is spread over tasks.

Cases: a null text is a message without lines and has null content. Null conversation ids are one conversation,
null turns come first. Messages that share a turn are ordered by role and text; a link to a turn is a link to that
turn number. Repeated rows stay and get neighbouring positions. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callspark.llm.staging import Stage

_GRAM, _LEAST = 5, 3
_QUOTED = r"^(?:[ \t]*>)+"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, _QUOTED, 0)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _QUOTED, "")), r"\s+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    lines = messages.select("conv", "turn", "who", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("conv", "turn", "who", "line_no", quote_level(F.col("line")).alias("level"), normal_line(F.col("line")).alias("said"))
    return lines.where("said <> ''").withColumn("h1", F.xxhash64("said")).withColumn("h2", F.xxhash64(F.lit(5), "said"))


def link_quotes(messages: DataFrame, stage: Stage) -> DataFrame:
    """(conv, turn, who, line_no, level, origin): each quoted line and the turn it comes from, or null."""
    lines = _lines(messages)
    quoted = stage.write(lines.where("level > 0").select("conv", "turn", "who", "line_no", "level", "h1", "h2"), "quoted")
    wanted = quoted.select("conv", "h1", "h2").distinct()
    same = lambda a, b: a.conv.eqNullSafe(b.conv) & (a.h1 == b.h1) & (a.h2 == b.h2)
    said = lines.where("level = 0").select("conv", "turn", "h1", "h2").distinct()
    said = said.join(stage.side(quoted, wanted), same(said, wanted), "left_semi")
    both = said.select("conv", "h1", "h2", "turn", F.lit(None).cast("long").alias("who"), F.lit(-1).alias("line_no"), F.lit(0).alias("level"), F.col("turn").alias("at"))
    both = both.unionByName(quoted.withColumn("at", F.lit(None).cast("long")))
    links = stage.write(_latest_before(both).select("conv", "turn", "who", "line_no", "level", "origin"), "by-line")
    lost = stage.write(links.where("origin is null").select("conv", "turn", "who").distinct(), "lost")
    if not stage.rows(lost):
        return links
    found = _link_passages(messages, lost, stage).select(*(F.col(c).alias(f"_{c}") for c in ("conv", "turn", "who", "line_no")), F.col("origin").alias("_origin"))
    found = stage.write(found, "by-passage")
    here = links.conv.eqNullSafe(F.col("_conv")) & links.turn.eqNullSafe(F.col("_turn")) & (links.who == F.col("_who")) & (links.line_no == F.col("_line_no"))
    return links.join(stage.side(found), here, "left").select("conv", "turn", "who", "line_no", "level", F.coalesce("origin", "_origin").alias("origin"))


def _latest_before(both: DataFrame) -> DataFrame:
    """Quoted rows (level > 0) with ``origin``: the latest earlier turn of the rows of level 0 with their hashes."""
    # earlier turns only: of one turn, what is quoted comes before what is said
    past = Window.partitionBy("conv", "h1", "h2").orderBy(F.col("turn").asc_nulls_first(), F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("origin", F.last("at", ignorenulls=True).over(past)).where("level > 0")


def _link_passages(messages: DataFrame, lost: DataFrame, stage: Stage) -> DataFrame:
    """(conv, turn, who, line_no, origin) of the lines of the messages ``lost`` that grams of their passage link."""
    conv = F.col("conv").eqNullSafe(F.col("_conv"))
    one = [F.col(c).alias(f"_{c}") for c in lost.columns]
    of = stage.side(lost, lost.select(*one))
    lines = messages.select("conv", "turn", "who", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("conv", "turn", "who", "line_no", quote_level(F.col("line")).alias("level"), normal_line(F.col("line")).alias("said"))
    # lines of one level with nothing between them have one difference of line number and rank
    quoted = lines.where("level > 0").join(of, conv & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("who") == F.col("_who")), "left_semi")
    rank = F.row_number().over(Window.partitionBy("conv", "turn", "who", "level").orderBy("line_no"))
    quoted = _grams(quoted.withColumn("run", F.col("line_no") - rank))
    quoted = quoted.where(f"size = least(n, {_GRAM})").select("conv", "turn", "who", "level", "run", "first", "last", "h1", "h2")
    quoted = stage.write(quoted, "quoted-grams")
    own = stage.side(lost, lost.select(F.col("conv").alias("_conv")).distinct())
    said = _grams(lines.where("level = 0").join(own, conv, "left_semi").withColumn("run", F.lit(0))).select("conv", "turn", "h1", "h2")
    wanted = quoted.select(F.col("conv").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    said = said.join(stage.side(quoted, wanted), conv & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left_semi").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    both = said.select("conv", "turn", none("long").alias("who"), F.lit(0).alias("level"), none("int").alias("run"), none("int").alias("first"), none("int").alias("last"), "h1", "h2", F.col("turn").alias("at"))
    both = both.unionByName(quoted.withColumn("at", none("long")))
    grams = stage.write(_latest_before(both).where("origin is not null").select("conv", "turn", "who", "level", "run", "first", "last", "origin"), "grams")
    passage = Window.partitionBy("conv", "turn", "who", "level", "run")
    votes = grams.groupBy("conv", "turn", "who", "level", "run", "origin").agg(F.count("*").alias("votes"), F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("lines"))
    votes = votes.withColumn("place", F.row_number().over(passage.orderBy(F.desc("votes"), F.desc("origin")))).where("place = 1")
    return votes.select("conv", "turn", "who", F.explode("lines").alias("line_no"), "origin")


def _grams(lines: DataFrame) -> DataFrame:
    """(conv, turn, who, level, run, size, n, first, last, h1, h2): grams of 3 to 5 words of each run, and the lines they reach over."""
    words = lines.select("conv", "turn", "who", "level", "run", "line_no", F.posexplode(F.split("said", " ")).alias("at", "word")).where("word <> ''")
    run = Window.partitionBy("conv", "turn", "who", "level", "run")
    ahead = run.orderBy("line_no", "at")
    rows = words.select("*", F.count("*").over(run).alias("n"), *(F.lead("word", k).over(ahead).alias(f"w{k}") for k in range(1, _GRAM)), *(F.lead("line_no", k - 1).over(ahead).alias(f"e{k}") for k in range(_LEAST, _GRAM + 1)))
    each = []
    for size in range(_LEAST, _GRAM + 1):
        gram = ["word", *(f"w{k}" for k in range(1, size))]
        hashes = [F.xxhash64(F.lit(seed), *gram).alias(name) for seed, name in ((size, "h1"), (size + _GRAM, "h2"))]
        each.append(F.when(F.col(f"e{size}").isNotNull(), F.struct(F.lit(size).alias("size"), F.col(f"e{size}").alias("last"), *hashes)))
    rows = rows.select("conv", "turn", "who", "level", "run", "n", F.col("line_no").alias("first"), F.explode(F.array(*each)).alias("gram")).where("gram is not null")
    return rows.select("conv", "turn", "who", "level", "run", "n", "first", "gram.*")


def _chain_starts(stage: Stage, replies: DataFrame) -> DataFrame:
    """(conv, turn, reply_to) to (conv, turn, start): where following reply_to ends."""
    chain = stage.write(replies.groupBy("conv", "turn").agg(F.min("reply_to").alias("start")), "chain")
    while stage.rows(chain):
        further = chain.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("start").alias("further"))
        longer = chain.join(stage.side(chain, further), chain.conv.eqNullSafe(F.col("c")) & (chain.start == F.col("t")), "left")
        new = stage.write(longer.select("conv", "turn", F.coalesce("further", "start").alias("start"), F.isnotnull("further").alias("_moved")), "chain", moved=F.count_if(F.col("_moved")))
        chain = new
        if not stage.counted(new)["moved"]:
            break
    return chain.select("conv", "turn", "start")


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, position, reply_to, chain_start, n_quoted, n_linked, content), a row per message."""
    stage = Stage(messages.sparkSession, "quotes")
    rows = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("who", F.xxhash64("role", "text"))
    links = stage.write(link_quotes(rows.dropDuplicates(["conv", "turn", "who"]), stage), "links")
    key = ["conv", "turn", "who"]
    votes = links.groupBy(*key, "level", "origin").agg(F.count("*").alias("n"))
    found = F.col("origin").isNotNull()
    best = votes.groupBy(*key).agg(
        F.sum("n").alias("n_quoted"), F.sum(F.when(found, F.col("n")).otherwise(0)).alias("n_linked"),
        F.min(F.when(found, F.struct("level", (-F.col("n")).alias("few"), (-F.col("origin")).alias("back"), "origin")))["origin"].alias("reply_to"),
    )
    best = stage.write(best, "replies")
    starts = _chain_starts(stage, best.where("reply_to is not null and turn is not null"))
    starts = stage.write(starts.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "start"), "starts")
    linked = stage.write(best.join(stage.side(starts), best.conv.eqNullSafe(F.col("c")) & (best.turn == F.col("t")) & best.reply_to.isNotNull(), "left").select(*(F.col(k).alias(f"_{k}") for k in key), "n_quoted", "n_linked", "reply_to", "start"), "linked")
    same = rows.conv.eqNullSafe(F.col("_conv")) & rows.turn.eqNullSafe(F.col("_turn")) & (rows.who == F.col("_who"))
    all_rows = rows.join(stage.side(linked), same, "left").withColumn("chain_start", F.coalesce("start", "turn"))
    content = F.array_join(F.filter(F.split("text", "\n"), lambda line: quote_level(line) == 0), "\n")
    content = F.when(F.col("text").contains(">"), F.trim(content)).otherwise(F.col("text"))
    order = [F.col("chain_start").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("who")]
    spread = all_rows.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id())
    spread = stage.write(spread.select("conv", "turn", "role", "who", "chain_start", "reply_to", "n_quoted", "n_linked", content.alias("content"), "part"), "ordered")
    sizes = spread.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("conv").alias("c"), F.col("part").alias("p"), before.alias("before"))
    inside = spread.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    out = inside.join(sizes.hint("merge"), inside.conv.eqNullSafe(F.col("c")) & (inside.part == F.col("p")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", (F.col("before") + F.col("rank") - 1).cast("long").alias("position"), "reply_to", "chain_start", zero("n_quoted"), zero("n_linked"), "content")
