"""Timed words and segments: utterances, stitched chunks, silences, talk time, speakers, quotes.

Everything is partitioned by call; a call's segments are few thousand at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callspark.functions.text import js_round, round_to
from callspark.operators.turns import alerts

_PUNCT = r"[\s\p{P}]"


def _r1(x: Column) -> Column:
    return round_to(x, 1)


def sessionise_words(words: DataFrame, gap: float = 0.8) -> DataFrame:
    """(call_id, seg_no, start, end, text) from (call_id, word_no, word, start, end).

    A new utterance begins after a gap of ``gap`` seconds or a word that ends a sentence; an utterance ends with its last word.
    """
    rows = words.withColumn("word", F.trim("word")).where("word <> '' and start is not null and end is not null")
    order = Window.partitionBy("call_id").orderBy("word_no")
    cut = (F.col("start") - F.lag("end").over(order) >= gap) | F.lag("word").over(order).rlike("[.?!。？！]$")
    rows = rows.withColumn("cut", F.coalesce(cut.cast("int"), F.lit(0)))
    rows = rows.withColumn("seg_no", F.sum("cut").over(order))
    piece = F.concat(F.when(F.col("word").rlike("^[,.?!]"), "").otherwise(" "), "word")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", piece.alias("piece")))), lambda x: x["piece"]), "")
    return rows.groupBy("call_id", "seg_no").agg(F.min_by("start", "word_no").alias("start"), F.max_by("end", "word_no").alias("end"), F.trim(said).alias("text")).select("call_id", F.col("seg_no").cast("int").alias("seg_no"), "start", "end", "text")


def stitch_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, blind): chunk-local times become call times, clipped to the chunk; chunks without segments are blind ranges.

    ``chunks`` has call_id, chunk_no, start, end, segments. Segments are (call_id, chunk_no, start, end, text, speaker).
    """
    base = F.coalesce(F.col("start"), F.lit(0.0))
    rows = chunks.withColumn("base", base)
    blind = rows.where("coalesce(size(segments), 0) <= 0 and end > base").select("call_id", F.col("base").alias("start"), "end")
    each = rows.select("call_id", "chunk_no", "base", F.col("end").alias("limit"), F.explode("segments").alias("s")).where("s.start is not null and s.end >= s.start and trim(s.text) <> ''")
    clip = lambda x: F.least(F.col("base") + x, "limit")  # noqa: E731  least() skips a null limit
    return each.select("call_id", "chunk_no", clip(F.col("s.start")).alias("start"), clip(F.col("s.end")).alias("end"), F.trim("s.text").alias("text"), F.col("s.speaker").alias("speaker")), blind


def speech_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), _PUNCT, ""))


def timeline_metrics(segments: DataFrame, durations: DataFrame | None = None, blind: DataFrame | None = None, silence: float = 3.0) -> DataFrame:
    """One row per call with segments: speech and call length, coverage, silences, rates.

    ``segments`` (call_id, start, end, text), ``durations`` (call_id, duration), ``blind`` (call_id, start, end). Overlapping
    segments count once; gaps from ``silence`` seconds that touch no blind range are silences.
    """
    spark = segments.sparkSession
    durations = spark.createDataFrame([], "call_id string, duration double").select(F.col("call_id").cast(segments.schema["call_id"].dataType), "duration") if durations is None else durations
    blind = segments.select("call_id", "start", "end").limit(0) if blind is None else blind
    rows = segments.join(durations.hint("merge"), "call_id", "left")
    hold = lambda x: F.when(F.col("duration").isNull(), F.greatest(F.lit(0.0), x)).otherwise(F.least(F.greatest(F.lit(0.0), x), "duration"))
    rows = rows.where("start is not null and end is not null").withColumns({"start": hold(F.col("start")), "end": hold(F.col("end"))}).where("end >= start").withColumn("chars", speech_chars(F.col("text")))
    order = Window.partitionBy("call_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    merged = rows.withColumn("island", F.sum("fresh").over(order)).groupBy("call_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gaps = merged.withColumn("next", F.lead("start").over(Window.partitionBy("call_id").orderBy("island"))).where(f"next - end >= {silence}")
    seen = blind.where("start is not null and end is not null").select(F.col("call_id").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    gaps = gaps.join(seen.hint("merge"), (gaps.call_id == seen._c) & (gaps.end < seen._e) & (gaps.next > seen._s), "left_anti")
    quiet = gaps.groupBy("call_id").agg(F.count("*").alias("silence_count"), _r1(F.sum(_r1(F.col("next") - F.col("end")))).alias("silence_sec"), F.max(F.struct(_r1(F.col("next") - F.col("end")).alias("sec"), (-_r1(F.col("end"))).alias("back"))).alias("top"))
    spoken = merged.groupBy("call_id").agg(F.sum(F.col("end") - F.col("start")).alias("speech"), F.min("start").alias("first"), F.max("end").alias("last"))
    timed = F.col("end") > F.col("start")
    rate = F.when((F.col("end") - F.col("start") >= 0.8) & (F.col("chars") >= 2), js_round(F.col("chars") / (F.col("end") - F.col("start")) * 60))
    rated = rows.withColumn("rate", rate)
    counted = rated.groupBy("call_id").agg(F.count("*").alias("segments"), F.sum(F.when(timed, F.col("chars")).otherwise(0)).alias("chars"), F.median("rate").alias("middle"), F.count("rate").alias("rated_segments"))
    fast = rated.select("call_id", "rate").join(counted.select("call_id", "middle").hint("merge"), "call_id").where("middle > 0 and rate >= 1.3 * middle").groupBy("call_id").agg(F.count("*").alias("fast_segments"), F.max("rate").alias("top_rate"))
    dark = blind.groupBy("call_id").agg(F.sum(F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")).otherwise(0.0)).alias("blind"))
    out = spoken.join(counted.hint("merge"), "call_id").join(quiet.hint("merge"), "call_id", "left").join(fast.hint("merge"), "call_id", "left").join(dark.hint("merge"), "call_id", "left").join(durations.hint("merge"), "call_id", "left")
    call, dim = F.greatest(F.coalesce("duration", F.lit(0.0)), "last"), F.coalesce("blind", F.lit(0.0))
    out = out.withColumns({"call": call, "dim": dim}).withColumn("covered", F.greatest(F.col("call") - F.col("dim"), F.lit(0.0)))
    touching = lambda low, high: out.join(seen.hint("merge"), (out.call_id == seen._c) & (low < seen._e) & (high > seen._s), "left_semi").select(F.col("call_id").alias("_t"))
    lead, trail = touching(F.lit(0.0), out["first"]).withColumn("_lead", F.lit(True)), touching(out["last"], out["call"]).withColumn("_trail", F.lit(True))
    out = out.join(lead.hint("merge"), out.call_id == lead._t, "left").drop("_t").join(trail.hint("merge"), out.call_id == F.col("_t"), "left").drop("_t")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "call_id", "segments", _r1(F.col("call")).alias("call_sec"), _r1(F.col("speech")).alias("speech_sec"), F.when(F.col("covered") > 0, _r1(F.col("speech") / F.col("covered") * 100)).alias("speech_ratio"),
        none("silence_count"), F.coalesce("silence_sec", F.lit(0.0)).alias("silence_sec"), F.coalesce("top.sec", F.lit(0.0)).alias("longest_silence_sec"), (-F.col("top.back")).alias("longest_silence_at"),
        F.when(F.col("_lead").isNull(), _r1(F.col("first"))).alias("leading_silence_sec"), F.when(F.col("_trail").isNull(), _r1(F.greatest(F.col("call") - F.col("last"), F.lit(0.0)))).alias("trailing_silence_sec"),
        F.when((F.col("speech") > 0) & (F.col("chars") > 0), js_round(F.col("chars") / F.col("speech") * 60)).alias("chars_per_min"), js_round(F.col("middle")).alias("median_chars_per_min"), "rated_segments",
        none("fast_segments"), "top_rate", (F.col("dim") > 0).alias("partial"), _r1(F.col("dim")).alias("blind_sec"), _r1(F.col("covered")).alias("covered_sec"),
    )


def diagnose_timeline(metrics: DataFrame) -> DataFrame:
    long, some = F.col("longest_silence_sec") >= 10, F.col("silence_count") > 0
    return alerts(metrics, "call_id", [
        ("partial-timeline", "info", F.col("partial")), ("long-silence", "warn", long), ("silence", "info", ~long & some), ("no-silence", "ok", ~long & ~some), ("low-density", "warn", F.col("speech_ratio") < 55),
        ("rate-spike", "warn", (F.col("fast_segments") > 0) & (F.col("median_chars_per_min") > 0)), ("late-open", "info", F.col("leading_silence_sec") >= 5),
    ])


def talk_metrics(segments: DataFrame, silence: float = 3.0) -> DataFrame:
    """One row per call with two segments or more: talk time by speaker, silences, response delays of the agent."""
    rows = segments.where("start is not null and end is not null")
    order = Window.partitionBy("call_id").orderBy("start", "end")
    rows = rows.withColumns({"gap": F.lead("start").over(order) - F.col("end"), "then": F.lead("speaker").over(order), "long": F.greatest(F.col("end") - F.col("start"), F.lit(0.0)), "last_end": F.last_value("end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    quiet, delay = F.when(F.col("gap") >= silence, F.col("gap")), F.when((F.col("gap") > 0) & (F.col("speaker") == "customer") & (F.col("then") == "agent"), F.col("gap"))
    own = lambda who: F.coalesce(F.sum(F.when(F.col("speaker") == who, F.col("long"))), F.lit(0.0))
    out = rows.groupBy("call_id").agg(
        F.count("*").alias("segments"), (F.max("last_end") - F.min("start")).alias("total"), own("agent").alias("agent"), own("customer").alias("customer"),
        F.coalesce(F.sum(quiet), F.lit(0.0)).alias("silence"), F.coalesce(F.max(quiet), F.lit(0.0)).alias("longest"), F.avg(delay).alias("avg_delay"), F.max(delay).alias("max_delay"),
    ).where("segments >= 2")
    both = F.col("agent") + F.col("customer")
    share = lambda c: F.when(both > 0, _r1(F.col(c) / both * 100))
    return out.select(
        "call_id", "segments", _r1(F.col("total")).alias("total_sec"), _r1(F.col("agent")).alias("agent_sec"), _r1(F.col("customer")).alias("customer_sec"), share("agent").alias("agent_ratio"), share("customer").alias("customer_ratio"),
        _r1(F.col("silence")).alias("silence_sec"), _r1(F.col("longest")).alias("longest_silence_sec"), _r1(F.col("avg_delay")).alias("avg_response_delay_sec"), _r1(F.col("max_delay")).alias("max_response_delay_sec"),
    )


def diagnose_talk(metrics: DataFrame) -> DataFrame:
    tests = [F.coalesce(t, F.lit(False)) for t in (F.col("longest_silence_sec") >= 10, F.col("max_response_delay_sec") >= 5, F.col("agent_ratio") >= 75)]
    return alerts(metrics, "call_id", [("long-silence", "warn", tests[0]), ("slow-response", "warn", tests[1]), ("agent-dominant", "warn", tests[2]), ("time-ok", "ok", ~(tests[0] | tests[1] | tests[2]))])


def assign_speakers(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """The i-th segment gets the speaker of the i-th labelled line (call_id, line_no, text); surplus segments stay null."""
    labelled = lines.where(r"text rlike '(?i)^\\s*(상담사|상담원|agent|고객|customer)\\s*[:：]'")
    number = lambda df, by: df.withColumn("_i", F.row_number().over(Window.partitionBy("call_id").orderBy(by)))
    who = F.when(F.col("text").rlike(r"(?i)^\s*(상담사|상담원|agent)"), "agent").otherwise("customer")
    named = number(labelled, "line_no").select("call_id", "_i", who.alias("speaker"))
    return number(segments.drop("speaker"), "seg_no").join(named.hint("merge"), ["call_id", "_i"], "left").drop("_i")


def apply_speaker_corrections(segments: DataFrame, fixes: DataFrame) -> DataFrame:
    """Human fixes (call_id, seg_no, speaker) over the given speakers; ``corrected`` marks them."""
    new = fixes.select("call_id", "seg_no", F.col("speaker").alias("_new"), F.lit(True).alias("_fixed"))
    out = segments.join(new.hint("merge"), ["call_id", "seg_no"], "left")
    return out.withColumns({"speaker": F.when(F.col("_fixed"), F.col("_new")).otherwise(F.col("speaker")), "corrected": F.coalesce("_fixed", F.lit(False))}).drop("_new", "_fixed")


def locate_quotes(quotes: DataFrame, segments: DataFrame, least: int = 3) -> DataFrame:
    """(call_id, quote_no, seg_no): the segment that shares most two-character pieces with a quote, the earliest of equals; null under ``least``."""
    flat = lambda c: F.regexp_replace(c, r"\s", "")
    q = quotes.withColumn("q", flat(F.col("quote")))
    pieces = q.select("call_id", "quote_no", F.explode(F.when(F.length("q") >= 2, F.transform(F.sequence(F.lit(1), F.length("q") - 1), lambda i: F.substring("q", i, F.lit(2))))).alias("piece"))
    pieces = pieces.groupBy("call_id", "quote_no", "piece").agg(F.count("*").alias("times"))
    hits = pieces.join(segments.select("call_id", "seg_no", flat(F.col("text")).alias("t")).hint("merge"), "call_id").where("contains(t, piece)")
    score = hits.groupBy("call_id", "quote_no", "seg_no").agg(F.sum("times").alias("score")).where(f"score >= {least}")
    best = score.groupBy("call_id", "quote_no").agg(F.min_by("seg_no", F.struct((-F.col("score")).alias("s"), "seg_no")).alias("seg_no"))
    return quotes.select("call_id", "quote_no").join(best.hint("merge"), ["call_id", "quote_no"], "left")


def clock(seconds: Column) -> Column:
    whole = F.greatest(F.floor(F.coalesce(seconds, F.lit(0.0))), F.lit(0))
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def render_transcript(segments: DataFrame) -> DataFrame:
    """(call_id, transcript): labelled lines in order."""
    line = F.concat(F.when(F.col("speaker") == "agent", "상담사: ").when(F.col("speaker").isNotNull(), "고객: ").otherwise(""), "text")
    return segments.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def plan_chunks(durations: DataFrame, seconds: float = 55.0, most: int = 30) -> DataFrame:
    """(call_id, chunk_no, start, end): the pieces in which a recording is read, ``most`` at most (a limit of the service)."""
    n = F.least(F.ceil(F.col("duration") / seconds), F.lit(most)).cast("int")
    rows = durations.where("duration > 0").select("call_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select("call_id", "chunk_no", (F.col("chunk_no") * seconds).alias("start"), F.least((F.col("chunk_no") + 1) * seconds, "duration").alias("end"))
