"""Reading and writing of calls, transcripts, recognition results, reports and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callspark.functions.text import micros, valid_date

CALL_SCHEMA = (
    "call_id string, call_date string, agent string, minutes double, title string, transcript string, mine boolean, "
    "analysis struct<category:string,sentiment:string,escalate:boolean,churn:struct<score:int,level:string,estimated:boolean,signals:array<string>>,route:struct<team:string,priority:string>>"
)
SEGMENT = "array<struct<start:double,end:double,text:string,speaker:string>>"
ASR_SCHEMA = f"call_id string, text string, duration double, segments {SEGMENT}, words array<struct<word:string,start:double,end:double>>"


def read_calls(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Call ledger. A date that is none is '' (undated), a missing title 'untitled', a missing analysis an empty one; no row is dropped."""
    return normalise_calls(spark.read.schema(CALL_SCHEMA).format(form).load(path))


def normalise_calls(calls: DataFrame) -> DataFrame:
    empty = F.from_json(F.lit("{}"), calls.schema["analysis"].dataType)
    return calls.withColumns({"call_date": F.coalesce("call_date", F.lit("")), "title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("untitled")), "analysis": F.coalesce("analysis", empty), "day": valid_date(F.col("call_date"))})


def split_bulk_calls(texts: DataFrame, key: str, column: str, max_calls: int = 5, max_chars: int = 2000) -> DataFrame:
    """(key, call_no, transcript): the blocks between blank lines, trimmed, at most ``max_calls`` of ``max_chars`` each (a limit of the format)."""
    parts = F.filter(F.transform(F.split(column, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return texts.select(key, F.posexplode(F.slice(parts, 1, max_calls)).alias("call_no", "_t")).select(key, "call_no", F.substring("_t", 1, max_chars).alias("transcript"))


def read_asr(results: DataFrame) -> DataFrame:
    """(call_id, seg_no, start, end, text, speaker) from recognition results (ASR_SCHEMA).

    Segments with both times and a text; a call that has none falls back to its words, joined into utterances;
    a call with neither has no row: its timing is not measured, which is not zero.
    """
    from callspark.operators.timeline import sessionise_words

    whole = lambda x: x.isNotNull() & ~F.isnan(x)
    good = F.filter(F.coalesce("segments", F.array().cast(SEGMENT)), lambda s: whole(s["start"]) & whole(s["end"]) & (F.coalesce(F.trim(s["text"]), F.lit("")) != ""))
    rows = results.withColumn("good", good)
    timed = rows.select("call_id", F.posexplode("good").alias("seg_no", "s")).select("call_id", "seg_no", "s.start", "s.end", F.trim("s.text").alias("text"), "s.speaker")
    words = rows.where(F.size("good") == 0).select("call_id", F.posexplode("words").alias("word_no", "w")).select("call_id", "word_no", "w.word", "w.start", "w.end")
    return timed.unionByName(sessionise_words(words).withColumn("speaker", F.lit(None).cast("string")))


def append_telemetry(events: DataFrame) -> DataFrame:
    """One row per request of (request_id, seq, endpoint, mode, started, ended, usage and findings): the last mode and endpoint,
    the first start, the newest usage that is not null; latency is end - start in milliseconds."""
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    usage = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "findings_count"]
    out = events.groupBy("request_id").agg(F.max_by("endpoint", "seq").alias("endpoint"), F.max_by("mode", "seq").alias("mode"), F.min("started").alias("started"), F.max("ended").alias("ended"), *(newest(c) for c in usage))
    millis = (micros("ended") - micros("started")) / 1000
    return out.withColumns({"latency_ms": F.round(millis).cast("int"), "created_at": F.col("ended"), "day": F.to_date("ended")})


def write_telemetry(requests: DataFrame, path: str) -> None:
    requests.write.mode("append").partitionBy("day").parquet(path)


def keep_last_n(df: DataFrame, partition: str, order: list, n: int = 60) -> DataFrame:
    """The newest ``n`` rows of each store (a bounded history)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def redacted_snapshot(calls: DataFrame) -> DataFrame:
    """What may be stored: labels and scores, a title of 40 characters, six signal labels; no transcript, no quotes."""
    churn = F.when(
        F.col("analysis.churn").isNotNull(),
        F.struct(F.col("analysis.churn.score").alias("score"), F.col("analysis.churn.level").alias("level"), F.col("analysis.churn.estimated").alias("estimated"), F.slice("analysis.churn.signals", 1, 6).alias("signals")),
    )
    analysis = F.struct(F.col("analysis.category").alias("category"), F.col("analysis.sentiment").alias("sentiment"), F.col("analysis.escalate").alias("escalate"), churn.alias("churn"), F.col("analysis.route").alias("route"))
    return calls.select("call_id", "call_date", "agent", "minutes", F.substring("title", 1, 40).alias("title"), analysis.alias("analysis"))


def qa_history_rows(qa: DataFrame) -> DataFrame:
    """QA results (call_id, call_date, label, score struct, mentions, findings) as history rows; results without a score are skipped."""
    return qa.where("score is not null").select(
        "call_id", "call_date", F.substring(F.coalesce("label", F.lit("")), 1, 30).alias("label"), "score.total", "score.grade", "score.rule_score", "score.llm_score", "score.estimated", "score.deduction",
        F.transform(F.filter("mentions", lambda m: ~m["found"]), lambda m: m["label"]).alias("missed"), F.transform("findings", lambda f: f["label"]).alias("violations"), F.coalesce("speaker_labeled", F.lit(True)).alias("speaker_labeled"),
    )
