"""The given tables as calls, turns, segments, events and documents, and small Latin dictionaries for their invented prose."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THEMES = (
    ("speed", "Speed", "network", ("tion", "slow")),
    ("billing", "Bills", "billing", ("rest", "fee")),
    ("legal", "Legal", "legal", ("shly", "court")),
    ("plan", "Plans", "planAdvice", (r"^The\b", "plan")),
    ("visit", "Visits", "install", ("ngthe", "visit")),
)
REPEATS = (r"again", r"onon", r"is\s+of")
CHURN = (
    ("leave", "Leaves", 30, ("hathe", "cancel")),
    ("other", "Other firm", 25, ("erthe", "rival")),
    ("cost", "Costs", 18, ("ering", "penalty")),
    ("twice", "Twice", 15, ("onon", "second")),
    ("glad", "Glad", -12, ("is of", "thanks")),
)
MENTIONS = (
    ("greeting", "Greeting", 8, ("The", "Hello")),
    ("identity", "Identity", 8, ("nded", "your name")),
    ("recording", "Recording", 8, ("ingthe", "recorded")),
    ("solution", "Solution", 8, ("reont", "solved")),
    ("closing", "Closing", 8, (r"with\s+the", "good day")),
)
FORBIDDEN = (("blame", "high", 6, False, ("thenon", "onthe")), ("informal", "medium", 4, True, ("hea", "nthe")))
QUESTION, EMPATHY, INTERRUPT = r"(tion|\?)\.$", "(with the|sorry)", "^(In|The|Of)"
LEXICON = (("TION", ("tion", "ti on")), ("THE", ("the+n",)), ("AND", (r"and,",)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, where each takes far longer to work on than to move: a file may have few row groups, and each is one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns; system messages are nobody's."""
    speaker = F.when(F.col("role") == "assistant", "agent").otherwise("customer")
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_no"), speaker.alias("speaker"), "text")


TURNS_SQL = "turns as (select conv_id as call_id, turn as turn_no, case role when 'assistant' then 'agent' else 'customer' end as speaker, text from conversations where role in ('user', 'assistant'))"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, title, day, transcript): a conversation's messages as labelled lines; a call is one text, as transcripts are."""
    lines = turns(spark, sf_dir).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", F.concat("speaker", F.lit(": "), "text").alias("line")))).alias("l"))
    return lines.select("call_id", F.lit("").alias("title"), F.expr("date_add(date '2024-01-01', cast(call_id % 14 as int))").alias("day"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analysed calls."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("agent-"), (F.col("o_custkey") % 40).cast("string")).alias("agent"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 10_000).cast("double")).alias("minutes"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("sentiment"), (F.col("o_totalprice") > 200_000).alias("escalate"),
    )


CALLS_SQL = """calls as (select o_orderkey as call_id, cast(o_orderdate as date) as day, 'agent-' || (o_custkey % 40) as agent,
  case when o_orderkey % 5 <> 0 then floor(o_totalprice / 10000) end as minutes, o_orderpriority as category, o_orderstatus as sentiment, o_totalprice > 200000 as escalate from orders)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def instants(rows: DataFrame) -> DataFrame:
    """Times become instants, as event times are."""
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files; the pattern takes a file as well as a folder. Times become instants, as event times are."""
    rows = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")
    return instants(rows)


def fed(rows: DataFrame, ts: str, parts: int = 3):
    """(stream, feeds): ``rows`` as a stream of ``parts`` stretches of time; the first is there, each feed but the first adds the next."""
    from callspark.sources.shared import shared_folder

    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/fed-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col(ts))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = ((high or 0) - (low or 0)) // parts + 1

    def feed(k: int) -> None:
        rows.where(F.floor((at - (low or 0)) / width) == k).write.mode("append").parquet(folder)

    feed(0)
    return spark.readStream.schema(rows.schema).parquet(folder), [None, *(functools.partial(feed, k) for k in range(1, parts))]


def telemetry_of(events: DataFrame) -> DataFrame:
    """Events as requests: tokens from the properties, latency from the value, engine by user."""
    k = F.get_json_object("props", "$.k").cast("long")
    mode = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, "fallback-timeout").otherwise("fallback")).when(F.col("user_id") % 3 == 0, "live-oss").when(F.col("user_id") % 7 == 0, "guarded").otherwise("live")
    return events.select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("endpoint"), mode.alias("mode"), F.when(F.col("event_type") != "signup", F.floor("value").cast("long")).alias("latency_ms"), (k * 1000).alias("input_tokens"), (k * 200).alias("output_tokens"),
        F.when(F.col("event_type") == "view", k * 100).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_write_tokens"), F.col("ts").alias("created_at"), F.col("user_id").alias("account"),
    )


TELEMETRY_SQL = """telemetry as (select event_id as request_id, event_type as endpoint,
  case when event_type = 'error' then case when user_id % 2 = 0 then 'fallback-timeout' else 'fallback' end when user_id % 3 = 0 then 'live-oss' when user_id % 7 = 0 then 'guarded' else 'live' end as mode,
  case when event_type <> 'signup' then cast(floor(value) as bigint) end as latency_ms, k * 1000 as input_tokens, k * 200 as output_tokens, case when event_type = 'view' then k * 100 end as cache_read_tokens, ts as created_at, user_id as account
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with times: each lasts a tenth of a second a character, and pauses follow from the turn's number."""
    t = turns(spark, sf_dir).withColumn("size", F.length("text").cast("double"))
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum(F.col("size") + 8 * (F.col("turn_no") % 7)).over(Window.partitionBy("call_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return t.withColumn("start", before / 8).select("call_id", F.col("turn_no").alias("seg_no"), "start", (F.col("start") + F.col("size") / 8).alias("end"), "text", "speaker")


SEGMENTS_SQL = f"""{TURNS_SQL}, segments as (select call_id, turn_no as seg_no, start, start + length(text) / 8.0 as "end", text, speaker from
  (select *, coalesce(sum(length(text) + 8 * (turn_no % 7)) over (partition by call_id order by turn_no rows between unbounded preceding and 1 preceding), 0) / 8.0 as start from turns))"""


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (doc_id, title, body): the first line, and all of the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("body"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def latin_tokens(text):
    """Runs of ASCII letters and digits of two characters and more, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def latin_terms_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 2)"
