"""Structured Streaming jobs with batch twins: guides, admission, spend, rollups, deduplication, masking, counts, utterances.

Event time is ``created_at`` or ``ts``; the watermark is an argument (10 minutes unless said). Each job needs its own
checkpoint location. Stateful handlers use the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callspark.functions.text import correct_terms, mask_pii, micros
from callspark.operators import dictionaries as D
from callspark.operators.rules import match_rules
from callspark.operators.telemetry import billed, merge_totals, telemetry_by_mode
from callspark.sources.shared import shared_folder
from callspark.streaming.ordered import WATERMARK, admit_stream, spend_live, utterances_live  # noqa: F401 - part of this module's interface

def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dedupe_requests(stream: DataFrame, key: str = "request_id", ts: str = "created_at", delay: str = WATERMARK) -> DataFrame:
    """The first row of each request."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def mask_stream(stream: DataFrame, column: str = "text", **lexicon) -> DataFrame:
    """Masked, then corrected, before any sink; stateless."""
    masked = mask_pii(stream, column, "_masked").withColumn("_text", F.col("_masked.text"))
    return correct_terms(masked, "_text", out="outbound", **lexicon).drop("_masked", "_text", column)


def daily_counts_stream(stream: DataFrame, key: str = "category", ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """(day, key, n): calls by category and day; a day is final when the watermark passes it."""
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), key).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), key, "n")


def spend_stream(stream: DataFrame, key: str = "account", ts: str = "created_at", delay: str = WATERMARK, window: str = "24 hours", slide: str = "5 minutes") -> DataFrame:
    """(account, start, end, spent): what an account spent in each sliding day; ``spend_live`` has the exact rolling sum of each row."""
    rows = billed(stream.withWatermark(ts, delay))
    out = rows.groupBy(F.window(ts, window, slide), key).agg(F.sum("cost").alias("spent"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.col("spent").cast("double").alias("spent"))


def utterance_stream(stream: DataFrame, ts: str = "ts", gap: str = "800 milliseconds", delay: str = WATERMARK) -> DataFrame:
    """(call_id, start, end, words): utterances by the gap rule; words are (call_id, word, ts). ``utterances_live`` has the punctuation rule too."""
    rows = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), "call_id").agg(F.array_sort(F.collect_list(F.struct(ts, "word"))).alias("said"))
    return rows.select("call_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.array_join(F.transform("said", lambda x: x["word"]), " ").alias("words"))


def telemetry_rollup_stream(stream: DataFrame, path: str, checkpoint: str, ts: str = "created_at", delay: str = WATERMARK, late_path: str | None = None):
    """Incremental (endpoint, mode) totals: each batch writes its own part under its number, so a batch that runs again
    replaces itself; ``read_rollup`` merges the parts. With ``late_path``, rows behind the batch's watermark are kept there."""
    seconds = int(pd.Timedelta(delay).total_seconds())

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        if late_path:
            # what lies further behind the newest row of the batch than the watermark allows
            edge = rows.agg((micros(F.max(ts)) - seconds * 1_000_000).alias("edge"))
            rows.crossJoin(F.broadcast(edge)).where(micros(ts) < F.col("edge")).drop("edge").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        telemetry_by_mode(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.unpersist()

    return stream.withWatermark(ts, delay).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return merge_totals(spark.read.parquet(path).drop("batch"))


_GUIDE = ["call_id", "stage", "next_mentions", "alerts", "forbidden", "progress"]


class _Guide(StatefulProcessor):
    """State of an open call: mentions said and signals seen; emits the stage after each batch of turns.

    A timer in event time, set anew by each batch, clears the state of a call that has been silent.
    """

    def __init__(self, stages, idle_ms: int, total: int):
        self.stages, self.idle_ms, self.total = stages, idle_ms, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "tag string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {t[0] for t in self.seen.get()} if self.seen.exists() else set()
        ends = [timerValues.getCurrentWatermarkInMs() + 1]
        for frame in rows:
            seen |= set(frame["tag"].dropna())
            ends.extend(int(at) + self.idle_ms for at in frame["at_ms"].dropna())
        timers = list(self.handle.listTimers())
        for at in timers:
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max([*ends, *timers]))
        if seen:
            self.seen.put([(t,) for t in sorted(seen)])
        done = {t[2:] for t in seen if t.startswith("m:")}
        stage = next((name for name, ids in self.stages if not set(ids) <= done), self.stages[-1][0])
        missing = [i for name, ids in self.stages for i in ids if i not in done]
        of = lambda mark: ",".join(sorted(t[2:] for t in seen if t.startswith(mark)))
        progress = (200 * len(done) + self.total) // (2 * self.total) if self.total else 0  # half up
        yield pd.DataFrame([(key[0], stage, ",".join(missing[:2]), of("a:"), of("f:"), progress)], columns=_GUIDE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame(columns=_GUIDE)

    def close(self) -> None:
        pass


def live_guide(turns: DataFrame, mentions=D.MENTIONS, signals=D.CHURN_SIGNALS, stages=D.CALL_STAGES, playbook=D.PLAYBOOK, forbidden=D.FORBIDDEN, idle: str = "30 minutes", ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """(call_id, stage, next_mentions, alerts, forbidden, progress), again whenever turns (call_id, speaker, text, ts) arrive; the state of a call
    expires when the watermark has passed its last turn by ``idle``.

    ``alerts`` are the signals of ``playbook`` that the customer gave, ``forbidden`` the rules of which the agent said a phrase,
    ``progress`` the share of mentions said, in percent. ``drain_last`` keeps one row a call.
    """
    turns = turns.withWatermark(ts, delay).withColumn("at_ms", F.floor(micros(ts) / 1000).cast("long"))
    agent, customer = turns.where("speaker = 'agent'"), turns.where("speaker = 'customer'")
    risks = tuple(s for s in signals if s[0] in playbook)
    banned = tuple((f[0], tuple(re.escape(phrase) for phrase in f[-1])) for f in forbidden)
    tags = turns.select("call_id", F.lit(None).cast("string").alias("tag"), "at_ms", ts)
    for mark, rows, rules in (("m:", agent, mentions), ("a:", customer, risks), ("f:", agent, banned)):
        if rules:
            tags = tags.union(match_rules(rows, rules, "text").select("call_id", F.concat(F.lit(mark), "rule").alias("tag"), "at_ms", ts))
    kind = turns.schema["call_id"].dataType.simpleString()
    guide = _Guide(stages, int(pd.Timedelta(idle).total_seconds() * 1000), len(mentions))
    return tags.groupBy("call_id").transformWithStateInPandas(statefulProcessor=guide, outputStructType=f"call_id {kind}, stage string, next_mentions string, alerts string, forbidden string, progress int", outputMode="Update", timeMode="EventTime")


def finish(writer, seconds: float = 600) -> None:
    """Starts a stream writer on what is there and waits for its end; TimeoutError after ``seconds``."""
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream had not ended after {seconds} s")


def _drained(df: DataFrame, mode: str, seconds: float, feeds: Sequence[Callable[[], None] | None]) -> DataFrame:
    folder = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    for feed in feeds:
        if feed:
            feed()
        finish(df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state"), seconds)
    return df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")


def drain(df: DataFrame, mode: str = "append", seconds: float = 600, feeds: Sequence[Callable[[], None] | None] = (None,)) -> DataFrame:
    """All rows that a stream gives over what is there, written to a new folder of the shared one and read back.

    In update mode a key that changes has a row for each batch. Each of ``feeds`` adds to the stream's source, and the
    stream then goes on from its checkpoint.
    """
    return _drained(df, mode, seconds, feeds).select(*df.columns)


def drain_last(df: DataFrame, key: str, seconds: float = 600, feeds: Sequence[Callable[[], None] | None] = (None,)) -> DataFrame:
    """As ``drain`` in update mode, but only the last row of each key; a batch has one row a key."""
    rows = _drained(df, "update", seconds, feeds)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), "batch").alias("_last")).select(key, "_last.*").select(*df.columns)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append", seconds: float = 300) -> Callable[[], DataFrame]:
    """Runs a stream over what is there, into an in-memory table (for tests and backfills); TimeoutError after ``seconds``."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"{name} had not ended after {seconds} s")
    return lambda: df.sparkSession.table(name)
