"""Service telemetry: usage, engines, failures, rollups, spend, admission.

Events have endpoint, mode, latency_ms, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callspark.functions.text import js_round, micros

# Prices in USD for a million tokens, the daily limit, the reserve of a call, known failures.
PRICES = {"input_tokens": "5", "output_tokens": "25", "cache_read_tokens": "0.5", "cache_write_tokens": "6.25"}
LIMIT_USD, RESERVE_USD = 3.0, 0.06
FAILURES = ("refusal", "max-tokens", "deadline", "timeout", "http", "no-key", "contract")
CONTRACT_TEXT = "응답에서 결과를 찾을 수 없|필드가 없|형식이 올바르지"
RETENTION_DAYS = 30


def is_live(mode: Column) -> Column:
    return F.coalesce(mode.startswith("live"), F.lit(False))


def is_fallback(mode: Column) -> Column:
    return F.coalesce((mode == "fallback") | mode.startswith("fallback-"), F.lit(False))


def is_oss(mode: Column) -> Column:
    return is_live(mode) & mode.rlike("oss|turbo|base")


def classify_failures(events: DataFrame, code: str = "error_code", message: str = "error_message", known=FAILURES) -> DataFrame:
    """``events`` with ``mode``: fallback-<code> for known codes, fallback-contract by message, else fallback."""
    name = F.replace(F.coalesce(F.col(code), F.lit("")), F.lit("_"), F.lit("-"))
    return events.withColumn("mode", F.when(name.isin(*known), F.concat(F.lit("fallback-"), name)).when(F.coalesce(F.col(message), F.lit("")).rlike(CONTRACT_TEXT), "fallback-contract").otherwise("fallback"))


def telemetry_by_mode(events: DataFrame) -> DataFrame:
    """(endpoint, mode, calls, latency_sum, latency_calls, first_at, last_at): sums and counts, which merge; never averages."""
    return events.groupBy("endpoint", "mode").agg(F.count("*").alias("calls"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_sum"), F.count("latency_ms").alias("latency_calls"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def merge_totals(*totals: DataFrame) -> DataFrame:
    both = totals[0]
    for more in totals[1:]:
        both = both.unionByName(more)
    return both.groupBy("endpoint", "mode").agg(F.sum("calls").alias("calls"), F.sum("latency_sum").alias("latency_sum"), F.sum("latency_calls").alias("latency_calls"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def telemetry_rollup(events: DataFrame, totals: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(new totals, events that stay): rows before ``cutoff`` are folded into the totals."""
    return merge_totals(totals, telemetry_by_mode(events.where(F.col("created_at") < cutoff))), events.where(F.col("created_at") >= cutoff)


def telemetry_cumulative(events: DataFrame, totals: DataFrame) -> DataFrame:
    """(endpoint, mode, calls, avg_latency_ms, since): totals and the raw rows after the latest moment in any total."""
    edge = totals.agg(F.max("last_at").alias("edge"))
    fresh = events.crossJoin(F.broadcast(edge)).where("edge is null or created_at > edge").drop("edge")  # one row
    merged = merge_totals(totals, telemetry_by_mode(fresh))
    return merged.select("endpoint", "mode", "calls", F.when(F.col("latency_calls") > 0, js_round(F.col("latency_sum") / F.col("latency_calls"))).alias("avg_latency_ms"), F.col("first_at").alias("since"))


def telemetry_stats(by_mode: DataFrame) -> DataFrame:
    """(endpoint, calls, live_calls, paid_calls, oss_calls, fallback_calls, guarded_calls, avg_latency_ms), and a row for all with a null endpoint and ``live_percent``.

    ``by_mode`` has endpoint, mode, calls, avg_latency_ms; averages are weighted by calls.
    """
    mode, n = F.col("mode"), F.col("calls")
    rows = by_mode.where("endpoint is not null and calls > 0")
    part = lambda test, name: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias(name)
    out = rows.rollup("endpoint").agg(
        F.sum("calls").alias("calls"), part(is_live(mode), "live_calls"), part(is_live(mode) & ~is_oss(mode), "paid_calls"), part(is_oss(mode), "oss_calls"), part(is_fallback(mode), "fallback_calls"), part(mode == "guarded", "guarded_calls"),
        js_round(F.sum(F.col("avg_latency_ms") * n) / F.sum(F.when(F.col("avg_latency_ms").isNotNull(), n))).alias("avg_latency_ms"),
    )
    return out.withColumn("live_percent", js_round(F.col("live_calls") / F.col("calls") * 100))


def failure_counts(by_mode: DataFrame) -> DataFrame:
    rows = by_mode.where(is_fallback(F.col("mode")))
    return rows.groupBy("mode").agg(F.sum("calls").alias("calls")).withColumn("classified", F.col("mode") != "fallback")


def cost_usd() -> Column:
    """Cost of a row, exact; a call is billed for its tokens, whatever answered in the end."""
    total = F.lit(0).cast("decimal(18,8)")
    for c, price in PRICES.items():
        total = total + F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)") * F.lit(price).cast("decimal(6,2)") / F.lit(1_000_000).cast("decimal(8,0)")
    return total.cast("decimal(18,8)")


def billed(events: DataFrame) -> DataFrame:
    any_tokens = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in PRICES)) > 0
    return events.where(any_tokens).withColumn("cost", cost_usd())


def spend_24h(events: DataFrame, key: str = "account", calls: int = 1, limit: float = LIMIT_USD) -> DataFrame:
    """Each billed row with what its account spent in the 24 hours up to it, whether ``calls`` more are admitted, and what is left."""
    rows = billed(events)
    last_day = Window.partitionBy(key).orderBy(micros("created_at")).rangeBetween(-86_400_000_000 + 1, 0)
    spent = F.sum("cost").over(last_day).cast("double")
    return spend_verdict(rows.withColumn("spent_24h", spent), calls, limit)


def spend_verdict(rows: DataFrame, calls: int = 1, limit: float = LIMIT_USD) -> DataFrame:
    """``rows`` with whether ``calls`` more are admitted after ``spent_24h``, and what is left."""
    return rows.withColumns({"admitted": F.col("spent_24h") + calls * RESERVE_USD <= limit, "remaining": F.greatest(F.lit(0.0), js_round((limit - F.col("spent_24h")) * 1000) / 1000)})


def spend_now(events: DataFrame, now: Column, key: str = "account", calls: int = 1, limit: float = LIMIT_USD) -> DataFrame:
    """(account, spent, admitted, remaining) at one moment."""
    rows = billed(events.where((F.col("created_at") >= now - F.expr("interval 1 day")) & (F.col("created_at") <= now)))
    out = rows.groupBy(key).agg(F.sum("cost").cast("double").alias("spent"))
    return out.withColumns({"admitted": F.col("spent") + calls * RESERVE_USD <= limit, "remaining": F.greatest(F.lit(0.0), js_round((limit - F.col("spent")) * 1000) / 1000)})


def bucket_usage(hits: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """(bucket, live): hits of each bucket within its own window (bucket, seconds).

    ``windows``, a row a bucket, goes to the hits if it has 100,000 rows at most, so that a hot bucket isn't shuffled.
    """
    few = windows.select("bucket").limit(100_001).count() <= 100_000
    joined = hits.join(windows.select("bucket", "seconds").hint("broadcast" if few else "merge"), "bucket")
    return joined.where((micros("ts") > micros(now) - F.col("seconds").cast("long") * 1_000_000) & (F.col("ts") <= now)).groupBy("bucket").agg(F.count("*").alias("live"))


def admit_requests(requests: DataFrame, max_hits: int, seconds: int, key: str = "bucket", ts: str = "ts", order: str = "request_id") -> DataFrame:
    """``requests`` with ``accepted``: a replay of the limit: a request passes if fewer than ``max_hits`` that passed lie within the last ``seconds``.

    Only what passed counts, so each decision needs the last ``max_hits`` passes; a bucket's rows stream through sorted
    and the state is that short list, carried over Arrow batches.
    """
    import pyarrow as pa

    schema = requests.withColumn("accepted", F.lit(True)).schema

    def replay(batches):
        current, passed = None, []
        for batch in batches:
            out = []
            for bucket, micros in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if bucket != current:
                    current, passed = bucket, []
                passed = [t for t in passed if t > micros - seconds * 1_000_000]
                good = len(passed) < max_hits
                if good:
                    passed.append(micros)
                out.append(good)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.bool_())], names=[*batch.schema.names[:-2], "accepted"])

    sorted_rows = requests.withColumn("_key", F.col(key).cast("string")).repartition("_key").withColumn("_at", micros(ts)).sortWithinPartitions("_key", "_at", order)
    return sorted_rows.mapInArrow(replay, schema)
