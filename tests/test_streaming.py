"""Streams over files, run to their end, against their batch twins."""

import datetime

from pyspark.sql import functions as F

from callspark.operators import telemetry, timeline
from callspark.plans import fixtures as fx
from callspark.streaming import jobs

T0 = datetime.datetime(2026, 1, 1)


def _stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def _events(spark):
    rows = [(k % 40, "qa" if k % 3 else "stt", "live", 100 + k, 1000 * k, k, None, None, T0 + datetime.timedelta(minutes=k), "x" if k % 2 else "y") for k in range(50)]
    return spark.createDataFrame(rows, "request_id int, endpoint string, mode string, latency_ms long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, created_at timestamp, account string")


def test_rollup_and_dedupe(spark, tmp_path):
    events = _events(spark)
    stream = _stream(spark, events, tmp_path / "in")
    jobs.telemetry_rollup_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late_path=str(tmp_path / "late")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(jobs.read_rollup(spark, str(tmp_path / "out")).collect()) == sorted(telemetry.telemetry_by_mode(events).collect())
    table = jobs.run_available(jobs.dedupe_requests(stream, delay="2 hours"), "deduped", str(tmp_path / "cp2"))
    assert table().count() == 40


def test_spend_and_counts_and_mask(spark, tmp_path):
    events = _events(spark)
    stream = _stream(spark, events, tmp_path / "in")
    spent = jobs.run_available(jobs.spend_stream(stream, window="1 hour", slide="1 hour"), "spent", str(tmp_path / "cp"), "complete")
    batch = telemetry.billed(events).groupBy("account").agg(F.sum("cost").cast("double").alias("spent"))
    assert {r.account: round(r.spent, 6) for r in spent().collect()} == {r.account: round(r.spent, 6) for r in batch.collect()}
    counts = jobs.run_available(jobs.daily_counts_stream(stream.withColumnRenamed("created_at", "ts"), "endpoint"), "counts", str(tmp_path / "cp2"), "complete")
    assert {r.endpoint: r.n for r in counts().collect()} == {"qa": 33, "stt": 17}
    texts = spark.createDataFrame([("헤지 010-1234-5678",)], "text string")
    masked = jobs.run_available(jobs.mask_stream(_stream(spark, texts, tmp_path / "t")), "masked", str(tmp_path / "cp3"))
    assert masked().first().outbound == "해지 010-****-5678"


def test_utterances(spark, tmp_path):
    rows = [("a", w, T0 + datetime.timedelta(milliseconds=ms)) for w, ms in (("one", 0), ("two", 500), ("three", 2000), ("last", 3_600_000))]
    stream = _stream(spark, spark.createDataFrame(rows, "call_id string, word string, ts timestamp"), tmp_path / "in")
    table = jobs.run_available(jobs.utterance_stream(stream), "spoken", str(tmp_path / "cp"))
    assert {r.words for r in table().collect()} >= {"one two", "three"}


def test_stateful_jobs(spark, tmp_path):
    jobs.use_rocksdb(spark)
    try:
        rows = [("a" if k % 3 else "b", T0 + datetime.timedelta(seconds=(k * 37) % 50), k) for k in range(60)] + [("z", T0 + datetime.timedelta(hours=2), 999)]
        requests = spark.createDataFrame(rows, "bucket string, ts timestamp, request_id int")
        stream = _stream(spark, requests, tmp_path / "in")
        table = jobs.run_available(jobs.admit_stream(stream, 2, 10, delay="1 minute"), "admitted", str(tmp_path / "cp"))
        got = {int(r.request_id): r.accepted for r in table().collect()}
        twin = {r.request_id: r.accepted for r in telemetry.admit_requests(requests.withColumn("request_id", F.col("request_id").cast("string")), 2, 10).collect()}
        assert got == {int(k): v for k, v in twin.items() if k != "999"}
        said = [("a", "agent", "안녕하세요 녹음됩니다", 0), ("a", "customer", "해지할게요", 1), ("b", "customer", "네", 2)]
        turns = spark.createDataFrame([(c, who, text, T0 + datetime.timedelta(minutes=k)) for c, who, text, k in said], "call_id string, speaker string, text string, ts timestamp")
        later = spark.createDataFrame([("c", "customer", "네", T0 + datetime.timedelta(hours=3)), ("d", "customer", "네", T0 + datetime.timedelta(hours=6))], turns.schema)
        again = spark.createDataFrame([("a", "customer", "네", T0 + datetime.timedelta(hours=7))], turns.schema)
        query = jobs.live_guide(_stream(spark, turns, tmp_path / "t")).writeStream.format("memory").queryName("guided").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).start()
        try:
            said = []
            for more in (None, later, again):
                if more is not None:
                    more.write.mode("append").parquet(str(tmp_path / "t"))
                query.processAllAvailable()
                said.append({(r.call_id, r.stage, r.alerts) for r in spark.table("guided").collect()})
            assert said[0] == {("a", "verify", "cancel-intent"), ("b", "open", "")}
            assert said[1] - said[0] == {("c", "open", ""), ("d", "open", "")}
            assert said[2] - said[1] == {("a", "open", "")}  # the call's state had expired
        finally:
            query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_ordered_jobs_in_several_runs(spark):
    """Rows that come out of order and in four stretches give what the batch twins give."""
    at = lambda seconds: T0 + datetime.timedelta(milliseconds=int(seconds * 1000))
    said = [("a", "one", 0), ("a", ".", 0.2), ("a", "two", 0.4), ("a", " ", 0.5), ("a", "three", 2), ("a", "four", 2.5), ("a", "five?", 600), ("a", "six", 600.1), ("b", "alone", 300), ("b", "끝。", 300.3), ("b", "open", 900)]
    # two far moments carry the watermark past all else in two steps
    said += [("z", "far", 5000), ("z", "further", 9000)]
    words = spark.createDataFrame([(c, w, at(s), at(s + 0.1), k) for k, (c, w, s) in enumerate(said)], "call_id string, word string, ts timestamp, until timestamp, no long")
    jobs.use_rocksdb(spark)
    try:
        stream, feeds = fx.fed(words, "ts", 4)
        got = jobs.drain(jobs.utterances_live(stream, until="until", order="no"), feeds=feeds).collect()
        micro = lambda c: F.unix_micros(c) / 1e6
        batch = timeline.sessionise_words(words.select("call_id", F.col("no").alias("word_no"), "word", micro("ts").alias("start"), micro("until").alias("end")))
        assert sorted((r.call_id, r.text) for r in got) == sorted((r.call_id, r.text) for r in batch.collect() if r.text != "further")
        ends = {(r.call_id, r.text): (r.start, r.end) for r in got}
        assert ends["a", "one."] == (at(0), at(0.3)) and ends["a", "three four"] == (at(2), at(2.6))

        hour = datetime.timedelta(hours=1)
        rows = [(k, "qa", "live", 1, 1000 * k, k, None, None, T0 + (k // 2) * 5 * hour, "x" if k % 3 else "y") for k in range(40)] + [(99, "qa", "live", 1, 0, 0, None, None, T0, "x")]
        events = spark.createDataFrame(rows, "request_id int, endpoint string, mode string, latency_ms long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, created_at timestamp, account string")
        stream, feeds = fx.fed(events, "created_at", 4)
        got = {int(r.request_id): (r.spent_24h, r.admitted, r.remaining) for r in jobs.drain(jobs.spend_live(stream), feeds=feeds).collect()}
        assert got == {r.request_id: (r.spent_24h, r.admitted, r.remaining) for r in telemetry.spend_24h(events).collect() if r.request_id < 38}

        hits = [("a" if k % 3 else "b", at((k * 37) % 50), k) for k in range(60)] + [("z", at(7200), 999)]
        requests = spark.createDataFrame(hits, "bucket string, ts timestamp, request_id int")
        stream, feeds = fx.fed(requests, "ts", 3)
        got = jobs.drain(jobs.admit_stream(stream, 2, 10, delay="1 minute"), feeds=feeds).collect()
        twin = telemetry.admit_requests(requests.withColumn("request_id", F.col("request_id").cast("string")), 2, 10)
        assert {r.request_id: r.accepted for r in got} == {r.request_id: r.accepted for r in twin.collect() if r.request_id != "999"}
        stream, feeds = fx.fed(requests.where("request_id < 999"), "ts", 3)
        assert jobs.drain(jobs.admit_stream(stream, 2, 10, delay="1 minute"), feeds=feeds).collect() == []  # the watermark has passed nothing
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_last_state_of_a_key(spark):
    turns = spark.createDataFrame([("a", "agent", "안녕하세요", T0), ("a", "agent", "어쩔 수 없습니다", T0 + datetime.timedelta(minutes=1)), ("b", "agent", "네", T0 + datetime.timedelta(minutes=2)), ("a", "customer", "해지할게요", T0 + datetime.timedelta(minutes=3))], "call_id string, speaker string, text string, ts timestamp")
    jobs.use_rocksdb(spark)
    try:
        stream, feeds = fx.fed(turns, "ts")
        rows = {r.call_id: r for r in jobs.drain_last(jobs.live_guide(stream), "call_id", feeds=feeds).collect()}
        assert set(rows) == {"a", "b"} and rows["a"].alerts == "cancel-intent" and rows["a"].forbidden == "dismissive" and rows["a"].progress == 20
        assert rows["b"].alerts == rows["b"].forbidden == "" and rows["b"].progress == 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
