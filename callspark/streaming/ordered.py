"""Stateful jobs that decide in event-time order: utterances, rolling spend, admission.

Rows wait in state until the watermark has passed them; then those of each key are settled in the order of their
time, so a result doesn't depend on how rows fall into batches. A handler is called for a group of keys (``buckets`` groups by hash,
a number that stays with a checkpoint), as a call with its reads and writes of state takes far longer than a key's few rows. A group has one
timer at most, for the next moment at which one of its keys can settle something, and its rows are written once a batch.

Cases: rows without a time, or behind the watermark, are dropped. Ties of time follow the order column. State is what waits
(rows within the delay), and what the rule still looks back to; a task holds that of one group at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callspark.functions.text import micros
from callspark.operators.telemetry import LIMIT_USD, billed, spend_verdict

WATERMARK = "10 minutes"
#: Groups that keys are dealt over.
BUCKETS = 1024


def _micros_of(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1_000_000)


class _Ordered(StatefulProcessor):
    """``waiting`` is the schema of a row (``at`` in microseconds first), ``kept`` that of what ``settle`` looks back to."""

    waiting: str
    kept: str
    result: str

    def settle(self, kept: list[tuple], ready: list[tuple], edge: int) -> tuple[list[tuple], list[tuple], int | None]:
        """For one key: (rows out, new ``kept``, moment in microseconds at which ``kept`` alone must be looked at again)."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = ["key", *(x.split()[0] for x in self.waiting.split(", "))]
        self.columns = ["key", *(x.split()[0] for x in self.result.split(", "))]
        # rows are packed, many to a value: written one by one they take longer than all else
        self.held, self.past = (handle.getListState(name, "rows binary") for name in ("held", "past"))

    def _read(self, state) -> Iterator[tuple]:
        for (rows,) in state.get() if state.exists() else ():
            yield from pickle.loads(rows)

    def _write(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put([(pickle.dumps(rows),)])
        else:
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moments = []
        for frame in rows:
            if len(frame):
                self.held.appendValue((pickle.dumps(list(zip(*(frame[c].tolist() for c in self.names)))),))
                moments.append(int(frame["at"].min()))
        timers = list(self.handle.listTimers())
        if moments and (not timers or min(moments) // 1000 + 1 < min(timers)):
            for at in timers:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(min(moments) // 1000 + 1)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[str, tuple[list[tuple], list[tuple]]] = {}
        for of, *row in self._read(self.past):
            due.setdefault(of, ([], []))[0].append(tuple(row))
        held, out, kept = [], [], []
        for of, *row in self._read(self.held):
            if row[0] < edge:
                due.setdefault(of, ([], []))[1].append(tuple(row))
            else:
                held.append((of, *row))
        moments = [row[1] for row in held]
        for of, (past, ready) in due.items():
            rows, left, again = self.settle(past, sorted(ready), edge)
            out += [(of, *r) for r in rows]
            kept += [(of, *r) for r in left]
            if again is not None:
                moments.append(again)
        self._write(self.held, held)
        self._write(self.past, kept)
        if moments:
            self.handle.registerTimer(max(min(moments), edge) // 1000 + 1)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _settled(rows: DataFrame, key: str, ts: str, rule: _Ordered, buckets: int) -> DataFrame:
    """``rule``'s rows out, each behind its key; ``rows`` has the key, what waits, and the event time."""
    kind = rows.schema[key].dataType
    # a null key is a key of its own
    named = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    names = [x.split()[0] for x in rule.waiting.split(", ")]
    named = named.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket_no"), "key", *names, ts)
    out = named.groupBy("bucket_no").transformWithStateInPandas(statefulProcessor=rule, outputStructType=f"key string, {rule.result}", outputMode="Append", timeMode="EventTime")
    return out.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(key), *out.columns[1:])


class _Utterances(_Ordered):
    waiting = "at bigint, no bigint, until bigint, word string"
    kept = waiting
    result = "start bigint, end bigint, text string"

    def __init__(self, gap: int):
        self.gap = gap

    def settle(self, kept, ready, edge):
        out, said = [], kept

        def end() -> None:
            text = "".join(w if w[0] in ",.?!" else " " + w for *_, w in said)
            out.append((said[0][0], said[-1][2], text.strip()))
            said.clear()

        for row in ready:
            if said and row[0] - said[-1][2] >= self.gap:
                end()
            said.append(row)
            if row[3][-1] in ".?!。？！":
                end()
        if said and edge - said[-1][2] >= self.gap:
            end()
        return out, said, said[-1][2] + self.gap if said else None


def utterances_live(words: DataFrame, ts: str = "ts", until: str | None = None, order: str | None = None, gap: str = "800 milliseconds", delay: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """(call_id, start, end, text): the utterances of ``sessionise_words`` from a stream of words (call_id, word, ts).

    An utterance ends after a gap or a word that ends a sentence. ``until`` is the column of a word's end (else its
    start), ``order`` a number that orders words of one moment. A closed utterance comes once the watermark has passed
    its last word, an open one when no word can follow within the gap. Blank words are dropped.
    """
    rows = words.withColumn("word", F.trim("word")).where(f"word <> '' and {ts} is not null").withWatermark(ts, delay)
    at = micros(ts)
    ends = F.coalesce(micros(until), at) if until else at
    number = F.coalesce(F.col(order).cast("long"), F.lit(0)) if order else F.lit(0).cast("long")
    rows = rows.select("call_id", at.alias("at"), number.alias("no"), ends.alias("until"), "word", ts)
    said = _settled(rows, "call_id", ts, _Utterances(_micros_of(gap)), buckets)
    return said.select("call_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "text")


class _Spend(_Ordered):
    waiting = "at bigint, id string, units bigint"
    kept = "at bigint, units bigint"
    result = "request_id string, at bigint, units bigint"
    day = 86_400_000_000

    def settle(self, kept, ready, edge):
        out, first, total, k = [], 0, sum(u for _, u in kept), 0
        while k < len(ready):
            at, start = ready[k][0], k
            while k < len(ready) and ready[k][0] == at:  # rows of one moment see each other
                kept.append((at, ready[k][2]))
                total += ready[k][2]
                k += 1
            while kept[first][0] <= at - self.day:
                total -= kept[first][1]
                first += 1
            out += [(request, at, total) for _, request, _ in ready[start:k]]
        # what a later row, at the watermark or after, can still look back to
        left = [x for x in kept[first:] if x[0] > edge - self.day]
        return out, left, left[-1][0] + self.day if left else None


def spend_live(events: DataFrame, key: str = "account", ts: str = "created_at", request: str = "request_id", calls: int = 1, limit: float = LIMIT_USD, delay: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """(key, request_id, at, spent_24h, admitted, remaining) of each billed row, once the watermark has passed it: the rows of ``spend_24h``.

    The state of an account is its costs of the last 24 hours; it goes when they have left the window. Costs are whole
    units of a hundred millionth, so sums are exact.
    """
    rows = billed(events).where(f"{ts} is not null").withWatermark(ts, delay)
    rows = rows.select(F.col(key).alias("account"), micros(ts).alias("at"), F.coalesce(F.col(request).cast("string"), F.lit("")).alias("id"), (F.col("cost") * 100_000_000).cast("long").alias("units"), ts)
    spent = _settled(rows, "account", ts, _Spend(), buckets)
    spent = spent.select(F.col("account").alias(key), "request_id", F.timestamp_micros("at").alias("at"), (F.col("units") / 100_000_000.0).alias("spent_24h"))
    return spend_verdict(spent, calls, limit)


class _Admission(_Ordered):
    waiting = "at bigint, request_id string"
    kept = "at bigint"
    result = "request_id string, at bigint, accepted boolean"

    def __init__(self, max_hits: int, seconds: int):
        self.max_hits, self.span = max_hits, seconds * 1_000_000

    def settle(self, kept, ready, edge):
        passed, out = [at for (at,) in kept], []
        for at, request in ready:
            passed = [p for p in passed if p > at - self.span]
            good = len(passed) < self.max_hits
            if good:
                passed.append(at)
            out.append((request, at, good))
        passed = [p for p in passed if p > edge - self.span]
        return out, [(p,) for p in passed], passed[-1] + self.span if passed else None


def admit_stream(requests: DataFrame, max_hits: int, seconds: int, ts: str = "ts", delay: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, request_id, at, accepted) once the watermark has passed a request; the batch twin is ``admit_requests``. ``at`` is in microseconds.

    The state of a bucket is what waits and the last ``max_hits`` passes; it goes when those have left the window.
    """
    rows = requests.where(f"{ts} is not null").withWatermark(ts, delay)
    rows = rows.select(F.col("bucket").cast("string").alias("bucket"), F.coalesce(F.col("request_id").cast("string"), F.lit("")).alias("request_id"), micros(ts).alias("at"), ts)
    return _settled(rows, "bucket", ts, _Admission(max_hits, seconds), buckets)
