"""Handlers of ordered streams take many keys at once, and keep them apart."""

import pandas as pd

from callspark.streaming.ordered import _Admission


class _List:
    def __init__(self):
        self.rows, self.writes = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.writes = list(rows), self.writes + 1

    def appendValue(self, row):
        self.rows, self.writes = [*self.rows, row], self.writes + 1

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, _List())

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _settle(rule, handle, ms):
    handle.timers.clear()  # it has expired
    return [tuple(r) for out in rule.handleExpiredTimer((0,), _Watermark(ms), None) for r in out.itertuples(index=False)]


def test_many_keys_in_one_call():
    rule, handle = _Admission(1, 10), _Handle()
    rule.init(handle)
    hits = [(f"={k}", at * 1_000_000, f"{k}-{at}") for k in range(500) for at in (20, 5, 12)]
    list(rule.handleInputRows((0,), iter([pd.DataFrame(hits, columns=["key", "at", "request_id"])]), _Watermark(0)))
    assert handle.timers == [5001] and handle.states["held"].writes == 1
    got = _settle(rule, handle, 15_000)
    assert sorted(got) == sorted((f"={k}", f"{k}-{at}", at * 1_000_000, at == 5) for k in range(500) for at in (5, 12))
    assert handle.timers == [20_001] and not handle.states["past"].rows  # what waits; a pass at 5 s has left the window
    assert sorted(_settle(rule, handle, 30_500)) == sorted((f"={k}", f"{k}-20", 20_000_000, True) for k in range(500))
    assert not handle.states["held"].rows and not handle.states["past"].rows and not handle.timers


def test_null_and_other_keys(spark):
    import datetime

    from callspark.plans import fixtures as fx
    from callspark.streaming import jobs

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(None, "a.", at(0)), (1, "a.", at(1)), (2**60 + 1, "b.", at(1)), (7, "late.", at(9_000))]
    stream, feeds = fx.fed(spark.createDataFrame(rows, "call_id long, word string, ts timestamp"), "ts")
    jobs.use_rocksdb(spark)
    try:
        got = jobs.drain(jobs.utterances_live(stream), feeds=feeds).select("call_id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {tuple(r) for r in got} == {(None, "a."), (1, "a."), (2**60 + 1, "b.")} and len(got) == 3
