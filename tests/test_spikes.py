"""The spike and repeat queries read all of their texts and days: their rows follow from brute force over the given tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from callspark.plans import fixtures as fx
from callspark.plans import registry

SF = "/root/testdata/sf0.001"


def _said(spark):
    calls, days = defaultdict(list), {}
    for r in sorted(fx.turns(spark, SF).collect(), key=lambda r: (r.call_id, r.turn_no)):
        calls[r.call_id].append(r)
        days[r.call_id] = r.call_id % 14
    texts = {c: "\n".join([r.text for r in rows if r.speaker == "customer"] or [f"{r.speaker}: {r.text}" for r in rows]) for c, rows in calls.items()}
    return texts, days


def _counts(events, days):
    """Of each value: its number on the last three days and before."""
    recent = sorted(set(days), reverse=True)[:3]
    return Counter(v for v, d in events if d in recent), Counter(v for v, d in events if d not in recent), len(set(days))


def _risen(events, days, ratio):
    now, past, n = _counts(events, days)
    return {v: now[v] for v in now if n >= 5 and now[v] >= 3 and (past[v] == 0 or now[v] / 3 / (past[v] / (n - 3)) >= ratio)}


def test_category_spikes_count_three_days_of_all_orders(spark):
    rows = [(r.category, r.day) for r in fx.calls(spark, SF).collect()]
    found = {r.category: r.now for r in registry.queries()["n1_category_spikes"](spark, SF).collect()}
    assert found == _risen(rows, [d for _, d in rows], 0.9)


def test_theme_spikes_read_what_was_said(spark):
    texts, days = _said(spark)
    events = [(t[0], days[c]) for c, text in texts.items() for t in fx.THEMES if any(re.search(p, line) for p in t[-1] for line in ("\n" + text).split("\n"))]
    found = {r.theme: r.now for r in registry.queries()["n2_theme_spikes"](spark, SF).collect()}
    assert found == _risen(events, list(days.values()), 0.5)


def test_repeat_alert_reads_what_was_said(spark):
    texts, _ = _said(spark)
    hits = sum(any(re.search(p, x) for p in fx.REPEATS) for x in texts.values())
    found = [(r.calls, r.hits) for r in registry.queries()["n4_repeat_alert"](spark, SF).collect()]
    assert found == ([(len(texts), hits)] if len(texts) >= 5 and hits / len(texts) >= 0.01 else [])
