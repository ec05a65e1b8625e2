"""Voice-of-customer aggregates: periods, causes, agents, spikes, self-checks, reports.

``calls`` have call_id, day (date), agent, minutes, category, sentiment, escalate.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callspark.functions.text import js_round, round_to

# The domains that always have a row, and the two sentiments that count as negative.
CATEGORIES = ("가입", "해지", "요금", "불만", "기타")
SENTIMENTS = ("긍정", "중립", "부정", "강성")
NEGATIVE = ("부정", "강성")
HOT = "강성"
UNASSIGNED = "미지정"
PRESETS = {"today": 1, "yesterday": 1, "week": 7}


# ---- periods ----------------------------------------------------------------------------------------------


def anchor_date(calls: DataFrame, fallback: datetime.date | None = None) -> DataFrame:
    """(anchor): the latest valid day, else ``fallback``."""
    return calls.agg(F.coalesce(F.max("day"), F.lit(fallback).cast("date")).alias("anchor"))


def resolve_period(anchor: DataFrame, preset: str, days: int | None = None) -> DataFrame:
    """(start, end, days): both ends count. 'all' has neither."""
    if preset == "all":
        return anchor.select(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(None).cast("int").alias("days"))
    n, back = days or PRESETS[preset], int(preset == "yesterday")
    return anchor.select(F.date_sub("anchor", back + n - 1).alias("start"), F.date_sub("anchor", back).alias("end"), F.lit(n).alias("days"))


def previous_range(period: DataFrame) -> DataFrame:
    """The range of the same length right before."""
    return period.select(F.expr("date_sub(start, days)").alias("start"), F.date_sub("start", 1).alias("end"), "days")


def split_period(calls: DataFrame, preset: str, anchor: DataFrame | None = None, days: int | None = None) -> DataFrame:
    """``calls`` of the period and the one before, with ``period`` ('current' or 'previous'); undated calls only in 'all'."""
    if preset == "all":
        return calls.withColumn("period", F.lit("current"))
    now = resolve_period(anchor_date(calls) if anchor is None else anchor, preset, days)
    ranges = now.withColumn("period", F.lit("current")).union(previous_range(now).withColumn("period", F.lit("previous")))
    return calls.join(F.broadcast(ranges.select("start", "end", "period")), F.col("day").between(F.col("start"), F.col("end"))).drop("start", "end")  # two rows


def comparable(split: DataFrame) -> DataFrame:
    """(comparable): whether the period before has any call."""
    return split.agg((F.count_if(F.col("period") == "previous") > 0).alias("comparable"))


# ---- aggregates -------------------------------------------------------------------------------------------


def voc_summary(calls: DataFrame, categories=CATEGORIES, sentiments=SENTIMENTS, hot=NEGATIVE) -> DataFrame:
    """(axis, value, calls, escalated, hot, timed, avg_minutes) by category and sentiment (zero rows for the whole domain,
    values outside it ignored), by day, and in total; one pass over the calls."""
    rows = calls.select("category", "sentiment", F.date_format("day", "yyyy-MM-dd").alias("date"), F.coalesce("escalate", F.lit(False)).alias("escalate"), F.col("sentiment").isin(*hot).alias("hot"), "minutes")
    axis = F.when(F.grouping("category") == 0, "category").when(F.grouping("sentiment") == 0, "sentiment").when(F.grouping("date") == 0, "date").otherwise("total")
    sets = rows.groupingSets([["category"], ["sentiment"], ["date"], []], "category", "sentiment", "date").agg(
        axis.alias("axis"), F.count("*").alias("calls"), F.count_if("escalate").alias("escalated"), F.count_if("hot").alias("hot"), F.count("minutes").alias("timed"), F.avg("minutes").alias("avg_minutes"),
    )
    sets = sets.select("axis", F.coalesce("category", "sentiment", "date", F.lit("")).alias("value"), "calls", "escalated", "hot", "timed", "avg_minutes")
    domain = calls.sparkSession.createDataFrame([("category", c) for c in categories] + [("sentiment", s) for s in sentiments], "axis string, value string")
    fixed = domain.join(sets.where("axis in ('category', 'sentiment')").hint("merge"), ["axis", "value"], "left").fillna(0, ["calls", "escalated", "hot", "timed"])
    return fixed.unionByName(sets.where("axis = 'total' or axis = 'date' and value <> ''"))


def aggregate_themes(themes: DataFrame) -> DataFrame:
    """(team_name, theme, label, calls, evidence): counts by cause, and by department where theme is null; three lines of evidence a cause."""
    counts = themes.rollup("team_name", "theme").agg(F.count("*").alias("calls"), F.max("label").alias("label"), F.grouping("theme").alias("g")).where("team_name is not null")
    lines = themes.select("theme", "call_id", F.posexplode("evidence").alias("n", "line")).groupBy("theme", "line").agg(F.min(F.struct("call_id", "n")).alias("at"))
    first = lines.withColumn("_n", F.row_number().over(Window.partitionBy("theme").orderBy("at"))).where("_n <= 3")
    quotes = first.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]).alias("evidence"))
    return counts.join(quotes.hint("merge"), "theme", "left").select("team_name", "theme", F.when(F.col("g") == 0, F.col("label")).alias("label"), "calls", "evidence")


def tagging_rates(calls: DataFrame, themes: DataFrame, repeats: DataFrame) -> DataFrame:
    """(total, untagged, repeats, tagged_rate); the rate of no calls is null."""
    marked = calls.select("call_id").join(themes.select("call_id").distinct().withColumn("t", F.lit(1)).hint("merge"), "call_id", "left").join(repeats.select("call_id").distinct().withColumn("r", F.lit(1)).hint("merge"), "call_id", "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.isnull("t")).alias("untagged"), F.count("r").alias("repeats")).withColumn("tagged_rate", F.when(F.col("total") > 0, (F.col("total") - F.col("untagged")) / F.col("total")))


def compare_themes(themes: DataFrame) -> DataFrame:
    """(theme, team_name, calls, previous, delta, is_new, is_gone) from causes with ``period``; causes of either period."""
    counts = themes.groupBy("period", "theme").agg(F.count("*").alias("n"), F.max("team_name").alias("team_name"))
    side = lambda period, n: counts.where(F.col("period") == period).select("theme", F.col("n").alias(n), F.col("team_name").alias(f"team_{n}"))
    both = side("current", "calls").join(side("previous", "previous").hint("merge"), "theme", "full")
    now, before = F.coalesce("calls", F.lit(0)), F.coalesce("previous", F.lit(0))
    return both.select("theme", F.coalesce("team_calls", "team_previous").alias("team_name"), now.alias("calls"), before.alias("previous"), (now - before).alias("delta"), F.isnull("previous").alias("is_new"), F.isnull("calls").alias("is_gone"))


def aggregate_by_agent(calls: DataFrame, repeats: DataFrame | None = None, min_sample: int = 3, negative=NEGATIVE, unassigned: str = UNASSIGNED) -> DataFrame:
    """(agent, calls, negative, escalated, repeats, rates, avg_minutes, timed, small_sample); rates are null under ``min_sample`` calls."""
    rows = calls.withColumn("agent", F.coalesce(F.nullif(F.trim("agent"), F.lit("")), F.lit(unassigned)))
    rows = rows.withColumn("again", F.lit(False)) if repeats is None else rows.join(repeats.select("call_id", F.lit(True).alias("again")).hint("merge"), "call_id", "left").fillna(False, ["again"])
    out = rows.groupBy("agent").agg(
        F.count("*").alias("calls"), F.count_if(F.col("sentiment").isin(*negative)).alias("negative"), F.count_if(F.coalesce("escalate", F.lit(False))).alias("escalated"), F.count_if("again").alias("repeats"),
        F.avg("minutes").alias("avg_minutes"), F.count("minutes").alias("timed"),
    )
    rate = lambda c: F.when(F.col("calls") >= min_sample, F.col(c) / F.col("calls")).alias(f"{c}_rate")
    return out.select("agent", "calls", "negative", "escalated", "repeats", rate("negative"), rate("escalated"), rate("repeats"), round_to("avg_minutes", 1).alias("avg_minutes"), "timed", (F.col("calls") < min_sample).alias("small_sample"))


def agent_order(agents: DataFrame, unassigned: str = UNASSIGNED) -> DataFrame:
    return agents.orderBy(F.col("agent") == unassigned, F.desc("calls"), "agent")


# ---- spikes -----------------------------------------------------------------------------------------------


def spikes(events: DataFrame, key: str, recent_days: int = 1, least: int = 3, ratio: float = 2.0, high: float = 3.0, days: DataFrame | None = None) -> DataFrame:
    """(key, now, baseline_per_day, ratio, level) of the values of ``key`` that rose.

    Days are the distinct days seen in ``days`` (default: in ``events``), not calendar days; recent + 2 of them are needed. A value
    without a past has ratio null and level high.
    """
    seen = (events if days is None else days).where("day is not null").select("day").distinct()
    ranked = seen.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("day"))))  # one row a day
    n_days = ranked.agg(F.count("*").alias("n_days"))
    rows = events.where(F.col("day").isNotNull() & F.col(key).isNotNull()).groupBy("day", key).agg(F.count("*").alias("n")).join(F.broadcast(ranked), "day")
    recent = F.col("rank") <= recent_days
    counts = rows.groupBy(key).agg(F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("now"), F.coalesce(F.sum(F.when(~recent, F.col("n"))), F.lit(0)).alias("past"))
    counts = counts.crossJoin(F.broadcast(n_days)).where(f"n_days >= {recent_days + 2} and now >= {least}")
    base = F.col("past") / (F.col("n_days") - recent_days)
    counts = counts.withColumn("base", base).withColumn("r", F.when(F.col("base") > 0, F.col("now") / recent_days / F.col("base"))).where(f"r is null or r >= {ratio}")
    return counts.select(key, "now", round_to("base", 1).alias("baseline_per_day"), round_to("r", 1).alias("ratio"), F.when(F.col("r").isNull() | (F.col("r") >= high), "high").otherwise("warn").alias("level"))


def category_spikes(calls: DataFrame, **options) -> DataFrame:
    return spikes(calls, "category", **options)


def theme_spikes(calls: DataFrame, themes: DataFrame, **options) -> DataFrame:
    """Spikes of causes, with their department; days are those that have any call."""
    found = spikes(calls.select("call_id", "day").join(themes.select("call_id", "theme").hint("merge"), "call_id"), "theme", days=calls, **options)
    return found.join(themes.groupBy("theme").agg(F.max("team_name").alias("team_name")).hint("merge"), "theme", "left")


def ratio_alerts(calls: DataFrame, hot: str = HOT, hot_share: float = 0.25, escalate_share: float = 0.30, least: int = 5) -> DataFrame:
    """(alert_id, level, calls, hits) over analysed calls (those with a category or sentiment)."""
    one = calls.where("category is not null or sentiment is not null").agg(F.count("*").alias("calls"), F.count_if(F.col("sentiment") == hot).alias("hot"), F.count_if(F.coalesce("escalate", F.lit(False))).alias("escalated")).where(f"calls >= {least}")
    each = one.select("calls", F.explode(F.array(F.struct(F.lit("hot-ratio").alias("alert_id"), F.lit("high").alias("level"), F.col("hot").alias("hits"), F.lit(hot_share).alias("share")), F.struct(F.lit("escalate-ratio").alias("alert_id"), F.lit("warn").alias("level"), F.col("escalated").alias("hits"), F.lit(escalate_share).alias("share")))).alias("a"))
    return each.where("a.hits / calls >= a.share").select("a.alert_id", "a.level", "calls", "a.hits")


def repeat_alert(calls: DataFrame, repeats: DataFrame, share: float = 0.15, least: int = 5) -> DataFrame:
    one = calls.select("call_id").join(repeats.select("call_id", F.lit(1).alias("r")).hint("merge"), "call_id", "left").agg(F.count("*").alias("calls"), F.count("r").alias("hits"))
    return one.where(f"calls >= {least} and hits / calls >= {share}").select(F.lit("repeat-ratio").alias("alert_id"), F.lit("warn").alias("level"), "calls", "hits")


def voc_anomalies(calls: DataFrame, themes: DataFrame, repeats: DataFrame) -> DataFrame:
    """(ord, alert_id, level, now): share alerts, repeats, category spikes, cause spikes, in this order."""
    shares = ratio_alerts(calls).select(F.lit(0).alias("ord"), "alert_id", "level", F.col("hits").alias("now"))
    again = repeat_alert(calls, repeats).select(F.lit(1).alias("ord"), "alert_id", "level", F.col("hits").alias("now"))
    kinds = category_spikes(calls).select(F.lit(2).alias("ord"), F.concat(F.lit("spike-"), "category").alias("alert_id"), "level", "now")
    causes = theme_spikes(calls, themes).select(F.lit(3).alias("ord"), F.concat(F.lit("theme-"), "theme").alias("alert_id"), "level", "now")
    return shares.unionByName(again).unionByName(kinds).unionByName(causes)


# ---- self-check, histories, reports -----------------------------------------------------------------------

# Words that are no suggestion, and the particles cut from a word's end.
# fmt: off
STOPWORDS = (
    "그런데", "그러면", "그리고", "그래서", "하지만", "그거", "이거", "저거", "뭐가", "어떻게", "있나요", "없나요", "인가요", "건가요", "거예요", "입니다", "합니다", "해주세요", "주세요", "알겠습니다",
    "감사합니다", "안녕하세요", "네네", "아니요", "괜찮아요", "지금", "오늘", "내일", "어제", "한번", "다시", "진짜", "정말", "조금", "많이", "아주", "너무", "제가", "저는", "고객", "상담사", "확인",
    "문의", "말씀", "전화", "통화", "부탁", "가능", "경우", "내용", "관련",
)
# fmt: on
_TAIL = "(이랑|에서|에게|한테|까지|부터|으로|로서|로써|보다|처럼|만큼|이나|라도|이라도|은|는|이|가|을|를|의|에|와|과|도|만|로|랑)$"


def suggest_terms(untagged: DataFrame, known: DataFrame, text: str = "speech", least: int = 2, top: int = 8, stopwords=STOPWORDS, tail: str = _TAIL) -> DataFrame:
    """(term, calls, examples): the ``top`` words in most untagged calls that no rule knows (``known``: term) - a top-k report.

    The two examples of a word are its first calls. Words are made distinct within each row and counted without their lines; only if a
    call has several rows are its (call, word) pairs shuffled. Lines are read again for the at most 2 * ``top`` calls that are shown.
    """

    def terms(c: str) -> Column:
        bare = F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, "[^가-힣a-zA-Z0-9]", ""))
        return F.transform(bare, lambda w: F.when(F.length(w) <= 2, w).otherwise(F.coalesce(F.nullif(F.regexp_replace(w, tail, ""), F.lit("")), w)))

    said = untagged.select("call_id", F.explode(F.array_distinct(terms(text))).alias("term")).where(F.length("term") >= 2).where(~F.col("term").isin(*stopwords))
    if not untagged.where(F.col(text).isNotNull()).groupBy("call_id").count().where("count > 1").isEmpty():
        said = said.distinct()
    counted = said.groupBy("term").agg(F.count("*").alias("calls")).where(f"calls >= {least}").join(known.select("term").distinct().hint("merge"), "term", "left_anti")
    best = counted.orderBy(F.desc("calls"), "term").limit(top)
    first = said.join(F.broadcast(best), "term").withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy("call_id"))).where("_n <= 2")
    lines = untagged.join(F.broadcast(first), untagged["call_id"].eqNullSafe(first["call_id"])).select("term", "calls", "_n", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    shown = lines.where(F.array_contains(terms("line"), F.col("term")))
    rows = shown.groupBy("term", "_n").agg(F.max("calls").alias("calls"), F.min_by("line", "line_no").alias("line"))
    quoted = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring(F.trim("line"), 1, 60).alias("line")))), lambda x: x["line"])
    return rows.groupBy("term").agg(F.max("calls").alias("calls"), quoted.alias("examples"))


def self_check(calls: DataFrame, themes: DataFrame, repeats: DataFrame, routes: DataFrame, pii: DataFrame | None = None, n_suggestions: DataFrame | None = None) -> DataFrame:
    """One row: totals, rates (null over no calls) and the gap alerts in order."""
    rates = tagging_rates(calls, themes, repeats)
    default = routes.agg(F.count_if(F.col("team") == "general").alias("routed_default"))
    hits = (calls.limit(1).agg(F.lit(0).cast("long").alias("pii_total"))) if pii is None else pii.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pii_total"))
    n = calls.limit(1).agg(F.lit(0).cast("long").alias("suggestions")) if n_suggestions is None else n_suggestions.agg(F.count("*").alias("suggestions"))
    one = rates.crossJoin(F.broadcast(default)).crossJoin(F.broadcast(hits)).crossJoin(F.broadcast(n))  # one row each
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total"))
    one = one.withColumns({"default_route_rate": rate("routed_default"), "repeat_rate": rate("repeats")})
    untagged, routed, found = F.coalesce(rate("untagged") > 0.2, F.lit(False)), F.coalesce(F.col("default_route_rate") > 0.3, F.lit(False)), F.col("suggestions") > 0
    none = (F.col("total") > 0) & ~untagged & ~routed & ~found
    left = (F.col("untagged") > 0) | (F.col("routed_default") > 0)
    gaps = [("gap-untagged", untagged), ("gap-default-route", routed), ("gap-suggestions", found), ("gap-empty", F.col("total") == 0), ("gap-minor", none & left), ("gap-none", none & ~left)]
    return one.withColumn("gaps", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in gaps))))


def qa_history_summary(history: DataFrame, key: str = "label", order: str = "eval_no") -> DataFrame:
    """Per ``key``: count, mean, estimated, the trend between the first and the last half (from four rows; 3 points up or down)."""
    rows = history.where("total is not null")
    w = Window.partitionBy(key)
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy(order)), "n": F.count("*").over(w)}).withColumn("half", F.floor(F.col("n") / 2))
    out = rows.groupBy(key).agg(
        F.count("*").alias("evaluations"), js_round(F.avg("total")).alias("average"), F.count_if("estimated").alias("estimated"), F.max_by("total", order).alias("latest"),
        F.avg(F.when(F.col("i") <= F.col("half"), F.col("total"))).alias("early"), F.avg(F.when(F.col("i") > F.col("n") - F.col("half"), F.col("total"))).alias("late"),
    )
    delta = F.when(F.col("evaluations") >= 4, js_round(F.col("late") - F.col("early")))
    trend = F.when(delta >= 3, "up").when(delta <= -3, "down").when(delta.isNotNull(), "flat")
    return out.select(key, "evaluations", "average", "estimated", "latest", delta.alias("delta"), trend.alias("trend"))


def qa_history_tops(history: DataFrame, column: str, key: str = "label", top: int = 5) -> DataFrame:
    """(key, item, times): the most frequent entries of an array column (missed, violations) - a top-k report."""
    counts = history.where("total is not null").select(key, F.explode(column).alias("item")).groupBy(key, "item").agg(F.count("*").alias("times"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("times"), "item"))).where(F.col("_n") <= top).drop("_n")


def qa_history_cards(history: DataFrame, key: str = "label") -> DataFrame:
    """(key, card, level, item): what to coach: repeated misses and violations, and the trend."""
    facts = qa_history_summary(history, key)
    top = lambda c: qa_history_tops(history, c, key, 1).where("times >= 2")
    missed = top("missed").join(facts.hint("merge"), key).select(key, F.lit("missed").alias("card"), F.when(F.col("times") / F.col("evaluations") >= 0.5, "high").otherwise("warn").alias("level"), "item")
    broken = top("violations").select(key, F.lit("violation").alias("card"), F.lit("high").alias("level"), "item")
    trend = facts.where("trend in ('up', 'down')").select(key, F.concat(F.lit("trend-"), "trend").alias("card"), F.when(F.col("trend") == "down", "warn").otherwise("ok").alias("level"), F.lit(None).cast("string").alias("item"))
    some = missed.union(broken).union(trend)
    calm = facts.join(some.select(key).hint("merge"), key, "left_anti").select(key, F.lit("none").alias("card"), F.lit("ok").alias("level"), F.lit(None).cast("string").alias("item"))
    return some.union(calm)


# The wording of the report.
_NO_MOOD = "감정 분포 데이터가 없어 품질 모니터링 대상은 판단하지 않았습니다."
_NO_SORE = "이번 집계에는 강성·부정 감정으로 분류된 통화가 없습니다."
_SORE_CALLS = "강성·부정 감정 통화가 "
_SORE_END = " 있어 품질 모니터링이 필요합니다."
_HEADLINE = "총 %d건 중 '%s' 유형이 %d건으로 최다, 에스컬레이션 %d건 대기"
_FINDING = "%s 문의가 %d건으로 가장 많아 반복 문의 소지가 있습니다."
_ADVICE = "%s 유형의 자주 묻는 절차를 상담 스크립트/ARS 안내로 선제 제공"


def voc_report(summary: DataFrame, negative=NEGATIVE) -> DataFrame:
    """(headline, finding, negative_finding, recommendation) from ``voc_summary``; no model."""
    one = summary.agg(
        F.max(F.when(F.col("axis") == "total", F.col("calls"))).alias("total"), F.max(F.when(F.col("axis") == "total", F.col("escalated"))).alias("escalated"),
        F.max(F.when(F.col("axis") == "category", F.struct(F.col("calls").alias("n"), "value"))).alias("top"), F.sum(F.when((F.col("axis") == "sentiment") & F.col("value").isin(*negative), F.col("calls"))).alias("negative"),
    )
    share = F.when(F.col("total") > 0, F.concat(F.lit(" (전체 "), F.col("total").cast("string"), F.lit("건 중 "), js_round(F.col("negative") / F.col("total") * 100).cast("string"), F.lit("%)"))).otherwise("")
    sore = F.when(F.col("negative").isNull(), _NO_MOOD).when(F.col("negative") == 0, _NO_SORE)
    sore = sore.otherwise(F.concat(F.lit(_SORE_CALLS), F.col("negative").cast("string"), F.lit("건"), share, F.lit(_SORE_END)))
    return one.select(
        F.format_string(_HEADLINE, "total", "top.value", "top.n", "escalated").alias("headline"), F.format_string(_FINDING, "top.value", "top.n").alias("finding"),
        sore.alias("negative_finding"), F.format_string(_ADVICE, "top.value").alias("recommendation"),
    )


def verify_report_numbers(reports: DataFrame, counts: DataFrame) -> DataFrame:
    """(report_id, ok, unknown): numbers in the texts must be 0 to 10, a count, or a count's share of the total in percent.

    ``reports`` (report_id, texts), ``counts`` (report_id, total, n): a row per count, the total among them.
    """
    said = reports.select("report_id", F.explode("texts").alias("t")).select("report_id", F.explode(F.regexp_extract_all("t", F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))).alias("x"))
    said = said.select("report_id", F.expr("try_cast(replace(x, ',', '') as double)").alias("n")).where("n is not null").distinct()
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100)
    allowed = counts.select("report_id", F.explode(F.array(F.col("n").cast("double"), js_round(share).cast("double"), round_to(share, 1))).alias("n")).where("n is not null").distinct()
    unknown = said.where("not (n between 0 and 10 and n = floor(n))").join(allowed.hint("merge"), ["report_id", "n"], "left_anti").groupBy("report_id").agg(F.array_sort(F.collect_list("n")).alias("unknown"))
    return reports.select("report_id").join(unknown.hint("merge"), "report_id", "left").select("report_id", F.isnull("unknown").alias("ok"), F.coalesce("unknown", F.array().cast("array<double>")).alias("unknown"))
