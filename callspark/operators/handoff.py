"""What a processed call still needs, and the reports and ledgers that leave: status, checks, texts, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callspark.functions.text import mask_pii
from callspark.operators.turns import alerts

# The six stages in order and what is missing without each.
STAGES = ("stt", "lex", "dia", "analyze", "qa", "voc")
STAGE_LABELS = {"stt": "① 녹취 전사", "lex": "② 도메인 보정", "dia": "③ 화자 분리", "analyze": "④ 통화 분석", "qa": "⑤ Auto QA", "voc": "⑥ VOC 누적"}
LEVELS = {"high": 0, "warn": 1, "info": 2}
CSV_COLUMNS = ("날짜", "상담사", "제목", "유형", "감정", "에스컬레이션", "원인", "처리부서", "재문의", "이탈위험", "위험등급", "담당", "출처")


def run_status(runs: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, state, done, failed, pending, status, owner, priority, sla) from stages (call_id, stage, present, error).

    A failed stage is a row with an error, never hidden. Without an analysis nobody is assigned; with one, a call that needs
    a hand-off (``routes``: call_id, team_name, priority, sla) goes to its owner, and others close.
    """
    state = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("present", F.lit(False)), "done").otherwise("pending")
    wide = runs.withColumn("state", state).groupBy("call_id").pivot("stage", list(STAGES)).agg(F.max("state")).fillna("pending", list(STAGES))
    count = lambda what: sum((F.col(s) == what).cast("int") for s in STAGES)
    wide = wide.withColumns({"done": count("done"), "failed": count("failed"), "pending": count("pending")})
    out = wide.join(routes.select("call_id", "team_name", "priority", "sla").hint("merge"), "call_id", "left")
    known = F.col("analyze") == "done"
    own = lambda c: F.when(known, F.col(c))
    return out.select(
        "call_id", F.when(F.col("done") + F.col("failed") == 0, "none").when(F.col("done") == len(STAGES), "complete").otherwise("partial").alias("state"), "done", "failed", "pending",
        F.when(~known, "manual").when(F.col("team_name").isNotNull(), "route").otherwise("close").alias("status"), own("team_name").alias("owner"), own("priority").alias("priority"), own("sla").alias("sla"),
    )


def handoff_checks(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """(call_id, alert_id, level): what a person should look at, most urgent first by ``rank``, then ``ord``.

    ``calls`` has call_id, analyzed, escalate, churn_score, churn_labeled, churn_estimated, qa_labeled, qa_total, qa_estimated, withheld, truncated, demo.
    """
    number = F.create_map(*(x for k, s in enumerate(STAGES) for x in (F.lit(s), F.lit(k))))
    failed = runs.where("error is not null").select("call_id", F.concat(F.lit("stage-"), "stage").alias("alert_id"), F.when(F.col("stage").isin("analyze", "stt"), "high").otherwise("warn").alias("level"), (number[F.col("stage")] - 100).alias("ord"))
    lost = runs.where("error is not null and stage = 'dia'").select("call_id").distinct().withColumn("dia_failed", F.lit(True))
    rows = calls.join(lost.hint("merge"), "call_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    analyzed = yes(F.col("analyzed"))
    found = alerts(rows, "call_id", [
        ("escalate", "high", analyzed & yes(F.col("escalate"))), ("churn", "high", F.col("churn_score") >= 70), ("churn", "warn", (F.col("churn_score") >= 40) & (F.col("churn_score") < 70)),
        ("speaker", "warn", ~F.coalesce("churn_labeled", F.lit(True)) | ~F.coalesce("qa_labeled", F.lit(True)) | yes(F.col("dia_failed"))), ("withheld", "warn", F.col("withheld") > 0), ("quality", "warn", F.col("qa_total") < 70),
        ("truncated", "warn", yes(F.col("truncated"))), ("estimated", "info", (analyzed & yes(F.col("demo"))) | yes(F.col("churn_estimated")) | yes(F.col("qa_estimated"))),
    ])
    some = failed.unionByName(found)
    calm = calls.select("call_id").join(some.select("call_id").hint("merge"), "call_id", "left_anti").select("call_id", F.lit("none").alias("alert_id"), F.lit("info").alias("level"), F.lit(0).alias("ord"))
    return some.unionByName(calm).withColumn("rank", F.create_map(*(x for kv in LEVELS.items() for x in map(F.lit, kv)))[F.col("level")])


def handoff_report(status: DataFrame, checks: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """(call_id, report): one text a call: state, owner, what to check, the ticket."""
    listed = checks.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "alert_id", "level"))), lambda c: F.concat(F.lit("- ["), c["level"], F.lit("] "), c["alert_id"])), "\n").alias("checks"))
    rows = status.join(listed.hint("merge"), "call_id", "left")
    rows = rows.withColumn("body", F.lit(None).cast("string")) if tickets is None else rows.join(tickets.select("call_id", "body").hint("merge"), "call_id", "left")
    head = F.format_string("통화 %s · %s (%d/%d)", F.col("call_id").cast("string"), "state", "done", F.lit(len(STAGES)))
    owner = F.when(F.col("owner").isNotNull(), F.concat(F.lit("담당: "), "owner", F.lit(" · "), "priority", F.lit(" · "), "sla")).when(F.col("status") == "close", "추가 이관 없음").otherwise("미배정")
    return rows.select("call_id", F.concat_ws("\n", head, F.concat(F.lit("상태: "), "status"), owner, F.concat(F.lit("확인 사항\n"), "checks"), F.concat(F.lit("\n"), "body")).alias("report"))


def write_handoff_reports(reports: DataFrame, path: str, day: str | None = None) -> None:
    """One text document per row, in a folder per ``day`` if given."""
    rows = reports.select(*([day] if day else []), F.col("report").alias("value"))
    writer = rows.write.mode("append").option("lineSep", "\n\f\n")
    (writer.partitionBy(day) if day else writer).text(path)


def ledger(calls: DataFrame, themes: DataFrame, repeats: DataFrame) -> DataFrame:
    """The 13 ledger columns; titles are masked again, what is missing is blank and not 0.

    ``calls`` has call_id, call_date, agent, title, category, sentiment, escalate, churn_score, churn_level, team_name, mine.
    """
    texts = themes.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "team_name"))).alias("t"))
    causes = texts.select("call_id", F.array_join(F.transform("t", lambda x: x["label"]), " / ").alias("causes"), F.array_join(F.array_distinct(F.transform("t", lambda x: x["team_name"])), " / ").alias("depts"))
    rows = calls.join(causes.hint("merge"), "call_id", "left").join(repeats.select("call_id", F.lit("Y").alias("again")).hint("merge"), "call_id", "left")
    rows = mask_pii(rows, "title")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = [blank("call_date"), blank("agent"), F.col("masked.text"), blank("category"), blank("sentiment"), F.when(F.coalesce("escalate", F.lit(False)), "Y").otherwise("N"), blank("causes"), blank("depts"), blank("again"), blank("churn_score"), blank("churn_level"), blank("team_name"), F.when(F.coalesce("mine", F.lit(False)), "직접 분석").otherwise("내장 샘플")]
    return rows.select("call_id", *(v.alias(n) for v, n in zip(values, CSV_COLUMNS)))


def write_ledger_csv(rows: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, quoted where needed."""
    rows.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
