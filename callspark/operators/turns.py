"""Transcripts as turns: who said what, in order, and what the talk looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callspark.functions.text import dense_length, js_round, round_to

# Speaker labels and the three agent patterns.
AGENT_LABEL = r"(?i)^\s*(상담사|상담원|agent)\s*[:：]\s*"
CUSTOMER_LABEL = r"(?i)^\s*(고객|customer)\s*[:：]\s*"
QUESTION = r"(\?|까요|나요|신가요|실까요|가요|런가요)\s*$"
EMPATHY = r"(죄송|불편을\s*드려|이해합니다|그러셨|많이\s*기다리|말씀\s*감사|공감|번거로우|번거롭)"
INTERRUPT = r"^(아니|그게\s*아니|그건\s*아니|잠깐|잠시만요|아니요)"


def explode_turns(calls: DataFrame, transcript: str = "transcript") -> DataFrame:
    """(call_id, turn_no, speaker, text): labelled lines begin turns, other lines continue the turn before.

    Lines before the first label and turns without text are dropped. Turns are numbered from 1 by their label.
    """
    lines = calls.select("call_id", F.posexplode(F.split(transcript, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    speaker = F.when(F.col("line").rlike(AGENT_LABEL), "agent").when(F.col("line").rlike(CUSTOMER_LABEL), "customer")
    lines = lines.withColumn("speaker", speaker)
    turn = F.sum(F.col("speaker").isNotNull().cast("int")).over(Window.partitionBy("call_id").orderBy("line_no"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", AGENT_LABEL, ""), CUSTOMER_LABEL, ""))
    lines = lines.withColumn("turn_no", turn).where("turn_no > 0").withColumn("line", F.when(F.col("speaker").isNotNull(), bare).otherwise(F.col("line")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return lines.groupBy("call_id", "turn_no").agg(F.max("speaker").alias("speaker"), F.trim(said).alias("text")).where("text <> ''")


def customer_speech(turns: DataFrame, calls: DataFrame, transcript: str = "transcript") -> DataFrame:
    """(call_id, speech, labeled): customer turns joined by line breaks; without any, the whole transcript."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "text"))), lambda x: x["text"]), "\n")
    spoken = turns.where("speaker = 'customer'").groupBy("call_id").agg(joined.alias("_said"))
    return calls.select("call_id", F.col(transcript).alias("_raw")).join(spoken.hint("merge"), "call_id", "left").select("call_id", F.coalesce("_said", "_raw", F.lit("")).alias("speech"), F.col("_said").isNotNull().alias("labeled"))


def agent_script(calls: DataFrame, transcript: str = "transcript") -> DataFrame:
    """(call_id, text, line_numbers, labeled): the lines that bear an agent label, without it; without any, all lines.

    Unlike turns, lines that continue an agent's line are not part of it. Line numbers count from 1.
    """
    lines = F.transform(F.split(F.coalesce(transcript, F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    rows = calls.select("call_id", lines.alias("all")).withColumn("own", F.filter("all", lambda x: x["line"].rlike(r"(?i)^\s*(상담사|상담원|agent)\s*[:：]")))
    rows = rows.withColumn("labeled", F.size("own") > 0)
    text = F.when(F.col("labeled"), F.array_join(F.transform("own", lambda x: F.regexp_replace(x["line"], AGENT_LABEL, "")), "\n")).otherwise(F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    return rows.select("call_id", text.alias("text"), F.transform(F.when(F.col("labeled"), F.col("own")).otherwise(F.col("all")), lambda x: x["no"]).alias("line_numbers"), "labeled")


def last_customer_query(calls: DataFrame, transcript: str = "transcript", chars: int = 300) -> DataFrame:
    """(call_id, query): the last customer line, else the end of the dialogue."""
    lines = F.filter(F.split(transcript, "\n"), lambda x: x.rlike(r"^\s*고객\s*[:：]"))
    last = F.regexp_replace(F.element_at(lines, -1), r"^\s*고객\s*[:：]\s*", "")
    return calls.select("call_id", F.trim(F.coalesce(F.when(F.size(lines) > 0, F.substring(F.trim(last), 1, chars)), F.expr(f"right({transcript}, {chars})"))).alias("query"))


def call_metrics(turns: DataFrame, question: str = QUESTION, empathy: str = EMPATHY, interrupt: str = INTERRUPT) -> DataFrame:
    """One row per call with both speakers: counts, shares of characters, longest turn and longest run of agent turns."""
    order = Window.partitionBy("call_id").orderBy("turn_no")
    same = Window.partitionBy("call_id", "speaker").orderBy("turn_no")
    rows = turns.withColumns({"chars": dense_length(F.col("text")), "island": F.row_number().over(order) - F.row_number().over(same)})
    run = F.row_number().over(Window.partitionBy("call_id", "speaker", "island").orderBy("turn_no"))
    agent, customer = F.col("speaker") == "agent", F.col("speaker") == "customer"
    count = lambda test: F.count_if(test)
    summed = rows.withColumn("run", run).groupBy("call_id").agg(
        F.count("*").alias("turns"), count(agent).alias("agent_turns"), count(customer).alias("customer_turns"),
        F.coalesce(F.sum(F.when(agent, F.col("chars"))), F.lit(0)).alias("agent_chars"), F.coalesce(F.sum(F.when(customer, F.col("chars"))), F.lit(0)).alias("customer_chars"),
        F.max(F.when(customer, F.col("chars"))).alias("longest_customer_turn"), F.max(F.when(agent, F.col("run"))).alias("agent_run"),
        count(agent & F.col("text").rlike(question)).alias("question_turns"), count(agent & F.col("text").rlike(empathy)).alias("empathy_turns"), count(agent & F.col("text").rlike(interrupt)).alias("interrupt_turns"),
    ).where("agent_turns > 0 and customer_turns > 0")
    total = F.col("agent_chars") + F.col("customer_chars")
    share = lambda c: F.when(total > 0, round_to(F.col(c) / total * 100, 1)).otherwise(0.0)
    mean = lambda c, n: js_round(F.col(c) / F.col(n)).cast("long")
    return summed.select(
        "call_id", "turns", "agent_turns", "customer_turns", share("agent_chars").alias("agent_share"), share("customer_chars").alias("customer_share"), mean("agent_chars", "agent_turns").alias("avg_agent_turn"),
        mean("customer_chars", "customer_turns").alias("avg_customer_turn"), F.col("longest_customer_turn").cast("long"), F.col("agent_run").cast("long"), "question_turns", "empathy_turns", "interrupt_turns", total.alias("total_chars"),
    )


def alerts(df: DataFrame, key: str, tests: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, alert_id, level, ord): a row for each (id, level, condition) that holds, in the given order."""
    made = [F.when(test, F.struct(F.lit(i).alias("alert_id"), F.lit(level).alias("level"), F.lit(k).alias("ord"))) for k, (i, level, test) in enumerate(tests)]
    return df.select(key, F.explode(F.array_compact(F.array(*made))).alias("a")).select(key, "a.alert_id", "a.level", "a.ord")


def diagnose_call_metrics(metrics: DataFrame) -> DataFrame:
    """(call_id, alert_id, level, ord) from ``call_metrics``."""
    agent, customer = F.col("agent_share") >= 75, F.col("customer_share") >= 70
    return alerts(metrics, "call_id", [
        ("agent-dominant", "warn", agent), ("customer-dominant", "info", ~agent & customer), ("balanced", "ok", ~agent & ~customer), ("monologue", "warn", F.col("agent_run") >= 3),
        ("long-complaint", "info", F.col("longest_customer_turn") >= 120), ("no-question", "warn", F.col("question_turns") == 0), ("no-empathy", "warn", F.col("empathy_turns") == 0), ("interrupt", "warn", F.col("interrupt_turns") > 0),
    ])
