"""All queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callspark.functions import text as X
from callspark.functions.literals import contained
from callspark.operators import handoff, rules, search, timeline, turns, verify, voc
from callspark.operators import telemetry as tele
from callspark.plans import fixtures as fx
from callspark.sources import ledger
from callspark.streaming import jobs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL for the same rows."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from callspark.plans import defaults, workflows  # noqa: F401 - register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from callspark.plans import defaults, workflows  # noqa: F401

    return dict(_SQL)


def _r(x: str, places: int = 1) -> str:
    return f"(floor(({x}) * {10**places} + 0.5) / {10**places})"


_SQUEEZED = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"

# ---- transcripts ------------------------------------------------------------------------------------------


@query(f"with {fx.TURNS_SQL} select call_id, row_number() over (partition by call_id order by turn_no) as turn_no, speaker, {_SQUEEZED} as text from turns")
def p1_explode_turns(spark, sf):
    return turns.explode_turns(fx.transcripts(spark, sf)).select("call_id", F.col("turn_no").cast("long").alias("turn_no"), "speaker", "text")


@query(f"""with {fx.TURNS_SQL}, said as (select call_id, string_agg({_SQUEEZED}, chr(10) order by turn_no) as speech from turns where speaker = 'customer' group by 1),
  whole as (select call_id, string_agg(speaker || ': ' || text, chr(10) order by turn_no) as raw from turns group by 1)
  select call_id, coalesce(speech, raw) as speech, speech is not null as labeled from whole left join said using (call_id)""")
def p2_customer_speech(spark, sf):
    calls = fx.transcripts(spark, sf)
    return turns.customer_speech(turns.explode_turns(calls), calls)


@query(f"""with {fx.TURNS_SQL}, own as (select call_id, string_agg(string_split(text, chr(10))[1], chr(10) order by turn_no) as text from turns where speaker = 'agent' group by 1),
  whole as (select call_id, string_agg(speaker || ': ' || text, chr(10) order by turn_no) as raw from turns group by 1)
  select call_id, coalesce(text, raw) as text, text is not null as labeled from whole left join own using (call_id)""")
def p3_agent_script(spark, sf):
    return turns.agent_script(fx.transcripts(spark, sf)).select("call_id", "text", "labeled")


_METRICS_SQL = f"""metric_rows as (select *, length(regexp_replace(text, '\\s', '', 'g')) as chars, row_number() over (partition by call_id order by turn_no) - row_number() over (partition by call_id, speaker order by turn_no) as island from turns),
  runs as (select *, row_number() over (partition by call_id, speaker, island order by turn_no) as run from metric_rows),
  sums as (select call_id, count(*) as turns, count(*) filter (speaker = 'agent') as agent_turns, count(*) filter (speaker = 'customer') as customer_turns,
    coalesce(sum(chars) filter (speaker = 'agent'), 0) as a, coalesce(sum(chars) filter (speaker = 'customer'), 0) as c, max(chars) filter (speaker = 'customer') as longest_customer_turn, max(run) filter (speaker = 'agent') as agent_run,
    count(*) filter (speaker = 'agent' and regexp_matches(text, '{fx.QUESTION}')) as question_turns, count(*) filter (speaker = 'agent' and regexp_matches(text, '{fx.EMPATHY}')) as empathy_turns,
    count(*) filter (speaker = 'agent' and regexp_matches(text, '{fx.INTERRUPT}')) as interrupt_turns from runs group by 1),
  metrics as (select call_id, turns, agent_turns, customer_turns, case when a + c > 0 then {_r("a / (a + c) * 100")} else 0.0 end as agent_share, case when a + c > 0 then {_r("c / (a + c) * 100")} else 0.0 end as customer_share,
    cast(floor(a / agent_turns + 0.5) as bigint) as avg_agent_turn, cast(floor(c / customer_turns + 0.5) as bigint) as avg_customer_turn, longest_customer_turn, agent_run, question_turns, empathy_turns, interrupt_turns, cast(a + c as bigint) as total_chars
    from sums where agent_turns > 0 and customer_turns > 0)"""


@query(f"with {fx.TURNS_SQL}, {_METRICS_SQL} select * from metrics")
def w11_call_metrics(spark, sf):
    return turns.call_metrics(fx.turns(spark, sf), fx.QUESTION, fx.EMPATHY, fx.INTERRUPT)


@query(f"""with {fx.TURNS_SQL}, {_METRICS_SQL} select call_id, a[1] as alert_id, a[2] as level from (select call_id, unnest(list_filter([
  case when agent_share >= 75 then ['agent-dominant', 'warn'] end, case when agent_share < 75 and customer_share >= 70 then ['customer-dominant', 'info'] end, case when agent_share < 75 and customer_share < 70 then ['balanced', 'ok'] end,
  case when agent_run >= 3 then ['monologue', 'warn'] end, case when longest_customer_turn >= 120 then ['long-complaint', 'info'] end, case when question_turns = 0 then ['no-question', 'warn'] end,
  case when empathy_turns = 0 then ['no-empathy', 'warn'] end, case when interrupt_turns > 0 then ['interrupt', 'warn'] end], lambda x: x is not null)) as a from metrics)""")
def w12_diagnose_call_metrics(spark, sf):
    return turns.diagnose_call_metrics(w11_call_metrics(spark, sf)).select("call_id", "alert_id", "level")


# ---- causes, churn, quality -------------------------------------------------------------------------------

_SPEECH_SQL = f"""{fx.TURNS_SQL}, own as (select call_id, string_agg(text, chr(10) order by turn_no) as speech from turns where speaker = 'customer' group by 1),
  whole as (select call_id, string_agg(speaker || ': ' || text, chr(10) order by turn_no) as raw from turns group by 1),
  speech as (select call_id, coalesce(speech, raw) as speech, date '2024-01-01' + cast(call_id % 14 as int) as day from whole left join own using (call_id)),
  lines as (select call_id, day, unnest(string_split(chr(10) || speech, chr(10))) as line, generate_subscripts(string_split(chr(10) || speech, chr(10)), 1) as line_no from speech)"""


def _pattern_rows(table, columns) -> str:
    rows = [f"('{r[0]}', '{r[2]}', {k}, {n}, '{p}')" for k, r in enumerate(table) for n, p in enumerate(r[-1])]
    return f"(values {', '.join(rows)}) as p({columns})"


_THEMES_SQL = f"""{_SPEECH_SQL}, hits as (select call_id, day, theme, team, ord, pattern_no, arg_min(line, line_no) as line from lines, {_pattern_rows(fx.THEMES, "theme, team, ord, pattern_no, pattern")} where regexp_matches(line, pattern) group by all),
  themes as (select call_id, day, theme, team, ord, to_json(list_distinct(list(trim(line)))) as evidence, count(distinct trim(line)) as n_evidence from hits group by all)"""


def _speech(spark, sf):
    """Customer speech straight from the turns; a call without any has all its turns."""
    t = fx.turns(spark, sf)
    plain = fx.transcripts(spark, sf)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("speaker") == "customer", F.struct("turn_no", "text")))), lambda x: x["text"]), "\n")
    own = t.groupBy("call_id").agg(joined.alias("own"), F.count_if(F.col("speaker") == "customer").alias("n"))
    return plain.join(own.hint("merge"), "call_id").select("call_id", F.when(F.col("n") > 0, F.col("own")).otherwise(F.col("transcript")).alias("speech"), (F.col("n") > 0).alias("labeled"), "day", "title")


def _themed(spark, sf):
    speech = _speech(spark, sf)
    return speech, rules.tag_themes(speech, speech.select("call_id", "speech", "labeled"), fx.THEMES)


@query(f"with {_THEMES_SQL} select call_id, theme, ord, team, n_evidence from themes")
def c1_tag_themes(spark, sf):
    return _themed(spark, sf)[1].select("call_id", "theme", "ord", "team", F.size("evidence").cast("long").alias("n_evidence"))


@query(f"with {_THEMES_SQL} select call_id, theme as rule, pattern_no, line_no from lines, {_pattern_rows(fx.THEMES, 'theme, team, ord, pattern_no, pattern')} where regexp_matches(line, pattern) and line_no > 1")
def c0_match_rules_table(spark, sf):
    """The theta join against a dictionary that is a table."""
    from callspark.operators.dictionaries import patterns_table

    lines = rules.speech_lines(_speech(spark, sf), "speech")
    return rules.match_rules(lines, patterns_table(spark, fx.THEMES)).select("call_id", "rule", F.col("pattern_no").alias("pattern_no"), (F.col("line_no") + 2).cast("long").alias("line_no"))


_PHRASES_SQL = r"""picked as (select doc_id as rule, regexp_extract_all(text, '[A-Za-z]+') as w from documents),
  phrases as (select rule, w[4] || ' ' || w[5] || ' ' as a, w[6] as b from picked where len(w) >= 6),
  lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents),
  folded as (select doc_id, line_no, regexp_replace(line, '[ ,.]+', ' ', 'g') as flat from lines)"""


@query(f"with {_PHRASES_SQL} select doc_id, line_no, rule from folded join phrases on contains(flat, a || b) or (contains(flat, a) and regexp_matches(flat, a || '[0-9]+x'))")
def c0_match_phrases(spark, sf):
    """A dictionary as large as the corpus: a pattern of three words from every document, asked of every line of all documents."""
    docs = fx.table(spark, sf, "documents")
    word = lambda k: F.get(F.col("w"), F.lit(k))
    picked = docs.select(F.col("doc_id").alias("rule"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where("size(w) >= 6")
    phrases = picked.select("rule", F.lit(0).alias("ord"), F.lit(0).alias("pattern_no"), F.concat(word(3), F.lit("[ ,.]+"), word(4), F.lit("[ ,.]+("), word(5), F.lit("|[0-9]+x)")).alias("pattern"))
    spread = docs.select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism)  # a small file would be one task
    lines = spread.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rules.match_rules(lines, phrases).select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "rule")


@query(f"with {_SPEECH_SQL} select call_id, {' or '.join(f'''regexp_matches(speech, '{p}')''' for p in fx.REPEATS)} as again from speech")
def c2_flag_repeat_calls(spark, sf):
    speech = _speech(spark, sf)
    found = rules.flag_repeat_calls(speech, speech.select("call_id", "speech", "labeled"), fx.REPEATS)
    return speech.select("call_id").join(found.select("call_id", F.lit(True).alias("again")).hint("merge"), "call_id", "left").fillna(False)


@query("select source, count(*) as calls, count(*) filter (regexp_matches(text, 'lawsuit|thing|Licensed')) as escalating from documents group by 1")
def c3_escalation_counts(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return rules.escalation_counts(rules.flag_escalation(docs, "text", ("lawsuit", "thing", "Licensed")), "source")


_CHURN_SQL = f"""{_SPEECH_SQL}, signals as (select distinct call_id, signal, cast(weight as int) as weight from lines, {_pattern_rows(fx.CHURN, 'signal, weight, ord, pattern_no, pattern')} where trim(line) <> '' and line_no > 1 and regexp_matches(line, pattern)),
  churn as (select call_id, cast(least(greatest(coalesce(sum(weight), 0), 0), 100) as int) as score, count(*) filter (weight > 0) as n_risk from speech left join signals using (call_id) group by 1)"""


@query(f"with {_CHURN_SQL} select call_id, score, case when score >= 70 then '높음' when score >= 40 then '중간' when score >= 15 then '낮음' else '없음' end as level, n_risk from churn")
def c4_score_churn(spark, sf):
    return rules.score_churn(_speech(spark, sf), fx.CHURN).select("call_id", "score", "level", "n_risk")


@query(f"""with {_CHURN_SQL}, given as (select *, case when call_id % 3 > 0 then call_id * 7 % 101 end as raw, case when n_risk >= 3 then 15 when n_risk >= 1 then 25 else 40 end as width from churn)
  select call_id, raw is null as estimated, cast(case when raw is null then score else least(greatest(raw, greatest(score - width, 0)), least(score + width, 100)) end as int) as banded from given""")
def c5_band_churn(spark, sf):
    scores = rules.score_churn(_speech(spark, sf), fx.CHURN).withColumn("llm_score", F.when(F.col("call_id") % 3 > 0, F.col("call_id") * 7 % 101))
    return rules.band_churn(scores).select("call_id", "estimated", "banded")


_SCRIPT_SQL = f"""{fx.TURNS_SQL}, own as (select call_id, string_agg(string_split(text, chr(10))[1], chr(10) order by turn_no) as text from turns where speaker = 'agent' group by 1),
  whole as (select call_id, string_agg(speaker || ': ' || text, chr(10) order by turn_no) as raw from turns group by 1),
  scripts as (select call_id, coalesce(text, raw) as text, text is not null as labeled from whole left join own using (call_id))"""
_MENTIONS_SQL = f"""{_SCRIPT_SQL}, mentioned as (select call_id, mention, bool_or(regexp_matches(text, pattern)) as found from scripts, {_pattern_rows(fx.MENTIONS, 'mention, points, ord, pattern_no, pattern')} group by 1, 2)"""
_FORBIDDEN_SQL = (
    f"""{_MENTIONS_SQL}, words(rule, deduct, ambiguous, word) as (values {', '.join(f"('{r}', {d}, {str(a).lower()}, '{w}')" for r, _, d, a, ws in fx.FORBIDDEN for w in ws)}),"""
    + """ parts as (select call_id, labeled, rule, deduct, ambiguous, word, string_split(text, word) as parts from scripts, words where contains(text, word)),
  spots as (select call_id, labeled, rule, deduct, ambiguous, word, unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(word))) as pos from parts),
  ordered as (select *, row_number() over (partition by call_id order by pos, -length(word), rule) as i from spots),
  kept as (with recursive walk as (select call_id, i, pos, pos + length(word) as last, true as keep from ordered where i = 1
     union all select o.call_id, o.i, o.pos, case when o.pos >= w.last then o.pos + length(o.word) else w.last end, o.pos >= w.last from walk w join ordered o on o.call_id = w.call_id and o.i = w.i + 1) select call_id, i from walk where keep),
  findings as (select o.call_id, rule, cast(pos as int) as pos, word, case when not labeled and ambiguous then 0 else deduct end as deduct, not labeled and ambiguous as withheld from ordered o join kept using (call_id, i))"""
)


@query(f"with {_MENTIONS_SQL} select call_id, mention, found from mentioned")
def c6_check_mentions(spark, sf):
    return rules.check_mentions(turns.agent_script(fx.transcripts(spark, sf)), fx.MENTIONS).select("call_id", "mention", "found")


def _findings(spark, sf):
    scripts = turns.agent_script(fx.transcripts(spark, sf))
    return scripts, rules.withhold_unattributed(rules.scan_forbidden(scripts, fx.FORBIDDEN), scripts)


@query(f"with {_FORBIDDEN_SQL} select call_id, rule, pos, word, deduct, withheld from findings")
def c9_c10_scan_forbidden(spark, sf):
    return _findings(spark, sf)[1].select("call_id", "rule", F.col("at").alias("pos"), "word", "deduct", "withheld")


@query(f"""with {_FORBIDDEN_SQL}, said as (select call_id, sum(case when found then 8 else 0 end) as rule_score from mentioned group by 1), off as (select call_id, least(sum(deduct), 20) as off from findings group by 1),
  facts as (select call_id, rule_score, floor(rule_score / 40.0 * 60 + 0.5) as llm_score, coalesce(off, 0) as off from said left join off using (call_id)),
  totals as (select *, least(greatest(rule_score + llm_score - off, 0), 100) as total from facts)
  select call_id, cast(rule_score as int) as rule_score, cast(llm_score as int) as llm_score, cast(off as int) as deduction, cast(total as int) as total, case when total >= 90 then 'A' when total >= 80 then 'B' when total >= 70 then 'C' else 'D' end as grade from totals""")
def c11_score_qa(spark, sf):
    scripts, findings = _findings(spark, sf)
    return rules.score_qa(rules.check_mentions(scripts, fx.MENTIONS), findings).select("call_id", "rule_score", "llm_score", "deduction", "total", "grade")


@query(f"""with {_FORBIDDEN_SQL}, m as (select call_id, count(*) filter (found) / count(*) as ratio from mentioned group by 1), n as (select call_id, count(*) as n from findings group by 1)
  select call_id, cast(least(greatest(floor(8 + 10 * ratio - least(3 * coalesce(n, 0), 8) + 0.5), 2), 18) as int) as estimate from m left join n using (call_id)""")
def c11c_estimate_review(spark, sf):
    scripts, findings = _findings(spark, sf)
    return rules.estimate_review(rules.check_mentions(scripts, fx.MENTIONS), findings)


@query(f"""with {_THEMES_SQL}, first as (select call_id, arg_min(team, ord) as team from themes group by 1) select call_id, coalesce(team, 'general') as team from speech left join first using (call_id)""")
def c12_route_calls(spark, sf):
    speech, themes = _themed(spark, sf)
    return rules.route_calls(speech.withColumn("category", F.lit(None).cast("string")), speech, themes).select("call_id", "team")


_CLASSES = dict(hot="!!", angry="scum|pathetic", ladder=(("가입", r"Licensed|\|"), ("요금", "token|password")), trouble="worthless", leaving="hathe", asks="AKIA", glad="with the", sore="onthe")


@query(r"""with t as (select doc_id, coalesce(text, '') as t from documents), f as (select *, regexp_matches(t, '!!') as hot, regexp_matches(t, '!!|scum|pathetic') as angry from t)
  select doc_id as call_id, case when angry or regexp_matches(t, 'worthless') then case when regexp_matches(t, 'hathe') then '해지' else '불만' end when regexp_matches(t, 'Licensed|\|') then '가입' when regexp_matches(t, 'token|password') then '요금' else '기타' end as category,
  case when angry then '강성' when regexp_matches(t, 'with the') then '긍정' when regexp_matches(t, 'onthe') then '부정' else '중립' end as sentiment, hot or regexp_matches(t, 'AKIA') as escalate from f""")
def c15_classify_calls(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.col("text").alias("transcript"))
    return rules.classify_calls(docs, **_CLASSES).select("call_id", "category", "sentiment", "escalate")


@query(f"""with {_MENTIONS_SQL}, d as (select call_id, list(mention) filter (found) as done, count(*) filter (found) as n from mentioned group by 1)
  select call_id, case when not (coalesce(list_contains(done, 'greeting'), false) and coalesce(list_contains(done, 'recording'), false)) then 'open' when not coalesce(list_contains(done, 'identity'), false) then 'verify'
    when not coalesce(list_contains(done, 'solution'), false) then 'resolve' else 'close' end as stage, cast(floor(n / 5.0 * 100 + 0.5) as int) as progress from d""")
def c16_guide_calls(spark, sf):
    scripts, findings = _findings(spark, sf)
    hits = rules.churn_hits(_speech(spark, sf), fx.CHURN)
    return rules.guide_calls(rules.check_mentions(scripts, fx.MENTIONS), findings, hits).select("call_id", "stage", "progress")


# ---- text preparation -------------------------------------------------------------------------------------


_FIXED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'tion', 'TION', 'g'), 'ti on', 'TION', 'g'), 'the+n', 'THE', 'g'), 'and,', 'AND', 'g')"


@query(f"select doc_id, md5({_FIXED}) as corrected from documents")
def p6_correct_terms(spark, sf):
    return X.correct_terms(fx.table(spark, sf, "documents").select("doc_id", "text"), "text", fx.LEXICON).select("doc_id", F.md5("corrected").alias("corrected"))


@query("""with one as (select source, regexp_replace(coalesce(text, ''), 'tion', 'TION', 'g') as t1, len(regexp_extract_all(coalesce(text, ''), 'tion')) as n1 from documents), two as (select *, len(regexp_extract_all(t1, 'ti on')) as n2, regexp_replace(t1, 'ti on', 'TION', 'g') as t2 from one),
  three as (select *, len(regexp_extract_all(t2, 'the+n')) as n3, regexp_replace(t2, 'the+n', 'THE', 'g') as t3 from two), four as (select *, len(regexp_extract_all(t3, 'and,')) as n4 from three)
  select * from (select source, 'TION' as term, cast(sum(n1 + n2) as bigint) as n from four group by 1 union all select source, 'THE', cast(sum(n3) as bigint) from four group by 1 union all select source, 'AND', cast(sum(n4) as bigint) from four group by 1) where n > 0""")
def p6_correction_audit(spark, sf):
    return X.correction_audit(X.correct_terms(fx.table(spark, sf, "documents").select("source", "text"), "text", fx.LEXICON), "source")


@query("select c_custkey, substr(sha256('salt:' || c_mktsegment || ':' || c_name), 1, 16) as caller from customer")
def p12_pseudonymise(spark, sf):
    return X.pseudonymise(fx.table(spark, sf, "customer"), "c_name", "c_mktsegment", "salt").select("c_custkey", "caller")


@query(f"select doc_id, term, count(*) as tf from (select doc_id, unnest({fx.latin_terms_sql('text')}) as term from documents) group by 1, 2")
def r1_tokenise(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.explode(fx.latin_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


# ---- voice of the customer --------------------------------------------------------------------------------

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")
_STATES = ("F", "O", "P", "X")


@query(f"""with {fx.CALLS_SQL}, sets as (select case when grouping(category) = 0 then 'category' when grouping(sentiment) = 0 then 'sentiment' when grouping(date) = 0 then 'date' else 'total' end as axis, coalesce(category, sentiment, date, '') as value,
    count(*) as calls, count(*) filter (escalate) as escalated, count(*) filter (s0 = 'F') as hot, count(minutes) as timed, avg(minutes) as avg_minutes from (select *, sentiment as s0, strftime(day, '%Y-%m-%d') as date from calls) group by grouping sets ((category), (sentiment), (date), ())),
  domain(axis, value) as (values {', '.join([f"('category', '{c}')" for c in _PRIORITIES] + [f"('sentiment', '{s}')" for s in _STATES])})
  select axis, value, coalesce(calls, 0) as calls, coalesce(escalated, 0) as escalated, coalesce(hot, 0) as hot, coalesce(timed, 0) as timed, avg_minutes from domain left join sets using (axis, value)
  union all select * from sets where axis in ('date', 'total')""")
def a1_voc_summary(spark, sf):
    return voc.voc_summary(fx.calls(spark, sf), _PRIORITIES, _STATES, ("F",))


@query(f"with {_THEMES_SQL} select team, theme, count(*) as calls from themes group by rollup (team, theme) having team is not null")
def a2_aggregate_themes(spark, sf):
    _, themes = _themed(spark, sf)
    return voc.aggregate_themes(themes.withColumn("team_name", F.col("team"))).select(F.col("team_name").alias("team"), "theme", "calls")


_PERIOD_SQL = "period as (select max(day) as anchor from speech), ranged as (select themes.*, case when day > anchor - 7 then 'current' when day > anchor - 14 then 'previous' end as period from themes, period)"


@query(f"""with {_THEMES_SQL}, {_PERIOD_SQL}, c as (select theme, count(*) filter (period = 'current') as calls, count(*) filter (period = 'previous') as previous from ranged where period is not null group by 1)
  select theme, calls, previous, calls - previous as delta, previous = 0 as is_new, calls = 0 as is_gone from c""")
def voc_compare_themes(spark, sf):
    """Which causes rose against the week before, and which department owns them."""
    speech, themes = _themed(spark, sf)
    split = voc.split_period(speech.select("call_id", "day"), "week")
    return voc.compare_themes(themes.join(split.select("call_id", "period").hint("merge"), "call_id")).select("theme", "calls", "previous", "delta", "is_new", "is_gone")


@query(f"with {fx.CALLS_SQL}, a as (select max(day) as a from calls) select call_id, case when day > a - 7 then 'current' else 'previous' end as period from calls, a where day > a - 14")
def t4_split_period(spark, sf):
    return voc.split_period(fx.calls(spark, sf), "week").select("call_id", "period")


@query(f"""with {fx.CALLS_SQL} select agent, count(*) as calls, count(*) filter (sentiment = 'F') as negative, count(*) filter (escalate) as escalated, case when count(*) >= 3 then count(*) filter (sentiment = 'F') / count(*) end as negative_rate,
  case when count(*) >= 3 then count(*) filter (escalate) / count(*) end as escalated_rate, {_r('avg(minutes)')} as avg_minutes, count(minutes) as timed from calls group by 1""")
def a4_aggregate_by_agent(spark, sf):
    return voc.aggregate_by_agent(fx.calls(spark, sf), negative=("F",)).select("agent", "calls", "negative", "escalated", "negative_rate", "escalated_rate", "avg_minutes", "timed")


def _spike_sql(key: str, source: str, days: str, ratio: float = 0.9) -> str:
    return f"""days as (select day, dense_rank() over (order by day desc) as rank from (select distinct day from {days} where day is not null)), size as (select count(*) as n_days from days),
  counted as (select {key}, count(*) filter (rank <= 3) as now, count(*) filter (rank > 3) as past from {source} join days using (day) where {key} is not null group by 1),
  based as (select *, past / (n_days - 3) as base from counted, size where n_days >= 5 and now >= 3), rated as (select *, case when base > 0 then now / 3 / base end as r from based)
  select {key}, now, {_r('base')} as baseline_per_day, {_r('r')} as ratio, case when r is null or r >= 3 then 'high' else 'warn' end as level from rated where r is null or r >= {ratio}"""


@query(f"with {fx.CALLS_SQL}, {_spike_sql('category', 'calls', 'calls')}")
def n1_category_spikes(spark, sf):
    return voc.category_spikes(fx.calls(spark, sf), recent_days=3, ratio=0.9)


@query(f"with {_THEMES_SQL}, {_spike_sql('theme', 'themes', 'speech', 0.5)}")
def n2_theme_spikes(spark, sf):
    speech, themes = _themed(spark, sf)
    return voc.theme_spikes(speech, themes, recent_days=3, ratio=0.5).drop("team_name")


@query(f"""with {fx.CALLS_SQL}, c as (select count(*) as calls, count(*) filter (sentiment = 'F') as hot, count(*) filter (escalate) as esc from calls)
  select * from (select 'hot-ratio' as alert_id, 'high' as level, calls, hot as hits from c where calls >= 5 and hot / calls >= 0.25 union all select 'escalate-ratio', 'warn', calls, esc from c where calls >= 5 and esc / calls >= 0.30)""")
def n3_ratio_alerts(spark, sf):
    return voc.ratio_alerts(fx.calls(spark, sf), hot="F")


@query(f"""with {_SPEECH_SQL}, c as (select count(*) as calls, count(*) filter ({' or '.join(f"regexp_matches(speech, '{p}')" for p in fx.REPEATS)}) as hits from speech) select 'repeat-ratio' as alert_id, 'warn' as level, calls, hits from c where calls >= 5 and hits / calls >= 0.01""")
def n4_repeat_alert(spark, sf):
    speech = _speech(spark, sf)
    return voc.repeat_alert(speech, rules.flag_repeat_calls(speech, speech, fx.REPEATS), share=0.01)


@query(f"""with {_THEMES_SQL}, tagged as (select distinct call_id, 1 as t from themes), again as (select call_id from speech where {' or '.join(f"regexp_matches(speech, '{p}')" for p in fx.REPEATS)})
  select count(*) as total, count(*) filter (t is null) as untagged, count(again.call_id) as repeats, case when count(*) > 0 then (count(*) - count(*) filter (t is null)) / count(*) end as tagged_rate from speech left join tagged using (call_id) left join again on again.call_id = speech.call_id""")
def a5_tagging_rates(spark, sf):
    speech, themes = _themed(spark, sf)
    return voc.tagging_rates(speech, themes, rules.flag_repeat_calls(speech, speech, fx.REPEATS))


@query("""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents), words as (select doc_id, line, line_no, regexp_replace(unnest(string_split_regex(line, '\\s+')), '[^a-zA-Z0-9]', '', 'g') as term from lines),
  each_one as (select term, doc_id, arg_min(line, line_no) as line from words where length(term) >= 2 and term not in ('the', 'of') and term not in ('and', 'in') group by 1, 2), best as (select term, count(*) as calls from each_one group by 1 having count(*) >= 2 order by calls desc, term limit 8),
  shown as (select term, best.calls, substr(trim(line), 1, 60) as line, row_number() over (partition by term order by doc_id) as n from each_one join best using (term)) select term, calls, string_agg(line, ' / ' order by n) as examples from shown where n <= 2 group by 1, 2""")
def a6_suggest_terms(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.col("text").alias("speech"))
    known = spark.createDataFrame([("and",), ("in",)], "term string")
    return voc.suggest_terms(docs, known, stopwords=("the", "of"), tail="가$").select("term", "calls", F.array_join("examples", " / ").alias("examples"))


_HISTORY_SQL = "history as (select source as label, d.doc_id as eval_no, 50 + 30 * quality + 10 * toxic + d.doc_id % 9 as total, toxic = 1 as estimated from documents d join labels l using (doc_id))"


def _history(spark, sf):
    rows = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels").hint("merge"), "doc_id")
    return rows.select(F.col("source").alias("label"), F.col("doc_id").alias("eval_no"), (50 + 30 * F.col("quality") + 10 * F.col("toxic") + F.col("doc_id") % 9).alias("total"), (F.col("toxic") == 1).alias("estimated"), F.array_compact(F.array(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic"))).alias("missed"))


@query(f"""with {_HISTORY_SQL}, n as (select *, row_number() over (partition by label order by eval_no) as i, count(*) over (partition by label) as n from history),
  s as (select label, count(*) as evaluations, floor(avg(total) + 0.5) as average, count(*) filter (estimated) as estimated, avg(total) filter (i <= n // 2) as early, avg(total) filter (i > n - n // 2) as late from n group by 1),
  d as (select *, case when evaluations >= 4 then floor(late - early + 0.5) end as delta from s)
  select label, evaluations, cast(average as bigint) as average, estimated, cast(delta as bigint) as delta, case when delta >= 3 then 'up' when delta <= -3 then 'down' when delta is not null then 'flat' end as trend from d""")
def a7_qa_history_summary(spark, sf):
    return voc.qa_history_summary(_history(spark, sf)).select("label", "evaluations", "average", "estimated", "delta", "trend")


@query("""with m as (select source as label, unnest(list_filter([case when quality = 0 then 'low' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null)) as item from documents join labels using (doc_id)) select label, item, count(*) as times from m group by 1, 2""")
def a7_qa_history_tops(spark, sf):
    return voc.qa_history_tops(_history(spark, sf), "missed").select("label", "item", "times")


@query("""with said as (select item_id, unnest([cast(cast(replace(x, ',', '') as double) as double)]) as n from (select item_id, unnest(regexp_extract_all(text || ' 12 of 37, 3 and 104', '(\\d[\\d,]*(?:\\.\\d+)?)')) as x from benchmark)), distinct_said as (select distinct item_id, n from said),
  counts as (select item_id, 104 as total, unnest([104, length(text) % 50]) as c from benchmark), allowed as (select item_id, cast(c as double) as n from counts union select item_id, floor(c / total * 100 + 0.5) from counts union select item_id, floor(c / total * 1000 + 0.5) / 10 from counts),
  bad as (select item_id, count(*) as unknown from distinct_said s where not (n between 0 and 10 and n = floor(n)) and not exists (select 1 from allowed a where a.item_id = s.item_id and a.n = s.n) group by 1)
  select item_id as report_id, unknown is null as ok, coalesce(unknown, 0) as unknown from benchmark left join bad using (item_id)""")
def a15_verify_report_numbers(spark, sf):
    bench = fx.table(spark, sf, "benchmark")
    reports = bench.select(F.col("item_id").alias("report_id"), F.array(F.concat("text", F.lit(" 12 of 37, 3 and 104"))).alias("texts"))
    counts = bench.select(F.col("item_id").alias("report_id"), F.lit(104).alias("total"), F.explode(F.array(F.lit(104), F.length("text") % 50)).alias("n"))
    return voc.verify_report_numbers(reports, counts).select("report_id", "ok", F.size("unknown").cast("long").alias("unknown"))


# ---- telemetry --------------------------------------------------------------------------------------------

_BY_MODE = 'by_mode as (select endpoint, mode, count(*) as calls, coalesce(sum(latency_ms), 0) as latency_sum, count(latency_ms) as latency_calls, min(created_at) as first_at, max(created_at) as last_at from telemetry group by 1, 2)'


@query(f"""with {fx.TELEMETRY_SQL}, m as (select endpoint, mode, count(*) as calls, floor(avg(latency_ms) + 0.5) as a from telemetry group by 1, 2)
  select endpoint, cast(sum(calls) as bigint) as calls, cast(coalesce(sum(calls) filter (mode like 'live%'), 0) as bigint) as live_calls, cast(coalesce(sum(calls) filter (mode = 'live-oss'), 0) as bigint) as oss_calls, cast(coalesce(sum(calls) filter (mode like 'fallback%'), 0) as bigint) as fallback_calls,
  cast(coalesce(sum(calls) filter (mode = 'guarded'), 0) as bigint) as guarded_calls, cast(floor(sum(a * calls) / sum(calls) filter (a is not null) + 0.5) as bigint) as avg_latency_ms, cast(floor(coalesce(sum(calls) filter (mode like 'live%'), 0) / sum(calls) * 100 + 0.5) as bigint) as live_percent from m group by rollup (endpoint)""")
def a8_telemetry_stats(spark, sf):
    by_mode = fx.telemetry(spark, sf).groupBy("endpoint", "mode").agg(F.count("*").alias("calls"), X.js_round(F.avg("latency_ms")).alias("avg_latency_ms"))
    return tele.telemetry_stats(by_mode).select("endpoint", "calls", "live_calls", "oss_calls", "fallback_calls", "guarded_calls", "avg_latency_ms", "live_percent")


_CUT = datetime.datetime(2024, 1, 16)


@query(f"""with {fx.TELEMETRY_SQL} select endpoint, mode, count(*) as calls, cast(coalesce(sum(latency_ms), 0) as bigint) as latency_sum, count(latency_ms) as latency_calls, min(created_at) as first_at, max(created_at) as last_at from telemetry where created_at < timestamp '2024-01-16' group by 1, 2""")
def a9_telemetry_rollup(spark, sf):
    """Totals of the first ten days, then those up to the cutoff folded in."""
    events = fx.telemetry(spark, sf)
    none = tele.telemetry_by_mode(events.limit(0))
    first, rest = tele.telemetry_rollup(events, none, F.lit(datetime.datetime(2024, 1, 11)))
    return tele.telemetry_rollup(rest, first, F.lit(_CUT))[0]


@query(f"""with {fx.TELEMETRY_SQL}, {_BY_MODE} select endpoint, mode, calls, case when latency_calls > 0 then cast(floor(latency_sum / latency_calls + 0.5) as bigint) end as avg_latency_ms, first_at as since from by_mode""")
def a10_telemetry_cumulative(spark, sf):
    events = fx.telemetry(spark, sf)
    totals = tele.telemetry_by_mode(events.where(F.col("created_at") < F.lit(_CUT)))
    return tele.telemetry_cumulative(events, totals)


@query(f"""with {fx.TELEMETRY_SQL}, cost as (select *, input_tokens * 500 + output_tokens * 2500 + coalesce(cache_read_tokens, 0) * 50 as c from telemetry where greatest(input_tokens, output_tokens, coalesce(cache_read_tokens, 0)) > 0),
  s as (select request_id, cast(sum(c) over (partition by account order by created_at range between interval '23:59:59.999999' hour preceding and current row) as double) / 100000000 as spent from cost)
  select request_id, cast(floor(spent * 1000000 + 0.5) as bigint) as spent_micro, spent + 0.06 <= 3 as admitted from s""".replace("interval '23:59:59.999999' hour", "interval '23 hours 59 minutes 59.999999 seconds'"))
def a11_spend_24h(spark, sf):
    out = tele.spend_24h(fx.telemetry(spark, sf))
    return out.select("request_id", X.js_round(F.col("spent_24h") * 1_000_000).alias("spent_micro"), "admitted")


@query("select event_type as bucket, count(*) as live from events where ts > timestamp '2024-01-20' - interval 1 day and ts <= timestamp '2024-01-20' group by 1")
def a12_bucket_usage(spark, sf):
    hits = fx.table(spark, sf, "events").select(F.col("event_type").alias("bucket"), "ts")
    windows = hits.select("bucket").distinct().withColumn("seconds", F.lit(86_400))
    return tele.bucket_usage(hits, windows, F.lit(datetime.datetime(2024, 1, 20)).cast("timestamp"))


@query("select event_id, case event_type when 'error' then 'fallback-timeout' when 'signup' then 'fallback-no-key' when 'view' then 'fallback-contract' else 'fallback' end as mode from events")
def a13_classify_failures(spark, sf):
    code = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "no_key").otherwise("odd")
    rows = fx.table(spark, sf, "events").select("event_id", code.alias("error_code"), F.when(F.col("event_type") == "view", "필드가 없습니다").alias("error_message"))
    rows = rows.withColumn("error_code", F.when(F.col("error_message").isNotNull(), None).otherwise(F.col("error_code")))
    return tele.classify_failures(rows).select("event_id", "mode")


_ADMIT_SQL = """with recursive r as (select user_id as bucket, event_id as request_id, ts, epoch_us(ts) as moment, row_number() over (partition by user_id order by ts, event_id) as n from events),
  walk as (select bucket, request_id, ts, n, true as accepted, [moment] as passed from r where n = 1 union all
    select bucket, request_id, ts, n, len(kept) < 2, case when len(kept) < 2 then list_append(kept, moment) else kept end from (select r.*, list_filter(w.passed, lambda p: p > r.moment - 86400000000) as kept from walk w join r on r.bucket = w.bucket and r.n = w.n + 1))"""


@query(f"{_ADMIT_SQL} select bucket, ts, request_id, accepted from walk")
def x2_admit_requests(spark, sf):
    """A replay, two a day: each decision rests on those before, so the SQL walks along each bucket."""
    hits = fx.table(spark, sf, "events").select(F.col("user_id").alias("bucket"), "ts", F.col("event_id").alias("request_id"))
    return tele.admit_requests(hits, 2, 86_400)


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) select user_id, event_id from r where n <= 60""")
def s8_keep_last_n(spark, sf):
    return ledger.keep_last_n(fx.table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 60).select("user_id", "event_id")


@query("""select user_id as request_id, arg_max(event_type, event_id) as endpoint, min(ts) as started, max(ts) as ended, arg_max(cast(floor(value) as bigint), event_id) filter (event_type <> 'view') as input_tokens from events group by 1""")
def s4_append_telemetry(spark, sf):
    rows = fx.table(spark, sf, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("endpoint"), F.col("event_type").alias("mode"), F.col("ts").alias("started"), F.col("ts").alias("ended"), F.when(F.col("event_type") != "view", F.floor("value").cast("long")).alias("input_tokens"), *(F.lit(None).cast("long").alias(c) for c in ("output_tokens", "cache_read_tokens", "cache_write_tokens", "findings_count")))
    return ledger.append_telemetry(rows).select("request_id", "endpoint", "started", "ended", "input_tokens")


# ---- timelines --------------------------------------------------------------------------------------------


@query(f"""with words as (select user_id as call_id, event_id as word_no, event_type || case when value > 150 then '.' else '' end as word, epoch_us(ts) / 1000000.0 as start, epoch_us(ts) / 1000000.0 + 60 as "end" from events),
  cuts as (select *, case when start - lag("end") over w >= 86400 or lag(word) over w like '%.' then 1 else 0 end as cut from words window w as (partition by call_id order by word_no)), segs as (select *, sum(cut) over (partition by call_id order by word_no) as seg_no from cuts)
  select call_id, cast(seg_no as int) as seg_no, arg_min(start, word_no) as start, arg_max("end", word_no) as "end", string_agg(word, ' ' order by word_no) as text from segs group by 1, 2""")
def w1_sessionise_words(spark, sf):
    at = X.micros("ts") / 1_000_000
    words = fx.table(spark, sf, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("word_no"), F.concat("event_type", F.when(F.col("value") > 150, ".").otherwise("")).alias("word"), at.alias("start"), (at + 60).alias("end"))
    return timeline.sessionise_words(words, gap=86_400.0)


@query(f"""with {fx.SEGMENTS_SQL}, rows_ as (select *, length(regexp_replace(text, '[\\s\\pP]', '', 'g')) as chars, max("end") over (partition by call_id order by start, "end" rows between unbounded preceding and 1 preceding) as reach from segments),
  isl as (select *, sum(case when start <= reach then 0 else 1 end) over (partition by call_id order by start, "end" rows unbounded preceding) as island from rows_), merged as (select call_id, island, min(start) as start, max("end") as "end" from isl group by 1, 2),
  gaps as (select call_id, lead(start) over (partition by call_id order by island) - "end" as gap from merged), quiet as (select call_id, count(*) as n, {_r(f"sum({_r('gap')})")} as s, max({_r('gap')}) as top from gaps where gap >= 3 group by 1),
  spoken as (select call_id, sum("end" - start) as speech, min(start) as first, max("end") as last from merged group by 1), rates as (select call_id, chars, case when "end" - start >= 0.8 and chars >= 2 then floor(chars / ("end" - start) * 60 + 0.5) end as rate, "end" > start as timed from isl),
  mid as (select call_id, count(*) as segments, median(rate) as middle, count(rate) as rated, sum(chars) filter (timed) as chars from rates group by 1), fast as (select call_id, count(*) as n from rates join mid using (call_id) where middle > 0 and rate >= 1.3 * middle group by 1)
  select call_id, segments, {_r('last')} as call_sec, {_r('speech')} as speech_sec, case when last > 0 then {_r('speech / last * 100')} end as speech_ratio, coalesce(quiet.n, 0) as silence_count, coalesce(s, 0.0) as silence_sec, coalesce(top, 0.0) as longest_silence_sec, {_r('first')} as leading_silence_sec,
    cast(floor(mid.middle + 0.5) as bigint) as median_chars_per_min, rated as rated_segments, coalesce(fast.n, 0) as fast_segments from spoken join mid using (call_id) left join quiet using (call_id) left join fast using (call_id)""")
def w3_timeline_metrics(spark, sf):
    return timeline.timeline_metrics(fx.segments(spark, sf)).select("call_id", "segments", "call_sec", "speech_sec", "speech_ratio", "silence_count", "silence_sec", "longest_silence_sec", "leading_silence_sec", "median_chars_per_min", "rated_segments", "fast_segments")


@query(f"""select call_id, a[1] as alert_id, a[2] as level from (select call_id, unnest(list_filter([case when longest_silence_sec >= 10 then ['long-silence', 'warn'] end, case when longest_silence_sec < 10 and silence_count > 0 then ['silence', 'info'] end,
  case when longest_silence_sec < 10 and silence_count = 0 then ['no-silence', 'ok'] end, case when speech_ratio < 55 then ['low-density', 'warn'] end, case when fast_segments > 0 and median_chars_per_min > 0 then ['rate-spike', 'warn'] end,
  case when leading_silence_sec >= 5 then ['late-open', 'info'] end], lambda x: x is not null)) as a from ({_SQL["w3_timeline_metrics"]}))""")
def w4_diagnose_timeline(spark, sf):
    return timeline.diagnose_timeline(timeline.timeline_metrics(fx.segments(spark, sf))).select("call_id", "alert_id", "level")


@query(f"""with {fx.SEGMENTS_SQL}, n as (select *, lead(start) over w - "end" as gap, lead(speaker) over w as nxt, "end" - start as long, last_value("end") over (w rows between unbounded preceding and unbounded following) as last from segments window w as (partition by call_id order by start, "end")),
  s as (select call_id, count(*) as segments, max(last) - min(start) as total, coalesce(sum(long) filter (speaker = 'agent'), 0) as a, coalesce(sum(long) filter (speaker = 'customer'), 0) as c, coalesce(sum(gap) filter (gap >= 3), 0) as q, coalesce(max(gap) filter (gap >= 3), 0) as top,
    avg(gap) filter (gap > 0 and speaker = 'customer' and nxt = 'agent') as d, max(gap) filter (gap > 0 and speaker = 'customer' and nxt = 'agent') as dm from n group by 1 having count(*) >= 2)
  select call_id, segments, {_r('total')} as total_sec, {_r('a')} as agent_sec, {_r('c')} as customer_sec, case when a + c > 0 then {_r('a / (a + c) * 100')} end as agent_ratio, {_r('q')} as silence_sec, {_r('top')} as longest_silence_sec, {_r('d')} as avg_response_delay_sec, {_r('dm')} as max_response_delay_sec from s""")
def w5_talk_metrics(spark, sf):
    return timeline.talk_metrics(fx.segments(spark, sf)).select("call_id", "segments", "total_sec", "agent_sec", "customer_sec", "agent_ratio", "silence_sec", "longest_silence_sec", "avg_response_delay_sec", "max_response_delay_sec")


@query(f"""with {fx.SEGMENTS_SQL}, ends as (select call_id, max("end") as duration from segments group by 1), c as (select call_id, duration, unnest(range(0, cast(least(ceil(duration / 55), 30) as bigint))) as chunk_no from ends where duration > 0)
  select call_id, cast(chunk_no as int) as chunk_no, chunk_no * 55.0 as start, least((chunk_no + 1) * 55.0, duration) as "end" from c""")
def w13_plan_chunks(spark, sf):
    return timeline.plan_chunks(fx.segments(spark, sf).groupBy("call_id").agg(F.max("end").alias("duration")))


# ---- retrieval --------------------------------------------------------------------------------------------

_BM25_SQL = f"""words as (select doc_id, unnest(list_concat(list_concat({fx.latin_terms_sql("string_split(text, chr(10))[1]")}, {fx.latin_terms_sql("string_split(text, chr(10))[1]")}), {fx.latin_terms_sql('text')})) as term from documents),
  postings as (select term, doc_id, count(*) as tf from words group by 1, 2), lens as (select d.doc_id, coalesce(sum(tf), 0) as len from documents d left join postings using (doc_id) group by 1), dfs as (select term, count(*) as df from postings group by 1), corpus as (select count(*) as n, avg(len) as avgdl from lens),
  terms as (select distinct item_id as query_id, unnest({fx.latin_terms_sql('text')}) as term from benchmark),
  scored as (select query_id, doc_id, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) * 1000 + 0.5) / 1000 as score from terms join dfs using (term) join postings using (term) join lens using (doc_id), corpus group by 1, 2),
  ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored where score > 0)"""


_INDEXES: dict[tuple, dict[str, DataFrame]] = {}


def _index(spark, sf):
    """The index of the documents, written once a session for each state of their files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf, status.getModificationTime(), status.getLen())
    if key not in _INDEXES:
        docs = fx.knowledge(spark, sf)
        if status.isFile() and status.getLen() < 1 << 30:  # one small file may be one row group, and that one task; a folder's length says nothing
            docs = docs.repartition(4 * spark.sparkContext.defaultParallelism)
        _INDEXES[key] = search.save_index(docs, f"{jobs.shared_folder(spark)}/index-{uuid.uuid4().hex}", fx.latin_tokens)
    return _INDEXES[key]


@query(f"with {_BM25_SQL} select query_id, doc_id, score from ranked where rank = 1")
def r5_bm25_rank(spark, sf):
    return search.bm25_rank(fx.questions(spark, sf), _index(spark, sf), 10, (), fx.latin_tokens).where("rank = 1").select("query_id", "doc_id", "score")


@query(f"with {_BM25_SQL} select query_id, doc_id, score, rank from ranked where rank <= 10")
def r5_bm25_top10(spark, sf):
    ranked = search.bm25_rank(fx.questions(spark, sf), _index(spark, sf), 10, (), fx.latin_tokens)
    return ranked.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _first_holding(docs, queries_, block=100_000):
    """(query_id, expected): the first document that holds each question; all questions are looked up in one pass over the documents."""
    hits = contained(docs.select("doc_id", "text"), "text", queries_.select("q").distinct(), "q", ["doc_id"], block)
    first = hits.groupBy("q").agg(F.min("doc_id").alias("expected"))
    return queries_.select("query_id", "q").join(first.hint("merge"), "q").select("query_id", "expected")


@query(f"""with {_BM25_SQL}, qrels as (select b.item_id as query_id, min(d.doc_id) as expected from benchmark b left join documents d on contains(d.text, b.text) group by 1),
  met as (select q.*, case when top.query_id is null then 'none' when top.score < 0.35 then 'none' else 'some' end as conf, r.rank from qrels q left join ranked top on top.query_id = q.query_id and top.rank = 1 left join (select * from ranked where rank <= 10) r on r.query_id = q.query_id and r.doc_id = q.expected)
  select 'all' as "set", count(*) as total, count(expected) as answerable, coalesce({_r("sum(case when rank = 1 then 1 else 0 end) filter (expected is not null) / count(expected)", 3)}, 0.0) as recall1, coalesce({_r("sum(case when rank <= 3 then 1 else 0 end) filter (expected is not null) / count(expected)", 3)}, 0.0) as recall3,
  coalesce({_r("sum(coalesce(1 / rank, 0)) filter (expected is not null) / count(expected)", 3)}, 0.0) as mrr, coalesce({_r("sum(case when conf = 'none' then 1 else 0 end) filter (expected is null) / count(*) filter (expected is null)", 3)}, 0.0) as abstain_accuracy from met""")
def r17_evaluate_ranker(spark, sf):
    """Each benchmark item asks for the first document that holds it; items that no document holds should go unanswered."""
    queries_ = fx.questions(spark, sf)
    held = _first_holding(fx.table(spark, sf, "documents"), queries_)
    qrels = queries_.select("query_id", F.lit("all").alias("set")).join(held.hint("merge"), "query_id", "left")
    ranked = search.bm25_rank(queries_, _index(spark, sf), 10, (), fx.latin_tokens)
    return search.evaluate_ranker(ranked, qrels, search.retrieval_confidence(queries_, ranked))[0]


@query("""with q as (select vec_id as query_id, embedding as qe, label as ql from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id as doc_id, row_number() over (partition by query_id order by round(list_cosine_similarity(cast(qe as double[]), cast(embedding as double[])), 9) desc, vec_id) as rank from q, embeddings) select query_id, doc_id, rank from s where rank <= 5""")
def r8_vector_topk(spark, sf):
    """The stated query set (ids that 100 divides) against all vectors."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    found = search.vector_topk(rows.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), rows, 5)
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""with docs as (select vec_id, embedding, case when vec_id % 3 = 0 then label end as owner from embeddings), q as (select vec_id as query_id, embedding as qe, label as asker from embeddings where vec_id % 100 = 0),
  s as (select query_id, vec_id as doc_id, owner, row_number() over (partition by query_id order by round(list_cosine_similarity(cast(qe as double[]), cast(embedding as double[])), 9) desc, vec_id) as rank from q join docs on owner is null or owner = asker) select query_id, doc_id, rank, owner is not null as own from s where rank <= 8""")
def r8_owner_documents(spark, sf):
    """Every third vector belongs to its label; a query sees what is everyone's and what is its own label's."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    docs = rows.select("doc_id", "vector", F.when(F.col("doc_id") % 3 == 0, F.col("label")).alias("owner"))
    asked = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector", F.col("label").alias("owner"))
    found = search.vector_topk(asked, docs, 8, owner="owner").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    return found.join(docs.select("doc_id", F.col("owner").isNotNull().alias("own")).hint("merge"), "doc_id")


@query()
def r8_vector_index(spark, sf):
    """The same query set through the inverted index: every vector is in it, results are approximate (recall in the README), so no SQL."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    index = search.save_vector_index(rows, f"{jobs.shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    found = search.vector_topk_index(rows.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), index, 5)
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_BM25_SQL}, kw as (select query_id, doc_id, sum(length(term)) as score from (select distinct query_id, term from terms) t join documents d on contains(lower(coalesce(string_split(text, chr(10))[1], '') || ' ' || coalesce(text, '')), term) group by 1, 2),
  k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from kw), u as (select query_id, doc_id, rank from ranked where rank <= 8 union all select query_id, doc_id, rank from k where rank <= 8),
  f as (select query_id, doc_id, floor(sum(1 / (60 + rank)) * 10000 + 0.5) / 10000 as rrf from u group by 1, 2), o as (select *, row_number() over (partition by query_id order by rrf desc, doc_id) as rank from f) select query_id, doc_id, rrf, rank from o where rank <= 3""")
def r7_r9_fused_search(spark, sf):
    asked, docs = fx.questions(spark, sf), fx.knowledge(spark, sf)
    lexical = search.bm25_rank(asked, _index(spark, sf), 8, (), fx.latin_tokens)
    plain = search.keyword_rank(asked, docs, 8, fx.latin_tokens)
    return search.rrf_fuse({"bm25": lexical, "keyword": plain}).select("query_id", "doc_id", "rrf", F.col("rank").cast("long").alias("rank"))


# ---- verification -----------------------------------------------------------------------------------------

_PAIRS_SQL = "flat as (select conv_id, turn, text, regexp_replace(text, '[\\s\\pP]', '', 'g') as f from conversations), pairs as (select a.conv_id, a.turn, a.text as answer, a.f as fa, b.f as fb from flat a join flat b on a.conv_id = b.conv_id and a.turn = b.turn + 1)"


def _pairs(spark, sf):
    rows = fx.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.col("text").alias("answer")).join(rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence")).hint("merge"), ["conv_id", "turn"])


@query(f"""with {_PAIRS_SQL}, g as (select conv_id, turn, list_distinct(list_transform(range(1, length(fa)), lambda i: substr(fa, i, 2))) as a, list_distinct(list_transform(range(1, length(fb)), lambda i: substr(fb, i, 2))) as b from pairs)
  select conv_id, turn, case when len(a) > 0 then floor(len(list_intersect(a, b)) / len(a) * 100 + 0.5) / 100 else 0.0 end as grounding from g""")
def r13_groundedness(spark, sf):
    return verify.groundedness(_pairs(spark, sf)).select("conv_id", "turn", "grounding")


@query(f"""with {_PAIRS_SQL}, g as (select conv_id, turn, answer, list_distinct(list_transform(range(1, length(fa)), lambda i: substr(fa, i, 2))) as a, list_distinct(list_transform(range(1, length(fb)), lambda i: substr(fb, i, 2))) as b from pairs),
  v as (select *, case when len(a) > 0 then floor(len(list_intersect(a, b)) / len(a) * 100 + 0.5) / 100 else 0.0 end as g from g) select conv_id, turn, case when g < 0.15 and length(trim(answer)) >= 40 then 'reject' when g < 0.35 then 'warn' else 'ok' end as verdict from v""")
def r14_grounding_verdict(spark, sf):
    return verify.grounding_verdict(verify.groundedness(_pairs(spark, sf))).select("conv_id", "turn", "verdict")


# A pair's distance in time with its length where it can be told so: texts of one length, whose places that differ share no character, have that many
# edits, as each of these characters is one too many. levenshtein, which fills a table of all places, has the others.
_CER_SQL = """c as (select doc_id, lang, regexp_replace(t, '[\\s.,!?;:]', '', 'g') as r, regexp_replace(replace(t, 'tion', 'shun'), '[\\s.,!?;:]', '', 'g') as h from (select doc_id, lang, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') as t from documents)),
  s as (select *, string_split(r, '') as a, string_split(h, '') as b from c where length(r) > 0), u as (select *, list_filter(list_zip(a, b), lambda x: x[1] <> x[2]) as differ from s),
  d as (select *, case when length(r) = length(h) and not list_has_any(list_transform(differ, lambda x: x[1]), list_transform(differ, lambda x: x[2])) then len(differ) else levenshtein(r, h) end as distance from u)"""


def _cer_pairs(spark, sf):
    """Letters, digits and blanks of whole texts, taken once, before rows are dealt out evenly: a small file would be one task."""
    docs = fx.table(spark, sf, "documents")
    bare = fx.dealt(docs.select("doc_id", "lang", F.regexp_replace("text", "[^a-zA-Z0-9 ]", "").alias("reference")))
    return bare.withColumn("hypothesis", F.replace("reference", F.lit("tion"), F.lit("shun")))


@query(f"with {_CER_SQL} select lang, count(*) as pairs, cast(sum(distance) as bigint) as distance, cast(sum(length(r)) as bigint) as ref_length from d group by 1")
def e1_corpus_cer(spark, sf):
    return verify.corpus_cer(verify.cer(_cer_pairs(spark, sf)), "lang").select("lang", "pairs", F.col("distance").cast("long").alias("distance"), F.col("ref_length").cast("long").alias("ref_length"))


@query(f"""with {_CER_SQL}, k as (select *, cast(floor(0.05 * length(r)) as bigint) as k, least(length(r), length(h)) as n from d),
  p as (select *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])) - 1, n) as head from k),
  t as (select *, coalesce(list_min(list_filter(range(1, n - head + 1), lambda i: a[-i] <> b[-i])) - 1, n - head) as tail from p)
  select doc_id, r <> h and abs(length(r) - length(h)) <= k and (length(r) - head - tail) * least(length(h) - head - tail, 2 * k + 1) > 400000 as unverifiable, distance <= k as within from t""")
def e2_cer_within(spark, sf):
    """Each pair measured; ``unverifiable`` tells which are over upstream's budget."""
    return verify.cer_within(_cer_pairs(spark, sf), 0.05, exact=True).where("unverifiable is not null").select("doc_id", "unverifiable", "within")


def _cer_whole(spark, sf):
    """Dealt out evenly: a pair takes far longer to compare than to move, and a small file would be one task."""
    docs = fx.dealt(fx.table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", F.col("text").alias("reference"), F.replace("text", F.lit("tion"), F.lit("shun")).alias("hypothesis"))


@query()
def e1_corpus_cer_whole(spark, sf):
    """Whole texts with all their letters. No SQL: it counts bytes, and its edit distance is quadratic in the longest texts."""
    return verify.corpus_cer(verify.cer(_cer_whole(spark, sf)), "lang").select("lang", "pairs", F.col("distance").cast("long").alias("distance"), F.col("ref_length").cast("long").alias("ref_length"))


@query()
def e2_cer_within_whole(spark, sf):
    """Whole texts with all their letters, each pair measured."""
    return verify.cer_within(_cer_whole(spark, sf), 0.05, exact=True).where("unverifiable is not null").select("doc_id", "unverifiable", "within")


# ---- hand-off ---------------------------------------------------------------------------------------------

_STAGE_OF = {"click": "stt", "purchase": "analyze", "signup": "qa", "view": "voc", "error": "dia"}


@query(f"""with runs as (select user_id as call_id, case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in _STAGE_OF.items())} end as stage, case when event_type = 'error' or value > 190 then 'failed' else 'done' end as state from events),
  s as (select call_id, stage, max(state) as state from runs group by 1, 2), w as (select call_id, count(*) filter (state = 'done') as done, count(*) filter (state = 'failed') as failed, coalesce(max(state) filter (stage = 'analyze'), 'pending') as an from s group by 1)
  select call_id, case when done + failed = 0 then 'none' when done = 6 then 'complete' else 'partial' end as state, cast(done as int) as done, cast(failed as int) as failed, case when an <> 'done' then 'manual' when call_id % 2 = 0 then 'route' else 'close' end as status from w""")
def o1_run_status(spark, sf):
    events = fx.table(spark, sf, "events")
    stage = F.create_map(*(F.lit(x) for kv in _STAGE_OF.items() for x in kv))[F.col("event_type")]
    runs = events.select(F.col("user_id").alias("call_id"), stage.alias("stage"), F.lit(True).alias("present"), F.when((F.col("event_type") == "error") | (F.col("value") > 190), "timeout").alias("error"))
    routes = events.select(F.col("user_id").alias("call_id")).distinct().where("call_id % 2 = 0").select("call_id", F.lit("team").alias("team_name"), F.lit("P1").alias("priority"), F.lit("today").alias("sla"))
    return handoff.run_status(runs, routes).select("call_id", "state", "done", "failed", "status")


# ---- more of each family ----------------------------------------------------------------------------------


@query(f"""with {_CHURN_SQL}, r as (select *, call_id % 4 = 0 as escalate from churn) select call_id, score as churn_score, escalate or score >= 40 as needs_handoff, case when escalate or score >= 40 then 'T' end as team from r""")
def c14_triage_batch(spark, sf):
    speech = _speech(spark, sf)
    routes = speech.select("call_id", F.lit("T").alias("team"), F.lit("P1").alias("priority"))
    return rules.triage_batch(speech.select("call_id", (F.col("call_id") % 4 == 0).alias("escalate")), rules.score_churn(speech, fx.CHURN), routes).select("call_id", "churn_score", "needs_handoff", "team")


@query(f"""with {_CHURN_SQL}, g as (select call_id, case when call_id % 2 = 0 then 50 end as given, score from churn) select call_id, coalesce(given, score) as churn_score from g""")
def p9_enrich_calls(spark, sf):
    speech = _speech(spark, sf)
    given = speech.select("call_id", F.col("speech").alias("transcript"), F.when(F.col("call_id") % 2 == 0, 50).alias("churn_score"), F.lit(None).cast("string").alias("route_team"))
    return rules.enrich_calls(given, rules.score_churn(speech, fx.CHURN), speech.select("call_id", F.lit("general").alias("team"))).select("call_id", "churn_score")


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events), c as (select user_id, n, trim(event_type || ' ' || props) as body from r where n <= 5)
  select cast(user_id as varchar) || '-' || n as doc_id, case when length(body) > 20 then substr(body, 1, 20) || '…' else body end as title from c""")
def p10_clean_custom_docs(spark, sf):
    docs = fx.table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.struct("ts", "event_id").alias("ord"), F.concat_ws(" ", "event_type", "props").alias("body"))
    return search.clean_custom_docs(docs).select("doc_id", "title")


@query("""select customer.c_custkey as key, case when c_custkey % 3 = 0 then 's' when c_custkey % 5 = 0 then 'arr' end as bad_key from customer""")
def p13_contract_check(spark, sf):
    rows = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 != 0, "x").otherwise(" ").alias("s"), F.when(F.col("c_custkey") % 5 != 0, F.array(F.lit("a"))).alias("arr"))
    judged = rows.withColumn("arr", F.when(F.col("key") % 3 == 0, F.array(F.lit("a"))).otherwise(F.col("arr")))
    good, bad = X.contract_check(judged, strings=["s"], string_arrays=["arr"])
    return good.select("key", F.lit(None).cast("string").alias("bad_key")).union(bad.select("key", "bad_key"))


@query(f"""with {fx.TURNS_SQL}, c as (select call_id, turn_no as chunk_no, turn_no * 10.0 as start, turn_no * 10.0 + 10 as "end", text, speaker from turns),
  s as (select call_id, chunk_no, least(start + 1, "end") as start, least(start + 1 + length(text) / 16.0, "end") as "end" from c where speaker = 'agent')
  select call_id, 'segment' as kind, start, "end" from s union all select call_id, 'blind', start, "end" from c where speaker <> 'agent'""")
def w2_stitch_chunks(spark, sf):
    t = fx.turns(spark, sf)
    said = F.array(F.struct(F.lit(1.0).alias("start"), (1.0 + F.length("text") / 16.0).alias("end"), F.col("text").alias("text"), F.col("speaker").alias("speaker")))
    chunks = t.select("call_id", F.col("turn_no").alias("chunk_no"), (F.col("turn_no") * 10.0).alias("start"), (F.col("turn_no") * 10.0 + 10).alias("end"), F.when(F.col("speaker") == "agent", said).alias("segments"))
    segs, blind = timeline.stitch_chunks(chunks)
    return segs.select("call_id", F.lit("segment").alias("kind"), "start", "end").unionByName(blind.select("call_id", F.lit("blind").alias("kind"), "start", "end"))


@query(f"""with {fx.TURNS_SQL}, n as (select call_id, turn_no as seg_no, row_number() over (partition by call_id order by turn_no) as i from turns), l as (select call_id, speaker, row_number() over (partition by call_id order by turn_no) as i from turns where turn_no % 3 <> 0)
  select n.call_id, seg_no, speaker from n left join l on n.call_id = l.call_id and n.i = l.i""")
def w7_assign_speakers(spark, sf):
    t = fx.turns(spark, sf)
    lines = t.select("call_id", F.col("turn_no").alias("line_no"), F.when(F.col("turn_no") % 3 != 0, F.concat("speaker", F.lit(": "), "text")).otherwise(F.concat(F.lit("-"), "text")).alias("text"))
    return timeline.assign_speakers(t.select("call_id", F.col("turn_no").alias("seg_no")), lines).select("call_id", "seg_no", "speaker")


@query(f"""with {fx.TURNS_SQL} select call_id, turn_no as seg_no, case when turn_no = 1 then 'agent' else speaker end as speaker, turn_no = 1 as corrected from turns""")
def w8_apply_speaker_corrections(spark, sf):
    t = fx.turns(spark, sf).select("call_id", F.col("turn_no").alias("seg_no"), "speaker")
    return timeline.apply_speaker_corrections(t, t.where("seg_no = 1").select("call_id", "seg_no", F.lit("agent").alias("speaker")))


@query(f"""with {_BM25_SQL}, top as (select * from ranked where rank = 1) select item_id as query_id, case when top.score is null or top.score < 0.35 then 'none' when top.score < 1.2 then 'weak' else 'strong' end as confidence from benchmark left join top on query_id = item_id""")
def r10_retrieval_confidence(spark, sf):
    asked = fx.questions(spark, sf)
    lexical = search.bm25_rank(asked, _index(spark, sf), 1, (), fx.latin_tokens).withColumn("weak", F.lit(False))
    return search.retrieval_confidence(asked, lexical)


@query(f"""with terms as (select distinct item_id as query_id, unnest({fx.latin_terms_sql('text')}) as term from benchmark), syn(word, canon) as (values ('tion', 'canon'), ('canon', 'canon'), ('thin', 'thing'), ('thing', 'thing'))
  select query_id, term from terms union select query_id, canon from terms, syn where term = word or contains(term, word) or starts_with(word, term)""")
def r3_expand_queries(spark, sf):
    return search.expand_queries(fx.questions(spark, sf), (("canon", ("tion",)), ("thing", ("thin",))), fx.latin_tokens)


@query(f"with {fx.CALLS_SQL}, a as (select max(day) as a from calls) select cast(a - 6 as varchar) as start, cast(a as varchar) as \"end\", 7 as days, cast(a - 13 as varchar) as previous_start, cast(a - 7 as varchar) as previous_end from a")
def t1_t2_t3_periods(spark, sf):
    now = voc.resolve_period(voc.anchor_date(fx.calls(spark, sf)), "week")
    before = voc.previous_range(now).select(F.col("start").alias("previous_start"), F.col("end").alias("previous_end"))
    both = now.crossJoin(F.broadcast(before))  # one row each
    return both.select("days", *(F.col(c).cast("string").alias(c) for c in ("start", "end", "previous_start", "previous_end")))
