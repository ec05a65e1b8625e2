"""More queries over the given tables: ledgers, evidence, retrieval, answers, hand-off and streams, with SQL for the same rows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from callspark.functions import text as X
from callspark.operators import handoff, rules, search, timeline, turns, verify, voc
from callspark.operators import telemetry as tele
from callspark.plans import fixtures as fx
from callspark.plans import registry as R
from callspark.plans.registry import query
from callspark.sources import ledger
from callspark.streaming import jobs


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, *values: str) -> str:
    """A printf template as an expression of DuckDB."""
    return f"format({_quoted(template.replace('%d', '{}').replace('%s', '{}'))}, {', '.join(values)})"


# ---- ledgers and recognition results ----------------------------------------------------------------------


@query("""select cast(o_orderkey as varchar) as call_id, case when o_orderkey % 11 <> 0 then case when o_orderkey % 7 = 0 then 'n. d.' else strftime(o_orderdate, '%Y-%m-%d') end else '' end as call_date,
  case when o_orderkey % 5 = 0 or o_orderkey % 6 = 0 then 'untitled' else o_orderpriority end as title, case when o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0 then cast(o_orderdate as date) end as day, case when o_orderkey % 3 <> 0 then o_orderstatus end as category from orders""")
def s1_read_calls(spark, sf):
    """Orders as JSON lines of a ledger, parsed by its schema: dates, titles and analyses may be missing or no such thing."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    record = F.struct(
        key.cast("string").alias("call_id"), F.when(key % 11 != 0, F.when(key % 7 == 0, "n. d.").otherwise(day)).alias("call_date"), F.when(key % 5 != 0, F.when(key % 6 == 0, "  ").otherwise(F.col("o_orderpriority"))).alias("title"),
        F.when(key % 3 != 0, F.struct(F.col("o_orderstatus").alias("category"))).alias("analysis"),
    )
    rows = fx.table(spark, sf, "orders").select(F.from_json(F.to_json(record), ledger.CALL_SCHEMA).alias("r")).select("r.*")
    return ledger.normalise_calls(rows).select("call_id", "call_date", "title", "day", F.col("analysis.category").alias("category"))


@query(r"""with t as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:5] as p from documents)
  select doc_id, cast(unnest(range(0, len(p))) as int) as call_no, substr(unnest(p), 1, 2000) as transcript from t""")
def s2_split_bulk_calls(spark, sf):
    """Whole documents with a blank line after each line; five calls of 2,000 characters are the limits of the format."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return ledger.split_bulk_calls(docs, "doc_id", "text")


@query(f"""with {fx.TURNS_SQL}, timed as (select call_id, cast(row_number() over (partition by call_id order by turn_no) - 1 as int) as seg_no, turn_no * 10.0 as start, turn_no * 10.0 + 5 as "end", trim(text) as text, speaker from turns where call_id % 3 <> 0 and turn_no % 4 <> 3 and turn_no % 5 <> 4 and trim(text) <> ''),
  words as (select call_id, cast(row_number() over (partition by call_id order by turn_no) - 1 as int) as seg_no, turn_no * 10.0 as start, turn_no * 10.0 + 1 as "end", 'w' || turn_no as text, cast(null as varchar) as speaker from turns where call_id not in (select call_id from timed))
  select * from timed union all select * from words""")
def s3_read_asr(spark, sf):
    """Segments without a time or a text go; calls without any left fall back to their words."""
    begin, text = F.col("turn_no") * 10.0, F.when(F.col("turn_no") % 5 != 4, F.col("text")).otherwise(" ")
    segment = F.struct(F.when(F.col("turn_no") % 4 != 3, begin).alias("start"), (begin + 5).alias("end"), text.alias("text"), F.col("speaker").alias("speaker"))
    word = F.struct(F.concat(F.lit("w"), F.col("turn_no").cast("string")).alias("word"), begin.alias("start"), (begin + 1).alias("end"))
    gathered = fx.turns(spark, sf).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", segment.alias("segment"), word.alias("word")))).alias("all"))
    results = gathered.select("call_id", F.when(F.col("call_id") % 3 != 0, F.transform("all", lambda x: x["segment"])).alias("segments"), F.transform("all", lambda x: x["word"]).alias("words"))
    return ledger.read_asr(results)


_LEDGER_COLUMNS = "date agent title category sentiment escalate causes departments repeated churn_score churn_level owner origin".split()


@query("""with t as (select l_orderkey as call_id, l_linenumber as ord, l_returnflag || l_linestatus as label, l_returnflag as team from lineitem), ranked as (select *, row_number() over (partition by call_id order by ord, label, team) as i from t),
  causes as (select call_id, string_agg(label, ' / ' order by i) as causes from ranked group by 1), firsts as (select call_id, team, min(i) as i from ranked group by 1, 2), depts as (select call_id, string_agg(team, ' / ' order by i) as departments from firsts group by 1)
  select o_orderkey as call_id, strftime(o_orderdate, '%Y-%m-%d') as date, 'agent-' || (o_custkey % 40) as agent, o_orderpriority as title, o_orderpriority as category, o_orderstatus as sentiment, case when o_orderkey % 10 <> 0 and o_totalprice > 200000 then 'Y' else 'N' end as escalate,
    coalesce(causes, '') as causes, coalesce(departments, '') as departments, case when o_custkey % 4 = 0 then 'Y' else '' end as repeated, case when o_orderkey % 6 <> 0 then cast(o_orderkey % 100 as varchar) else '' end as churn_score, '' as churn_level, 'team' as owner,
    case when o_orderkey % 2 = 0 then '직접 분석' else '내장 샘플' end as origin from orders left join causes on o_orderkey = causes.call_id left join depts on o_orderkey = depts.call_id""")
def s5_ledger_rows(spark, sf):
    """The rows that ``write_ledger_csv`` writes."""
    orders, key = fx.table(spark, sf, "orders"), F.col("o_orderkey")
    calls = orders.select(
        key.alias("call_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("call_date"), F.concat(F.lit("agent-"), (F.col("o_custkey") % 40).cast("string")).alias("agent"), F.col("o_orderpriority").alias("title"), F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("sentiment"), F.when(key % 10 != 0, F.col("o_totalprice") > 200_000).alias("escalate"), F.when(key % 6 != 0, (key % 100).cast("int")).alias("churn_score"), F.lit(None).cast("string").alias("churn_level"), F.lit("team").alias("team_name"), (key % 2 == 0).alias("mine"),
    )
    themes = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_returnflag").alias("team_name"))
    return handoff.ledger(calls, themes, orders.where("o_custkey % 4 = 0").select(key.alias("call_id"))).toDF("call_id", *_LEDGER_COLUMNS)


@query("""select cast(o_orderkey as varchar) as call_id, substr(repeat(o_orderpriority, 5), 1, 40) as title, o_orderstatus as category, case when o_orderkey % 4 <> 0 then o_orderkey % 100 end as churn_score,
  case when o_orderkey % 4 <> 0 then array_to_string(list_transform(range(1, least(6, o_orderkey % 9 + 1) + 1), lambda x: 's' || x), ',') end as signals, 'T' as team from orders""")
def s7_redacted_snapshot(spark, sf):
    key = F.col("o_orderkey")
    signals = F.transform(F.sequence(F.lit(1), (key % 9 + 1).cast("int")), lambda n: F.concat(F.lit("s"), n.cast("string")))
    churn = F.when(key % 4 != 0, F.struct((key % 100).alias("score"), F.lit("x").alias("level"), F.lit(False).alias("estimated"), signals.alias("signals")))
    analysis = F.struct(F.col("o_orderstatus").alias("category"), F.lit("s").alias("sentiment"), F.lit(True).alias("escalate"), churn.alias("churn"), F.struct(F.lit("T").alias("team"), F.lit("P1").alias("priority")).alias("route"))
    calls = fx.table(spark, sf, "orders").select(key.cast("string").alias("call_id"), F.lit("2024-01-01").alias("call_date"), F.lit("a").alias("agent"), F.lit(1.0).alias("minutes"), F.repeat("o_orderpriority", F.lit(5)).alias("title"), F.lit("said").alias("transcript"), analysis.alias("analysis"))
    return ledger.redacted_snapshot(calls).select("call_id", "title", "analysis.category", F.col("analysis.churn.score").alias("churn_score"), F.array_join("analysis.churn.signals", ",").alias("signals"), "analysis.route.team")


@query("""select doc_id as call_id, substr(coalesce(source, ''), 1, 30) as label, 40 + doc_id % 60 as total, case when quality = 1 then '' else 'low' end as missed, source as violations, case when doc_id % 2 = 0 then true else doc_id % 3 = 0 end as speaker_labeled from documents join labels using (doc_id) where toxic = 0""")
def s9_qa_history_rows(spark, sf):
    """Results without a score (the toxic ones) are skipped."""
    rows, key = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels").hint("merge"), "doc_id"), F.col("doc_id")
    score = F.struct((40 + key % 60).alias("total"), F.lit("A").alias("grade"), F.lit(1).alias("rule_score"), F.lit(2).alias("llm_score"), F.lit(False).alias("estimated"), F.lit(0).alias("deduction"))
    mention = lambda label, found: F.struct(F.lit(label).alias("label"), found.alias("found"))
    qa = rows.select(
        key.alias("call_id"), F.lit("2024-01-01").alias("call_date"), F.col("source").alias("label"), F.when(F.col("toxic") == 0, score).alias("score"), F.array(mention("low", F.col("quality") == 1), mention("said", F.lit(True))).alias("mentions"),
        F.array(F.struct(F.col("source").alias("label"))).alias("findings"), F.when(key % 2 != 0, key % 3 == 0).alias("speaker_labeled"),
    )
    return ledger.qa_history_rows(qa).select("call_id", "label", "total", F.array_join("missed", ",").alias("missed"), F.array_join("violations", ",").alias("violations"), "speaker_labeled")


# ---- texts that leave -------------------------------------------------------------------------------------

_CARD_SQL, _MAIL_SQL = r"(^|[^A-Za-z0-9_])((?:[0-9]\x03?[ -]?){12,18}[0-9])($|[^A-Za-z0-9_])", r"(^|[^A-Za-z0-9_])([A-Za-z0-9_.+-]+)@([A-Za-z0-9_-]+\.[A-Za-z0-9_.]+)"
_LUHN_SQL = "list_sum(list_transform(string_split(reverse(regexp_replace(string_split(x, chr(2))[1], '[^0-9]', '', 'g')), ''), lambda c, i: case when i % 2 = 0 then cast(c as int) * 2 // 10 + cast(c as int) * 2 % 10 else cast(c as int) end)) % 10 = 0"
# A mark behind digits lets two cards share the blank between them. Cards and mails of the given texts are marked, cut at the marks and masked piece by piece; what stands behind each text is written masked.
_MASKED_SQL = rf"""given as (select doc_id, string_split(replace(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])([^A-Za-z0-9_])', '\1' || chr(3) || '\2', 'g'), '{_CARD_SQL}', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(3), ''), chr(1)) as c from documents),
  carded as (select doc_id, c, c[1] || array_to_string(list_transform(c[2:], lambda x: case when {_LUHN_SQL} then regexp_replace(left(string_split(x, chr(2))[1], -4), '[0-9]', '*', 'g') || right(string_split(x, chr(2))[1], 4) || string_split(x, chr(2))[2] else replace(x, chr(2), '') end), '') as t from given),
  mailed as (select doc_id, c, string_split(regexp_replace(t, '{_MAIL_SQL}', '\1' || chr(1) || '\2' || chr(2) || '@\3', 'g'), chr(1)) as m from carded),
  masked as (select doc_id, c, m, m[1] || array_to_string(list_transform(m[2:], lambda x: case when position(chr(2) in x) > 2 then left(x, 1) || repeat('*', position(chr(2) in x) - 2) else '*' end || string_split(x, chr(2))[2]), '')
    || ' 해지 문의 010-****-' || lpad(cast(doc_id * 7 % 10000 as varchar), 4, '0') || ' 주민 900101-1******' || chr(10) || '입금 계좌 ***-**-***' || right(lpad(cast(doc_id % 1000000 as varchar), 6, '0'), 3) as text from mailed)"""
# A card keeps its last four digits, and a blank between them isn't one.
_TAIL_SQL = "regexp_extract(string_split(x, chr(2))[1], '[0-9]([ -]?[0-9]){3}$')"
_OUTBOUND_SQL = f"""with {
    _MASKED_SQL.replace("left(string_split(x, chr(2))[1], -4)", f"left(string_split(x, chr(2))[1], length(string_split(x, chr(2))[1]) - length({_TAIL_SQL}))").replace("right(string_split(x, chr(2))[1], 4)", _TAIL_SQL)
} select doc_id, md5(text) as outbound from masked"""


def _outgoing(docs):
    """Whole texts with their cards and mails, and behind them a term to correct, a phone, a resident and an account number of the document's own."""
    padded = lambda n, size: F.lpad(n.cast("string"), size, "0")
    key = F.col("doc_id")
    more = F.concat(F.lit(" 헤지 문의 010-"), padded(key % 10_000, 4), F.lit("-"), padded(key * 7 % 10_000, 4), F.lit(" 주민 900101-1"), padded(key % 1_000_000, 6), F.lit("\n입금 계좌 123-45-"), padded(key % 1_000_000, 6))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))


@query(f"""with {_MASKED_SQL}, n as (select count(*) as docs, sum(len(list_filter(c[2:], lambda x: {_LUHN_SQL}))) as cards, sum(len(m) - 1) as mails from masked)
  select type, cast(n as bigint) as n from (select unnest(['rrn', 'card', 'phone', 'account', 'email']) as type, unnest([docs, cards, docs, docs, mails]) as n from n) where n > 0""")
def p4_p5_pii_audit(spark, sf):
    return X.pii_audit(X.mask_pii(_outgoing(fx.table(spark, sf, "documents")), "text"))


@query(_OUTBOUND_SQL)
def p8_outbound_text(spark, sf):
    return X.outbound_text(_outgoing(fx.table(spark, sf, "documents")), "text").select("doc_id", F.md5("outbound").alias("outbound"))


@query(_OUTBOUND_SQL)
def x6_mask_stream(spark, sf):
    return jobs.drain(jobs.mask_stream(_outgoing(fx.stream(spark, sf, "documents"))).select("doc_id", F.md5("outbound").alias("outbound")))


def _own(spark, sf, *values):
    """A row of each source of the documents for each of ``values``; every third source has none."""
    table = F.array(*(F.struct(F.lit(k).alias("ord"), *cells) for k, cells in enumerate(values)))
    owners = fx.table(spark, sf, "documents").select(F.col("source").alias("owner")).where("owner is not null").distinct().where("ascii(substr(md5(owner), 1, 1)) % 3 <> 0")
    return owners.select("owner", F.explode(table).alias("v")).select("owner", "v.*")


@query("""with d as (select doc_id, coalesce(text, '') as t0, source, source is not null and ascii(substr(md5(source), 1, 1)) % 3 <> 0 as own from documents),
  a as (select *, case when own then replace(t0, 'the', source || '!') else t0 end as t1 from d), b as (select *, case when own then replace(t1, source, 'the') else t1 end as t2 from a), c as (select *, case when own then replace(t2, 'en', 'the') else t2 end as t3 from b)
  select doc_id, md5(t3) as corrected, case when own and contains(t0, 'the') then (length(t0) - length(replace(t0, 'the', ''))) // 3 else 0 end as marked,
    case when own then (length(t1) - length(replace(t1, source, ''))) // length(source) + (length(t2) - length(replace(t2, 'en', ''))) // 2 else 0 end as other from c""")
def p6_own_terms(spark, sf):
    """Each source's own pairs, of which one reads what the one before wrote, on its own documents only."""
    owner = F.col("owner")
    made = _own(spark, sf, (F.lit("the").alias("wrong"), F.concat("owner", F.lit("!")).alias("term")), (owner.alias("wrong"), F.lit("the").alias("term")), (F.lit("en").alias("wrong"), F.lit("the").alias("term")), (F.lit("e").alias("wrong"), F.lit("x").alias("term")))
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("owner"))
    out = X.correct_own_terms(docs, "text", X.clean_custom_terms(made))
    count = lambda key: F.coalesce(F.try_element_at("corrected_counts", key), F.lit(0)).cast("long")
    return out.select("doc_id", F.md5("corrected").alias("corrected"), count(F.concat(F.coalesce("owner", F.lit("")), F.lit("!"))).alias("marked"), count(F.lit("the")).alias("other"))


@query(f"""with {R._MENTIONS_SQL}, teams as (select call_id, call_id % 4 as owner, text from scripts),
  more as (select call_id, 'custom-' || k as mention, 4 + k as ord, case when owner = 1 then contains(text, 'tion') or contains(text, 'zzz') when owner = 2 and k = 1 then contains(text, 'Re') else contains(text, 'qu') end as found from teams, (values (1), (2)) as v(k) where owner = 1 and k = 1 or owner = 2),
  every as (select call_id, mention, list_position([{', '.join(_quoted(m[0]) for m in fx.MENTIONS)}], mention) - 1 as ord, found from mentioned union all select * from more),
  sized as (select *, count(*) over (partition by call_id) as n from every)
  select call_id, mention, cast(ord as int) as ord, cast(40 // n + case when ord < 40 % n then 1 else 0 end as int) as points, found from sized""")
def c6_own_mentions(spark, sf):
    """Four teams: one has a mention of its own, one has two, and two have none that can be used."""
    scripts = turns.agent_script(fx.transcripts(spark, sf)).withColumn("owner", (F.col("call_id") % 4).cast("long"))
    words = lambda *w: F.array(*map(F.lit, w))
    made = {1: [("Ends", words("zzz", " tion "))], 2: [("Starts", words("Re")), ("  ", words("The")), ("Asks", words("qu", ""))], 3: [("Empty", words(" "))]}
    table = F.array(*(F.struct(F.lit(o).cast("long").alias("owner"), F.lit(k).alias("ord"), F.lit(label).alias("label"), w.alias("keywords")) for o, rows in made.items() for k, (label, w) in enumerate(rows)))
    raw = scripts.select(F.explode(table).alias("r")).select("r.*").distinct()
    return rules.check_own_mentions(rules.check_mentions(scripts, fx.MENTIONS), scripts, rules.custom_mentions(raw))


_LABELLED_SQL = f"{fx.TURNS_SQL}, labelled as (select call_id, string_agg(case speaker when 'agent' then '상담사: ' else '고객: ' end || text, chr(10) order by turn_no) as transcript from turns group by 1)"
_LAST_SQL = _LABELLED_SQL + r""", own as (select call_id, transcript, list_filter(string_split(transcript, chr(10)), lambda x: regexp_matches(x, '^\s*고객\s*[:：]')) as l from labelled),
  asked as (select call_id, trim(case when len(l) > 0 then substr(trim(regexp_replace(l[-1], '^\s*고객\s*[:：]\s*', '')), 1, 300) else right(transcript, 300) end) as query from own)"""


def _labelled(spark, sf):
    """(call_id, transcript) with the labels that upstream transcripts have."""
    line = F.concat(F.when(F.col("speaker") == "agent", "상담사: ").otherwise("고객: "), "text").alias("line")
    gathered = fx.turns(spark, sf).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", line))).alias("l"))
    return gathered.select("call_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


@query(f"with {_LAST_SQL} select call_id, query from asked")
def p11_last_customer_query(spark, sf):
    return turns.last_customer_query(_labelled(spark, sf))


@query(f"""with words as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^가-힣a-z0-9]+'), lambda w: length(w) >= 2) as w from documents)
  select doc_id, cast(unnest(range(0, len(w))) as int) as pos, unnest(w) as term from words""")
def r1_tokenise_positions(spark, sf):
    """The tokeniser itself; Latin words have no endings to cut."""
    return X.tokenise(fx.table(spark, sf, "documents"), "doc_id", "text")


# ---- evidence of quality ----------------------------------------------------------------------------------

_PIECES = [(m[0], lit, lit[:n], n, len(lit)) for m in fx.MENTIONS for lit in dict.fromkeys(x for p in m[-1] for x in rules.pattern_literals(p)) for n in range(max(2, -(-len(lit) // 2)), len(lit) + 1)]


@query(f"""with {R._MENTIONS_SQL}, pieces(mention, literal, matched, n, size) as (values {', '.join(f"('{m}', '{lit}', '{part}', {n}, {size})" for m, lit, part, n, size in _PIECES)}),
  said as (select call_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from scripts), missing as (select call_id, mention from mentioned where not found),
  hits as (select said.call_id, mention, line_no, literal, matched, cast(n as double) / size as ratio, row_number() over (partition by said.call_id, mention order by cast(n as double) / size desc, n desc, line_no, literal) as i from said join pieces on contains(line, matched) join missing using (call_id, mention))
  select call_id, mention, cast(line_no as int) as line_no, literal, matched, ratio from hits where i = 1""")
def c7_near_misses(spark, sf):
    scripts = turns.agent_script(fx.transcripts(spark, sf))
    return rules.near_misses(scripts, rules.check_mentions(scripts, fx.MENTIONS), fx.MENTIONS)


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events),
  g as (select user_id, ts, event_id, substr(trim(case when event_type = 'error' then '  ' else ' ' || event_type || ' of the account ' || user_id || ' at ' || event_id end), 1, 30) as label,
    list_filter(list_transform([' ', event_type, props, 'xxxxxxxxxxxxxxxxxxxxxxxxx', 'a', 'b', 'c'], lambda k: substr(trim(k), 1, 20)), lambda k: k <> '')[1:5] as kw from r where n <= 3)
  select user_id as owner, 'custom-' || row_number() over (partition by user_id order by ts, event_id) as rule, label, array_to_string(kw, '|') as keywords from g where label <> ''""")
def c8_custom_mentions(spark, sf):
    """The first three rules of an account are a limit of the form."""
    label = F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" of the account "), F.col("user_id").cast("string"), F.lit(" at "), F.col("event_id").cast("string")))
    keywords = F.array(F.lit(" "), "event_type", "props", F.lit("x" * 25), F.lit("a"), F.lit("b"), F.lit("c"))
    raw = fx.table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.struct("ts", "event_id").alias("ord"), label.alias("label"), keywords.alias("keywords"))
    return rules.custom_mentions(raw).select("owner", "rule", "label", F.array_join("keywords", "|").alias("keywords"))


def _clamped(x: str, low: int, high: int) -> str:
    return f"least(greatest({x}, {low}), {high})"


_MIDDLE = "least(greatest(floor(8 + ratio * 10 - least({n} * 2, 6) + 0.5), 2), 18)"
_BANDED = {c: f"least(greatest({c}, low), high)" for c in ("empathy", "clarity", "resolution")}


@query(f"""with {R._FORBIDDEN_SQL}, m as (select call_id, count(*) filter (found) / count(*) as ratio from mentioned group by 1), f as (select call_id, count(*) as n_all, count(*) filter (deduct > 0) as n_counted from findings group by 1),
  facts as (select call_id, ratio, coalesce(n_all, 0) as n_all, coalesce(n_counted, 0) as n_counted, floor(8 - 3 * abs(ratio - 0.5) * 2 + 0.5) as half from m left join f using (call_id)),
  bands as (select call_id, least({_clamped(_MIDDLE.format(n='n_counted') + ' - half', 0, 20)}, {_clamped(_MIDDLE.format(n='n_all') + ' - half', 0, 20)}) as low, {_clamped(_MIDDLE.format(n='n_counted') + ' + half', 0, 20)} as high from facts),
  given as (select *, least(call_id % 23, 20) as empathy, least(call_id * 7 % 25, 20) as clarity, case when call_id % 3 <> 0 then 10 else 0 end as resolution from bands)
  select call_id, cast(low as int) as low, cast(high as int) as high, {', '.join(f'cast({x} as int) as {c}' for c, x in _BANDED.items())}, {' or '.join(f'{x} <> {c}' for c, x in _BANDED.items())} as adjusted from given""")
def c11b_band_qa(spark, sf):
    scripts, findings = R._findings(spark, sf)
    given = scripts.select("call_id", (F.col("call_id") % 23).alias("empathy"), (F.col("call_id") * 7 % 25).alias("clarity"), F.when(F.col("call_id") % 3 != 0, 10).alias("resolution"))
    return rules.band_qa(given, rules.check_mentions(scripts, fx.MENTIONS), findings)


_SAID_SQL = f"{fx.TURNS_SQL}, said as (select call_id, regexp_extract(string_agg(speaker || ': ' || text, chr(10) order by turn_no), '[a-z]{{5,}}') as word from turns group by 1)"


def _audited(spark, sf):
    """Three comments a call: on a word that was said, on one that was not, and without a quote."""
    calls = fx.transcripts(spark, sf)
    word = F.regexp_extract("transcript", "[a-z]{5,}", 0)
    made = F.array(F.concat(F.lit("“"), word, F.lit("” was said")), F.lit('"¤¤¤¤" was not'), F.lit("no quote"))
    return rules.audit_comments(calls.select("call_id", F.posexplode(made).alias("comment_no", "comment")), calls)


@query(f"""with {_SAID_SQL} select call_id, 0 as comment_no, case when word <> '' then 1 else 0 end as n_quotes, case when word <> '' then cast(1 as double) end as ratio, case when word <> '' then true end as verified from said
  union all select call_id, 1, 1, cast(0 as double), false from said union all select call_id, 2, 0, null, null from said""")
def c11d_audit_comments(spark, sf):
    return _audited(spark, sf)


_HEARD_SQL = f"""{fx.TURNS_SQL}, heard as (select call_id, trim(regexp_extract(string_agg(speaker || ': ' || text, chr(10) order by turn_no), '[A-Za-z ,.]{{12,24}}')) as said from turns group by 1),
  sized as (select call_id, length(regexp_replace(said, '[ ,.]', '', 'g')) as n from heard)"""


@query(f"""with {_HEARD_SQL}, q as (select *, unnest([0, 1, 2]) as comment_no from sized), r as (select call_id, comment_no, n, [1, 4, 20][comment_no + 1] as more from q)
  select call_id, cast(comment_no as int) as comment_no, 1 as n_quotes, n / (n + more) as ratio, n + more >= 10 and n / (n + more) >= 0.8 as verified from r""")
def c11d_partial_quotes(spark, sf):
    """Comments that quote a stretch of the call and go on with what nobody said: a little, some, and much of it."""
    calls = fx.transcripts(spark, sf)
    said = F.trim(F.regexp_extract("transcript", "[A-Za-z ,.]{12,24}", 0))
    made = F.array(*(F.concat(F.lit("so “"), said, F.lit("¤" * n), F.lit("”")) for n in (1, 4, 20)))
    return rules.audit_comments(calls.select("call_id", F.posexplode(made).alias("comment_no", "comment")), calls)


@query(f"""with {_SAID_SQL}, n as (select call_id, case when word <> '' then 1 else 0 end as n from said) select call_id, cast(n + 1 as bigint) as quoted, cast(2 - n as bigint) as unquoted, cast(n as bigint) as verified, cast(1 as bigint) as unverified, n / 2 as average from n""")
def c11d_comment_summary(spark, sf):
    return rules.comment_audit_summary(_audited(spark, sf))


_TITLE_SQL = f"'[' || category || '] ' || substr(trim(regexp_replace(coalesce(kw[1], summary[1], {_quoted(rules._UNCLEAR)}), '\\s+', ' ', 'g')), 1, 40) || case when sentiment = '강성' then ' (강성)' else '' end"


@query(f"""with c as (select o_orderkey as call_id, o_orderpriority as category, case o_orderstatus when 'F' then '강성' else '중립' end as sentiment, o_totalprice > 300000 as escalate, case when o_totalprice > 300000 then 'over the limit' end as why,
    case when o_orderkey % 3 <> 0 then ['a ' || o_orderstatus, 'b', 'c'] end as summary, case when o_orderkey % 2 = 0 then ['fee  query'] else [] end as kw, case when o_orderkey % 5 <> 0 then o_orderkey % 100 end as score, 'r' || (o_custkey % 5) as reason from orders),
  d as (select *, {_TITLE_SQL} as title from c where coalesce(escalate, false) or coalesce(score, 0) >= 40)
  select call_id, title, concat_ws(chr(10), '제목: ' || title, '담당: team · 우선순위 P1 · today', '배정 근거: ' || reason, chr(10) || '문의 유형: ' || category || ' / 고객 감정: ' || sentiment, '이탈 위험: ' || score || '점 (L)', case when score is not null then '위험 신호: one, two' end,
    case when summary is not null then chr(10) || '통화 요약' || chr(10) || '  1. ' || summary[1] || chr(10) || '  2. b' || chr(10) || '  3. c' end, chr(10) || '에스컬레이션 사유: ' || why,
    chr(10) || '요청 조치' || chr(10) || '  - w' || chr(10) || '  - x' || chr(10) || '  - y' || chr(10) || '  - z', case when score is not null then chr(10) || '근거 발화 (전사 인용)' || chr(10) || '  "said so"' end, {_quoted(rules._NOTE)}) as body from d""")
def c13_ticket_drafts(spark, sf):
    orders, key = fx.table(spark, sf, "orders"), F.col("o_orderkey")
    calls = orders.select(
        key.alias("call_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "F", "강성").otherwise("중립").alias("sentiment"), (F.col("o_totalprice") > 300_000).alias("escalate"), F.when(F.col("o_totalprice") > 300_000, "over the limit").alias("escalate_reason"),
        F.when(key % 3 != 0, F.array(F.concat(F.lit("a "), "o_orderstatus"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("summary"), F.array("o_orderpriority", F.lit(" "), F.when(key % 2 == 0, "fee  query").otherwise("")).alias("intent_keywords"), F.array(*map(F.lit, "wxyz!")).alias("actions"),
    )
    routes = orders.select(key.alias("call_id"), F.lit("team").alias("team_name"), F.lit("P1").alias("priority"), F.lit("today").alias("sla"), F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("reason"))
    signal = lambda label, evidence: F.struct(F.lit(label).alias("label"), F.lit(evidence).alias("evidence"))
    churn = orders.where("o_orderkey % 5 <> 0").select(key.alias("call_id"), (key % 100).alias("score"), F.lit("L").alias("level"), F.array(signal("one", "said so"), signal("two", "")).alias("signals"))
    return rules.ticket_drafts(calls, routes, churn)


# ---- timelines --------------------------------------------------------------------------------------------


@query(f"""with m as ({R._SQL["w5_talk_metrics"]}), t as (select call_id, coalesce(longest_silence_sec >= 10, false) as a, coalesce(max_response_delay_sec >= 5, false) as b, coalesce(agent_ratio >= 75, false) as c from m)
  select call_id, 'long-silence' as alert_id, 'warn' as level from t where a union all select call_id, 'slow-response', 'warn' from t where b union all select call_id, 'agent-dominant', 'warn' from t where c union all select call_id, 'time-ok', 'ok' from t where not (a or b or c)""")
def w6_diagnose_talk(spark, sf):
    return timeline.diagnose_talk(timeline.talk_metrics(fx.segments(spark, sf))).select("call_id", "alert_id", "level")


@query(f"""with {fx.TURNS_SQL}, q as (select call_id, turn_no as quote_no, regexp_replace(substr(text, 5, 12), '\\s', '', 'g') as q from turns), pieces as (select call_id, quote_no, unnest(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) as piece from q),
  counted as (select call_id, quote_no, piece, count(*) as times from pieces group by 1, 2, 3), flat as (select call_id, turn_no as seg_no, regexp_replace(text, '\\s', '', 'g') as t from turns),
  scored as (select call_id, quote_no, seg_no, sum(times) as score from counted join flat using (call_id) where contains(t, piece) group by 1, 2, 3), best as (select *, row_number() over (partition by call_id, quote_no order by score desc, seg_no) as i from scored where score >= 3)
  select q.call_id, q.quote_no, seg_no from q left join best on best.call_id = q.call_id and best.quote_no = q.quote_no and i = 1""")
def w9_locate_quotes(spark, sf):
    """A piece of each turn, looked for in all turns of its call."""
    t = fx.turns(spark, sf)
    return timeline.locate_quotes(t.select("call_id", F.col("turn_no").alias("quote_no"), F.substring("text", 5, 12).alias("quote")), t.select("call_id", F.col("turn_no").alias("seg_no"), "text"))


@query(f"""with {fx.TURNS_SQL} select call_id, string_agg(case when turn_no % 4 = 3 then '' when speaker = 'agent' then '상담사: ' else '고객: ' end || text, chr(10) order by turn_no) as transcript from turns group by 1""")
def w10_render_transcript(spark, sf):
    return timeline.render_transcript(fx.turns(spark, sf).select("call_id", F.col("turn_no").alias("seg_no"), F.when(F.col("turn_no") % 4 != 3, F.col("speaker")).alias("speaker"), "text"))


# ---- voice of the customer --------------------------------------------------------------------------------


@query(f"""with {fx.CALLS_SQL}, n as (select count(*) as total, count(*) filter (escalate) as escalated, count(*) filter (sentiment = 'F') as negative from calls), t as (select category, count(*) as c from calls group by 1), top as (select * from t order by c desc, category desc limit 1)
  select {_filled(voc._HEADLINE, 'total', 'category', 'c', 'escalated')} as headline, {_filled(voc._FINDING, 'category', 'c')} as finding,
    case when negative = 0 then {_quoted(voc._NO_SORE)} else {_quoted(voc._SORE_CALLS)} || negative || '건 (전체 ' || total || '건 중 ' || cast(floor(negative / total * 100 + 0.5) as bigint) || '%)' || {_quoted(voc._SORE_END)} end as negative_finding, {_filled(voc._ADVICE, 'category')} as recommendation from n, top""")
def a14_voc_report(spark, sf):
    return voc.voc_report(voc.voc_summary(fx.calls(spark, sf), R._PRIORITIES, R._STATES, ("F",)), ("F",))


def _risen(key: str) -> str:
    """Values of a key that rose on the last of the days that have calls, by the default thresholds."""
    return f"""select {key} as value, count(*) filter (rank = 1) as now, count(*) filter (rank > 1) / (select max(rank) - 1 from ranked) as base from ranked group by 1 having now >= 3 and (base = 0 or now / base >= 2)"""


_RISEN_SQL = "ranked as (select o_orderkey, case when o_orderkey % 14 = 13 then 'rush' else o_orderpriority end as category, case when o_orderkey % 14 = 13 or o_orderkey % 140 = 0 then 'late' else o_orderstatus end as theme, dense_rank() over (order by o_orderkey % 14 desc) as rank from orders)"


def _risen_calls(spark, sf):
    """Fourteen days of orders, the last with a category of its own and a cause that was rare before."""
    orders, key = fx.table(spark, sf, "orders"), F.col("o_orderkey")
    calls = orders.select(
        key.alias("call_id"), F.expr("date_add(date '2024-01-01', cast(o_orderkey % 14 as int))").alias("day"), F.when(key % 14 == 13, "rush").otherwise(F.col("o_orderpriority")).alias("category"), F.when(F.col("o_orderstatus") == "F", voc.HOT).otherwise("s").alias("sentiment"),
        (F.col("o_totalprice") > 200_000).alias("escalate"),
    )
    themes = orders.select(key.alias("call_id"), F.when((key % 14 == 13) | (key % 140 == 0), "late").otherwise(F.col("o_orderstatus")).alias("theme"), F.lit("T").alias("team_name"))
    return calls, themes, orders.where("o_custkey % 4 = 0").select(key.alias("call_id"))


_SPIKE_COLUMNS = f"now, {R._r('base')} as baseline_per_day, case when base > 0 then {R._r('now / base')} end as ratio, case when base = 0 or now / base >= 3 then 'high' else 'warn' end as level"


@query(f"with {_RISEN_SQL} select value as category, {_SPIKE_COLUMNS} from ({_risen('category')})")
def n1_default_spikes(spark, sf):
    return voc.category_spikes(_risen_calls(spark, sf)[0])


@query(f"with {_RISEN_SQL} select value as theme, {_SPIKE_COLUMNS}, 'T' as team_name from ({_risen('theme')})")
def n2_default_theme_spikes(spark, sf):
    return voc.theme_spikes(*_risen_calls(spark, sf)[:2])


@query("select 'repeat-ratio' as alert_id, 'warn' as level, count(*) as calls, count(*) filter (o_custkey % 4 = 0) as hits from orders having count(*) >= 5 and count(*) filter (o_custkey % 4 = 0) / count(*) >= 0.15")
def n4_default_repeat_alert(spark, sf):
    calls, _, again = _risen_calls(spark, sf)
    return voc.repeat_alert(calls, again)


@query(f"""with {_RISEN_SQL},
  n as (select count(*) as calls, count(*) filter (o_orderstatus = 'F') as hot, count(*) filter (o_totalprice > 200000) as esc, count(*) filter (o_custkey % 4 = 0) as again from orders)
  select 0 as ord, 'hot-ratio' as alert_id, 'high' as level, hot as now from n where hot / calls >= 0.25 union all select 0, 'escalate-ratio', 'warn', esc from n where esc / calls >= 0.30 union all select 1, 'repeat-ratio', 'warn', again from n where again / calls >= 0.15
  union all select 2, 'spike-' || value, case when base = 0 or now / base >= 3 then 'high' else 'warn' end, now from ({_risen('category')}) union all select 3, 'theme-' || value, case when base = 0 or now / base >= 3 then 'high' else 'warn' end, now from ({_risen('theme')})""")
def n5_voc_anomalies(spark, sf):
    return voc.voc_anomalies(*_risen_calls(spark, sf))


# ---- retrieval --------------------------------------------------------------------------------------------

_REWRITES = (("tion", "topic", ("tion",), "canon"), ("thing", "modifier", ("^the", "ing$"), "thing"), ("never", "topic", ("qqqq",), "never"))


@query(f"""with known as (select list(distinct lower(lang)) as known from documents where lang is not null), q as (select item_id as query_id, text as q, regexp_replace(lower(text), '[^가-힣a-z0-9]', '', 'g') as flat, list_distinct({fx.latin_terms_sql('text')}) as own from benchmark),
  h as (select *, list_has_any(own, known) as anchored, regexp_matches(flat, 'tion') as h1, regexp_matches(flat, '^the|ing$') as h2 from q, known), u as (select *, (h1 or h2) and (anchored or (h1 and h2)) as use from h),
  a as (select *, case when use then list_filter([case when h1 then 'canon' end, case when h2 then 'thing' end], lambda x: x is not null and not list_contains(own, x)) else [] end as added from u)
  select query_id, md5(case when len(added) > 0 then q || ' ' || array_to_string(added, ' ') else q end) as text, array_to_string(added, ',') as added, case when use then array_to_string(list_filter([case when h1 then 'tion' end, case when h2 then 'thing' end], lambda x: x is not null), ',') else '' end as applied, anchored,
    (h1 or h2) and not use as blocked from a""")
def r4_rewrite_queries(spark, sf):
    """Questions that name a language of the corpus count as anchored."""
    vocabulary = fx.table(spark, sf, "documents").select(F.lower("lang").alias("term"))
    out = search.rewrite_queries(fx.questions(spark, sf), vocabulary, _REWRITES, (), fx.latin_tokens)
    return out.select("query_id", F.md5("text").alias("text"), F.array_join("added", ",").alias("added"), F.array_join("applied", ",").alias("applied"), "anchored", "blocked")


_GRAMS = "list_distinct(list_transform(range(1, length(f)), lambda i: substr(f, i, 2)))"


@query(f"""with d as (select doc_id, regexp_replace(lower(coalesce(string_split(text, chr(10))[1] || ' ' || text, '')), '[^가-힣a-z0-9]', '', 'g') as f from documents), q as (select item_id as query_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as f from benchmark),
  dg as (select doc_id, unnest({_GRAMS}) as gram from d), qg as (select query_id, unnest({_GRAMS}) as gram from q), n as (select query_id, count(*) as n from qg group by 1),
  s as (select query_id, doc_id, floor(count(*) / max(n) * 0.5 * 1000 + 0.5) / 1000 as score from qg join dg using (gram) join n using (query_id) group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, score, true as weak, rank from r where rank <= 10""")
def r6_bigram_fallback(spark, sf):
    """Whole benchmark items typed without any blank: no word of theirs is known, so the bigrams of whole documents answer."""
    asked = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("q"))
    found = search.bm25_rank(asked, R._index(spark, sf), 10, (), fx.latin_tokens)
    return found.select("query_id", "doc_id", "score", "weak", F.col("rank").cast("long").alias("rank"))


_SURE_SQL = f"""{R._BM25_SQL}, sure as (select query_id, case when score < 0.35 then 'none' when score < 1.2 then 'weak' else 'strong' end as confidence from ranked where rank = 1)"""


@query(f"""with {_SURE_SQL}, answered as (select s.query_id, s.confidence, e.embedding from sure s join embeddings e on s.query_id = e.vec_id where s.confidence <> 'none'),
  near as (select query_id, vec_id as doc_id, row_number() over (partition by query_id order by round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) desc, vec_id) as rank from answered a, embeddings b),
  mixed as (select query_id, doc_id, rank from ranked join answered using (query_id) where rank <= 8 union all select query_id, doc_id, rank from near where rank <= 8), f as (select query_id, doc_id, floor(sum(1 / (60 + rank)) * 10000 + 0.5) / 10000 as rrf from mixed group by 1, 2),
  o as (select *, row_number() over (partition by query_id order by rrf desc, doc_id) as rank from f) select query_id, doc_id, rrf, rank, confidence, md5(string_split(text, chr(10))[1]) as title from o join answered using (query_id) join documents using (doc_id) where rank <= 3""")
def r11_hybrid_search(spark, sf):
    """Benchmark items with the vector of their number, over documents with theirs."""
    docs, vectors = fx.knowledge(spark, sf), fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = fx.questions(spark, sf).join(vectors.withColumnRenamed("doc_id", "query_id").hint("merge"), "query_id")
    found = search.hybrid_search(asked, docs, R._index(spark, sf), vectors, toks=fx.latin_tokens, synonyms=())
    return found.select("query_id", "doc_id", "rrf", F.col("rank").cast("long").alias("rank"), "confidence", F.md5("title").alias("title"))


@query(f"""with {_SURE_SQL}, lead as (select query_id, doc_id, confidence, array_to_string(string_split(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ') as lead from sure join ranked using (query_id) join documents using (doc_id) where rank = 1)
  select query_id, case when confidence = 'strong' then '' else '관련성이 낮을 수 있습니다: ' end || lead as answer, doc_id as cited from lead""")
def r12_extractive_answers(spark, sf):
    asked = fx.questions(spark, sf)
    ranked = search.bm25_rank(asked, R._index(spark, sf), 3, (), fx.latin_tokens)
    out = search.extractive_answers(ranked, fx.knowledge(spark, sf), search.retrieval_confidence(asked, ranked))
    return out.select("query_id", "answer", F.get("cited", F.lit(0)).alias("cited"))


_RELS_SQL = f"""{R._BM25_SQL}, rels as (select b.item_id as query_id, case when b.item_id % 2 = 0 then 'tuned' else 'held_out' end as kind, min(d.doc_id) as expected from benchmark b left join documents d on contains(d.text, b.text) group by 1, 2),
  shifted as (select query_id, doc_id, score, rank - 1 as rank from ranked where rank between 2 and 10), kept as (select * from ranked where rank <= 10)"""


def _rated_sql(name: str, source: str) -> str:
    ratio = lambda x: f"""coalesce({R._r(f"sum({x}) filter (expected is not null) / count(expected)", 3)}, 0.0)"""
    return f"""{name}_at as (select r.*, k.rank, case when t.score >= 0.35 then 1 else 0 end as answered from rels r left join {source} k on k.query_id = r.query_id and k.doc_id = r.expected left join {source} t on t.query_id = r.query_id and t.rank = 1),
  {name} as (select kind, {ratio("case when rank = 1 then 1 else 0 end")} as recall1, {ratio("case when rank <= 3 then 1 else 0 end")} as recall3, {ratio("coalesce(1 / rank, 0)")} as mrr,
    coalesce({R._r("sum(1 - answered) filter (expected is null) / count(*) filter (expected is null)", 3)}, 0.0) as abstain_accuracy from {name}_at group by 1)"""


def _rated(spark, sf):
    """BM25 as it is, and without its first result, on benchmark items in two sets; a document that holds an item answers it."""
    asked = fx.questions(spark, sf)
    held = R._first_holding(fx.table(spark, sf, "documents"), asked)
    rels = asked.select("query_id", F.when(F.col("query_id") % 2 == 0, "tuned").otherwise("held_out").alias("set")).join(held.hint("merge"), "query_id", "left")
    ranked = search.bm25_rank(asked, R._index(spark, sf), 10, (), fx.latin_tokens)
    shifted = ranked.withColumn("rank", F.col("rank") - 1).where("rank >= 1")
    return (search.evaluate_ranker(r, rels, search.retrieval_confidence(asked, r)) for r in (ranked, shifted))


@query(f"""with {_RELS_SQL}, {_rated_sql('old', 'kept')}, {_rated_sql('new', 'shifted')} select kind as "set", {', '.join(f"floor((new.{c} - old.{c}) * 1000 + 0.5) / 1000 as {c}" for c in ("recall1", "recall3", "mrr", "abstain_accuracy"))} from new join old using (kind)""")
def r18_compare_rankers(spark, sf):
    before, after = _rated(spark, sf)
    return search.compare_rankers(before, after)[0]


@query(f"""with {_RELS_SQL}, {_rated_sql('old', 'kept')}, l as (select kind, unnest(['recall1', 'recall3', 'mrr']) as metric, unnest([recall1, recall3, mrr]) as v from old)
  select metric, max(v) filter (kind = 'tuned') as tuned, max(v) filter (kind = 'held_out') as held_out, floor((max(v) filter (kind = 'tuned') - max(v) filter (kind = 'held_out')) * 1000 + 0.5) / 1000 as gap from l group by 1""")
def r19_self_assessment(spark, sf):
    before, _ = _rated(spark, sf)
    return search.self_assessment(before[0])


# What no word of the corpus answers is answered by bigrams: a document has a question's bigram if its text without blanks contains it.
_BARE_SQL = "regexp_replace(lower(coalesce({}, '')), '[^가-힣a-z0-9]', '', 'g')"
_ASSIST_SQL = f"""{_LAST_SQL}, {R._BM25_SQL.replace("select distinct item_id as query_id, unnest(" + fx.latin_terms_sql('text') + ") as term from benchmark", "select distinct call_id as query_id, unnest(" + fx.latin_terms_sql('query') + ") as term from asked")},
  lost as (select query_id, {_GRAMS} as grams from (select call_id as query_id, {_BARE_SQL.format('query')} as f from asked where not exists (select 1 from ranked where query_id = call_id))),
  guessed as (select query_id, doc_id, len(list_filter(grams, lambda g: contains(f, g))) as hit, len(grams) as n from lost, (select doc_id, {_BARE_SQL.format("string_split(text, chr(10))[1] || ' ' || text")} as f from documents)),
  guesses as (select query_id, doc_id, floor(hit / n * 0.5 * 1000 + 0.5) / 1000 as score from guessed where hit > 0),
  found as (select query_id, doc_id, score, rank from ranked union all select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from guesses)"""


@query(f"""with {_ASSIST_SQL}
  select call_id, md5(query) as query, doc_id, score, rank, regexp_matches(query, 'the') as heated from asked left join (select * from found where rank <= 3) r on r.query_id = call_id""")
def r20_assist_docs(spark, sf):
    out = search.assist_docs(_labelled(spark, sf), R._index(spark, sf), 3, "the", fx.latin_tokens, ())
    return out.select("call_id", F.md5("query").alias("query"), "doc_id", "score", F.col("rank").cast("long").alias("rank"), "heated")


# ---- checks of answers ------------------------------------------------------------------------------------

_ANSWERS_SQL = """given as (select o_orderkey as answer_id, cast(1000 + floor(o_totalprice) as bigint) as a, o_custkey % 40 + 10 as b from orders), answers as (select *, a || '원 and ' || b || '% are what this order adds up to in all' as answer, case answer_id % 3 when 0 then 'zzz' when 1 then a || '원 and the rest' else answer end as evidence from given),
  support as (select answer_id, list_filter([case when answer_id % 3 = 0 then a || '원' end, case when answer_id % 3 <> 2 and answer_id % 2 <> 0 then b || '%' end], lambda x: x is not null) as lost from answers)"""


def _answers(spark, sf):
    """An amount and a share a order; a third of the evidence has neither, a third the amount; half of the questions name the share."""
    key, a, b = F.col("o_orderkey"), (F.floor("o_totalprice") + 1000).cast("string"), (F.col("o_custkey") % 40 + 10).cast("string")
    answer = F.concat(a, F.lit("원 and "), b, F.lit("% are what this order adds up to in all"))
    evidence = F.when(key % 3 == 0, "zzz").when(key % 3 == 1, F.concat(a, F.lit("원 and the rest"))).otherwise(answer)
    question = F.when(key % 2 == 0, F.concat(F.lit("is it "), b, F.lit(" now"))).otherwise("how much")
    return fx.table(spark, sf, "orders").select(key.alias("answer_id"), answer.alias("answer"), evidence.alias("evidence"), question.alias("question"), F.array(F.lit("d1"), F.concat(F.lit("d"), (key % 3).cast("string"))).alias("cited"))


@query(f"with {_ANSWERS_SQL} select answer_id, len(lost) = 0 as ok, 2 as checked, 2 - len(lost) as supported, array_to_string(list_sort(lost), '|') as unsupported from support")
def r15_numeric_support(spark, sf):
    out = verify.numeric_support(_answers(spark, sf))
    return out.select("answer_id", "ok", F.col("checked").cast("int").alias("checked"), F.col("supported").cast("long").alias("supported"), F.array_join("unsupported", "|").alias("unsupported"))


@query(f"""with {_ANSWERS_SQL}, flat as (select *, regexp_replace(answer, '[\\s\\pP]', '', 'g') as fa, regexp_replace(evidence, '[\\s\\pP]', '', 'g') as fe from answers), p as (select *, {_GRAMS.replace('(f', '(fa')} as pa, {_GRAMS.replace('(f', '(fe')} as pe from flat),
  g as (select *, floor(len(list_intersect(pa, pe)) / len(pa) * 100 + 0.5) / 100 as grounding from p), v as (select *, case when grounding < 0.15 and length(trim(answer)) >= 40 then 'reject' when grounding < 0.35 then 'warn' else 'ok' end as verdict from g)
  select answer_id, case when verdict = 'reject' or len(lost) > 0 then 'extract ' || answer_id else answer end as final, verdict = 'reject' or len(lost) > 0 as replaced, verdict, case when answer_id % 2 <> 0 then '' when answer_id % 3 = 2 then 'd1,d2' else 'd1' end as cited from v join support using (answer_id)""")
def r16_gate_answers(spark, sf):
    answers, key = _answers(spark, sf), F.col("answer_id")
    extracts = answers.select("answer_id", F.concat(F.lit("extract "), key.cast("string")).alias("extract"))
    results = answers.where("answer_id % 2 = 0").select("answer_id", F.array(F.lit("d1"), F.lit("d2")).alias("doc_ids"))
    return verify.gate_answers(answers, extracts, results).select("answer_id", "final", "replaced", "verdict", F.array_join("cited", ",").alias("cited"))


_BARE = "regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 ]', '', 'g')"
_FLAT = "replace({}, ' ', '')"


def _bare(spark, sf):
    return fx.dealt(fx.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9 ]", "").alias("t"))


@query(f"""with c as (select conv_id, turn, {_BARE} as o, case turn % 3 when 0 then {_BARE} when 1 then replace({_BARE}, 'th', 'ht') else replace({_BARE}, 'e', 'ooo') end as n from conversations), f as (select *, {_FLAT.format('o')} as r, {_FLAT.format('n')} as h from c),
  k as (select *, cast(floor(cast(0.15 as double) * length(r)) as bigint) as k, least(length(r), length(h)) as m from f),
  p as (select *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: substr(r, i, 1) <> substr(h, i, 1))) - 1, m) as head from k),
  t as (select *, coalesce(list_min(list_filter(range(1, m - head + 1), lambda i: substr(r, -i, 1) <> substr(h, -i, 1))) - 1, m - head) as tail from p),
  j as (select *, r = h as same, abs(length(r) - length(h)) > k as far, (length(r) - head - tail) * least(length(h) - head - tail, 2 * k + 1) > 400000 as big from t),
  d as (select *, case when length(r) > 0 then not same and not far and big end as unverifiable, case when length(r) > 0 and not far then same or levenshtein(r, h) <= k else false end as ok from j)
  select conv_id, turn, ok, unverifiable, md5(case when ok then n else o end) as kept from d""")
def e3_preserve_gate(spark, sf):
    """Letters, digits and blanks of whole messages against versions with no, few or many changes, each pair measured; ``unverifiable`` tells which are over upstream's budget."""
    rows = _bare(spark, sf)
    new = F.when(F.col("turn") % 3 == 0, F.col("t")).when(F.col("turn") % 3 == 1, F.replace("t", F.lit("th"), F.lit("ht"))).otherwise(F.replace("t", F.lit("e"), F.lit("ooo")))
    return verify.preserve_gate(rows.select("conv_id", "turn", F.col("t").alias("original"), new.alias("rewritten")), exact=True).select("conv_id", "turn", "ok", "unverifiable", F.md5("kept").alias("kept"))


@query(f"""with c as (select role as model, {_BARE} as t from conversations), h as (select model, t, replace(replace(t, 'the', 'teh'), 'tion', 'shun') as h from c), p as (select model, 'raw' as stage, t, h from h union all select model, 'corrected', t, replace(h, 'shun', 'tion') from h where contains(h, 'shun')),
  f as (select model, stage, {_FLAT.format('t')} as r, {_FLAT.format('h')} as h from p) select model, stage, count(*) as pairs, cast(sum(levenshtein(r, h)) as bigint) as distance, cast(sum(length(r)) as bigint) as ref_length, cast(sum(levenshtein(r, h)) as bigint) / cast(sum(length(r)) as bigint) as cer from f where length(r) > 0 group by 1, 2""")
def e4_compare_asr(spark, sf):
    heard = F.replace(F.replace("t", F.lit("the"), F.lit("teh")), F.lit("tion"), F.lit("shun"))
    pairs = _bare(spark, sf).select(F.col("role").alias("model"), F.col("t").alias("reference"), heard.alias("hypothesis"))
    out = verify.compare_asr(pairs, (("tion", ("shun",)),))
    return out.select("model", "stage", "pairs", F.col("distance").cast("long").alias("distance"), F.col("ref_length").cast("long").alias("ref_length"), "cer")


# ---- hand-off ---------------------------------------------------------------------------------------------

_STAGE_CASE = f"case event_type {' '.join(f'when {_quoted(a)} then {_quoted(b)}' for a, b in R._STAGE_OF.items())} end"
_CHECKS_SQL = f"""runs as (select user_id as call_id, {_STAGE_CASE} as stage, max(case when event_type = 'error' and value > 150 or value > 190 then 'timeout' end) as error from events group by 1, 2),
  facts as (select c_custkey as call_id, c_custkey % 3 <> 0 as analyzed, c_custkey % 4 = 0 as escalate, case when c_custkey % 5 <> 0 then c_custkey % 100 end as churn, c_custkey % 6 <> 0 as labeled, c_custkey % 7 = 0 as estimated, 50 + c_custkey % 50 as qa, c_custkey % 9 % 2 as withheld, c_custkey % 8 = 0 as truncated, c_custkey % 10 = 0 as demo from customer),
  failed as (select call_id, 'stage-' || stage as alert_id, case when stage in ('analyze', 'stt') then 'high' else 'warn' end as level, list_position(['stt', 'lex', 'dia', 'analyze', 'qa', 'voc'], stage) - 101 as ord from runs where error is not null),
  f as (select facts.*, lost.call_id is not null as lost from facts left join (select call_id from runs where error is not null and stage = 'dia') lost using (call_id)),
  found as (select call_id, 'escalate' as alert_id, 'high' as level, 0 as ord from f where analyzed and escalate union all select call_id, 'churn', 'high', 1 from f where churn >= 70 union all select call_id, 'churn', 'warn', 2 from f where churn >= 40 and churn < 70 union all select call_id, 'speaker', 'warn', 3 from f where not labeled or lost
    union all select call_id, 'withheld', 'warn', 4 from f where withheld > 0 union all select call_id, 'quality', 'warn', 5 from f where qa < 70 union all select call_id, 'truncated', 'warn', 6 from f where truncated union all select call_id, 'estimated', 'info', 7 from f where analyzed and demo or estimated),
  marked as (select * from failed union all select * from found), checks as (select * from marked union all select call_id, 'none', 'info', 0 from facts where call_id not in (select call_id from marked))"""


def _runs(spark, sf):
    """Users as calls and kinds of events as their stages; large values and large errors failed."""
    stage = F.create_map(*(F.lit(x) for kv in R._STAGE_OF.items() for x in kv))[F.col("event_type")]
    error = F.when((F.col("event_type") == "error") & (F.col("value") > 150) | (F.col("value") > 190), "timeout")
    return fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("call_id"), stage.alias("stage")).agg(F.lit(True).alias("present"), F.max(error).alias("error"))


def _checks(spark, sf):
    key = F.col("c_custkey")
    calls = fx.table(spark, sf, "customer").select(
        key.alias("call_id"), (key % 3 != 0).alias("analyzed"), (key % 4 == 0).alias("escalate"), F.when(key % 5 != 0, key % 100).alias("churn_score"), (key % 6 != 0).alias("churn_labeled"), (key % 7 == 0).alias("churn_estimated"), F.lit(None).cast("boolean").alias("qa_labeled"),
        (50 + key % 50).alias("qa_total"), F.lit(False).alias("qa_estimated"), (key % 9 % 2).alias("withheld"), (key % 8 == 0).alias("truncated"), (key % 10 == 0).alias("demo"),
    )
    return handoff.handoff_checks(calls, _runs(spark, sf))


@query(f"with {_CHECKS_SQL} select call_id, alert_id, level, cast(ord as int) as ord, case level when 'high' then 0 when 'warn' then 1 else 2 end as rank from checks")
def o2_handoff_checks(spark, sf):
    return _checks(spark, sf).select("call_id", "alert_id", "level", "ord", "rank")


@query(f"""with {_CHECKS_SQL}, listed as (select call_id, string_agg('- [' || level || '] ' || alert_id, chr(10) order by case level when 'high' then 0 when 'warn' then 1 else 2 end, ord, alert_id) as checks from checks group by 1),
  w as (select call_id, count(*) filter (error is null) as done, count(*) filter (error is not null) as failed, coalesce(bool_or(stage = 'analyze' and error is null), false) as known from runs group by 1)
  select call_id, concat_ws(chr(10), '통화 ' || call_id || ' · ' || case when done + failed = 0 then 'none' when done = 6 then 'complete' else 'partial' end || ' (' || done || '/6)', '상태: ' || case when not known then 'manual' when call_id % 2 = 0 then 'route' else 'close' end,
    case when not known then '미배정' when call_id % 2 = 0 then '담당: team · P1 · today' else '추가 이관 없음' end, '확인 사항' || chr(10) || checks) as report from w left join listed using (call_id)""")
def o3_handoff_report(spark, sf):
    runs = _runs(spark, sf)
    routes = runs.select("call_id").distinct().where("call_id % 2 = 0").select("call_id", F.lit("team").alias("team_name"), F.lit("P1").alias("priority"), F.lit("today").alias("sla"))
    return handoff.handoff_report(handoff.run_status(runs, routes), _checks(spark, sf))


# ---- streams, run over what is there ----------------------------------------------------------------------

def _local(*columns: str):
    """Instants as the given tables have times."""
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


@contextmanager
def _rocks(spark):
    """The state store that stateful handlers need, for the streams inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:
        jobs.use_rocksdb(spark)
        yield
    finally:
        spark.conf.set(name, before)


_MARK_SQL = "mark as (select max(ts) - interval 10 minutes as mark from events)"


_RISKS = ("leave", "other", "cost")


@query(f"""with {fx.TURNS_SQL}, tags as (select call_id, {', '.join(f"bool_or(speaker = 'agent' and ({' or '.join(f'regexp_matches(text, {_quoted(p)})' for p in m[-1])})) as {m[0]}" for m in fx.MENTIONS)} {', '.join(['', *(f"bool_or(speaker = 'customer' and ({' or '.join(f'regexp_matches(text, {_quoted(p)})' for p in c[-1])})) as {c[0]}" for c in fx.CHURN if c[0] in _RISKS)])} {', '.join(['', *(f"bool_or(speaker = 'agent' and ({' or '.join(f'contains(text, {_quoted(p)})' for p in f[-1])})) as {f[0]}" for f in fx.FORBIDDEN)])} from turns group by 1)
  select call_id, array_to_string(list_filter([{', '.join(f"case when {f[0]} then '{f[0]}' end" for f in sorted(fx.FORBIDDEN))}], lambda x: x is not null), ',') as forbidden, cast(floor((cast(greeting as int) + cast(recording as int) + cast(identity as int) + cast(solution as int) + cast(closing as int)) * 20 + 0.5) as int) as progress,
    case when not (greeting and recording) then 'open' when not identity then 'verify' when not solution then 'resolve' else 'close' end as stage,
    array_to_string(list_filter([case when not greeting then 'greeting' end, case when not recording then 'recording' end, case when not identity then 'identity' end, case when not solution then 'solution' end, case when not closing then 'closing' end], lambda x: x is not null)[1:2], ',') as next_mentions,
    array_to_string(list_filter([{', '.join(f"case when {r} then '{r}' end" for r in sorted(_RISKS))}], lambda x: x is not null), ',') as alerts from tags""")
def x1_live_guide(spark, sf):
    """The last state of each call once all turns are in; turns come in three stretches, and the stream goes on from its checkpoint."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn_no"))
    said, feeds = fx.fed(fx.turns(spark, sf).select("call_id", "speaker", "text", at.alias("ts")), "ts")
    with _rocks(spark):
        return jobs.drain_last(jobs.live_guide(said, fx.MENTIONS, fx.CHURN, playbook=_RISKS, forbidden=fx.FORBIDDEN), "call_id", feeds=feeds)


# watermarks are whole milliseconds; a row is settled when it lies before
_EDGE_SQL = "edge as (select epoch_ms(max({ts})) * 1000 - 600000000 as edge from {rows})"


@query(f"{R._ADMIT_SQL}, {_EDGE_SQL.format(ts='ts', rows='events')} select cast(bucket as varchar) as bucket, cast(request_id as varchar) as request_id, epoch_us(ts) as \"at\", accepted from walk, edge where epoch_us(ts) < edge")
def x2_admit_stream(spark, sf):
    """Two requests a day and account, decided in time order while events come in three stretches."""
    hits, feeds = fx.fed(fx.instants(fx.table(spark, sf, "events")).select(F.col("user_id").alias("bucket"), "ts", F.col("event_id").alias("request_id")), "ts")
    with _rocks(spark):
        return jobs.drain(jobs.admit_stream(hits, 2, 86_400), feeds=feeds)


@query(
    R._SQL["a11_spend_24h"].replace("select request_id, cast(sum", "select request_id, created_at, cast(sum").replace("), s as (", ",\n  s as (")
    .replace("\n  select request_id, cast(floor", f", {_EDGE_SQL.format(ts='created_at', rows='cost')}\n  select cast(request_id as varchar) as request_id, cast(floor")
    + ", edge where epoch_us(created_at) < edge"
)
def x3_spend_live(spark, sf):
    """What an account has spent in the 24 hours up to each of its requests, while requests come in three stretches."""
    asked, feeds = fx.fed(fx.telemetry_of(fx.instants(fx.table(spark, sf, "events"))), "created_at")
    with _rocks(spark):
        out = jobs.drain(jobs.spend_live(asked), feeds=feeds)
    return out.select("request_id", X.js_round(F.col("spent_24h") * 1_000_000).alias("spent_micro"), "admitted")


@query(f"""with {_EDGE_SQL.format(ts='ts', rows='events')}, words as (select user_id as call_id, event_id as word_no, event_type || case when value > 150 then '.' else '' end as word, epoch_us(ts) as start, epoch_us(ts) + 60000000 as until from events, edge where epoch_us(ts) < edge),
  cuts as (select *, case when start - lag(until) over w >= 43200000000 or lag(word) over w like '%.' then 1 else 0 end as cut from words window w as (partition by call_id order by word_no)), segs as (select *, sum(cut) over (partition by call_id order by word_no) as seg_no from cuts),
  said as (select call_id, seg_no, min(start) as start, max(until) as until, string_agg(word, ' ' order by word_no) as text, max(seg_no) over (partition by call_id) as top from segs group by 1, 2)
  select call_id, make_timestamp(start) as start, make_timestamp(until) as "end", text from said, edge where seg_no < top or text like '%.' or edge - until >= 43200000000""")
def x8_utterances_live(spark, sf):
    """Utterances by both rules from words (events of a minute each) that come in three stretches; gaps are half days."""
    rows = fx.instants(fx.table(spark, sf, "events")).select(F.col("user_id").alias("call_id"), F.concat("event_type", F.when(F.col("value") > 150, ".").otherwise("")).alias("word"), "ts", (F.col("ts") + F.expr("interval 1 minute")).alias("until"), F.col("event_id").alias("no"))
    words, feeds = fx.fed(rows, "ts")
    with _rocks(spark):
        return jobs.drain(jobs.utterances_live(words, until="until", order="no", gap="12 hours"), feeds=feeds).select("call_id", *_local("start", "end"), "text")


@query(f"""with {fx.TELEMETRY_SQL}, cost as (select account, created_at, input_tokens * 500 + output_tokens * 2500 + coalesce(cache_read_tokens, 0) * 50 as c from telemetry where greatest(input_tokens, output_tokens, coalesce(cache_read_tokens, 0)) > 0),
  w as (select account, c, unnest(list_transform([0, 1, 2, 3], lambda k: time_bucket(interval 6 hours, created_at) - k * interval 6 hours)) as start from cost), {_MARK_SQL}
  select account, start, start + interval 24 hours as "end", cast(floor(cast(sum(c) as double) / 100 + 0.5) as bigint) as spent_micro from w, mark where start + interval 24 hours <= mark group by 1, 2""")
def x3_spend_stream(spark, sf):
    """Days that slide by six hours; the last ones are still open when the stream ends."""
    out = jobs.drain(jobs.spend_stream(fx.telemetry_of(fx.stream(spark, sf, "events")), slide="6 hours"))
    return out.select("account", *_local("start", "end"), X.js_round(F.col("spent") * 1_000_000).alias("spent_micro"))


@query(R._SQL["a9_telemetry_rollup"].replace(" where created_at < timestamp '2024-01-16'", ""))
def x4_telemetry_rollup_stream(spark, sf):
    folder = f"{jobs.shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    jobs.finish(jobs.telemetry_rollup_stream(fx.telemetry_of(fx.stream(spark, sf, "events")), f"{folder}/parts", f"{folder}/state"))
    return jobs.read_rollup(spark, f"{folder}/parts").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query("select distinct user_id || '-' || event_type as request_id from events")
def x5_dedupe_requests(spark, sf):
    """Retries of a request (an account's events of one kind) are seen once."""
    rows = fx.stream(spark, sf, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("request_id"), F.col("ts").alias("created_at"))
    return jobs.drain(jobs.dedupe_requests(rows)).select("request_id")


@query(f"with {_MARK_SQL}, c as (select cast(ts as date) as day, event_type as category, count(*) as n from events group by 1, 2) select day, category, n from c, mark where day + interval 1 day <= mark")
def x7_daily_counts_stream(spark, sf):
    """Days that the watermark has passed."""
    return jobs.drain(jobs.daily_counts_stream(fx.stream(spark, sf, "events").withColumnRenamed("event_type", "category")))


@query(f"""with {_MARK_SQL}, c as (select *, case when ts - lag(ts) over w >= interval 1 day then 1 else 0 end as cut from events window w as (partition by user_id order by ts)), s as (select *, sum(cut) over (partition by user_id order by ts rows unbounded preceding) as n from c)
  select user_id as call_id, min(ts) as start, max(ts) + interval 1 day as "end", string_agg(event_type, ' ' order by ts, event_type) as words from s, mark group by user_id, n, mark having max(ts) + interval 1 day <= mark""")
def x8_utterance_stream(spark, sf):
    """Runs of an account's events without a day's gap."""
    rows = fx.stream(spark, sf, "events").select(F.col("user_id").alias("call_id"), F.col("event_type").alias("word"), "ts")
    return jobs.drain(jobs.utterance_stream(rows, gap="1 day")).select("call_id", *_local("start", "end"), "words")
