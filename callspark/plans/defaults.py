"""The default (Korean) dictionaries on the given conversations: each turn is followed by a sentence that its numbers pick, and SQL reads the same patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from callspark.functions import text as X
from callspark.operators import dictionaries as D
from callspark.operators import rules, search, turns, voc
from callspark.plans import fixtures as fx
from callspark.plans import registry as R
from callspark.plans.registry import query
from callspark.plans.workflows import _quoted

# Sentences of customers and agents; some meet several rules, some none.
ASKED = (
    "인터넷 속도가 느려요 또 느려졌어요", "요금이 왜 이렇게 많이 나왔나요", "해외 로밍 요금제를 알고 싶어요", "약정이 남았는데 위약금이 얼마예요", "그냥 해지하려고 하는데 다른 회사로 옮기려고요", "요금제를 바꾸려면 어떻게 하나요",
    "자동이체 날짜를 바꿔 주세요", "게임 결제가 자꾸 돼요 환불해 주세요", "아버지 폰이랑 같이 쓰면 싼 걸로 묶어 주나요", "기사님이 방문 점검을 안 왔어요", "명의를 동생으로 바꾸려고요", "새로 가입하려고 합니다", "안내를 못 받았고 불친절해요 실망이에요",
    "소비자원에 민원 접수하고 변호사와 법적으로 가겠습니다", "지난 주에도 말했는데 두 번째 전화예요", "네 고맙습니다 해결됐어요 그대로 둘게요", "이사를 가는데 철거가 되나요", "잘 모르겠어요", "헤지 요금 제 문의와 소액 결제 명의변경 문의",
)
SAID = (
    "안녕하세요 반갑습니다", "본인 확인을 위해 생년월일을 말씀해 주세요", "통화 내용은 녹음됩니다", "바로 처리해 드리고 안내해 드리겠습니다", "더 궁금한 점이 있으신가요 좋은 하루 되세요", "고객님이 잘못 누르신 것 같아요 그러게 왜 그러셨어요",
    "어쩔 수 없습니다 규정이라 안 됩니다", "아 진짜 했잖아요", "무조건 됩니다 제가 다 책임지겠습니다", "잠시만 기다려 주세요",
)


def _picked(sentences, number):
    return F.get(F.array(*map(F.lit, sentences)), (number % len(sentences)).cast("int"))


def _turns(spark, sf):
    number = F.col("call_id") * 7 + F.col("turn_no") * 5
    return fx.turns(spark, sf).withColumn("text", F.concat("text", F.lit("\n"), F.when(F.col("speaker") == "agent", _picked(SAID, number)).otherwise(_picked(ASKED, number))))


def _picked_sql(sentences) -> str:
    return f"[{', '.join(map(_quoted, sentences))}][cast((call_id * 7 + turn_no * 5) % {len(sentences)} as int) + 1]"


_TURNS_SQL = f"{fx.TURNS_SQL.replace('turns as', 'plain as', 1)}, turns as (select call_id, turn_no, speaker, text || chr(10) || case speaker when 'agent' then {_picked_sql(SAID)} else {_picked_sql(ASKED)} end as text from plain)"
_SPEECH_SQL = R._SPEECH_SQL.replace(fx.TURNS_SQL, _TURNS_SQL)


def _speech(spark, sf):
    """(call_id, speech, labeled, title, category): what the customer said, else all turns."""
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("turn_no", "text")))), lambda x: x["text"]), "\n")
    raw = F.concat("speaker", F.lit(": "), "text").alias("raw")
    t = _turns(spark, sf).select("call_id", "turn_no", "speaker", "text", raw)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "raw"))), lambda x: x["raw"]), "\n")
    customer = F.col("speaker") == "customer"
    g = t.groupBy("call_id").agg(joined(customer).alias("own"), whole.alias("raw"), F.count_if(customer).alias("n"))
    return g.select("call_id", F.when(F.col("n") > 0, F.col("own")).otherwise(F.col("raw")).alias("speech"), (F.col("n") > 0).alias("labeled"), F.lit("").alias("title"), F.lit(None).cast("string").alias("category"))


def _themed(spark, sf):
    speech = _speech(spark, sf)
    return speech, rules.tag_themes(speech, speech.select("call_id", "speech", "labeled"))


_HITS_SQL = f"""hits as (select call_id, theme, team, ord, pattern_no, arg_min(line, line_no) as line from lines, {R._pattern_rows(D.THEMES, "theme, team, ord, pattern_no, pattern")} where regexp_matches(line, pattern) group by all),
  themes as (select call_id, theme, team, ord, count(distinct trim(line)) as n_evidence from hits group by all)"""


@query(f"with {_SPEECH_SQL}, {_HITS_SQL} select call_id, theme, ord, team, n_evidence from themes")
def c1_default_themes(spark, sf):
    return _themed(spark, sf)[1].select("call_id", "theme", "ord", "team", F.size("evidence").cast("long").alias("n_evidence"))


_AGAIN_SQL = " or ".join(f"regexp_matches(speech, {_quoted(p)})" for p in D.REPEATS)


@query(f"with {_SPEECH_SQL} select call_id from speech where {_AGAIN_SQL}")
def c2_default_repeats(spark, sf):
    speech = _speech(spark, sf)
    return rules.flag_repeat_calls(speech, speech).select("call_id")


_CHURN_SQL = f"""signals as (select distinct call_id, signal, cast(weight as int) as weight from lines, {R._pattern_rows(D.CHURN_SIGNALS, 'signal, weight, ord, pattern_no, pattern')} where trim(line) <> '' and line_no > 1 and regexp_matches(line, pattern)),
  churn as (select call_id, cast(least(greatest(coalesce(sum(weight), 0), 0), 100) as int) as score, count(*) filter (weight > 0) as n_risk from speech left join signals using (call_id) group by 1)"""


@query(f"with {_SPEECH_SQL}, {_CHURN_SQL} select call_id, score, case when score >= 70 then '높음' when score >= 40 then '중간' when score >= 15 then '낮음' else '없음' end as level, n_risk from churn")
def c4_default_churn(spark, sf):
    return rules.score_churn(_speech(spark, sf)).select("call_id", "score", "level", "n_risk")


_ROUTES_SQL = f"""{_SPEECH_SQL}, {_HITS_SQL}, {_CHURN_SQL}, first as (select call_id, arg_min(team, ord) as theme_team from themes group by 1),
  routes as (select call_id, speech, case when regexp_matches(speech, {_quoted(D.ESCALATION)}) then 'legal' when score >= 70 or (contains(speech, '해지') and regexp_matches(speech, '타사|번호\\s*이동|다른\\s*통신사')) then 'retention' when theme_team is not null then theme_team
    {' '.join(f"when regexp_matches(speech, {_quoted(p)}) then {_quoted(team)}" for team, _, p in D.RESIDUAL_ROUTES)} else 'general' end as team from speech left join first using (call_id) join churn using (call_id)),
  teams(team, team_name, priority) as (values {', '.join(f"({_quoted(t[0])}, {_quoted(t[1])}, {_quoted(t[3])})" for t in D.TEAMS)})"""


def _routed(spark, sf):
    speech, themes = _themed(spark, sf)
    return speech, themes, rules.route_calls(speech, speech, themes, rules.score_churn(speech))


@query(f"with {_ROUTES_SQL} select call_id, team, team_name, priority from routes join teams using (team)")
def c12_default_routes(spark, sf):
    return _routed(spark, sf)[2].select("call_id", "team", "team_name", "priority")


_BARE_SQL = "regexp_replace(w, '[^가-힣a-zA-Z0-9]', '', 'g')"
_UNKNOWN_SQL = f"""untagged as (select * from speech where call_id not in (select call_id from themes)), said as (select call_id, unnest(string_split(speech, chr(10))) as line, generate_subscripts(string_split(speech, chr(10)), 1) as line_no from untagged),
  pieces as (select call_id, line, line_no, unnest(string_split_regex(line, '\\s+')) as w from said), bare as (select call_id, line, line_no, {_BARE_SQL} as b from pieces),
  termed as (select call_id, line, line_no, case when length(b) <= 2 then b else coalesce(nullif(regexp_replace(b, {_quoted(voc._TAIL)}, ''), ''), b) end as term from bare),
  each_one as (select call_id, term, arg_min(line, line_no) as line from termed where length(term) >= 2 and term not in ({', '.join(map(_quoted, voc.STOPWORDS))}) and term not in ('de', 'la') group by 1, 2),
  best as (select term, count(*) as calls from each_one group by 1 having count(*) >= 2 order by calls desc, term limit 8)"""


def _unknown(spark, sf):
    speech, themes, routes = _routed(spark, sf)
    untagged = speech.join(themes.select("call_id").distinct().hint("merge"), "call_id", "left_anti")
    known = spark.createDataFrame([("de",), ("la",)], "term string")
    return speech, themes, routes, voc.suggest_terms(untagged, known)


@query(f"""with {_SPEECH_SQL}, {_HITS_SQL}, {_UNKNOWN_SQL}, shown as (select term, best.calls, substr(trim(line), 1, 60) as line, row_number() over (partition by term order by call_id) as n from each_one join best using (term))
  select term, calls, string_agg(line, ' / ' order by n) as examples from shown where n <= 2 group by 1, 2""")
def a6_default_suggestions(spark, sf):
    return _unknown(spark, sf)[3].select("term", "calls", F.array_join("examples", " / ").alias("examples"))


@query(f"""with {_ROUTES_SQL}, {_UNKNOWN_SQL}, n as (select (select count(*) from speech) as total, (select count(*) from untagged) as untagged, (select count(*) from speech where {_AGAIN_SQL}) as repeats, (select count(*) from routes where team = 'general') as routed_default,
    (select count(*) from best) as suggestions), r as (select *, case when total > 0 then untagged / total end as u, case when total > 0 then routed_default / total end as default_route_rate, case when total > 0 then repeats / total end as repeat_rate from n),
  g as (select *, list_filter([case when u > 0.2 then 'gap-untagged' end, case when default_route_rate > 0.3 then 'gap-default-route' end, case when suggestions > 0 then 'gap-suggestions' end, case when total = 0 then 'gap-empty' end], lambda x: x is not null) as l from r)
  select total, untagged, repeats, case when total > 0 then (total - untagged) / total end as tagged_rate, routed_default, suggestions, default_route_rate, repeat_rate,
    case when len(l) > 0 then array_to_string(l, ',') when untagged > 0 or routed_default > 0 then 'gap-minor' else 'gap-none' end as gaps from g""")
def a5_self_check(spark, sf):
    """What the default rules miss on these calls: rates, calls that go to the default team, words to add, and the gaps."""
    speech, themes, routes, found = _unknown(spark, sf)
    return voc.self_check(speech, themes, rules.flag_repeat_calls(speech, speech), routes, n_suggestions=found).drop("pii_total").withColumn("gaps", F.array_join("gaps", ","))


# Scripts are what the agent said; here straight from the turns, as the default labels are no part of the given roles.
_SCRIPTS_SQL = f"{_TURNS_SQL}, scripts as (select call_id, coalesce(string_agg(text, chr(10) order by turn_no) filter (speaker = 'agent'), '') as text from turns group by 1)"


def _scripts(spark, sf):
    agent = F.col("speaker") == "agent"
    said = F.transform(F.array_sort(F.collect_list(F.when(agent, F.struct("turn_no", "text")))), lambda x: x["text"])
    return _turns(spark, sf).groupBy("call_id").agg(F.array_join(said, "\n").alias("text")).select("call_id", "text", F.array().cast("array<int>").alias("line_numbers"), F.lit(True).alias("labeled"))


@query(f"with {_SCRIPTS_SQL}, m(mention, points, patterns) as (values {', '.join(f'({_quoted(m[0])}, {m[2]}, {_quoted(chr(124).join(m[3]))})' for m in D.MENTIONS)}) select call_id, mention, points, regexp_matches(text, patterns) as found from scripts, m")
def c6_default_mentions(spark, sf):
    return rules.check_mentions(_scripts(spark, sf)).select("call_id", "mention", "points", "found")


@query(f"""with {_SCRIPTS_SQL}, f(rule, word, deduct) as (values {', '.join(f"({_quoted(f[0])}, {_quoted(w)}, {f[2]})" for f in D.FORBIDDEN for w in f[4])}),
  n as (select call_id, rule, word, deduct, (length(text) - length(replace(text, word, ''))) // length(word) as n from scripts, f) select call_id, rule, cast(sum(n) as bigint) as times, cast(sum(n * deduct) as bigint) as deduct from n where n > 0 group by 1, 2""")
def c9_default_forbidden(spark, sf):
    """The default phrases don't overlap each other, so SQL may count them one by one."""
    return rules.scan_forbidden(_scripts(spark, sf)).groupBy("call_id", "rule").agg(F.count("*").alias("times"), F.sum("deduct").alias("deduct"))


def _asked(spark, sf):
    """Each customer turn's made sentence as a question."""
    t = fx.turns(spark, sf).where("speaker = 'customer'")
    number = F.col("call_id") * 7 + F.col("turn_no") * 5
    return t.select(F.concat_ws("-", "call_id", "turn_no").alias("query_id"), _picked(ASKED, number).alias("q"))


def _stem_sql(w: str, words) -> str:
    return f"case when length({w}) > 2 then regexp_replace({w}, {_quoted(X._suffix(words))}, '\\1') else {w} end"


def _tokens_sql(text: str) -> str:
    lowered = f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^가-힣a-z0-9]+'), lambda w: length(w) > 0)"
    once = f"list_transform({lowered}, lambda w: {_stem_sql('w', X.ENDINGS)})"
    return f"list_filter(list_transform({once}, lambda w: {_stem_sql('w', X.PARTICLES)}), lambda w: length(w) >= 2)"


_ASKED_SQL = f"{fx.TURNS_SQL}, asked as (select call_id || '-' || turn_no as query_id, {_picked_sql(ASKED)} as q from turns where speaker = 'customer')"


@query(f"with docs as (select doc_id, text || ' ' || [{', '.join(map(_quoted, ASKED))}][cast(doc_id % {len(ASKED)} as int) + 1] as text from documents), t as (select doc_id, {_tokens_sql('text')} as t from docs) select doc_id, len(t) as n_terms, md5(array_to_string(t, ' ')) as terms from t")
def r1_default_tokens(spark, sf):
    """Whole documents with a Korean sentence behind, by the default tokeniser: endings and particles are cut."""
    docs = fx.dealt(fx.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.lit(" "), _picked(ASKED, F.col("doc_id"))).alias("text"))
    return docs.withColumn("t", X.tokens(F.col("text"))).select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms"))


_PAIRS_SQL = ", ".join(f"({_quoted(w)}, {_quoted(canon)})" for canon, words in D.SYNONYMS for w in (*words, canon))
_EXPANDED_SQL = f"""{_ASKED_SQL}, base as (select distinct query_id, unnest({_tokens_sql('q')}) as term from asked), pairs(word, canon) as (values {_PAIRS_SQL}),
  expanded as (select query_id, term from base union select query_id, canon from base, pairs where term = word or (length(word) >= 2 and contains(term, word)) or (length(term) >= 2 and starts_with(word, term)))"""


@query(f"with {_EXPANDED_SQL} select query_id, term from expanded")
def r3_default_synonyms(spark, sf):
    return search.expand_queries(_asked(spark, sf))


def _rule_sql(k: int) -> str:
    _, kind, when, add = D.REWRITES[k]
    return f"case when regexp_matches(flat, {_quoted('|'.join(when))}) then struct_pack(id := {_quoted(D.REWRITES[k][0])}, kind := {_quoted(kind)}, word := {_quoted(add)}) end"


@query(f"""with {_EXPANDED_SQL}, known(term) as (values ('요금제'), ('위약금')), own as (select query_id, list(term) as own, bool_or(term in (select term from known)) as anchored from expanded group by 1),
  hit as (select query_id, q, list_filter([{', '.join(_rule_sql(k) for k in range(len(D.REWRITES)))}], lambda x: x is not null) as h, coalesce(own, []) as own, coalesce(anchored, false) as anchored from (select *, regexp_replace(lower(q), '[^가-힣a-z0-9]', '', 'g') as flat from asked) left join own using (query_id)),
  used as (select *, len(h) > 0 and (anchored or (list_contains(list_transform(h, lambda x: x.kind), 'topic') and list_contains(list_transform(h, lambda x: x.kind), 'modifier'))) as use from hit),
  added as (select *, case when use then list_filter(list_transform(h, lambda x: x.word), lambda x: not list_contains(own, x)) else [] end as added from used)
  select query_id, case when len(added) > 0 then q || ' ' || array_to_string(added, ' ') else q end as text, case when use then array_to_string(list_transform(h, lambda x: x.id), ',') else '' end as applied, anchored, len(h) > 0 and not use as blocked from added""")
def r4_default_rewrites(spark, sf):
    """Two words of the base are known; other questions need a topic and a modifier."""
    vocabulary = spark.createDataFrame([("요금제",), ("위약금",)], "term string")
    return search.rewrite_queries(_asked(spark, sf), vocabulary).select("query_id", "text", F.array_join("applied", ",").alias("applied"), "anchored", "blocked")


# ---- what retrieval gives an agent ------------------------------------------------------------------------

from callspark.plans import workflows as W  # noqa: E402

_HEATED = "nation|pathetic|worthless"


@query(f"""with {W._ASSIST_SQL}, best as (select query_id as call_id, doc_id, text from found join documents using (doc_id) where rank = 1)
  select call_id, {_quoted(search._SORRY)} || ' ' || case when doc_id is null then {_quoted(search._NOT_FOUND)} else {W._filled(search._FOUND, "coalesce(string_split(best.text, chr(10))[1], '')", "coalesce(string_split(best.text, '. ')[1], '')")} end as suggestions,
    case when regexp_matches(transcript, '{_HEATED}') then {_quoted(search._CAUTION)} else '' end as caution, coalesce(cast(doc_id as varchar), '') as cited from labelled left join best using (call_id)""")
def r20_assist_cards(spark, sf):
    """Suggestions for what the customer said last, and the caution of dialogues that are heated."""
    calls = W._labelled(spark, sf)
    found = search.assist_docs(calls, R._index(spark, sf), 3, _HEATED, fx.latin_tokens, ())
    out = search.assist_cards(calls, found, fx.knowledge(spark, sf), _HEATED)
    return out.select("call_id", F.array_join("suggestions", " ").alias("suggestions"), "caution", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


# A question whose words were joined by mistake finds its way by a rule that adds a word of the corpus.
_JOINED = (("the", "topic", ("the",), "the"), ("tion", "topic", ("tion",), "nation"), ("de", "topic", ("de",), "de"), ("en", "modifier", ("en$", "on$"), "with"))


def _terms_sql(text: str, source: str, name: str) -> str:
    """The words' CTEs once, then scores of the questions of ``source`` under ``name``."""
    return f"""{name}_terms as (select distinct query_id, unnest({fx.latin_terms_sql(text)}) as term from {source}), {name}_scored as (select query_id, doc_id, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) * 1000 + 0.5) / 1000 as score from {name}_terms join dfs using (term) join postings using (term) join lens using (doc_id), corpus group by 1, 2),
  {name}_ranked as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {name}_scored where score > 0) where rank <= 10)"""


def _joined_rule_sql(k: int) -> str:
    rule, kind, when, add = _JOINED[k]
    return f"case when regexp_matches(flat, {_quoted('|'.join(when))}) then struct_pack(kind := {_quoted(kind)}, word := {_quoted(add)}) end"


_GAIN_SQL = f"""{W._RELS_SQL}, typed as (select item_id as query_id, replace(replace(text, ' and ', ''), ' de ', '') as q from benchmark), typed_words as (select distinct query_id, unnest({fx.latin_terms_sql('q')}) as term from typed),
  typed_own as (select query_id, list(distinct term) as own, bool_or(term in (select term from dfs)) as anchored from typed_words group by 1),
  typed_hit as (select query_id, q, list_filter([{', '.join(_joined_rule_sql(k) for k in range(len(_JOINED)))}], lambda x: x is not null) as h, coalesce(own, []) as own, coalesce(anchored, false) as anchored from (select *, regexp_replace(lower(q), '[^가-힣a-z0-9]', '', 'g') as flat from typed) left join typed_own using (query_id)),
  rewritten as (select query_id, case when len(h) > 0 and (anchored or (list_contains(list_transform(h, lambda x: x.kind), 'topic') and list_contains(list_transform(h, lambda x: x.kind), 'modifier'))) then q || ' ' || array_to_string(list_filter(list_transform(h, lambda x: x.word), lambda x: not list_contains(own, x)), ' ') else q end as text from typed_hit),
  {_terms_sql('q', 'typed', 'was')}, {_terms_sql('text', 'rewritten', 'is')}, {W._rated_sql('old', 'was_ranked')}, {W._rated_sql('new', 'is_ranked')},
  old_failed as (select query_id from old_at where (expected is not null and coalesce(rank, 99) > 1) or (expected is null and answered = 1)), new_failed as (select query_id, kind from new_at where (expected is not null and coalesce(rank, 99) > 1) or (expected is null and answered = 1))"""


@query(f"""with {_GAIN_SQL}, f as (select kind, count(*) as remaining, count(*) filter (query_id not in (select query_id from old_failed)) as regressions from new_failed group by 1)
  select kind as "set", {', '.join(f"floor((new.{c} - old.{c}) * 1000 + 0.5) / 1000 as {c}" for c in ("recall1", "recall3", "mrr", "abstain_accuracy"))}, new.abstain_accuracy >= old.abstain_accuracy as abstain_kept, kind = 'held_out' as reportable, coalesce(remaining, 0) as remaining, coalesce(regressions, 0) as regressions
  from new join old using (kind) left join f using (kind)""")
def r19_rewrite_gain(spark, sf):
    """Benchmark items with words run together, as typed and rewritten, in two sets; only the held-out set's gain is reportable."""
    index, items = R._index(spark, sf), fx.questions(spark, sf)
    held = R._first_holding(fx.table(spark, sf, "documents"), items)
    rels = items.select("query_id", F.when(F.col("query_id") % 2 == 0, "tuned").otherwise("held_out").alias("set")).join(held.hint("merge"), "query_id", "left")
    typed = items.select("query_id", F.replace(F.replace("q", F.lit(" and "), F.lit("")), F.lit(" de "), F.lit("")).alias("q"))
    rewritten = search.rewrite_queries(typed, index["term_stats"], _JOINED, (), fx.latin_tokens).select("query_id", F.col("text").alias("q"))

    def rated(asked):
        ranked = search.bm25_rank(asked, index, 10, (), fx.latin_tokens)
        return search.evaluate_ranker(ranked, rels, search.retrieval_confidence(asked, ranked))

    return search.rewrite_gain(rated(typed), rated(rewritten))
