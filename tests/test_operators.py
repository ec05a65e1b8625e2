"""Operators on small Korean calls of our own, by the behaviours that matter."""

import datetime

import pytest
from pyspark.sql import functions as F

from callspark.functions import text as X
from callspark.operators import dictionaries as D
from callspark.operators import handoff, rules, search, telemetry, timeline, turns, verify, voc
from callspark.sources import ledger


def _one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


CALL = "통화 시작\n상담사: 안녕하세요 상담사입니다\n통화 내용이 녹음됩니다\n고객: 인터넷이 또 느려요\n계속 이래요\n상담사: 본인 확인 부탁드립니다\n고객: 해지 좀 해주세요"


@pytest.fixture(scope="module")
def calls(spark):
    rows = [("a", CALL, "속도 문의"), ("b", "라벨 없는 통화입니다\n위약금이 얼마예요", ""), ("c", "상담사: 감사합니다", "")]
    return spark.createDataFrame(rows, "call_id string, transcript string, title string").cache()


def test_turns(spark, calls):
    rows = {(r.call_id, r.turn_no): (r.speaker, r.text) for r in turns.explode_turns(calls).collect()}
    assert rows["a", 1] == ("agent", "안녕하세요 상담사입니다 통화 내용이 녹음됩니다")
    assert rows["a", 2] == ("customer", "인터넷이 또 느려요 계속 이래요") and ("b", 1) not in rows and len(rows) == 5
    speech = {r.call_id: (r.speech, r.labeled) for r in rules.speech_of(calls).collect()}
    assert speech["a"] == ("인터넷이 또 느려요 계속 이래요\n해지 좀 해주세요", True) and speech["b"][1] is False
    scripts = {r.call_id: r for r in turns.agent_script(calls).collect()}
    assert scripts["a"].text == "안녕하세요 상담사입니다\n본인 확인 부탁드립니다" and scripts["a"].line_numbers == [2, 6] and not scripts["b"].labeled
    assert {r.call_id for r in turns.call_metrics(turns.explode_turns(calls)).collect()} == {"a"}
    assert {r.call_id: r["query"] for r in turns.last_customer_query(calls).collect()}["a"] == "해지 좀 해주세요"


def test_themes_repeats_churn_routes(spark, calls):
    speech = rules.speech_of(calls)
    themes = rules.tag_themes(calls, speech)
    found = {(r.call_id, r.theme): (r.team, r.evidence) for r in themes.collect()}
    assert set(found) == {("a", "speed"), ("a", "churn"), ("b", "penalty")} or {("a", "speed"), ("b", "penalty")} <= set(found)
    assert found["a", "speed"][0] == "network" and found["a", "speed"][1] == ["인터넷이 또 느려요 계속 이래요"]
    assert {r.call_id for r in rules.flag_repeat_calls(calls, speech).collect()} == {"a"}
    churn = {r.call_id: r for r in rules.score_churn(speech).collect()}
    assert churn["a"].score == 45 and churn["a"].level == "중간" and churn["b"].score == 18 and churn["c"].score == 0
    assert {r.call_id: r.team for r in rules.route_calls(calls.withColumn("category", F.lit("")), speech, themes).collect()}["a"] == "network"
    quotes = [r.evidence for r in rules.churn_hits(speech).collect()]
    texts = "\n".join(r.speech for r in speech.collect())
    assert all(q in texts for q in quotes)


def test_theta_and_unrolled_matching_agree(spark, calls):
    lines = rules.speech_lines(calls.select("call_id", F.col("transcript").alias("t")), "t")
    one = rules.match_rules(lines, D.THEMES).select("call_id", "line_no", "rule", "pattern_no")
    two = rules.match_rules(lines, D.patterns_table(spark)).select("call_id", "line_no", "rule", "pattern_no")
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 2


def test_every_default_pattern_compiles(spark):
    patterns = [p for table in (D.THEMES, D.CHURN_SIGNALS, D.MENTIONS) for r in table for p in r[-1]] + list(D.REPEATS) + [p for _, ps in X.LEXICON for p in ps]
    tests = [F.lit("가").rlike(p) for p in patterns]
    assert len(spark.range(1).select(F.array(*tests).alias("a")).first().a) == len(patterns)


def test_churn_band_keeps_null_apart_from_zero(spark):
    df = spark.createDataFrame([("a", 65, 3, None), ("b", 65, 3, 0.0), ("c", 0, 0, 90.0)], "call_id string, score int, n_risk int, llm_score double")
    rows = {r.call_id: (r.banded, r.estimated, r.adjusted) for r in rules.band_churn(df).collect()}
    assert rows == {"a": (65, True, False), "b": (50, False, True), "c": (40, False, True)}


def test_quality(spark, calls):
    scripts = turns.agent_script(calls)
    checked = {(r.call_id, r.mention): r for r in rules.check_mentions(scripts).collect()}
    hit = checked["a", "identity"]
    assert hit.found and hit.match == "본인 확인" and hit.line == 6 and hit.speaker == "agent" and hit.match in hit.quote
    assert not checked["a", "closing"].found and checked["a", "closing"].quote is None
    near = rules.near_misses(scripts, rules.check_mentions(scripts)).collect()
    assert all(r.ratio >= 0.5 and len(r.matched) >= 2 for r in near)
    text = spark.createDataFrame([("x", "고객님이 잘못 아시고 어쩔 수 없습니다 아 진짜", [1], False)], "call_id string, text string, line_numbers array<int>, labeled boolean")
    findings = rules.scan_forbidden(text)
    assert [(r.rule, r.at) for r in findings.orderBy("at").collect()] == [("blame", 0), ("dismissive", 12), ("informal", 22)]
    held = {r.rule: (r.deduct, r.withheld, r.withheld_deduct) for r in rules.withhold_unattributed(findings, text).collect()}
    assert held["informal"] == (0, True, 4) and held["blame"] == (6, False, None)
    score = rules.score_qa(rules.check_mentions(text), rules.withhold_unattributed(findings, text)).first()
    assert (score.rule_score, score.deduction, score.total, score.grade, score.estimated) == (0, 11, 0, "D", True)
    assert rules.mention_points(7) == [6, 6, 6, 6, 6, 5, 5]
    banded = rules.band_qa(spark.createDataFrame([("x", 20, 0, 10)], "call_id string, empathy int, clarity int, resolution int"), rules.check_mentions(text), findings).first()
    assert banded.low <= banded.clarity and banded.empathy <= banded.high and banded.adjusted


def test_comment_audit(spark, calls):
    comments = spark.createDataFrame([("a", 0, '고객이 "해지 좀 해주세요"라고 함'), ("a", 1, '“전혀 없는 문장을 길게 인용합니다”'), ("a", 2, "인용 없음")], "call_id string, comment_no int, comment string")
    audited = rules.audit_comments(comments, calls)
    assert {r.comment_no: r.verified for r in audited.collect()} == {0: True, 1: False, 2: None}
    s = rules.comment_audit_summary(audited).first()
    assert (s.quoted, s.unquoted, s.verified, s.unverified) == (2, 1, 1, 1)


def test_classifier_and_tickets(spark, calls):
    got = {r.call_id: r for r in rules.classify_calls(calls).collect()}
    assert got["a"].category == "해지" and got["b"].category == "해지" and len(got["a"].summary) == 3 and got["c"].sentiment == "긍정"
    speech = rules.speech_of(calls)
    routes = rules.route_calls(calls.withColumn("category", F.lit("")), speech, rules.tag_themes(calls, speech))
    drafts = rules.ticket_drafts(rules.classify_calls(calls).withColumn("escalate_reason", F.lit(None).cast("string")), routes, rules.score_churn(speech)).collect()
    assert [r.call_id for r in drafts] == ["a"] and "이탈 위험: 45점" in drafts[0].body and drafts[0].title.startswith("[해지]")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("번호는 010-1234-5678입니다", "번호는 010-****-5678입니다"),
        ("주민번호940101-1234567", "주민번호940101-1******"),
        ("카드 1234-5678-9012-3456", "카드 ****-****-****-3456"),
        ("계좌로 입금 110-234-567890", "계좌로 입금 ***-***-***890"),
        ("메일 abc@example.com", "메일 a**@example.com"),
        ("2026-07-21에 12,000원", "2026-07-21에 12,000원"),
    ],
)
def test_masking(spark, raw, want):
    r = X.mask_pii(_one(spark, t=raw), "t").first().masked
    assert r.text == want and len(r.text) == len(raw) and X._mask_one(r.text)[0] == r.text


def test_correction_order_and_counts(spark):
    r = X.correct_terms(_one(spark, t="헤지 하면 위 약금 이약금"), "t").first()
    assert r.corrected == "해지 하면 위약금 위약금" and r.corrected_counts == {"해지": 1, "위약금": 2}
    assert X.correct_terms(_one(spark, t="a$b"), "t", (), (("a$b", "c\\d"),)).first().corrected == "c\\d"


def test_tokens_and_rounding(spark):
    assert _value(spark, X.tokens(F.lit("인터넷이 느린데요 해지하려면 ABC"))) == ["인터넷", "느린", "해지", "abc"]
    assert _value(spark, X.js_round(F.lit(-2.5))) == -2
    assert _value(spark, X.valid_date(F.lit("2026-02-31"))) is None and _value(spark, X.valid_date(F.lit("2026-02-28"))) == datetime.date(2026, 2, 28)


def test_timeline(spark):
    words = spark.createDataFrame([("a", 0, "네", 0.0, 0.5), ("a", 1, "맞아요.", 0.6, 1.0), ("a", 2, "그럼", 1.1, 1.4), ("a", 3, ",", 1.4, 1.5), ("a", 4, "끝", 9.4, 10.0)], "call_id string, word_no int, word string, start double, end double")
    assert [(r.start, r.end, r.text) for r in timeline.sessionise_words(words).orderBy("seg_no").collect()] == [(0.0, 1.0, "네 맞아요."), (1.1, 1.5, "그럼,"), (9.4, 10.0, "끝")]
    chunks = spark.createDataFrame([("a", 0, 0.0, 55.0, [(1.0, 2.0, "하나", None), (50.0, 60.0, "둘", None)]), ("a", 1, 55.0, 70.0, None), ("a", 2, 70.0, 80.0, [(5.0, 6.0, "셋", "agent")])], f"call_id string, chunk_no int, start double, end double, segments {ledger.SEGMENT}")
    segments, blind = timeline.stitch_chunks(chunks)
    assert sorted((r.start, r.end) for r in segments.collect()) == [(1.0, 2.0), (50.0, 55.0), (75.0, 76.0)] and [tuple(r)[1:] for r in blind.collect()] == [(55.0, 70.0)]
    m = timeline.timeline_metrics(segments, spark.createDataFrame([("a", 80.0)], "call_id string, duration double"), blind).first()
    assert m.silence_count == 1 and m.longest_silence_sec == 48.0 and m.partial and m.blind_sec == 15.0 and m.covered_sec == 65.0 and m.trailing_silence_sec == 4.0
    talk = timeline.talk_metrics(spark.createDataFrame([("a", 0.0, 2.0, "customer"), ("a", 7.5, 9.5, "agent")], "call_id string, start double, end double, speaker string")).first()
    assert talk.max_response_delay_sec == 5.5 and talk.agent_ratio == 50.0 and talk.silence_sec == 5.5
    quotes = spark.createDataFrame([("a", 0, "둘 하나 셋"), ("a", 1, "없음")], "call_id string, quote_no int, quote string")
    texts = spark.createDataFrame([("a", 0, "하나 둘 하나 셋"), ("a", 1, "다른 말")], "call_id string, seg_no int, text string")
    assert {r.quote_no: r.seg_no for r in timeline.locate_quotes(quotes, texts).collect()} == {0: 0, 1: None}
    assert [r.start for r in timeline.plan_chunks(spark.createDataFrame([("a", 120.0)], "call_id string, duration double")).orderBy("chunk_no").collect()] == [0.0, 55.0, 110.0]
    assert timeline.timeline_metrics(segments.limit(0)).count() == 0


def test_speakers(spark):
    segs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z")], "call_id string, seg_no int, text string")
    lines = spark.createDataFrame([("a", 0, "상담사: x"), ("a", 1, "그냥"), ("a", 2, "고객: y")], "call_id string, line_no int, text string")
    named = timeline.assign_speakers(segs, lines)
    assert {r.seg_no: r.speaker for r in named.collect()} == {0: "agent", 1: "customer", 2: None}
    fixed = timeline.apply_speaker_corrections(named, spark.createDataFrame([("a", 2, "agent")], "call_id string, seg_no int, speaker string"))
    assert {r.seg_no: (r.speaker, r.corrected) for r in fixed.collect()}[2] == ("agent", True)
    assert timeline.render_transcript(named).first().transcript == "상담사: x\n고객: y\nz"


def _dated(spark, rows):
    return spark.createDataFrame([(str(k), datetime.date(2026, 7, d), *rest) for k, (d, *rest) in enumerate(rows)], "call_id string, day date, category string, sentiment string, escalate boolean, agent string, minutes double")


def test_voc(spark):
    rows = [(20, "요금", "중립", False, "A", 3.0)] + [(21, "불만", "강성", True, None, None)] * 1 + [(22, "불만", "강성", True, "A", 4.0)] * 4 + [(22, "가입", "긍정", False, " ", 1.0)] * 3
    calls = _dated(spark, rows)
    spikes = {r.category: (r.now, r.ratio, r.level) for r in voc.category_spikes(calls).collect()}
    assert spikes == {"불만": (4, 8.0, "high"), "가입": (3, None, "high")}
    assert voc.category_spikes(calls.where("day > date '2026-07-20'")).count() == 0
    assert {r.alert_id for r in voc.ratio_alerts(calls).collect()} == {"hot-ratio", "escalate-ratio"}
    agents = {r.agent: r for r in voc.aggregate_by_agent(calls).collect()}
    assert agents["A"].negative_rate == 0.8 and agents["미지정"].calls == 4 and agents["미지정"].avg_minutes == 1.0
    small = voc.aggregate_by_agent(calls.where("day = date '2026-07-20'")).first()
    assert small.negative_rate is None and small.small_sample
    s = {(r.axis, r.value): r.calls for r in voc.voc_summary(calls).collect()}
    assert s["category", "해지"] == 0 and s["category", "불만"] == 5 and s["total", ""] == 9 and s["date", "2026-07-22"] == 7
    split = voc.split_period(calls, "today")
    assert {r.period: r["count"] for r in split.groupBy("period").count().collect()} == {"current": 7, "previous": 1} and voc.comparable(split).first().comparable
    assert "불만" in voc.voc_report(voc.voc_summary(calls)).first().headline


def test_theme_comparison_keeps_gone_causes(spark):
    df = spark.createDataFrame([("current", "a", "T"), ("current", "a", "T"), ("previous", "b", "U")], "period string, theme string, team_name string")
    assert {r.theme: (r.calls, r.delta, r.is_new, r.is_gone) for r in voc.compare_themes(df).collect()} == {"a": (2, 2, True, False), "b": (0, -1, False, True)}


def test_history(spark):
    rows = [("A", k, t, False, ["녹취"] if k < 3 else [], []) for k, t in enumerate([60, 62, 80, 82])] + [("B", 0, 70, True, [], [])]
    history = spark.createDataFrame(rows, "label string, eval_no int, total int, estimated boolean, missed array<string>, violations array<string>")
    got = {r.label: r for r in voc.qa_history_summary(history).collect()}
    assert (got["A"].delta, got["A"].trend, got["A"].average) == (20, "up", 71) and got["B"].trend is None and got["B"].estimated == 1
    cards = {(r.label, r.card): r.level for r in voc.qa_history_cards(history).collect()}
    assert cards == {("A", "missed"): "high", ("A", "trend-up"): "ok", ("B", "none"): "ok"}


def test_self_check_and_suggestions(spark):
    calls = spark.createDataFrame([(k, f"공유기 교체 문의{k}") for k in range(4)], "call_id int, speech string")
    known = spark.createDataFrame([("교체",)], "term string")
    found = voc.suggest_terms(calls, known)
    assert [(r.term, r.calls) for r in found.collect()] == [("공유기", 4)]
    themes = spark.createDataFrame([], "call_id int, theme string")
    routes = calls.select("call_id", F.lit("general").alias("team"))
    check = voc.self_check(calls, themes, calls.select("call_id").limit(0), routes, n_suggestions=found).first()
    assert check.gaps == ["gap-untagged", "gap-default-route", "gap-suggestions"] and check.tagged_rate == 0.0
    none = calls.limit(0)
    assert voc.self_check(none, themes, none.select("call_id"), routes.limit(0)).first().gaps == ["gap-empty"]


def test_report_numbers(spark):
    reports = spark.createDataFrame([(1, ["총 40건 중 10건(25%)", "12.5%가 늘어 1,234건"]), (2, ["3가지"])], "report_id int, texts array<string>")
    counts = spark.createDataFrame([(1, 40, 40), (1, 40, 10), (1, 40, 5)], "report_id int, total int, n int")
    assert {r.report_id: (r.ok, r.unknown) for r in voc.verify_report_numbers(reports, counts).collect()} == {1: (False, [1234.0]), 2: (True, [])}


def test_telemetry(spark):
    at = lambda h: datetime.datetime(2026, 7, 1, h)
    rows = [(1, "qa", "live", 100, 1000, 100, None, None, at(1), "x"), (2, "qa", "live-oss", 300, None, None, None, None, at(2), "x"), (3, "stt", "fallback-timeout", None, 500_000, 0, 0, 0, at(3), "x")]
    events = spark.createDataFrame(rows, "request_id int, endpoint string, mode string, latency_ms long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, created_at timestamp, account string")
    totals, left = telemetry.telemetry_rollup(events, telemetry.telemetry_by_mode(events.limit(0)), F.lit(at(3)))
    assert {(r.endpoint, r.mode): r.calls for r in totals.collect()} == {("qa", "live"): 1, ("qa", "live-oss"): 1} and left.count() == 1
    both = {(r.endpoint, r.mode): r.avg_latency_ms for r in telemetry.telemetry_cumulative(events, totals).collect()}
    assert both == {("qa", "live"): 100, ("qa", "live-oss"): 300, ("stt", "fallback-timeout"): None}
    spent = {r.request_id: (round(r.spent_24h, 6), r.admitted) for r in telemetry.spend_24h(events).collect()}
    assert spent == {1: (0.0075, True), 3: (2.5075, True)}
    stats = {r.endpoint: r for r in telemetry.telemetry_stats(telemetry.telemetry_cumulative(events, totals)).collect()}
    assert stats["qa"].avg_latency_ms == 200 and stats[None].fallback_calls == 1 and stats[None].live_percent == 67
    codes = spark.createDataFrame([("max_tokens", ""), (None, "필드가 없음"), ("odd", "")], "error_code string, error_message string")
    assert [r.mode for r in telemetry.classify_failures(codes).collect()] == ["fallback-max-tokens", "fallback-contract", "fallback"]


def _replay(rows, most, seconds):
    passed, out = {}, {}
    for bucket, second, request in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        live = [t for t in passed.get(bucket, []) if t > second - seconds]
        out[request] = len(live) < most
        passed[bucket] = live + [second] * out[request]
    return out


def test_admission_replay(spark):
    rows = [("a" if k % 3 else "b", (k * 37) % 50, k) for k in range(60)]
    df = spark.createDataFrame([(b, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s), r) for b, s, r in rows], "bucket string, ts timestamp, request_id int")
    assert {r.request_id: r.accepted for r in telemetry.admit_requests(df, 2, 10).collect()} == _replay(rows, 2, 10)


DOCS = [("d1", "위약금 안내", "약정 기간 안에 해지하면 위약금이 발생합니다. 남은 기간에 따라 계산합니다. 자세한 내용은 문의하세요."), ("d2", "로밍 요금", "해외 로밍 데이터 요금은 하루 단위로 부과됩니다."), ("d3", "이전 설치", "이전 설치는 접수 후 방문합니다.")]


def test_search(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, title string, body string")
    index = search.build_index(docs)
    asked = spark.createDataFrame([(1, "해지수수료가 얼마인가요"), (2, "로밍 요금이 궁금해요"), (3, "zzz qqq"), (4, "그만두려는데 어떻게 하나요")], "query_id int, q string")
    ranked = search.bm25_rank(asked, index)
    assert {r.query_id: r.doc_id for r in ranked.where("rank = 1 and not weak").collect()} == {1: "d1", 2: "d2"}
    assert {r.query_id: r.confidence for r in search.retrieval_confidence(asked, ranked).collect()}[3] == "none"
    rewritten = {r.query_id: r for r in search.rewrite_queries(asked, index["term_stats"]).collect()}
    assert rewritten[4].blocked and rewritten[2].added == []
    qrels = spark.createDataFrame([(1, "tuned", "d1"), (2, "held_out", "d1"), (3, "held_out", None)], "query_id int, set string, expected string")
    metrics, fails = search.evaluate_ranker(ranked, qrels, search.retrieval_confidence(asked, ranked))
    assert {r.set: (r.recall1, r.abstain_accuracy) for r in metrics.collect()} == {"tuned": (1.0, 0.0), "held_out": (0.0, 1.0)} and fails.count() == 1
    assert {r.metric: r.gap for r in search.self_assessment(metrics).collect()}["recall1"] == 1.0
    vectors = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [0.6, 0.8]), ("d3", [0.0, 0.0])], "doc_id string, vector array<double>")
    near = search.vector_topk(spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, vector array<double>"), vectors, 3)
    assert [(r.doc_id, round(r.score, 6)) for r in near.orderBy("rank").collect()] == [("d1", 1.0), ("d2", 0.6), ("d3", 0.0)]
    fused = search.rrf_fuse({"keyword": ranked, "vector": near}).where("query_id = 1").orderBy("rank").collect()
    assert fused[0].doc_id == "d1" and fused[0].vector_score == 1.0 and fused[1].keyword_score is None
    full = search.hybrid_search(asked.where("query_id < 3").withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))), docs, index, vectors)
    assert {r.query_id for r in full.collect()} == {1, 2}
    answers = search.extractive_answers(ranked, docs, search.retrieval_confidence(asked, ranked))
    assert {r.query_id: r.cited for r in answers.collect()}[1] == ["d1"]


def test_verification(spark):
    rows = spark.createDataFrame([(1, "요금은 3만 5천원이고 12개월 약정입니다", "월 35,000원, 12개월", ""), (2, "위약금은 9만원입니다", "위약금이 있습니다", ""), (3, "문서에 해당 내용이 명시되어 있지 않습니다. 자세한 사항은 고객센터에 확인해 주시기 바랍니다 감사합니다.", "zz", "")], "answer_id int, answer string, evidence string, question string")
    support = {r.answer_id: (r.ok, r.unsupported) for r in verify.numeric_support(rows).collect()}
    assert support == {1: (True, []), 2: (False, ["9만원"]), 3: (True, [])}
    verdicts = {r.answer_id: r.verdict for r in verify.grounding_verdict(verify.groundedness(rows)).collect()}
    assert verdicts[3] == "warn"
    gated = verify.gate_answers(rows.withColumn("cited", F.array(F.lit("d1"), F.lit("x"))), spark.createDataFrame([(2, "extract")], "answer_id int, extract string"), spark.createDataFrame([(2, ["d1"])], "answer_id int, doc_ids array<string>"))
    assert {r.answer_id: (r.final == "extract", r.cited) for r in gated.collect()}[2] == (True, ["d1"])
    pairs = spark.createDataFrame([("m", "안녕 하세요.", "안녕하세오"), ("m", "", "x"), ("m", "가" * 900, "나" * 900)], "model string, reference string, hypothesis string")
    got = [(r.distance, r.ref_length) for r in verify.cer(pairs).collect()]
    assert got[0] == (1, 5) and got[1] == (None, 0)
    within = [(r.within, r.unverifiable) for r in verify.cer_within(pairs, 0.3).collect()]
    assert within == [(True, False), (None, None), (False, True)]
    gate = verify.preserve_gate(spark.createDataFrame([("네 맞아요 알겠습니다", "상담사: 네 맞아요\n고객: 알겠습니다"), ("원래 말", "아주 다른 말입니다")], "original string, rewritten string")).collect()
    assert gate[0].ok and gate[0].kept.startswith("상담사") and gate[1].kept == "원래 말"
    fixed = {r.stage: r.distance for r in verify.compare_asr(spark.createDataFrame([("m", "해지 문의", "헤지 문의")], "model string, reference string, hypothesis string")).collect()}
    assert fixed == {"raw": 1, "corrected": 0}


def test_handoff_and_ledger(spark, calls, tmp_path):
    runs = spark.createDataFrame([("a", s, True, None) for s in handoff.STAGES] + [("b", "stt", True, None), ("b", "analyze", False, "timeout")], "call_id string, stage string, present boolean, error string")
    routes = spark.createDataFrame([("a", "팀", "P1", "오늘"), ("b", "팀", "P1", "오늘")], "call_id string, team_name string, priority string, sla string")
    status = {r.call_id: (r.state, r.status, r.owner) for r in handoff.run_status(runs, routes).collect()}
    assert status == {"a": ("complete", "route", "팀"), "b": ("partial", "manual", None)}
    facts = spark.createDataFrame([("a", True, False, 10, True, False, True, 90, False, 0, False, False), ("b", False, None, None, None, None, None, None, None, None, None, None)], "call_id string, analyzed boolean, escalate boolean, churn_score int, churn_labeled boolean, churn_estimated boolean, qa_labeled boolean, qa_total int, qa_estimated boolean, withheld int, truncated boolean, demo boolean")
    checks = handoff.handoff_checks(facts, runs)
    assert {(r.call_id, r.alert_id, r.level) for r in checks.collect()} == {("a", "none", "info"), ("b", "stage-analyze", "high")}
    reports = handoff.handoff_report(handoff.run_status(runs, routes), checks)
    assert "complete" in {r.call_id: r.report for r in reports.collect()}["a"]
    handoff.write_handoff_reports(reports, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "2026-07-21", None, '문의 010-1234-5678 "긴급"', "불만", "강성", True, None, None, None, False)], "call_id string, call_date string, agent string, title string, category string, sentiment string, escalate boolean, churn_score int, churn_level string, team_name string, mine boolean")
    speech = rules.speech_of(calls)
    out = handoff.ledger(rows, rules.tag_themes(calls, speech), rules.flag_repeat_calls(calls, speech))
    r = out.first()
    assert r["제목"] == '문의 010-****-5678 "긴급"' and r["이탈위험"] == "" and r["재문의"] == "Y" and "네트워크" in r["처리부서"]
    handoff.write_ledger_csv(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["제목"] == r["제목"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"call_id": "1", "call_date": "2026-02-31", "title": " "}\n{"call_id": "2", "call_date": "2026-02-03", "analysis": {"category": "요금"}}\n')
    rows = {r.call_id: r for r in ledger.read_calls(spark, str(tmp_path / "c.json")).collect()}
    assert rows["1"].day is None and rows["1"].title == "untitled" and rows["1"].analysis.category is None and rows["2"].day == datetime.date(2026, 2, 3)
    bulk = ledger.split_bulk_calls(_one(spark, k=1, t="첫째\n줄\n\n  \n둘째\n\n\n셋째"), "k", "t", max_calls=2)
    assert [r.transcript for r in bulk.orderBy("call_no").collect()] == ["첫째\n줄", "둘째"]
    asr = spark.createDataFrame([("a", None, 1.0, [(0.0, 1.0, "말", None), (None, 2.0, "x", None)], None), ("b", None, 1.0, [], [("단어", 0.0, 0.5)]), ("c", None, 1.0, None, None)], ledger.ASR_SCHEMA)
    assert sorted((r.call_id, r.text) for r in ledger.read_asr(asr).collect()) == [("a", "말"), ("b", "단어")]
    good, bad = X.contract_check(spark.createDataFrame([("x", ["a"]), (" ", ["a"]), ("y", None)], "s string, arr array<string>"), strings=["s"], string_arrays=["arr"])
    assert good.count() == 1 and sorted(r.bad_key for r in bad.collect()) == ["arr", "s"]
    snap = ledger.redacted_snapshot(ledger.normalise_calls(spark.createDataFrame([("1", "2026-01-01", None, None, "t" * 50, "비밀", False, None)], ledger.CALL_SCHEMA))).first()
    assert len(snap.title) == 40 and "transcript" not in snap.asDict()


def test_dictionaries_of_owners(spark):
    raw = spark.createDataFrame([("a", 0, " cat ", "dog"), ("a", 1, "dog", "cow"), ("a", 2, "", "x"), ("a", 3, "big", "small"), ("b", 0, "a.b", "c$1"), (None, 0, "big", "no")], "owner string, ord int, wrong string, term string")
    docs = spark.createDataFrame([(1, "a", "cat dog catcat big"), (2, "b", "a.b aXb a.ba.b"), (3, None, "big cat"), (4, "z", "cat"), (5, "a", None), (6, "a", "")], "id int, owner string, text string")
    rows = {r.id: r for r in X.correct_own_terms(docs, "text", X.clean_custom_terms(raw)).collect()}
    assert rows[1].corrected == "cow cow cowcow big" and rows[1].corrected_counts == {"dog": 3, "cow": 4}
    assert rows[2].corrected == "c$1 aXb c$1c$1" and rows[2].corrected_counts == {"c$1": 3}
    assert [rows[k].corrected for k in (3, 4, 5, 6)] == ["big cat", "cat", "", ""] and rows[3].corrected_counts == rows[5].corrected_counts == {}

    scripts = spark.createDataFrame([("x", "a", "안녕하세요 청약철회", [1], True), ("y", "b", "네", [1], True)], "call_id string, owner string, text string, line_numbers array<int>, labeled boolean")
    own = rules.custom_mentions(spark.createDataFrame([("a", 0, "Cancel", ["청약철회"]), ("a", 1, "Other", ["none"]), ("c", 0, "Not", ["네"])], "owner string, ord int, label string, keywords array<string>"))
    rows = rules.check_own_mentions(rules.check_mentions(scripts), scripts, own).orderBy("call_id", "ord").collect()
    x, y = [r for r in rows if r.call_id == "x"], [r for r in rows if r.call_id == "y"]
    assert [r.points for r in x] == [6, 6, 6, 6, 6, 5, 5] and [r.points for r in y] == [8] * 5
    assert [(r.mention, r.found) for r in x[5:]] == [("custom-1", True), ("custom-2", False)] and x[0].found and not any(r.found for r in y)


def test_quotes_are_compared_without_punctuation_and_in_part(spark):
    calls = spark.createDataFrame([("x", "고객: 위약금, 없이 해지 가능하다고 들었어요. 정말요?"), ("e", "")], "call_id string, transcript string")
    said = ["“위약금 없이 해지. 가능하다고 들었어요”", "“위약금 없이 해지 가능하다고 하셨다”", "“위약금 없이 해지 가능하다고 들었는데요 아니었나요 정말”", "“...”", "no quote"]
    comments = spark.createDataFrame([("x", k, c) for k, c in enumerate(said)] + [("e", 0, said[0])], "call_id string, comment_no int, comment string")
    rows = {(r.call_id, r.comment_no): (r.ratio, r.verified) for r in rules.audit_comments(comments, calls).collect()}
    flat = "위약금없이해지가능하다고들었"
    assert rows["x", 0] == (1.0, True) and rows["x", 1] == (12 / 15, True) and rows["x", 2] == (len(flat) / 24, False)
    assert rows["x", 3] == (0.0, False) and rows["x", 4] == (None, None) and rows["e", 0] == (0.0, False)
