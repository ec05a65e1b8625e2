"""Checks of generated answers and transcripts against their sources: groundedness, numbers, edit distance."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callspark.functions.distance import edit_distance
from callspark.functions.text import js_round, nfc, pairs_of

# Grounding thresholds, refusal words, numeric units.
WARN, FLOOR, MIN_LENGTH = 0.35, 0.15, 40
SOURCE_WORD = "(문서|규정|자료|정보|내용|약관|안내)"
ABSENCE = (
    r"((포함|명시|언급|기재|기술|확인|안내)되(어|어서)?\s*있지\s*않|되지\s*않(습니|았|아)|확인할\s*수\s*없|찾을\s*수\s*없|답변(을)?\s*(드릴|할)\s*수\s*없|나와\s*있지\s*않|없습니다|없는\s*내용)"
)
CRITICAL_UNITS = ("원", "%", "퍼센트", "개월", "년", "일", "시간")
OTHER_UNITS = ("회선", "회", "건", "기가", "gb", "명", "분")
_SCALE = {"억": 100_000_000, "만": 10_000, "천": 1_000, "백": 100, "십": 10}
_CLAIM = r"(?i)((?:\d[\d,\.]*\s*(?:억|만|천|백|십)?\s*){1,4})(" + "|".join((*CRITICAL_UNITS, *OTHER_UNITS)) + ")"
_BARE = r"(\d[\d,]*(?:\.\d+)?(?:\s*(?:억|만|천|백|십)\s*\d*[\d,]*)*)"
_CER_DROP = r"[\s  .,!?;:'\"“”‘’()\[\]{}~\-·…—/\\]"


def char_pairs(flat: Column) -> Column:
    """Distinct two-character pieces of a text."""
    return F.array_distinct(pairs_of(flat))


def groundedness(answers: DataFrame, answer: str = "answer", evidence: str = "evidence") -> DataFrame:
    """``answers`` with ``grounding``: the share of the answer's pieces that the evidence has, to two places; 0 without a piece."""
    flat = lambda c: F.regexp_replace(nfc(F.coalesce(F.col(c), F.lit(""))), r"[\s\p{P}]", "")
    rows = answers.withColumns({"_a": flat(answer), "_e": flat(evidence)})
    rows = rows.withColumns({"_a": char_pairs(F.col("_a")), "_e": char_pairs(F.col("_e"))})
    share = F.when(F.size("_a") > 0, js_round(F.size(F.array_intersect("_a", "_e")) / F.size("_a") * 100) / 100).otherwise(0.0)
    return rows.withColumn("grounding", share).drop("_a", "_e")


def is_refusal(answer: Column) -> Column:
    """Says that a source lacks something, and does so in its first two sentences."""
    lead = F.array_join(F.slice(F.split(F.trim(answer), r"(?<=[.!?。])\s+"), 1, 2), " ")
    return answer.rlike(SOURCE_WORD) & lead.rlike(ABSENCE)


def grounding_verdict(rows: DataFrame, answer: str = "answer", grounding: str = "grounding") -> DataFrame:
    """``rows`` with ``verdict``: reject, warn or ok; short answers and refusals are never rejected; an unmeasured one is ok."""
    text, g = F.coalesce(F.col(answer), F.lit("")), F.col(grounding)
    low = (g < FLOOR) & (F.length(F.trim(text)) >= MIN_LENGTH) & ~is_refusal(text)
    return rows.withColumn("verdict", F.when(low, "reject").when(g < WARN, "warn").otherwise("ok"))


def korean_number(text: Column) -> Column:
    """Value of a number with units of magnitude (3만 5천, 1,200, 0.5), null without a digit."""
    flat = F.regexp_replace(text, r"[\s,]", "")
    parts = F.transform(F.regexp_extract_all(flat, F.lit(r"(\d+(?:\.\d+)?(?:억|만|천|백|십)?)"), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, r"^([\d.]+)", 1).cast("double").alias("v"), F.regexp_extract(p, "(억|만|천|백|십)$", 1).alias("u")))
    scale = F.create_map(*(F.lit(x) for kv in _SCALE.items() for x in kv))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda n, p: n + p["v"] * F.coalesce(scale[p["u"]], F.lit(1))))


def numeric_claims(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text, value, unit, critical): numbers with a unit in a text."""
    rows = df.select(key, F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"({_CLAIM})"), F.lit(1))).alias("text"))
    unit = F.lower(F.regexp_extract("text", _CLAIM, 2))
    rows = rows.select(key, F.trim("text").alias("text"), korean_number(F.regexp_extract("text", _CLAIM, 1)).alias("value"), unit.alias("raw")).where("value is not null")
    return rows.select(key, "text", "value", F.when(F.col("raw") == "퍼센트", "%").when(F.col("raw") == "gb", "기가").otherwise(F.col("raw")).alias("unit"), F.col("raw").isin(*CRITICAL_UNITS).alias("critical"))


def numeric_support(answers: DataFrame, key: str = "answer_id", answer: str = "answer", evidence: str = "evidence", question: str = "question") -> DataFrame:
    """(key, ok, checked, supported, unsupported): numbers in an answer that neither evidence nor question have.

    A claim is supported by the same unit and value, or by its value as a whole number in the text; ok if no critical one is unsupported.
    """
    claims = numeric_claims(answers, key, answer)
    known = numeric_claims(answers, key, evidence).union(numeric_claims(answers, key, question)).select(key, "unit", "value").distinct()
    source = F.concat_ws(" ", F.coalesce(evidence, F.lit("")), F.coalesce(question, F.lit("")))
    bare = answers.select(key, F.explode(F.regexp_extract_all(source, F.lit(_BARE), F.lit(1))).alias("x")).select(key, korean_number(F.col("x")).alias("value")).where("value is not null").distinct()
    lost = claims.join(known.hint("merge"), [key, "unit", "value"], "left_anti").join(bare.hint("merge"), [key, "value"], "left_anti")
    bad = lost.groupBy(key).agg(F.array_sort(F.collect_list("text")).alias("unsupported"), F.max("critical").alias("_critical"))
    n = claims.groupBy(key).agg(F.count("*").alias("checked"))
    out = answers.select(key).join(n.hint("merge"), key, "left").join(bad.hint("merge"), key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, (~F.coalesce("_critical", F.lit(False))).alias("ok"), F.coalesce("checked", F.lit(0)).alias("checked"), (F.coalesce("checked", F.lit(0)) - F.size(F.coalesce("unsupported", none))).alias("supported"), F.coalesce("unsupported", none).alias("unsupported"))


def gate_answers(answers: DataFrame, fallback: DataFrame, results: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, final, replaced, verdict, cited): rejected or unsupported answers give way to the extract; citations must be results.

    ``answers`` has answer, evidence, question, cited; ``fallback`` (key, extract); ``results`` (key, doc_ids).
    """
    judged = grounding_verdict(groundedness(answers)).join(numeric_support(answers, key).select(key, F.col("ok").alias("numbers_ok")).hint("merge"), key)
    rows = judged.join(fallback.select(key, "extract").hint("merge"), key, "left").join(results.select(key, "doc_ids").hint("merge"), key, "left")
    replace = (F.col("verdict") == "reject") | ~F.col("numbers_ok")
    return rows.select(key, F.when(replace, F.col("extract")).otherwise(F.col("answer")).alias("final"), replace.alias("replaced"), "verdict", F.array_intersect("cited", F.coalesce("doc_ids", F.array().cast("array<string>"))).alias("cited"))


# ---- transcript accuracy ----------------------------------------------------------------------------------


def cer_text(text: Column) -> Column:
    """A transcript as it is compared: composed, without blanks and punctuation."""
    return F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), _CER_DROP, "")


@F.pandas_udf(T.StructType().add("distance", "integer").add("length", "integer"))
def _distances(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"distance": pd.Series([edit_distance(a, b) if a else None for a, b in zip(left, right)], dtype="Int32"), "length": left.str.len().astype("Int32")})


def cer(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with distance, ref_length, cer, accuracy; null where the reference is empty."""
    # said to be nondeterministic, so that what is made of it doesn't clean its texts again
    rows = pairs.withColumn("_judged", _distances.asNondeterministic()(cer_text(F.col(reference)), cer_text(F.col(hypothesis))))
    rows = rows.withColumns({"distance": F.col("_judged.distance"), "ref_length": F.col("_judged.length")})
    share = F.col("distance") / F.when(F.col("ref_length") > 0, F.col("ref_length"))
    return rows.withColumns({"cer": share, "accuracy": F.greatest(F.lit(0.0), 1 - share)}).drop("_judged")


def corpus_cer(measured: DataFrame, *by: str) -> DataFrame:
    """Distances over lengths, by model: long references weigh as much as they are long."""
    # no filter on the distance: it would be moved below the projection, and each distance computed twice
    length = F.sum(F.when(F.col("distance").isNotNull(), F.col("ref_length")))
    out = measured.groupBy(*by).agg(F.count("distance").alias("pairs"), F.sum("distance").alias("distance"), length.alias("ref_length"), (F.sum("distance") / length).alias("cer"))
    return out.where("pairs > 0") if by else out


def _shared(a: str, b: str, most: int, end: bool) -> int:
    """How many characters two texts share at the start or end, up to ``most``; found bit by bit on slices."""
    n, step = 0, 1 << most.bit_length()
    while step:
        to = n + step
        if to <= most and (a[len(a) - to : len(a) - n] == b[len(b) - to : len(b) - n] if end else a[n:to] == b[n:to]):
            n = to
        step >>= 1
    return n


def _within(a: str, b: str, limit: float, cells: int, exact: bool) -> tuple[int, bool]:
    """The distance of two texts, or -1 if it is over the limit or the pair is not measured; and whether it is over the budget."""
    if a == b:
        return 0, False
    most = math.floor(limit * len(a))
    if abs(len(a) - len(b)) > most:
        return -1, False
    head = _shared(a, b, min(len(a), len(b)), False)
    tail = _shared(a, b, min(len(a), len(b)) - head, True)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    hard = len(a) * min(len(b), 2 * most + 1) > cells
    return -1 if hard and not exact else edit_distance(a, b, most), hard


def cer_within(pairs: DataFrame, limit: float, reference: str = "reference", hypothesis: str = "hypothesis", cells: int = 400_000, exact: bool = False) -> DataFrame:
    """``pairs`` with within, cer (null beyond the limit), unverifiable.

    Common ends are cut first. Pairs whose rest has a length times band over ``cells`` are unverifiable, not different;
    equal texts, and texts whose lengths alone are too far apart, never are. An empty reference gives nulls.
    With ``exact`` every pair is measured; ``unverifiable`` then only says that it is over that budget, which is upstream's, and takes nothing from ``within`` and ``cer``.
    """

    @F.pandas_udf(T.StructType().add("distance", "integer").add("length", "integer").add("unverifiable", "boolean"))
    def judged(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        found = [(*_within(a, b, limit, cells, exact), len(a)) if a else (None, None, None) for a, b in zip(left, right)]
        distance, hard, length = zip(*found) if found else ((), (), ())
        return pd.DataFrame({"distance": pd.Series(distance, dtype="Int32"), "length": pd.Series(length, dtype="Int32"), "unverifiable": pd.Series(hard, dtype="boolean")})

    # said to be nondeterministic, so that a filter on what it finds isn't moved below it and its texts cleaned and judged again
    rows = pairs.withColumn("_judged", judged.asNondeterministic()(cer_text(F.col(reference)), cer_text(F.col(hypothesis))))
    d = F.col("_judged.distance")
    return rows.withColumns({"unverifiable": F.col("_judged.unverifiable"), "within": d >= 0, "cer": F.when(d >= 0, d / F.col("_judged.length"))}).drop("_judged")


def strip_labels(text: Column) -> Column:
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?i)^\s*(상담사|상담원|고객|agent)\s*[:：]\s*", ""))
    return F.trim(F.regexp_replace(F.array_join(bare, " "), r"\s+", " "))


def preserve_gate(pairs: DataFrame, limit: float = 0.15, original: str = "original", rewritten: str = "rewritten", exact: bool = False) -> DataFrame:
    """``pairs`` with kept (the rewritten text only if it stays within ``limit``), ok, unverifiable; ``exact`` as in ``cer_within``."""
    rows = pairs.withColumns({"_o": strip_labels(F.col(original)), "_n": strip_labels(F.col(rewritten))})
    judged = cer_within(rows, limit, "_o", "_n", exact=exact)
    ok = F.coalesce(F.col("within"), F.lit(False))  # what is not measured is not within
    return judged.withColumns({"ok": ok, "kept": F.when(ok, F.col(rewritten)).otherwise(F.col(original))}).drop("_o", "_n", "within")


def compare_asr(pairs: DataFrame, lexicon=None, literals=()) -> DataFrame:
    """(model, stage, pairs, distance, ref_length, cer): accuracy by model, and after term correction where one applied.

    ``pairs`` has model, reference, hypothesis.
    """
    from callspark.functions.text import LEXICON, correct_terms

    raw = corpus_cer(cer(pairs), "model").withColumn("stage", F.lit("raw"))
    fixed = correct_terms(pairs, "hypothesis", LEXICON if lexicon is None else lexicon, literals, "_fixed").where(F.size("_fixed_counts") > 0)
    after = corpus_cer(cer(fixed, hypothesis="_fixed"), "model").withColumn("stage", F.lit("corrected"))
    return raw.unionByName(after).select("model", "stage", "pairs", "distance", "ref_length", "cer")
