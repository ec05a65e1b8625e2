"""Column helpers and text preparation: rounding, masking, term correction, tokens, pseudonyms."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the upstream regular expressions read it: also the no-break and ideographic blanks.
SPACE = r"[\s 　﻿]"


def js_round(x: Column | str) -> Column:
    """Half up towards plus infinity."""
    return F.floor((F.col(x) if isinstance(x, str) else x) + 0.5)


def round_to(x: Column | str, places: int) -> Column:
    return js_round((F.col(x) if isinstance(x, str) else x) * 10**places) / 10**places


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))  # least() and greatest() skip nulls


def micros(moment: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp of either kind, in the session's zone (UTC)."""
    return F.unix_micros((F.col(moment) if isinstance(moment, str) else moment).cast("timestamp"))


def dense_length(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, f"{SPACE}+", ""))


def valid_date(text: Column) -> Column:
    """'YYYY-MM-DD' as a date; anything else, impossible days included, is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


# ---- masking ----------------------------------------------------------------------------------------------

# The five rules in their order. JS \b is spelt out for ASCII, so digits glued to Hangul are seen.
_EDGE, _NEXT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_RRN = re.compile(_EDGE + r"([0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])([-\s]?)([0-9])[0-9]{6}" + _NEXT)
_CARD = re.compile(_EDGE + r"(?:[0-9][ -]?){12,18}[0-9]" + _NEXT)
_CARD_WORDS = re.compile("카드|결제|승인|체크카드|신용")
_PHONE = re.compile(_EDGE + r"(01[016-9]|0[2-6][0-9]?)([-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4})" + _NEXT)
_ACCOUNT = re.compile(_EDGE + r"[0-9]{2,6}[-\s]?[0-9]{2,6}[-\s]?[0-9]{2,7}" + _NEXT)
_BANK_WORDS = re.compile("계좌|입금|이체|송금|은행|출금계좌")
_MAIL = re.compile(_EDGE + r"([A-Za-z0-9_.+-]+)@([A-Za-z0-9_-]+\.[A-Za-z0-9_.]+)" + _NEXT)
PII_TYPES = ("rrn", "card", "phone", "account", "email")


def _hide(text: str, keep: int) -> str:
    """Digits but the last ``keep`` as stars."""
    hidden = max(sum(c.isdigit() for c in text) - keep, 0)
    return re.sub("[0-9]", "*", text, count=hidden) if hidden else text


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _line_of(match: re.Match) -> str:
    text, at = match.string, match.start()
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at + 1) + 1 : end if end >= 0 else len(text)]


def _mask_one(text: str | None) -> tuple[str, dict[str, int], int]:
    text, hits = text or "", {}

    def apply(kind: str, pattern: re.Pattern, accept, mask) -> None:
        nonlocal text

        def each(m: re.Match) -> str:
            if accept and not accept(m):
                return m[0]
            hits[kind] = hits.get(kind, 0) + 1
            return mask(m)

        text = pattern.sub(each, text)

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    apply("rrn", _RRN, None, lambda m: f"{m[1]}{m[2]}{m[3]}{m[4]}{m[5]}******")
    apply("card", _CARD, lambda m: _luhn(digits(m)) or _CARD_WORDS.search(_line_of(m)), lambda m: _hide(m[0], 4))
    apply("phone", _PHONE, None, lambda m: m[1] + _hide(m[2], 4))
    apply("account", _ACCOUNT, lambda m: 10 <= len(digits(m)) <= 14 and _BANK_WORDS.search(_line_of(m)), lambda m: _hide(m[0], 3))
    if "@" in text:
        apply("email", _MAIL, None, lambda m: (m[1][0] + "*" * (len(m[1]) - 1) if len(m[1]) > 1 else "*") + "@" + m[2])
    return text, hits, sum(hits.values())


#: Texts of which a worker holds strings at once: an Arrow batch may have thousands, and a sign beyond Latin-1 doubles each one's bytes.
_STRINGS = 128


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("hits", T.MapType(T.StringType(), T.IntegerType())), T.StructField("total", T.IntegerType())]))
def _mask(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("text", pa.string()), ("hits", pa.map_(pa.string(), pa.int32())), ("total", pa.int32())])
    parts = [pa.array([], kind)]
    for at in range(0, len(texts), _STRINGS):
        done = map(_mask_one, texts.slice(at, _STRINGS).to_pylist())
        parts.append(pa.array([{"text": text, "hits": list(hits.items()), "total": total} for text, hits, total in done], kind))
    return pa.concat_arrays(parts)


def mask_pii(df: DataFrame, column: str, out: str = "masked") -> DataFrame:
    """``df`` with ``out``: struct of the masked text (same length), hits by type, total. Later rules see earlier masks."""
    bare = F.struct(F.coalesce(column, F.lit("")).alias("text"), F.create_map().cast("map<string,int>").alias("hits"), F.lit(0).alias("total"))
    return df.withColumn(out, F.when(F.col(column).rlike("[0-9@]"), _mask(F.col(column))).otherwise(bare))


def pii_audit(masked: DataFrame, column: str = "masked") -> DataFrame:
    """(type, n): hits by type over all rows; types without a hit have no row."""
    return masked.select(F.explode(f"{column}.hits").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))


# ---- term correction --------------------------------------------------------------------------------------

# Terms and what they are mis-transcribed as, in order.
LEXICON: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("한빛텔레콤", (r"한비\s*텔레콤", r"한빛\s+텔레콤", r"한\s*밑에?\s*내\s*콤", r"한빛\s*텔레컴", r"한빛\s*텔레컨")),
    ("위약금", (r"위\s+약금", "위악금", "이약금")),
    ("소액결제", (r"소액\s+결제", r"소약\s*결제")),
    ("요금제", (r"요금\s+제(?=[가-힣]?\s|$)",)),
    ("명의 변경", (r"명이\s*변경", "명의변경")),
    ("해지", ("헤지",)),
    ("에스컬레이션", ("에스칼레이션", "이스컬레이션")),
    ("약정", (r"약전(?=\s|기간|이|을|은)", "야꿍")),
    ("할인반환금", (r"할인\s+반환금", "할인반한금", r"할인\s*반한금")),
    ("결합할인", (r"결합\s+할인", r"겹합\s*할인")),
    ("자동이체", (r"자동\s+이체", "자동이채")),
    ("청구서", (r"청구\s+서(?=[가-힣]?\s|$)", "청꾸서")),
    ("미납", (r"미\s+납(?=\s|금|액)",)),
    ("번호이동", (r"번호\s+이동", "번호이돔")),
    ("개통", ("게통", "개퉁")),
    ("기가인터넷", (r"기가\s+인터넷", "기가인터냇")),
    ("셋톱박스", (r"셋탑\s*박스", r"샛톱\s*박스", r"셋톱\s+박스")),
    ("로밍", ("노밍", r"로망(?=\s*(요금|서비스|해지|신청))")),
    ("소비자원", (r"소비자\s+원(?=\s|에|이)", "소비자언")),
    ("방송통신위원회", ("방통위", r"방송통신\s+위원회")),
    ("본인확인", (r"보닌\s*확인",)),
    ("접수번호", (r"접수\s+번호",)),
)


def clean_custom_terms(pairs: DataFrame, owner: str = "owner", cap: int = 3) -> DataFrame:
    """(owner, wrong, term) pairs that are usable: the first ``cap`` of an owner by ``ord``, trimmed, 30 characters, both given and different."""
    from pyspark.sql.window import Window

    cut = lambda c: F.substring(F.trim(c), 1, 30)
    first = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy("ord"))).where(F.col("_n") <= cap)
    return first.select(owner, "ord", cut("wrong").alias("wrong"), cut("term").alias("term")).where("wrong <> '' and term <> '' and wrong <> term")


def correct_terms(df: DataFrame, column: str, lexicon: Sequence[tuple[str, Sequence[str]]] = LEXICON, literals: Sequence[tuple[str, str]] = (), out: str = "corrected") -> DataFrame:
    """``df`` with ``out`` (corrected text) and ``out``_counts (term to count). Each rule reads what the rule before left."""
    rules = [(term, p) for term, patterns in lexicon for p in patterns] + [(term, re.escape(wrong)) for wrong, term in literals]
    text, counts = F.coalesce(F.col(column), F.lit("")), {}
    df = df.withColumn(out, text)
    # one projection per rule keeps each regular expression evaluated once
    for k, (term, pattern) in enumerate(rules):
        df = df.withColumn(f"_c{k}", F.regexp_count(F.col(out), F.lit(pattern))).withColumn(out, F.regexp_replace(F.col(out), pattern, term.replace("\\", r"\\").replace("$", r"\$")))
        counts.setdefault(term, []).append(F.col(f"_c{k}"))
    entries = [F.struct(F.lit(term).alias("key"), functools.reduce(lambda a, b: a + b, c).alias("value")) for term, c in counts.items()]
    found = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0)) if entries else F.create_map().cast("map<string,int>")
    return df.withColumn(f"{out}_counts", found).drop(*(f"_c{k}" for k in range(len(rules))))


def correct_own_terms(df: DataFrame, column: str, pairs: DataFrame, owner: str = "owner", out: str = "corrected") -> DataFrame:
    """As ``correct_terms``, but with each row's owner's own pairs (``clean_custom_terms``), literal and in their order.

    A pair reads what the pair before left. Rows whose owner has no pairs, or is null, stay as they are. An owner has a few
    pairs; the table of owners goes to the rows if it has 100,000 rows at most, else both are merged.
    """
    of = pairs.groupBy(F.col(owner).alias("_owner")).agg(F.array_sort(F.collect_list(F.struct("ord", "wrong", "term"))).alias("_pairs"))
    few = of.limit(100_001).count() <= 100_000
    rows = df.join(of.hint("broadcast" if few else "merge"), F.col(owner) == F.col("_owner"), "left")
    start = F.struct(F.coalesce(F.col(column), F.lit("")).alias("text"), F.array().cast("array<struct<term:string,n:int>>").alias("hits"))

    def step(done, pair):
        text, bare = done["text"], F.replace(done["text"], pair["wrong"], F.lit(""))
        n = F.floor((F.length(text) - F.length(bare)) / F.length(pair["wrong"])).cast("int")
        return F.struct(F.replace(text, pair["wrong"], pair["term"]).alias("text"), F.concat(done["hits"], F.array(F.struct(pair["term"].alias("term"), n.alias("n")))).alias("hits"))

    rows = rows.withColumn("_done", F.when(F.col("_pairs").isNotNull(), F.aggregate("_pairs", start, step)).otherwise(start))
    hits = F.filter("_done.hits", lambda h: h["n"] > 0)
    terms = F.array_distinct(F.transform(hits, lambda h: h["term"]))
    sums = F.transform(terms, lambda t: F.aggregate(hits, F.lit(0), lambda n, h: n + F.when(h["term"] == t, h["n"]).otherwise(0)))
    return rows.withColumns({out: F.col("_done.text"), f"{out}_counts": F.map_from_arrays(terms, sums)}).drop("_done", "_pairs", "_owner")


def correction_audit(corrected: DataFrame, day: str, column: str = "corrected_counts") -> DataFrame:
    """(day, term, n): corrections per term and day."""
    return corrected.select(day, F.explode(column).alias("term", "n")).groupBy(day, "term").agg(F.sum("n").alias("n"))


def outbound_text(calls: DataFrame, column: str = "transcript", out: str = "outbound") -> DataFrame:
    """Masked, then corrected: the only form of a text that may leave."""
    masked = mask_pii(calls, column, "_masked").withColumn("_text", F.col("_masked.text"))
    return correct_terms(masked, "_text", out=out).drop("_masked", "_text")


# ---- tokens -----------------------------------------------------------------------------------------------

# Particles and endings that are cut from a word, longest first when applied.
# fmt: off
PARTICLES = (
    "으로서", "으로써", "이라도", "에게서", "한테서", "에서", "에게", "한테", "까지", "부터", "으로", "보다", "처럼", "만큼", "이나", "라도", "이라", "은", "는", "이", "가", "을", "를", "의",
    "에", "와", "과", "도", "만", "로", "랑",
)
ENDINGS = (
    "인데요", "한데요", "거든요", "나요", "까요", "가요", "데요", "어요", "아요", "해요", "예요", "이에요", "네요", "지요", "군요", "려면", "하려고", "되나요", "됩니까", "습니까", "입니까", "합니다",
    "습니다", "입니다", "했어요", "해주세요", "주세요", "싶어요", "있어요", "없어요", "하려면", "하면", "되면", "한다면", "하고", "해서", "하려고요", "려고요", "하고요", "드려요", "드릴까요", "될까요", "인가요",
    "한가요",
)
# fmt: on


def _suffix(words: Sequence[str]) -> str:
    return "^(..+?)(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")$"


def stem(word: Column) -> Column:
    """One ending, then one particle off a lower-cased word, if two characters stay."""
    # a suffix goes only if the word is longer than it by two; the lazy head makes the longest suffix win
    off = lambda w, p: F.when(F.length(w) > 2, F.regexp_replace(w, p, "$1")).otherwise(w)
    return off(F.when(F.length(word) > 2, F.regexp_replace(word, _suffix(ENDINGS), "$1")).otherwise(word), _suffix(PARTICLES))


def tokens(text: Column) -> Column:
    """Array of a text's tokens, in order, with repeats."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^가-힣a-z0-9]+"), lambda w: F.length(w) > 0)
    return F.filter(F.transform(words, stem), lambda w: F.length(w) >= 2)


def tokenise(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, term): a row per token."""
    return df.select(key, F.posexplode(tokens(F.col(column))).alias("pos", "term"))


def bigrams(text: Column) -> Column:
    """Array of distinct two-character pieces of a text without blanks and punctuation, case folded."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^가-힣a-z0-9]", "")
    return F.array_distinct(pairs_of(flat))


def pairs_of(flat: Column) -> Column:
    """Array of all two-character pieces of a text, in order, in one pass over it (a look-ahead steps by one character, never into half of one)."""
    return F.regexp_extract_all(flat, F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}].))"), F.lit(1))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form; only texts with combining letters go through Python."""
    # what a Python function is given decides what is sent to it, not where its result is used
    return F.coalesce(_nfc(F.when(text.rlike("[\\u1100-\\u11FF\\u0300-\\u036F]"), text)), text)


def pseudonymise(df: DataFrame, ip: str, day: str, salt: str, out: str = "caller") -> DataFrame:
    """First 16 hex digits of SHA-256 of salt:day:ip; 'unknown' stays."""
    code = F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.col(day).cast("string"), F.col(ip)), 256), 1, 16)
    return df.withColumn(out, F.when(F.col(ip) == "unknown", F.lit("unknown")).otherwise(code))


def contract_check(df: DataFrame, strings: Sequence[str] = (), arrays: Sequence[str] = (), string_arrays: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(passing, quarantined) rows of a table of parsed model outputs; ``bad_key`` names the first failing key.

    Arrays must be there, strings must not be blank, string arrays must hold no null; scalars in them are text.
    """
    tests = [F.when(F.col(c).isNull(), F.lit(c)) for c in arrays]
    tests += [F.when(F.col(c).isNull() | F.exists(F.col(c).cast("array<string>"), lambda x: x.isNull()), F.lit(c)) for c in string_arrays]
    tests += [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in strings]
    judged = df.withColumn("bad_key", F.coalesce(*tests, F.lit(None).cast("string")))
    passing = judged.where("bad_key is null").drop("bad_key")
    for c in string_arrays:
        passing = passing.withColumn(c, F.col(c).cast("array<string>"))
    return passing, judged.where("bad_key is not null")
