"""Secret scan: a trigram inverted index picks the texts that each rule's regular expression must be tried on.

Each rule's expression is parsed and turned into a Boolean query of trigrams that every match must contain
(case folded). For each slice of a batch the postings of the queried trigrams are built, the queries are evaluated
on them, and only the candidates are searched. A rule without mandatory trigrams is tried on every text.

Base kinds are ``assign``, ``access`` and ``hex``; further kinds are in ``RULES``. Spans are in code points, end
exclusive; of one kind they are leftmost and don't overlap.

Cases: null counts as an empty text and has no spans. Each row is judged on its own, with repeated or null ids
too. Very long texts are searched whole; memory follows the longest text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callspark.llm.textbytes import TextSlice, slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    accept: Callable[[re.Match], bool] | None = None


#: The three base rules as the contract words them, then rules of our own for published key formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}", re.ASCII),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}={0,2}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("repo_token", r"(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
BASE_KINDS = ("assign", "access", "hex")


def _alternatives(items, limit: int = 64) -> list[set[str] | None]:
    """The parts of a parsed sequence: sets of the strings a part can be, None where they are too many."""
    out: list[set[str] | None] = []
    for op, value in items:
        if op is sre.LITERAL:
            out.append({chr(value).lower()})
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in value) and len(value) <= 8:
            out.append({chr(v).lower() for _, v in value})
        elif op is sre.SUBPATTERN:
            out.append(_strings(value[3], limit))
        elif op is sre.BRANCH:
            options = [_strings(x, limit) for x in value[1]]
            out.append(set().union(*options) if all(x is not None for x in options) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1 and value[0] == 0:
            inner = _strings(value[2], limit)
            out.append(inner | {""} if inner is not None else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] == value[1] and value[0] <= 8:
            inner = _strings(value[2], limit)
            out += [inner] * value[0]
        else:
            out.append(None)
    return out


def _strings(items, limit: int) -> set[str] | None:
    """All strings that a parsed sequence matches, if they are at most ``limit``."""
    total = {""}
    for part in _alternatives(items, limit):
        if part is None or len(total) * len(part) > limit:
            return None
        total = {a + b for a in total for b in part}
    return total


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of trigram sets (each set an AND); empty if nothing is mandatory.

    Each clause comes from a stretch of the expression with few possible strings, all of three characters at least.
    """
    query, stretch = [], {""}

    def end() -> None:
        if stretch and all(len(s) >= 3 for s in stretch):
            query.append([frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in sorted(stretch)])

    for part in [*_alternatives(sre_parse.parse(pattern)), None]:
        if part is None or len(stretch) * len(part) > 64:
            end()
            stretch = {""} if part is None else part
        else:
            stretch = {a + b for a in stretch for b in part}
    return query


class TrigramIndex:
    """Postings of the trigrams that any rule's query names, over the rows of a slice."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [trigram_query(r.pattern) for r in rules]
        grams = sorted({g for q in self.queries for clause in q for s in clause for g in s if g.isascii()})
        self.number = {g: k for k, g in enumerate(grams)}
        self.codes = np.full(1 << 24, -1, dtype=np.int16)
        for g, k in self.number.items():
            a, b, c = g.encode()
            self.codes[a << 16 | b << 8 | c] = k
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def candidates(self, piece: TextSlice) -> list[np.ndarray]:
        """For each rule, whether each row can match."""
        data = self.fold[piece.data]
        code = self.codes[data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]] if len(data) > 2 else np.zeros(0, dtype=np.int16)
        at = np.flatnonzero(code >= 0)
        row = np.searchsorted(piece.offsets, at, side="right") - 1
        inside = at + 3 <= piece.offsets[row + 1]
        postings = np.zeros((len(self.number), piece.rows), dtype=bool)
        postings[code[at[inside]], row[inside]] = True
        out = []
        for query in self.queries:
            possible = np.ones(piece.rows, dtype=bool)
            for clause in query:
                any_of = np.zeros(piece.rows, dtype=bool)
                for grams in clause:
                    every = np.ones(piece.rows, dtype=bool)
                    for g in grams:
                        every &= postings[self.number[g]] if g in self.number else True
                    any_of |= every
                possible &= any_of
            out.append(possible)
        return out


_FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        searches = [re.compile(r.pattern, r.flags) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for piece in slices(batch.column(1)):
                texts: dict[int, str] = {}
                spans: list[list] = [[] for _ in range(piece.rows)]
                for order, (rule, search, possible) in enumerate(zip(rules, searches, index.candidates(piece))):
                    for row in np.flatnonzero(possible).tolist():
                        if row not in texts:
                            texts[row] = piece.data[piece.offsets[row] : piece.offsets[row + 1]].tobytes().decode()
                        for m in search.finditer(texts[row]):
                            if rule.accept is None or rule.accept(m):
                                spans[row].append((m.start(), order, m.end(), rule.kind))
                made = [[{"kind": k, "start": a, "end": b} for a, _, b, k in sorted(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), pa.array(made, kind)], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans), a row per row of ``docs``; spans are (kind, start, end) by start, then in the rules' order."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(_scan(rules), _FOUND)


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), spans as text ``kind:start:end``, comma-joined."""
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return find_secrets(docs).select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", word), ",").alias("spans")
    )
