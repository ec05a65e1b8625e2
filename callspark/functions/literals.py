"""Which of many words or patterns a text may hold: fragments of their fixed characters, looked up in one pass over the bytes.

Texts and literals are folded: each run of ASCII characters that are neither letter nor digit counts as one blank, so words with any
blanks between them are one literal. A task packs every 1 to 24 bytes of its texts into one number each and looks these up in the
fragments of all words of a block, so its time follows the texts and the hits, not texts times words. Of what a pattern needs, the
rarest in a slice of the texts is spread to candidates, a bounded number at a time.
"""

from __future__ import annotations

import re
import re._parser as regex_parser
from collections.abc import Iterator
from re import _constants as ops

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words or patterns that one broadcast holds.
BLOCK_BYTES = 16_000_000
_SLICE = 1 << 20
#: Bytes of a literal that are looked up, candidates held at once, bytes of texts sent on at once, alternatives that one literal may have.
_LONGEST, _PAIRS, _SENT, _MOST = 24, 200_000, 4_000_000, 64
_SPREAD, _SECOND, _THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BLANKS = r"[\x00-/:-@\[-`{-\x7f]"
_BLANK = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])


def mandatory_literals(pattern: str) -> list[frozenset[str]] | None:
    """Sets of texts, of each of which every match of the pattern contains at least one; None if there are none to rely on.

    Only what Python and Java read alike is relied on: patterns that Python can't parse, that ignore case or white space,
    or use octal escapes have none.
    """
    if "\\0" in pattern or "\\Q" in pattern:
        return None
    try:
        parsed = regex_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    found = _options(parsed)
    try:
        return found if found and all(x.encode() for option in found for x in option) else None
    except UnicodeEncodeError:  # halves of a surrogate pair
        return None


def fold(text: str) -> str:
    """A text with one blank for each run of ASCII characters that are neither letter nor digit."""
    return re.sub(_BLANKS + "+", " ", text)


def folded_literals(pattern: str) -> list[frozenset[str]] | None:
    """Like ``mandatory_literals``, of the folded text: literals with blanks between them, and with the alternatives behind them, are one."""
    if "\\0" in pattern or "\\Q" in pattern or "&&" in pattern:
        return None
    try:
        parsed = regex_parser.parse(pattern)
        if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) or _nested(parsed):
            return None
        found = _folded_options(parsed)
        return found if found and all(x.encode() for option in found for x in option) else None
    except (re.error, OverflowError, RecursionError, UnicodeEncodeError):
        return None


def _nested(sequence) -> bool:
    """Whether a class has a bracket in it, which Java reads as a class of its own."""
    for op, value in sequence:
        if op is ops.IN and (ops.LITERAL, ord("[")) in value:
            return True
        inner = value[1] if op is ops.BRANCH else [x for x in value if isinstance(x, regex_parser.SubPattern)] if isinstance(value, tuple) else [value] if isinstance(value, regex_parser.SubPattern) else []
        if any(map(_nested, inner)):
            return True
    return False


def _step(op, value) -> tuple[list[str], bool] | None:
    """How an element's matches may begin, folded, and whether nothing of them is left behind that."""
    if op is ops.LITERAL:
        return [chr(value)], True
    if op is ops.AT:  # a place takes no characters
        return [""], True
    if op is ops.IN:
        if not all(kind is ops.LITERAL or kind is ops.RANGE and x[1] - x[0] < 128 for kind, x in value):
            return None
        signs = sorted({chr(c) for kind, x in value for c in ([x] if kind is ops.LITERAL else range(x[0], x[1] + 1))})
        return ([" "], True) if all(re.fullmatch(_BLANKS, x) for x in signs) else (signs, True) if len(signs) <= 16 else None
    if op is ops.SUBPATTERN and not value[1] & (re.IGNORECASE | re.VERBOSE):
        return _lead(value[3])
    if op is ops.ATOMIC_GROUP:
        return _lead(value)
    if op is ops.BRANCH:
        parts = [_lead(x) for x in value[1]]
        return [x for part, _ in parts for x in part], all(whole for _, whole in parts)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
        part, whole = _lead(value[2])
        return ([" "], True) if whole and set(map(fold, part)) == {" "} else (part, False)
    return None


def _lead(sequence) -> tuple[list[str], bool]:
    run = [""]
    for op, value in sequence:
        step = _step(op, value)
        if step is None or len(run) * len(step[0]) > _MOST:
            return run, False
        run = [a + b for a in run for b in step[0]]
        if not step[1]:
            return run, False
    return run, True


def _folded_options(sequence) -> list[frozenset[str]]:
    options, run = [], [""]

    def close() -> None:
        if all(run):
            options.append(frozenset(map(fold, run)))
        run[:] = [""]

    for op, value in sequence:
        step = _step(op, value)
        if step is None or len(run) * len(step[0]) > _MOST:
            close()
        if step is not None and len(step[0]) <= _MOST:
            run[:] = [a + b for a in run for b in step[0]]
            if not step[1]:
                close()
        if (step is None or not all(step[0])) and (inner := _inner(op, value)):
            options.append(frozenset(map(fold, inner)))
    close()
    # a set that another one implies needs no look
    kept = list(dict.fromkeys(options))
    for x in list(kept):
        if any(x != y and all(any(a in b for a in x) for b in y) for y in kept):
            kept.remove(x)
    return kept


def _needed(sequence) -> frozenset[str] | None:
    """Of what a sequence needs, the set with the longest texts."""
    return max(_options(sequence), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _inner(op, value) -> frozenset[str] | None:
    """What an element with parts of its own needs."""
    if op is ops.SUBPATTERN and not value[1] & (re.IGNORECASE | re.VERBOSE):
        return _needed(value[3])
    if op is ops.ATOMIC_GROUP:
        return _needed(value)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
        return _needed(value[2])
    if op is ops.BRANCH:
        parts = [_needed(x) for x in value[1]]
        return frozenset().union(*parts) if all(parts) else None
    return None


def _options(sequence) -> list[frozenset[str]]:
    options, run = [], []

    def close() -> None:
        if run:
            options.append(frozenset(["".join(run)]))
            run.clear()

    for op, value in sequence:
        if op is ops.LITERAL:
            run.append(chr(value))
            continue
        if op is ops.AT:  # a place takes no characters
            continue
        close()
        if inner := _inner(op, value):
            options.append(inner)
    close()
    return list(dict.fromkeys(options))


def _ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    run = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[run], run


class FragmentIndex:
    """What each owner needs, as fragments of folded texts: the first 24 bytes of a literal, or all of a shorter one."""

    def __init__(self, needs: list[list[list[str]]]):
        """``needs``: of each owner, sets of literals of which one must be there; an owner without any, or with an empty literal, meets every text."""
        numbers: dict[bytes, int] = {}
        sets, owners, always = [], [], []
        for owner, options in enumerate(needs):
            known = [sorted({numbers.setdefault(fold(w).encode()[:_LONGEST], len(numbers)) for w in option}) for option in options if all(option)]
            (owners if known else always).append(owner)
            if known:
                sets.append(known)
        self.always, self.owners = np.array(always, dtype=np.int64), np.array(owners, dtype=np.int64)
        self.n_sets = np.array([len(x) for x in sets], dtype=np.int64)
        self.first_set = np.cumsum(self.n_sets) - self.n_sets
        self.set_size = np.array([len(x) for own in sets for x in own], dtype=np.int64)
        self.set_start = np.cumsum(self.set_size) - self.set_size
        self.fragments = np.array([f for own in sets for x in own for f in x], dtype=np.int64)
        self.n_fragments = len(numbers)
        by_size: dict[int, list[tuple[bytes, int]]] = {}
        for data, number in numbers.items():
            by_size.setdefault(len(data), []).append((data, number))
        self.tables = {}
        for size, some in by_size.items():
            keys = _keys(np.frombuffer(b"".join(d for d, _ in some), dtype=np.uint8).reshape(len(some), size))
            order = np.argsort(keys, kind="stable")
            shift = np.uint64(64 - min(max(16, (8 * len(some)).bit_length()), 24))
            bits = np.zeros(1 << (64 - int(shift)), dtype=bool)
            bits[(keys * _SPREAD) >> shift] = True
            self.tables[size] = (keys[order], bits, shift, np.array([n for _, n in some], dtype=np.int64)[order])

    def candidates(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, owner) pairs, each once, a bounded number at a time; a null text has none."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        said = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        if len(self.always):
            step = max(1, _PAIRS // len(self.always))
            for k in range(0, len(said), step):
                yield np.repeat(said[k : k + step], len(self.always)), np.tile(self.always, len(said[k : k + step]))
        first = 0
        while first < len(texts) and len(self.owners):
            last = min(max(int(np.searchsorted(offsets, offsets[first] + _SLICE, side="right")) - 1, first + 1), len(texts))
            for rows, owners in self._pairs(*self._hits(*_folded(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])), last - first):
                yield rows + first, owners
            first = last

    def _hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fragment, row) pairs, each once, in order."""
        n, found = len(offsets) - 1, [np.zeros(0, dtype=np.int64)]
        packed, mixed = data.astype(np.uint64), None
        for size in range(1, max(self.tables, default=0) + 1):
            if size > len(data):
                break
            if 1 < size <= 8:
                packed = packed[:-1] | (data[size - 1 :].astype(np.uint64) << np.uint64(8 * (size - 1)))
            if size not in self.tables:
                continue
            if size > 8 and mixed is None:
                mixed = packed * _SECOND, packed * _THIRD
            keys, bits, shift, numbers = self.tables[size]
            key = packed if size <= 8 else _mixed(packed, *mixed, size)
            at = np.flatnonzero(bits[(key * _SPREAD) >> shift])
            where = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            sure = keys[where] == key[at]
            at, where = at[sure], where[sure]
            row = np.searchsorted(offsets, at, side="right") - 1
            whole = at + size <= offsets[row + 1]
            found.append(np.unique(numbers[where[whole]] * n + row[whole]))
        return np.divmod(np.sort(np.concatenate(found)), max(n, 1))

    def _pairs(self, fragment: np.ndarray, row: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, owner): candidates come from the owner's rarest set, the other sets are looked up."""
        times = np.bincount(fragment, minlength=self.n_fragments)
        start = np.cumsum(times) - times
        keys = fragment * n + row
        cost = np.add.reduceat(times[self.fragments], self.set_start)
        least = np.minimum.reduceat(cost, self.first_set)
        best = np.flatnonzero(cost == np.repeat(least, self.n_sets))
        of = np.repeat(np.arange(len(self.owners)), self.n_sets)[best]
        hopeful, at = np.unique(of, return_index=True)
        best, hopeful = best[at][least[hopeful] > 0], hopeful[least[hopeful] > 0]
        parts = (np.cumsum(least[hopeful]) - 1) // _PAIRS if len(hopeful) else np.zeros(0, dtype=np.int64)
        for part in np.unique(parts):
            own, chosen = hopeful[parts == part], best[parts == part]
            place, run = _ragged(self.set_start[chosen], self.set_size[chosen])
            used = self.fragments[place]
            place, spread = _ragged(start[used], times[used])
            pairs = np.unique(own[run[spread]] * n + row[place])
            owner, rows = np.divmod(pairs, n)
            more = np.flatnonzero(self.n_sets[owner] > 1)
            for k in range(0, len(more), _PAIRS // 10):
                some = more[k : k + _PAIRS // 10]
                sets, of_pair = _ragged(self.first_set[owner[some]], self.n_sets[owner[some]])
                place, of_set = _ragged(self.set_start[sets], self.set_size[sets])
                asked = self.fragments[place] * n + rows[some][of_pair[of_set]]
                there = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
                good = np.bincount(of_set, weights=there, minlength=len(sets)) > 0
                rows[some[np.bincount(of_pair, weights=~good, minlength=len(some)) > 0]] = -1
            yield rows[rows >= 0], self.owners[owner[rows >= 0]]


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as ``fold`` gives them, as bytes and offsets."""
    blank = _BLANK[data]
    again = np.zeros(len(data), dtype=bool)
    again[1:] = blank[1:] & blank[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    return np.where(blank, np.uint8(32), data)[~again], kept[offsets]


def _mixed(packed: np.ndarray, second: np.ndarray, third: np.ndarray, size: int) -> np.ndarray:
    """One number for 9 to 24 bytes from each place, of the numbers for 8 and their products."""
    n = len(packed) - size + 8
    return packed[:n] + second[size - 8 :][:n] + (third[8:][:n] if size > 16 else 0)


def _keys(words: np.ndarray) -> np.ndarray:
    """The numbers of words of one size, as those of texts."""
    size = words.shape[1]
    pack = lambda a: (words[:, a : a + 8].astype(np.uint64) << (np.uint64(8) * np.arange(min(size, 8), dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    if size <= 8:
        return pack(0)
    return pack(0) + pack(size - 8) * _SECOND + (pack(8) * _THIRD if size > 16 else np.uint64(0))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def needs_of(patterns: pd.Series) -> pd.Series:
    """What each pattern needs of a folded text, for ``meet``; empty if there is nothing to rely on."""
    return patterns.map(lambda p: [sorted(x) for x in folded_literals(p) or []])


def meet(texts: DataFrame, text: str, asked: DataFrame, needs: Column, sure: str | None = None, block: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all) columns of ``texts`` with the columns of each row of ``asked`` that a text may hold, found by the literals that ``needs`` (arrays of arrays) says of a row: one of each has to be there.

    A row without literals meets every text that isn't null. ``sure`` names a column of ``asked`` that must be contained
    as it is, which is then checked here. ``asked`` goes to the executors in blocks of at most ``block`` rows on average and about
    BLOCK_BYTES; each block reads ``texts`` once, so write that before, if it is dear to compute and the blocks are many.
    """
    keep = texts.columns if keep is None else keep
    spark, named = texts.sparkSession, asked.columns
    size = F.lit(64).cast("long")
    for field in asked.schema:
        if isinstance(field.dataType, T.StringType):
            size += F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
    known = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-known.n // block), -(-known.bytes // BLOCK_BYTES))
    schema = T.StructType([*(texts.schema[c] for c in keep), *asked.schema.fields])

    def scanner(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, table = held.value
            exact = table[sure].to_pylist() if sure else None
            check = np.array([len(x.encode()) > 8 or not x.isalnum() for x in exact], dtype=bool) if exact else None
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text))
                own = batch.select(keep)
                bytes_of = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 64 if text in keep else np.full(len(column), 64)
                for rows, owners in index.candidates(column):
                    if exact:
                        good = ~check[owners]  # a fragment is all of a short word
                        for k in np.flatnonzero(~good):
                            good[k] = exact[owners[k]] in column[int(rows[k])].as_py()
                        rows, owners = rows[good], owners[good]
                    order = np.argsort(owners, kind="stable")  # rows of one pattern together: it is compiled once
                    sent = np.maximum(np.cumsum(bytes_of[rows[order]]) // _SENT, np.arange(len(order)) // 10_000)
                    for part in np.split(order, np.flatnonzero(np.diff(sent)) + 1) if len(order) else ():
                        left, right = own.take(pa.array(rows[part])), table.take(pa.array(owners[part])).combine_chunks()
                        yield pa.RecordBatch.from_arrays([*left.columns, *(c.combine_chunks() for c in right.columns)], names=[*keep, *named])

        return run

    out = None
    for k in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64(*named), F.lit(n_blocks)) == k).withColumn("_needs", needs).toArrow()
        index = FragmentIndex(part["_needs"].to_pylist())
        held = spark.sparkContext.broadcast((index, part.drop_columns("_needs").combine_chunks()))
        found = texts.mapInArrow(scanner(held), schema)
        out = found if out is None else out.unionByName(found)
    return out


def contained(texts: DataFrame, text: str, words: DataFrame, word: str, keep: list[str], block: int = 100_000) -> DataFrame:
    """``keep`` of ``texts`` with each ``word`` (of a table of distinct words) that the text contains; null words are in no text."""
    return meet(texts, text, words.select(word).where(F.col(word).isNotNull()), F.array(F.array(word)), word, block, keep)
