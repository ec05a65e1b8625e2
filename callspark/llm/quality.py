"""Quality rules: fixed text rules, then a logistic regression on hashed word and character n-grams.

Features of a text: shares of hashed words, of hashed word pairs (a word that repeats itself is one common
feature) and of hashed three-byte sequences. The model is fitted in numpy on a bounded sample of labelled
rows (``sample`` per class, those with the smallest hash of the id, whole texts); executors turn the texts
into hashed counts first. A fifth of the sample is held back, and the scores on it fix a Platt
calibration. Documents are then scored in Arrow batches and judged against fixed thresholds.

Rules (``n_words`` under 10, or over 20 % of words in repeated five-word windows) reject on their own.

Cases: null and empty texts have no words and fail the rules. Labels without a quality or an id are not
used; with no label of one of the two classes there is no model, ``p_good`` is null and only the rules
judge. Rows that repeat a doc_id are judged each on its own text; the model learns from one of them, the
greatest text, and an id with labels of both kinds counts as not good. Texts of any length are read whole, in
slices. An empty table gives no row. Extra columns are ignored, and stay in ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callspark.llm.textbytes import SPACE_WORDS, TextSlice, Words, mix, ragged_positions, segment_sums, slices

_U = np.uint64
WORD_BITS, PAIR_BITS, CHAR_BITS = 17, 16, 17
GROUPS = np.array([0, 1 << WORD_BITS, (1 << WORD_BITS) + (1 << PAIR_BITS), (1 << WORD_BITS) + (1 << PAIR_BITS) + (1 << CHAR_BITS)])
SAMPLE = 1500
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is kept if the model gives it at least this probability of being good.
KEEP_FROM = 0.35
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SAME = _U(0x5A17E)


def _features(piece: TextSlice, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, offsets by row) of words, word pairs and byte triples."""
    hashes = words.hashes(fold=False)
    first, _ = ragged_positions(words.offsets[:-1], np.maximum(words.counts - 1, 0))
    one, two = hashes[first], hashes[first + 1]
    pairs = np.where(one == two, _SAME, mix(one + two * _U(3)))
    pair_counts = np.maximum(words.counts - 1, 0)
    data = piece.data.astype(np.uint32)
    n = np.diff(piece.offsets)
    at, _ = ragged_positions(piece.offsets[:-1], np.maximum(n - 2, 0)) if piece.rows > 1 else (slice(0, max(len(data) - 2, 0)), None)
    code = (data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16))[at] if len(data) > 2 else np.zeros(0, dtype=np.uint32)
    triples = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)
    ends = lambda counts: np.concatenate([[0], np.cumsum(counts)])
    return [
        ((hashes >> _U(64 - WORD_BITS)).astype(np.int64) + GROUPS[0], words.offsets),
        ((mix(pairs) >> _U(64 - PAIR_BITS)).astype(np.int64) + GROUPS[1], ends(pair_counts)),
        (triples.astype(np.int64) + GROUPS[2], ends(np.maximum(n - 2, 0))),
    ]


def _score(weights: np.ndarray, bias: float, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    total = np.full(len(parts[0][1]) - 1, bias)
    for at, offsets in parts:
        total += segment_sums(weights[at], offsets) / np.maximum(np.diff(offsets), 1)
    return total


def _sparse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, good, text) to (mark, good, at, share): at most one entry a bucket, however long the text."""
    for batch in batches:
        for piece in slices(batch.column(2), 1):
            parts = _features(piece, piece.words(SPACE_WORDS))
            at, share = [], []
            for index, offsets in parts:
                found, count = np.unique(index, return_counts=True)
                at.append(found)
                share.append(count / max(len(index), 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(piece.first, 1),
                    batch.column(1).slice(piece.first, 1),
                    pa.array([np.concatenate(at).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([np.concatenate(share).astype(np.float32)], pa.list_(pa.float32())),
                ],
                names=["mark", "good", "at", "share"],
            )


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _score(self.weights, self.bias, parts) + self.shift, -30, 30)))


def _platt(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the held-back scores, by damped Newton steps."""
    n_good, n_bad = good.sum(), (~good).sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([scores, np.ones_like(scores)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        grad = x @ (weight * (p - target)) + 1e-3 * (ab - [1, 0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab = ab - step / max(1.0, np.abs(step).max())
    return float(max(ab[0], 1e-3)), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 60) -> QualityModel | None:
    """A model from at most ``sample`` labelled rows of each class; None if a class has none."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") > 0).alias("good")).where("_id is not null and good is not null")
    known = known.groupBy("_id").agg(F.min("good").alias("good"))
    order = [F.xxhash64("_id", F.lit(11)), "_id"]
    picked = known.where("good").orderBy(*order).limit(sample).union(known.where("not good").orderBy(*order).limit(sample))  # two bounded sets of ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("_id", "good").agg(F.max("text").alias("text"))
    text = text.select(F.xxhash64("_id", F.lit(12)).alias("mark"), "good", "text")
    table = text.mapInArrow(_sparse_batches, "mark long, good boolean, at array<int>, share array<float>").toArrow()
    table = table.take(np.argsort(table["mark"].to_numpy(), kind="stable"))
    good = np.array(table["good"].to_pylist(), dtype=bool)
    if not good.any() or good.all():
        return None
    held = np.mod(table["mark"].to_numpy(), 5) == 0
    if not (good[held].any() and (~good[held]).any() and good[~held].any() and (~good[~held]).any()):
        held = np.zeros(len(good), dtype=bool)
    at, share = table["at"].combine_chunks(), table["share"].combine_chunks()
    offsets, at, share = at.offsets.to_numpy(), at.values.to_numpy(), share.values.to_numpy().astype(np.float64)
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(good)), np.diff(offsets))
    learn = ~held if held.any() else ~np.zeros(len(good), dtype=bool)
    balance = np.where(good, 0.5 / max(good[learn].sum(), 1), 0.5 / max((~good[learn]).sum(), 1)) * learn
    weights, bias = np.zeros(GROUPS[-1]), 0.0
    speed, bias_speed = np.full(GROUPS[-1], 1e-8), 1e-8
    score = lambda: segment_sums(share * weights[at], offsets) + bias
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(score(), -30, 30)))
        residual = balance * (p - good)
        grad = np.bincount(at, weights=share * residual[row], minlength=GROUPS[-1]) + 1e-7 * weights
        speed += grad**2
        bias_speed += residual.sum() ** 2
        weights -= 1.0 * grad / np.sqrt(speed)
        bias -= 0.1 * residual.sum() / np.sqrt(bias_speed)
    use = held if held.any() else learn
    weight = np.where(good, 0.5 / max(good[use].sum(), 1), 0.5 / max((~good[use]).sum(), 1))[use] * use.sum()
    slope, shift = _platt(score()[use], good[use], weight)
    return QualityModel(weights.astype(np.float32), bias, slope, shift)


def _repeats(words: Words, size: int = 5) -> np.ndarray:
    """Words of each row that lie in windows found twice or more in the row."""
    first, windows = words.windows(words.hashes(fold=False), size)
    row = np.searchsorted(words.offsets, first, side="right") - 1
    keys = mix(windows + row.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    keys = keys[order]
    again = np.zeros(len(keys), dtype=bool)
    same = keys[1:] == keys[:-1]
    again[1:] = same
    again[:-1] |= same
    edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(edge, first[order[again]], 1)
    np.add.at(edge, first[order[again]] + size, -1)
    return segment_sums(np.cumsum(edge)[:-1] > 0, words.offsets)


def _dup_lines(piece: TextSlice, words: Words) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier line of the row."""
    breaks = np.flatnonzero(piece.data == 10)
    of = np.searchsorted(piece.offsets, breaks, side="right") - 1
    begins = np.concatenate([piece.offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(piece.rows), of])
    order = np.lexsort((begins, row))
    begins, row = begins[order], row[order]
    ends = np.append(begins[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    ends[last] = piece.offsets[row[last] + 1]
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends, row = begins[full], ends[full], row[full]
    keys = piece.range_hash(piece.prefix_hash(fold=False), begins, ends)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    again = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=piece.rows)


_JUDGED = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_good double"


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.value
        for batch in batches:
            for piece in slices(batch.column(2)):
                words = piece.words(SPACE_WORDS)
                heads = (piece.data & 0xC0) != 0x80
                in_words = heads & SPACE_WORDS[piece.data]
                p = pa.nulls(piece.rows, pa.float64()) if found is None else pa.array(found.probability(_features(piece, words)))
                numbers = [words.counts, segment_sums(in_words, piece.offsets), segment_sums(_SYMBOLS[piece.data], piece.offsets), _dup_lines(piece, words), _repeats(words)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(piece.first, piece.rows) for k in (0, 1)), *(pa.array(x.astype(np.int64)) for x in numbers), p],
                    names=["doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p_good"],
                )

    return run


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good, text_hash), a row per row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    judged = text.mapInArrow(_judge(model), _JUDGED)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (F.coalesce("p_good", F.lit(1.0)) >= keep_from)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "p_good", "text_hash")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` without the rows that the rules or the model reject; all columns stay.

    The text is judged once more beside the row it belongs to, so no join and no shuffle is needed.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            blank = pa.nulls(batch.num_rows, pa.int64())
            keep = []
            for x in _judge(model)(iter([pa.RecordBatch.from_arrays([blank, blank, text], names=["doc_id", "text_hash", "text"])])):
                n, repeated = x.column(2).to_numpy(), x.column(6).to_numpy()
                p = x.column(7).fill_null(1.0).to_numpy()
                keep.append((n >= MIN_WORDS) & (100 * repeated <= MAX_REPEAT_PERCENT * n) & (p >= keep_from))
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
