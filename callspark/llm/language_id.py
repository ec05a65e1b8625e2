"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the sequences of two, three and four bytes inside a word (case of A-Z folded, every byte that is
not a letter or beyond ASCII read as a word edge, edges included). Their hashed embeddings are averaged and
a linear softmax reads the average. Stochastic gradient descent in numpy fits both on chunks of at most
``chunk_words`` words and CHUNK_BYTES bytes of a bounded, hash-chosen sample of labelled rows (about ``sample_docs`` a language,
at most DOC_CHUNKS chunks of each, from all over the text). Every language is learned, from an equal share of ``max_chunks`` or
LEAST_CHUNKS, whichever is more, so the driver holds max(max_chunks, LEAST_CHUNKS x languages) chunks at most. A tenth of the chunks is held back: a temperature is
fitted there, and the rejection level is the lowest score from which the answers are right in
``target_precision`` of the cases. As the average and the softmax are linear, executors get one table
of subword scores; with more languages than embedding dimensions they get the embeddings and the softmax instead, which is smaller.

Cases: text that is null or without a letter gets ``und`` and score 0. A null doc_id counts as the empty
string in the held-out rule, so it is held out. Rows without a language are never learned from. If no row
can be learned from, all texts get ``und``. With one language, that is the answer with score 1. Repeated rows
are answered each on its own; of languages that tie, the first by name is the answer. A very long text is scored whole, in one
pass over its bytes. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callspark.llm.textbytes import SPACE_WORDS, TextSlice, mix, ragged_positions, segment_sums, slices

BITS = 16
DIM = 16
SIZES = (2, 3, 4)
SAMPLE_DOCS = 600
MAX_CHUNKS = 8000
CHUNK_WORDS = 32
CHUNK_BYTES = 512
#: Chunks of one document, and of one language at least.
DOC_CHUNKS, LEAST_CHUNKS = 64, 20
#: Steps of descent at least (or 20 a language).
LEAST_STEPS = 300
UNKNOWN = "und"
_FOLD = np.zeros(256, dtype=np.uint32)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[65:91] = np.arange(1, 27)
_FOLD[128:] = np.arange(27, 155)


def subwords(data: np.ndarray) -> np.ndarray:
    """(len(data), 3) bucket of the subword of each size that begins at each byte; bucket 0 is none."""
    code = np.zeros(len(data) + 3, dtype=np.uint32)
    code[: len(data)] = _FOLD[data]
    n = len(data)
    out = np.zeros((n, len(SIZES)), dtype=np.int32)
    total = code[:n].copy()
    inner = np.ones(n, dtype=bool)
    for k in range(1, max(SIZES)):
        total = total * np.uint32(157) + code[k : n + k]
        if k > 1:
            inner &= code[k - 1 : n + k - 1] > 0
        if k + 1 in SIZES:
            mixed = (total + np.uint32(k)) * np.uint32(0x9E3779B1)
            bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            real = inner & ((code[:n] > 0) | (code[1 : n + 1] > 0)) & ((code[:n] > 0) | (code[k : n + k] > 0) | (k > 1))
            out[:, SIZES.index(k + 1)] = np.where(real, np.maximum(bucket, 1), 0)
    return out


class LanguageModel:
    """``table`` has the scores of each subword for each language (or its embedding, which ``out`` turns into scores), ``bias`` those of an empty text."""

    def __init__(self, names: list[str], table: np.ndarray, out: np.ndarray | None, bias: np.ndarray, temperature: float, accept_from: float):
        self.names, self.table, self.out, self.bias, self.temperature, self.accept_from = names, table, out, bias, temperature, accept_from

    def probabilities(self, piece: TextSlice) -> np.ndarray:
        buckets = subwords(piece.data)
        buckets[_row_ends(piece)] = 0
        scores, count = np.zeros((piece.rows, self.table.shape[1])), np.zeros(piece.rows)
        for k in range(buckets.shape[1]):
            scores += segment_sums(self.table[buckets[:, k]], piece.offsets)
            count += segment_sums(buckets[:, k] > 0, piece.offsets)
        mean = scores / np.maximum(count, 1)[:, None]
        return _softmax(((mean if self.out is None else mean @ self.out) + self.bias) / self.temperature)


def _row_ends(piece: TextSlice) -> np.ndarray:
    """The last three bytes of each row, whose subwords would run into the next row."""
    ends = piece.offsets[1:, None] - np.arange(1, 4)
    return np.unique(ends[(ends >= piece.offsets[:-1, None])])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _chunks(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(2), 1):
                found = piece.words(SPACE_WORDS)
                cuts = np.append(found.starts[::words], len(piece.data))
                long, _ = ragged_positions(np.zeros(len(cuts) - 1, dtype=np.int64), np.diff(cuts) // CHUNK_BYTES + 1)
                begins = np.repeat(cuts[:-1], np.diff(cuts) // CHUNK_BYTES + 1) + long * CHUNK_BYTES
                ends = np.append(begins[1:], len(piece.data))[: len(begins)]
                some = np.sort(np.argsort(mix(np.arange(len(begins), dtype=np.uint64) + np.uint64(zlib.crc32(piece.data[:4096].tobytes()))), kind="stable")[:DOC_CHUNKS])
                buckets = subwords(piece.data)
                rows = [x[x > 0] for x in (buckets[begins[k] : ends[k]].ravel() for k in some)]
                n = len(rows)
                take = lambda k: batch.column(k).slice(piece.first, 1).take(pa.array(np.zeros(n, dtype=np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take(0), take(1), pa.array(some.astype(np.int64)), pa.array(rows, pa.list_(pa.int32()))], names=["key", "lang", "chunk", "at"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, max_chunks: int = MAX_CHUNKS, chunk_words: int = CHUNK_WORDS, epochs: int = 6, target_precision: float = 0.99) -> LanguageModel | None:
    """A model of the languages in ``docs``, which must hold no row that is to be held out."""
    known = docs.select(F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    names = sorted(r["lang"] for r in counts)
    spark, part = docs.sparkSession, F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30))
    share = spark.createDataFrame([(r["lang"], int(min(1.0, sample_docs / r["count"]) * (1 << 30))) for r in counts], "_lang string, _below long")
    chosen = known.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(part < F.col("_below")).select("key", "lang", "text")
    rows = chosen.mapInArrow(_chunks(chunk_words), "key string, lang string, chunk long, at array<int>").where("size(at) > 0")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key", "chunk"), "key", "chunk"))
    table = rows.withColumn("_place", place).where(F.col("_place") <= max(LEAST_CHUNKS, max_chunks // len(names))).orderBy(F.xxhash64("key", "chunk"), "key", "chunk").drop("_place").toArrow()
    if not table.num_rows:
        return None
    at = table["at"].combine_chunks()
    offsets, flat = at.offsets.to_numpy() - at.offsets.to_numpy()[0], at.values.to_numpy()
    truth = np.searchsorted(names, np.array(table["lang"].to_pylist(), dtype=str))
    return _train(names, flat, offsets, truth, epochs, target_precision)


def _train(names: list[str], flat: np.ndarray, offsets: np.ndarray, truth: np.ndarray, epochs: int, target_precision: float, batch: int = 64) -> LanguageModel:
    rng = np.random.default_rng(0)
    n, classes = len(truth), len(names)
    held = np.arange(n) % 10 == 9
    learn = np.flatnonzero(~held)  # never empty, as the first row isn't held back
    size = np.diff(offsets)
    share = np.bincount(truth[learn], minlength=classes)
    weight = (len(learn) / classes / np.maximum(share, 1))[truth]  # rare languages count as much
    embed = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    epochs = max(epochs, -(-max(LEAST_STEPS, 20 * classes) // -(-len(learn) // batch)))  # few examples are seen more often
    steps = epochs * -(-len(learn) // batch)
    done = 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for k in range(0, len(learn), batch):
            rows = learn[k : k + batch]
            rate = 2.0 * (1 - done / steps)
            done += 1
            where, run = ragged_positions(offsets[rows], size[rows])
            index = flat[where]
            ends = np.concatenate([[0], np.cumsum(size[rows])])
            mean = segment_sums(embed[index], ends) / size[rows][:, None]
            error = _softmax(mean @ out + bias)
            error[np.arange(len(rows)), truth[rows]] -= 1
            error *= np.minimum(weight[rows], 10.0)[:, None] / len(rows)
            back = (error @ out.T / size[rows][:, None]).astype(np.float32)
            out -= rate * (mean.T @ error).astype(np.float32)
            bias -= 0.1 * rate * error.sum(axis=0).astype(np.float32)
            np.add.at(embed, index, -rate * 50 * back[run])
    embed[0] = 0
    table = embed @ out if classes <= DIM else embed
    test = np.flatnonzero(held) if held.any() else np.arange(n)
    where, _ = ragged_positions(offsets[test], size[test])
    scores = segment_sums(table[flat[where]], np.concatenate([[0], np.cumsum(size[test])])) / size[test][:, None]
    scores = (scores if classes <= DIM else scores @ out) + bias
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(test)), truth[test]], 1e-12)).mean())
    sure = _softmax(scores / temperature)
    order = np.argsort(-sure.max(axis=1))
    right = (sure.argmax(axis=1) == truth[test])[order]
    good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= target_precision)
    accept_from = float(sure.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(names, table.astype(np.float32), None if classes <= DIM else out, bias.astype(np.float64), float(temperature), accept_from)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.value
        for batch in batches:
            for piece in slices(batch.column(2)):
                letters = pc.fill_null(pc.match_substring_regex(batch.column(2).slice(piece.first, piece.rows), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if found is None:
                    names, score, sure = np.full(piece.rows, UNKNOWN, dtype=object), np.zeros(piece.rows), np.zeros(piece.rows, dtype=bool)
                else:
                    p = found.probabilities(piece)
                    best = p.argmax(axis=1)
                    score = np.where(letters, np.minimum(p[np.arange(len(best)), best], 1.0), 0.0)
                    names = np.where(letters, np.array(found.names, dtype=object)[best], UNKNOWN)
                    sure = letters & (score >= found.accept_from)
                ids = [batch.column(k).slice(piece.first, piece.rows) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(names, pa.string()), pa.array(score), pa.array(sure)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def identify_language(docs: DataFrame, held_out_of: int = 5, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), a row per row of ``docs`` (doc_id, text, lang).

    Rows with crc32(doc_id as text) mod ``held_out_of`` = 0 are never learned from. ``accepted`` is false
    where the calibrated score is below the rejection level.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(held_out_of)) == 0
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held), **options))
    text = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    return text.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
