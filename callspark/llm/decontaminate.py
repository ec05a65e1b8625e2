"""Benchmark decontamination by winnowing.

Method. Of the k-grams of words in each run of ``w`` consecutive k-grams the smallest hash is the
fingerprint, so two texts that share k + w - 1 = 10 consecutive words share the fingerprint there. The
fingerprints of the benchmark's 10-word windows are joined with those of the documents; each hit is extended
to the 10-word windows that chose it, and a window counts if it is a window of an item. Items of fewer words
than ten are one window of their own length and are looked up at every position.

Scale. The benchmark is read in blocks of at most ``block_chars`` characters; a block's index is the only
thing that is broadcast (about 30 bytes a word), and documents stream past it in Arrow batches, without a
shuffle. A larger benchmark takes more passes, whose few hits are merged by document.

Cases: null or wordless texts have no words, no hits and ``contaminated`` false. Rows that repeat a doc_id
are judged each on its own. An item with a null id marks words but isn't counted or listed; repeated item
ids count once. An empty benchmark hits nothing. One item longer than a block is a block of its own. Documents of any length are read whole, in
slices; an empty table gives no row; extra columns are ignored, and stay in ``drop_contaminated``. Windows that
several items share count for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callspark.llm.staging import Stage, packed, unpacked
from callspark.llm.textbytes import ALNUM_WORDS, TextSlice, Words, ragged_positions, slices, window_hash

_U = np.uint64
WINDOW = 10
GRAM = 5
BLOCK_CHARS = 16_000_000
_FILTER_BITS = 22
_ROWS = "doc_id long, text_hash long, n_words long, runs array<struct<first:long,last:long>>, items array<string>"


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of values[i : i + size] for each i that has so many."""
    out = values[: max(len(values) - size + 1, 0)].copy()
    for k in range(1, size):
        np.minimum(out, values[k : k + len(out)], out=out)
    return out


class _Sieve:
    """A sorted set of hashes with a bit table before it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.bits[(self.sorted >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the set, and where they stand in it."""
        maybe = np.flatnonzero(self.bits[(hashes >> _U(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        sure = self.sorted[np.minimum(at, len(self.sorted) - 1)] == hashes[maybe] if len(self.sorted) else np.zeros(0, bool)
        return maybe[sure], at[sure]


class BenchmarkIndex:
    """Windows, fingerprints and the items of each window, of one block of items."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.ids = window, gram, np.array([i if i is not None else "" for i in ids], dtype=object)
        self.named = np.array([i is not None for i in ids], dtype=bool)
        self.windows: dict[int, _Sieve] = {}
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        prints, found = [np.zeros(0, dtype=np.uint64)], {}
        for piece in slices(pa.array(texts, pa.string())):
            words = piece.words(ALNUM_WORDS)
            hashes = words.hashes(fold=True)
            first, windows = words.windows(hashes, window)
            if len(first):
                prints.append(_sliding_min(window_hash(hashes, np.arange(len(hashes) - gram + 1), gram), window - gram + 1)[first])
                found.setdefault(window, []).append((windows, piece.first + np.searchsorted(words.offsets, first, side="right") - 1))
            for short in range(1, window):
                rows = np.flatnonzero(words.counts == short)
                if len(rows):
                    found.setdefault(short, []).append((window_hash(hashes, words.offsets[rows], short), piece.first + rows))
        self.prints = _Sieve(np.concatenate(prints))
        for size, parts in found.items():
            windows, owner = (np.concatenate(x) for x in zip(*parts))
            pairs = np.unique(np.rec.fromarrays([windows, owner], names="w,o"))
            self.windows[size] = _Sieve(pairs.w)
            self.owners[size] = (np.searchsorted(pairs.w, np.append(self.windows[size].sorted, _U(0))), np.array(pairs.o))
            self.owners[size][0][-1] = len(pairs)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, sizes and items of all window occurrences in the rows of a slice."""
        hashes = words.hashes(fold=True)
        out = []
        for size, sieve in self.windows.items():
            first, run = ragged_positions(words.offsets[:-1], np.maximum(words.counts - size + 1, 0))
            if not len(first):
                continue
            if size == self.window:
                grams = window_hash(hashes, np.arange(len(hashes) - self.gram + 1), self.gram)
                prints = _sliding_min(grams, size - self.gram + 1)[first]
                begins = np.flatnonzero(np.append(True, (prints[1:] != prints[:-1]) | (run[1:] != run[:-1])))  # a fingerprint and the windows that chose it
                chosen, _ = self.prints.find(prints[begins])
                reach = np.append(begins, len(first))
                spread, _ = ragged_positions(begins[chosen], reach[chosen + 1] - begins[chosen])
                first = first[spread]
            at, which = sieve.find(window_hash(hashes, first, size))
            begins, owner = self.owners[size]
            item, of = ragged_positions(begins[which], begins[which + 1] - begins[which])
            out.append((first[at][of], np.full(len(of), size), owner[item]))
        if not out:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out))


def _scan(index, hits_only: bool):
    def rows_of(piece: TextSlice, found: BenchmarkIndex):
        words = piece.words(ALNUM_WORDS)
        first, size, item = found.hits(words)
        runs: list = [[] for _ in range(piece.rows)]
        items: list = [[] for _ in range(piece.rows)]
        if len(first):
            edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + size, -1)
            hit = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
            row_of = lambda at: np.searchsorted(words.offsets, at, side="right") - 1
            cut = hit[1:-1] > 0
            starts = np.flatnonzero(cut & ((hit[:-2] == 0) | np.isin(np.arange(len(cut)), words.offsets)))
            ends = np.flatnonzero(cut & ((hit[2:] == 0) | np.isin(np.arange(1, len(cut) + 1), words.offsets)))
            for a, b, row in zip(starts, ends, row_of(starts)):
                runs[row].append({"first": int(a - words.offsets[row]), "last": int(b - words.offsets[row])})
            keep = found.named[item]
            pairs = np.unique(np.stack([row_of(first[keep]), item[keep]]), axis=1)
            for row, k in pairs.T:
                items[row].append(found.ids[k])
        return words.counts, runs, [sorted(set(x)) for x in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
        for batch in batches:
            for piece in slices(batch.column(2)):
                counts, runs, items = rows_of(piece, found)
                ids = [batch.column(k).slice(piece.first, piece.rows) for k in (0, 1)]
                out = pa.RecordBatch.from_arrays(
                    [*ids, pa.array(counts.astype(np.int64)), pa.array(runs, types[3]), pa.array(items, types[4])], names=["doc_id", "text_hash", "n_words", "runs", "items"]
                )
                yield out.filter(pa.array([bool(x) for x in runs])) if hits_only else out

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items, runs), a row per row of ``docs``.

    ``runs`` has the hit words as ranges, ``items`` the ids of the items of which a window occurs, sorted as strings.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct()  # a repeated item is one
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    out, others = None, []
    for k in range(n_blocks):
        block = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        index = spark.sparkContext.broadcast(BenchmarkIndex([r.item_id for r in block], [r.text for r in block], window, gram))
        rows = text.mapInArrow(_scan(index, hits_only=k > 0), _ROWS)
        if k == 0:
            out = rows
        else:
            others.append(rows)
    if others:
        more = others[0]
        for rows in others[1:]:
            more = more.union(rows)
        # rows with one doc_id and text have the same hits in each block
        more = more.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("runs")).alias("more_runs"), F.flatten(F.collect_set("items")).alias("more_items"))
        more = more.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
        out = out.join(more.hint("merge"), out.doc_id.eqNullSafe(F.col("_id")) & (out.text_hash == F.col("_hash")), "left")
        none = F.array().cast("array<string>")
        out = out.withColumn("items", F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", none)))))
        out = out.withColumn("runs", F.coalesce(F.concat("runs", "more_runs"), "runs"))
        hit = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))).cast("long")
    else:
        hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), "items", "runs")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row per row of ``docs``."""
    found = find_contamination(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay."""
    gone = find_contamination(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    stage = Stage(docs.sparkSession, "decontaminate")
    gone = stage.write(gone, "gone")
    same = F.col("at_id").eqNullSafe(F.col("_id")) & (F.col("at_hash") == F.col("_hash"))
    return unpacked(packed(docs).join(stage.side(gone), same, "left_anti"), docs)
