"""Removal of passages that an earlier document has, by prefix-partitioned suffix trees over words.

Method. A suffix is the text from one word on, cut at ``window`` words. Suffixes are divided by variable-length prefixes:
the words at its start, as few as are needed so that no more than a bounded number of suffixes have them (counted over
all suffixes, level by level); a prefix that is still heavier at ``window`` words is one repeated passage, dealt out in slices that all get
its first occurrence as a leaf. Each group of prefixes is one subtree in the memory of a task: its sorted suffixes, of
which those that agree in all words hang below one deep internal node. A node's first occurrence is that of the smallest
doc_id; all its leaves of larger ids are repeats. Repeats that follow each other, in the text and in the first occurrence
(suffix links), are one maximal repeat.

Scale. Equal texts are one text, whose smallest id counts; the others are repeats as a whole. Only suffixes that can
have a partner are made: of the 6-word grams in a window the one with the smallest hash is its anchor, equal windows have equal
anchors, and windows go whose anchor is in one text only. What is left is written as passages; suffixes leave a task as
compressed blocks, one a bin and flush. The plan of heavy prefixes is all that is broadcast, at most PLAN_ROWS hashes a
level. Texts are shuffled twice, by their hash, and no pairs are made.

Cases: null, empty and short texts (fewer words than a window) lose nothing. Equal doc_ids aren't smaller than each
other: rows that repeat an id keep what only they share. A null doc_id counts as the largest. Of ties in the smallest id the first place
in a text counts. Very long texts are one row each, and their windows are dealt out like all others. An empty table
gives no rows. Extra columns are kept by ``drop_repeated_passages`` and otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callspark.llm.ordering import runs
from callspark.llm.staging import Stage
from callspark.llm.textbytes import SPACE_WORDS, mix, ragged_positions, slices, window_hash

_U = np.uint64
WINDOW = 13
#: Words of the grams from which a window's anchor is chosen.
GRAM = 6
#: Suffixes that a bin, the work of one task at a time, should have at most.
BIN = 400_000
#: Heavy prefixes of one length that a plan has at most.
PLAN_ROWS = 4_000_000
#: Bytes of suffixes that a task gathers before it sends them on.
FLUSH_BYTES = 48_000_000
_MAX_ID = 2**63 - 1


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    out = values[: max(len(values) - size + 1, 0)].copy()
    for k in range(1, size):
        np.minimum(out, values[k : k + len(out)], out=out)
    return out


def _anchors(words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of each window of a slice."""
    hashes = words.hashes(fold=False)
    first, _ = ragged_positions(words.offsets[:-1], np.maximum(words.counts - window + 1, 0))
    grams = window_hash(hashes, np.arange(max(len(hashes) - gram + 1, 0)), gram)
    return first, _sliding_min(grams, window - gram + 1)[first].astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, text): 128 bits of hash stand for a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_MAX_ID)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def _list_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(2)):
                words = piece.words(SPACE_WORDS)
                first, anchor = _anchors(words, window, gram)
                row = np.searchsorted(words.offsets, first, side="right") - 1
                new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))[: len(first)])
                at = pa.array(row[new] + piece.first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), batch.column(0).take(at), batch.column(1).take(at)], names=["anchor", "h1", "h2"])

    return run


_PASSAGES = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("words", pa.string())])


def _cut_passages(window: int, gram: int):
    """Runs of windows whose anchor is shared, as the words that they cover; ``n`` windows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(4)
            for piece in slices(batch.column(3)):
                words = piece.words(SPACE_WORDS)
                first, anchor = _anchors(words, window, gram)
                row = np.searchsorted(words.offsets, first, side="right") - 1
                own = shared.slice(piece.first, piece.rows)
                of, values = np.repeat(np.arange(piece.rows), pc.list_value_length(own).to_numpy(zero_copy_only=False)), own.flatten().to_numpy()
                wanted = np.unique(mix(values.view(_U) + mix(of.astype(_U))))
                live = np.isin(mix(anchor.view(_U) + mix(row.astype(_U))), wanted)
                joins = np.append(False, live[1:] & live[:-1] & (row[1:] == row[:-1]))[: len(first)]
                begin = np.flatnonzero(live & ~joins)
                end = np.flatnonzero(live & ~np.append(joins[1:], False)[: len(first)])
                if not len(begin):
                    continue
                text = []
                for a, b in zip(first[begin], first[end] + window):
                    data = piece.data[words.starts[a] : words.ends[b - 1]].tobytes()
                    text.append(b" ".join(data.split()))
                at = pa.array(row[begin] + piece.first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(3)), pa.array(first[begin] - words.offsets[row[begin]]), pa.array(end - begin + 1), pa.array(text, pa.binary()).cast(pa.string())], schema=_PASSAGES
                )

    return run


class _Suffixes:
    """The suffixes of a slice of passages: their first words, rows, and hashes of prefixes."""

    def __init__(self, piece, window: int):
        self.words = piece.words(SPACE_WORDS)
        self.hashes = self.words.hashes(fold=False)
        self.first, self.row = ragged_positions(self.words.offsets[:-1], np.maximum(self.words.counts - window + 1, 0))
        self.window = window

    def prefix(self, at: np.ndarray, size: int) -> np.ndarray:
        return window_hash(self.hashes, self.first[at], size)

    def place(self) -> np.ndarray:
        """Each suffix's count of windows from the passage's start."""
        return self.first - self.words.offsets[self.row]

    def texts(self, at: np.ndarray) -> pa.Array:
        begin = self.words.starts[self.first[at]]
        size = self.words.ends[self.first[at] + self.window - 1] - begin
        spread, _ = ragged_positions(begin, size)
        offsets = np.concatenate([[0], np.cumsum(size)])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.words.piece.data[spread]))


def _levels(window: int) -> list[int]:
    return [*(k for k in (1, 2, 3, 4, 6, 9) if k < window), window]


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _count_prefixes(plan, level: int, window: int):
    """Suffixes of each prefix of a level, of those whose shorter prefixes are all heavy, with the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = plan.value
        for batch in batches:
            ids, first = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for piece in slices(batch.column(5)):
                found = _Suffixes(piece, window)
                at = np.arange(len(found.first))
                for size in _levels(window)[:level]:
                    at = at[_in_sorted(found.prefix(at, size), heavy[size][0])]
                own = found.row[at] + piece.first
                place = first[own] + found.place()[at]
                value = found.prefix(at, _levels(window)[level])
                order = np.lexsort((place, ids[own], value))
                values, where, count = np.unique(value[order], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count), pa.array(ids[own][order][where]), pa.array(place[order][where])], names=["prefix", "n", "id", "place"])

    return run


def _prefix_plan(spark, passages: DataFrame, limit: int, window: int):
    """Broadcast: for each length, the sorted hashes of prefixes with more than ``limit`` suffixes, their counts and first occurrences."""
    levels, heavy = _levels(window), {}
    for level, size in enumerate(levels):
        plan = spark.sparkContext.broadcast(heavy)
        counted = passages.mapInArrow(_count_prefixes(plan, level, window), "prefix long, n long, id long, place long").groupBy("prefix").agg(F.sum("n").alias("n"), F.min(F.struct("id", "place")).alias("origin"))
        rows = counted.where(F.col("n") > limit).select("prefix", "n", "origin.id", "origin.place").toArrow()
        columns = [c.combine_chunks().to_numpy() for c in rows.columns]
        order = np.argsort(columns[0].view(_U))
        heavy = heavy | {size: (columns[0].view(_U)[order], *(c[order] for c in columns[1:]))}
        if not len(order):
            break
    empty = (np.zeros(0, dtype=_U), *(np.zeros(0, dtype=np.int64) for _ in range(3)))
    return spark.sparkContext.broadcast({size: heavy.get(size, empty) for size in levels})


_LEAVES = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("place", pa.int64()), ("words", pa.large_string())])


def _deal(plan, bins: int, limit: int, window: int):
    """Suffixes by bin of their prefix group, as compressed blocks."""

    def groups(found: _Suffixes, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each suffix's group, and where its whole window is heavy, the place of that in the plan (else -1)."""
        group, hot = np.zeros(len(found.first), dtype=_U), np.full(len(found.first), -1)
        at = np.arange(len(found.first))
        for size in _levels(window):
            value, table = found.prefix(at, size), plan.value[size]
            heavy = _in_sorted(value, table[0])
            group[at[~heavy]] = mix(value[~heavy] + _U(size))
            at, value = at[heavy], value[heavy]
        if len(at):  # one passage of window words: slices
            hot[at] = np.searchsorted(plan.value[window][0], value)
            n_slices = -(-plan.value[window][1][hot[at]] // limit)
            group[at] = mix(value + mix(spread[at] % n_slices.astype(_U)))
        return group, hot

    def blocks(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        table = table.take(pc.sort_indices(table["bin"])).combine_chunks()
        bin_ = table["bin"].to_numpy()
        edges = np.flatnonzero(np.append(True, bin_[1:] != bin_[:-1]))
        names, out = bin_[edges], []
        for a, b in zip(edges, np.append(edges[1:], len(bin_))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _LEAVES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.select(_LEAVES.names).slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(out, pa.binary())], names=["bin", "leaves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids, h1, h2, first = (batch.column(k).to_numpy() for k in range(4))
            for piece in slices(batch.column(5), 1 << 18):
                found = _Suffixes(piece, window)
                own = found.row + piece.first
                group, hot = groups(found, mix(h1[own].view(_U)))
                bin_ = (group % _U(bins)).astype(np.int64)
                columns = [bin_, ids[own], h1[own], h2[own], first[own] + found.place()]
                seen = np.flatnonzero(hot >= 0)
                if len(seen):  # the first occurrence of a sliced passage is a leaf of each slice; its place is given as -1 - place
                    _, one = np.unique(np.stack([group[seen], hot[seen].astype(_U)]), axis=1, return_index=True)
                    seen = seen[one]
                    origin = [x[hot[seen]] for x in plan.value[window][2:]]
                    more = [bin_[seen], origin[0], np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64), -1 - origin[1]]
                    columns = [np.concatenate(x) for x in zip(columns, more)]
                texts = found.texts(np.concatenate([np.arange(len(own)), seen]))
                parts.append(pa.table([pa.array(c) for c in columns] + [texts], names=["bin", *_LEAVES.names]))
                size += texts.nbytes + 40 * len(own)
                if size >= FLUSH_BYTES:
                    yield from blocks(parts)
                    parts, size = [], 0
        if parts:
            yield from blocks(parts)

    return run


_REPEATS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("place", pa.int64()), ("of_id", pa.int64()), ("of_place", pa.int64())])


def deep_nodes(leaves: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of a subtree's deep internal nodes the leaves that repeat the node's first occurrence."""
    leaves = leaves.take(pc.sort_indices(leaves["words"])).combine_chunks()
    text = leaves["words"].combine_chunks()
    same = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False) if len(text) > 1 else np.zeros(0, dtype=bool)
    node = np.cumsum(np.append(True, ~same)) - 1
    deep = np.append(same, False) | np.append(False, same)
    id_, h1, h2, place = (leaves[c].to_numpy()[deep] for c in _LEAVES.names[:4])
    node = node[deep]
    if not len(node):
        return
    real = np.where(place < 0, -1 - place, place)
    order = np.lexsort((real, id_, node))
    begin = np.flatnonzero(np.append(True, np.diff(node[order]) > 0))
    size = np.diff(np.append(begin, len(order)))
    of_id, of_place = (np.repeat(x[order][begin], size) for x in (id_, real))
    keep = (id_[order] > of_id) & (place[order] >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[order][keep], h2[order][keep], place[order][keep], of_id[keep], of_place[keep])], schema=_REPEATS)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, ["bin"]):
        yield from deep_nodes(pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in run["leaves"]).combine_chunks())


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("of_id", pa.int64()), ("of_first", pa.int64())])
_SPANS = "h1 long, h2 long, spans array<struct<first:long,last:long,of_id:long,of_first:long>>"


def _link(window: int):
    """Repeats of a text, in order, joined along suffix links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for text in runs(batches, ["h1", "h2"]):
            place, of_id, of_place = (text[c].to_numpy() for c in _REPEATS.names[2:])
            new = np.append(True, (np.diff(place) != 1) | (np.diff(of_id) != 0) | (np.diff(of_place) != 1))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(place)) - 1
            rows.append((text["h1"][0].as_py(), text["h2"][0].as_py(), [dict(zip(_SPAN.names, x)) for x in zip(place[begin].tolist(), (place[end] + window).tolist(), of_id[begin].tolist(), of_place[begin].tolist())]))
            if len(rows) >= 500:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        a, b, spans = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(spans, pa.list_(_SPAN))], names=["h1", "h2", "spans"])

    return run


def _repeats(stage: Stage, texts: DataFrame, window: int, gram: int, bin_size: int, plan_rows: int) -> DataFrame:
    """(h1, h2, spans) of each distinct text that repeats another one's words."""
    spark = texts.sparkSession
    listed = texts.select("h1", "h2", "text").mapInArrow(_list_anchors(window, gram), "anchor long, h1 long, h2 long")
    shared = listed.groupBy("anchor").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select(F.col("anchor").alias("_anchor"))
    shared = stage.write(shared, "shared")
    stage.drop()
    marks = listed.join(shared.hint("merge"), F.col("anchor") == F.col("_anchor"), "left_semi").groupBy("h1", "h2").agg(F.collect_set("anchor").alias("anchors"))
    marks = stage.write(marks, "marks")
    stage.drop(shared)
    once = texts.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    marked = once.join(marks.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "anchors").hint("merge"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    passages = marked.select("id", "h1", "h2", "text", "anchors").mapInArrow(_cut_passages(window, gram), "id long, h1 long, h2 long, first long, n long, words string")
    passages = stage.write(passages, "passages", suffixes=F.coalesce(F.sum("n"), F.lit(0)))
    stage.drop(marks)

    suffixes = stage.counted(passages)["suffixes"]
    bins = max(1, -(-2 * suffixes // bin_size), min(-(-suffixes // 10_000), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    limit = max(8, suffixes // (4 * bins), suffixes // plan_rows)
    plan = _prefix_plan(spark, passages, limit, window)
    stage.drop()
    dealt = passages.mapInArrow(_deal(plan, bins, limit, window), "bin long, leaves binary").repartition(bins, "bin").sortWithinPartitions("bin")
    repeats = stage.write(dealt.mapInArrow(_grow, "h1 long, h2 long, place long, of_id long, of_place long"), "repeats")
    stage.drop(passages)
    linked = repeats.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "place").mapInArrow(_link(window), _SPANS)
    spans = stage.write(linked, "spans")
    stage.drop(repeats)
    return spans


def _remove(whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, least, found = (batch.column(k).to_pylist() for k in range(1, 5))
            counts, gone, kept, spans = [], [], [], []
            for id_, text, low, own in zip(ids, texts, least, found):
                words = (text or "").encode().split()
                if low is not None and low < id_ and len(words) >= whole:
                    own = [{"first": 0, "last": len(words), "of_id": low, "of_first": 0}]
                own = own or []
                if own:
                    stay = bytearray(b"\x01") * len(words)
                    for span in own:
                        stay[span["first"] : span["last"]] = bytes(span["last"] - span["first"])
                    left = [w for w, s in zip(words, stay) if s]
                else:
                    left = words
                counts.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                spans.append(own)
            data = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays(data, names=["carried", "n_words", "n_removed", "kept", "spans"])

    return run


def _without_repeats(docs: DataFrame, carried: Column, window: int = WINDOW, gram: int = GRAM, bin_size: int = BIN, plan_rows: int = PLAN_ROWS) -> DataFrame:
    """(carried, n_words, n_removed, kept, spans), a row per row of ``docs``."""
    stage, texts = Stage(docs.sparkSession, "repeats"), _texts(docs)
    spans = _repeats(stage, texts, window, gram, bin_size, plan_rows)
    copies = texts.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h1", "h2", "least")
    facts = copies.unionByName(spans, allowMissingColumns=True).groupBy("h1", "h2").agg(F.min("least").alias("least"), F.first("spans", ignorenulls=True).alias("spans"))
    facts = stage.write(facts, "facts")
    stage.drop(spans)
    side = facts.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "least", "spans").hint("merge")
    rows = docs.select(carried.alias("carried"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_MAX_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    joined = rows.join(side, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left").select("carried", "id", "text", "least", "spans")
    schema = T.StructType([joined.schema["carried"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string").add("spans", spans.schema["spans"].dataType)
    return joined.mapInArrow(_remove(window), schema)


def repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans), a row per row of ``docs``.

    ``spans`` are the maximal repeats: words ``first`` to ``last`` (exclusive) stand in document ``of_id`` from word
    ``of_first`` on; spans may overlap. ``kept`` are the words in no span, joined by one space.
    """
    out = _without_repeats(docs, F.col("doc_id").cast("long"), **options)
    return out.withColumnRenamed("carried", "doc_id")


def drop_repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept words as text where something is removed; all other columns and texts stay."""
    names = docs.columns
    out = _without_repeats(docs, F.struct(*(F.col(f"`{c}`") for c in names)), **options)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast(docs.schema["text"].dataType)).otherwise(F.col("carried.text"))
    return out.select(*((text if c == "text" else F.col(f"carried.`{c}`")).alias(c) for c in names))
