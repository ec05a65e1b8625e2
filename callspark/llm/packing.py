"""Packing of tokenised documents into sequences: best-fit-decreasing matrices, and sum-of-squares online.

Both work inside the partitions that the scan gives, on a bounded number of tokens at a time, so nothing is
shuffled and memory doesn't grow with the input. Sequence ids are the partition's number times 2^33 plus a
count. The same partition read again gives the same sequences.

Cases: a null or empty text is the end id alone. A text of any length is cut without loss. Rows that
repeat a doc_id, or have none, are documents of their own. Extra columns are ignored; an empty table gives
no sequence. Ties of best-fit-decreasing: documents of one length go in the order of the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callspark.llm.textbytes import ragged_positions, slices
from callspark.llm.tokens import SLICE_BYTES, default_vocabulary, reader

#: Tokens that best-fit-decreasing sorts and packs at once.
BLOCK_TOKENS = 1 << 22
#: Windows that the online packer holds open at once; beyond, the fullest is closed.
MAX_OPEN = 1024


def _with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by ``end_id``."""
    to = offsets + np.arange(len(offsets))
    out = np.full(to[-1], end_id, dtype=np.uint32)
    at, run = ragged_positions(offsets[:-1], np.diff(offsets))
    out[at + run] = ids[at]
    return out, to


def _documents(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for piece in slices(batch.column(1), SLICE_BYTES):
            ids, offsets = _with_end(*reader(path).read(piece), end_id)
            yield batch.column(0).slice(piece.first, piece.rows).to_pylist(), ids, offsets


class CapacityTree:
    """Open bins by the room they have left; finds the smallest room that is large enough in log steps."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        k = room + self.base
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room of at least ``need``, removed; or None."""
        k = need + self.base
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.base
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Indices of the pieces of each sequence; no length may exceed ``size``."""
    out: list[list[int]] = []
    tree = CapacityTree(size)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.take(need)
        if found is None:
            room, name = size, len(out)
            out.append([])
        else:
            room, name = found
        out[name].append(k)
        if room > need:
            tree.add(room - need, name)
    return out


_MATRIX = "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def _pack_matrix(path: str, size: int, end_id: int, pad_id: int):
    width = np.uint16 if size <= 1 << 16 else np.uint32

    def flush(held: list, base: int) -> pa.RecordBatch:
        """held: (doc_id, ids) of whole documents."""
        starts = [np.arange(0, len(x), size) for _, x in held]
        doc = np.repeat(np.arange(len(held)), [len(x) for x in starts])
        start = np.concatenate(starts)
        length = np.minimum(np.array([len(x) for _, x in held])[doc] - start, size)
        bins = best_fit_decreasing(length, size)
        rows: list[list] = [[] for _ in range(7)]
        for k, pieces in enumerate(bins):
            ids, at = np.full(size, pad_id, dtype=np.uint32), np.zeros(size, dtype=width)
            ends = np.concatenate([[0], np.cumsum(length[pieces])])
            for piece, a, b in zip(pieces, ends[:-1], ends[1:]):
                ids[a:b] = held[doc[piece]][1][start[piece] : start[piece] + b - a]
                at[a:b] = np.arange(b - a, dtype=width)
            kept = ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")
            for column, x in zip(rows, (base + k, int(ends[-1]), kept.tobytes(), at.tobytes(), ends, [held[doc[p]][0] for p in pieces], start[pieces])):
                column.append(x)
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=[x.split()[0] for x in _MATRIX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, tokens = TaskContext.get().partitionId() << 33, [], 0
        for names, ids, offsets in _documents(batches, path, end_id):
            for name, a, b in zip(names, offsets[:-1], offsets[1:]):
                held.append((name, ids[a:b]))
                tokens += int(b - a)
                if tokens >= BLOCK_TOKENS:
                    out = flush(held, base)
                    base, held, tokens = base + out.num_rows, [], 0
                    yield from _chunks(out)
        if held:
            yield from _chunks(flush(held, base))

    return run


def _chunks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def pack_token_matrix(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 49407, pad_id: int = 0) -> DataFrame:
    """Rows of packed id matrices, by best-fit-decreasing over documents cut into pieces of at most ``size``.

    ``ids`` are ``size`` little-endian unsigned integers (16 bits if all fit, else 32: by length of the value), padded
    with ``pad_id``; ``positions`` restart at 0 with each piece (16 bits up to a size of 65,536); ``cu_seqlens`` are the
    cumulative piece lengths from 0; ``doc_ids`` and ``starts`` say which ids of which document a piece holds.
    """
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(_pack_matrix(path or default_vocabulary(), size, end_id, pad_id), _MATRIX)


def write_token_matrix(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet files, rows in sequence order within each file."""
    packed.write.mode("error").parquet(path)


class SumOfSquares:
    """Online packing: a level array counts open windows by fill, and a document goes where the sum of the
    squared counts ends smallest. ``emit`` gets (sequence number, pieces) of each window that closes.

    A piece is (document, start, ids). When more than ``max_open`` windows are open, the fullest is closed: what it
    lacks comes from the emptiest open windows, of which the last is cut and stays open with its rest. So each window
    that closes is full, packing goes on by sums of squares, and a closing cuts one piece at most. ``close`` ends
    all windows in this way and lays the last rest out in sequences of powers of two; nothing is padded.

    Ties: of the fills that end with one sum the largest is taken, and of windows of one fill the latest.
    """

    def __init__(self, size: int, emit: Callable[[list], None], max_open: int = MAX_OPEN):
        self.size, self.emit, self.max_open = size, emit, max_open
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open = 0

    def add(self, doc, ids: np.ndarray) -> None:
        size = self.size
        full = len(ids) // size * size
        for start in range(0, full, size):
            self.emit([(doc, start, ids[start : start + size])])
        need = len(ids) - full
        if not need:
            return
        count = self.level
        at = np.flatnonzero(count[1 : size - need + 1]) + 1
        best, fill = 2 * int(count[need]) + 1, 0
        if len(at):
            to = at + need
            cost = 2 - 2 * count[at] + 2 * count[to]
            cost[to == size] -= 1  # a full window leaves the array
            k = len(at) - 1 - int(cost[::-1].argmin())
            if cost[k] <= best:
                fill = int(at[k])
        window = [] if not fill else self.windows[fill].pop()
        if fill:
            count[fill] -= 1
            self.n_open -= 1
        window.append((doc, full, ids[full:].copy()))  # a view would keep the whole batch
        if fill + need == size:
            self.emit(window)
            return
        self._put(window, fill + need)
        if self.n_open > self.max_open:
            self.emit(self._filled()[0])

    def _put(self, window: list, fill: int) -> None:
        self.windows[fill].append(window)
        self.level[fill] += 1
        self.n_open += 1

    def _take(self, which: int) -> tuple[list, int]:
        """The emptiest (0) or fullest (-1) open window, and its fill."""
        fill = int(np.flatnonzero(self.level)[which])
        self.level[fill] -= 1
        self.n_open -= 1
        return self.windows[fill].pop(), fill

    def _filled(self) -> tuple[list, int]:
        """The fullest open window, filled up from the emptiest ones as far as they go, and its fill."""
        window, fill = self._take(-1)
        while fill < self.size and self.n_open:
            other, held = self._take(0)
            while other and fill < self.size:
                doc, start, ids = other.pop()
                room = self.size - fill
                if len(ids) > room:
                    other.append((doc, start + room, ids[room:]))
                    ids = ids[:room]
                window.append((doc, start, ids))
                fill += len(ids)
                held -= len(ids)
            if other:
                self._put(other, held)
        return window, fill

    def close(self) -> None:
        while self.n_open:
            window, fill = self._filled()
            if fill == self.size:
                self.emit(window)
                continue
            window.reverse()
            while fill:  # the last rest
                room, current = 1 << (fill.bit_length() - 1), []
                fill -= room
                while room:
                    doc, start, ids = window.pop()
                    if len(ids) > room:
                        window.append((doc, start + room, ids[room:]))
                        ids = ids[:room]
                    current.append((doc, start, ids))
                    room -= len(ids)
                self.emit(current)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_online(path: str, size: int, end_id: int):
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rows = TaskContext.get().partitionId() << 33, []

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for (name, total), start, ids in window:
                rows.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        packer = SumOfSquares(size, emit)
        for ids_of, ids, offsets in _documents(batches, path, end_id):
            for name, a, b in zip(ids_of, offsets[:-1].tolist(), offsets[1:].tolist()):
                packer.add((name, b - a), ids[a:b])
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)
                rows.clear()
        packer.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

    return run


def pack_online(docs: DataFrame, size: int = 4096, path: str | None = None, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece of a document in a sequence.

    A document is its ids and ``end_id``. ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian unsigned 32-bit integers.
    """
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(_pack_online(path or default_vocabulary(), size, end_id), _PIECES)
