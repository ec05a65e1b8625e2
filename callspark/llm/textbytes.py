"""Arrow text columns as flat byte arrays, and word, window and hash arithmetic on them.

Everything works on UTF-8 bytes of a bounded slice of rows, so that memory follows the slice (or the
one longest text) and not the Arrow batch. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_WINDOW_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED_CODES = _BYTE_CODES.copy()
_FOLDED_CODES[65:91] = _BYTE_CODES[97:123]

#: Word bytes for the pattern [^\x20\x09-\x0D]+
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[32, *range(9, 14)]] = False
#: Word bytes for the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, _U(base))
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if size > 4 * SLICE_BYTES:  # of one very long text: not kept
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


class TextSlice:
    """Rows ``first .. last`` of a batch: their bytes, and where each row's bytes begin and end."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets
        self.rows = last - first

    def words(self, table: np.ndarray) -> Words:
        return Words(self, table)

    def prefix_hash(self, fold: bool) -> np.ndarray:
        """Prefix sums from which the hash of any byte range follows."""
        up, _ = _power_tables(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((_FOLDED_CODES if fold else _BYTE_CODES)[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def range_hash(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = _power_tables(len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a slice: byte ``starts`` and ``ends``, and ``offsets`` of each row's words."""

    def __init__(self, piece: TextSlice, table: np.ndarray):
        self.piece = piece
        inside = np.zeros(len(piece.data) + 2, dtype=bool)
        inside[1:-1] = table[piece.data]
        before, after = inside[:-2].copy(), inside[2:].copy()
        edges = piece.offsets[1:-1]
        before[edges[edges < len(before)]] = False
        after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside[1:-1] & ~before)
        self.ends = np.flatnonzero(inside[1:-1] & ~after) + 1
        self.offsets = np.searchsorted(self.starts, piece.offsets)
        self.counts = np.diff(self.offsets)

    def hashes(self, fold: bool) -> np.ndarray:
        return self.piece.range_hash(self.piece.prefix_hash(fold), self.starts, self.ends)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window of ``size`` consecutive words of a row, and the windows' hashes."""
        first, _ = ragged_positions(self.offsets[:-1], np.maximum(self.counts - size + 1, 0))
        return first, window_hash(hashes, first, size)


def window_hash(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    total = np.full(len(first), _U(size) * _WINDOW_FACTORS[63])
    for k in range(size):
        total += hashes[first + k] * _WINDOW_FACTORS[k % 63]
    return mix(total)


def ragged_positions(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... (``count`` of them) of each run, joined; and the run of each."""
    run = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    return np.arange(len(run)) - begins[run] + starts[run], run


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for each i; 0 for an empty range."""
    shape = (len(offsets) - 1, *values.shape[1:])
    kind = np.int64 if values.dtype == bool else np.result_type(values.dtype, np.float64 if values.dtype.kind == "f" else np.int64)
    out = np.zeros(shape, dtype=kind)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=kind)
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """The rows of a string column in slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield TextSlice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
