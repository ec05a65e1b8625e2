"""Token ids of texts from a public vocabulary file, in Arrow batches.

Most tokenizers read a text at once. ``word_bpe`` vocabularies drop white space, fold case and break a text
at every change between ASCII letters or digits and plain punctuation, so a text's ids are its parts'
ids joined. There, each distinct part is read once and kept in a bounded table of the worker process,
keyed by two 64-bit hashes.
"""

from __future__ import annotations

import json
import os

import numpy as np

from callspark.llm.textbytes import SPACE_WORDS, TextSlice, mix, ragged_positions

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_U = np.uint64
SLICE_BYTES = 1 << 20
#: Parts that a worker keeps; beyond it the table starts anew. About 40 bytes each.
TABLE_PARTS = 1_500_000
_MARK = b"<|endoftext|>"
_ALNUM, _PUNCT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT[[ord(c) for c in '.,!?;:()"-']] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TokenReader:
    """Reads slices of texts into ids with the vocabulary file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_part = "</w>" == spec["model"].get("end_of_word_suffix") and self.tokenizer.token_to_id(_MARK.decode()) is not None and "Lowercase" in str(spec.get("normalizer")) and "\\s+" in str(spec.get("normalizer"))
        self.mark = self.tokenizer.token_to_id(_MARK.decode())
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.begins, self.counts, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def read(self, piece: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, joined, and the rows' offsets in them."""
        if not self.by_part:
            raw, at = piece.data.tobytes(), piece.offsets
            rows = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(at[:-1], at[1:])], add_special_tokens=False)
            counts = np.array([len(x) for x in rows], dtype=np.int64)
            return np.fromiter((i for x in rows for i in x.ids), dtype=np.uint32, count=counts.sum()), np.concatenate([[0], np.cumsum(counts)])
        words = piece.words(SPACE_WORDS)
        cut = np.flatnonzero((_ALNUM[piece.data[:-1]] & _PUNCT[piece.data[1:]]) | (_PUNCT[piece.data[:-1]] & _ALNUM[piece.data[1:]])) + 1
        cut = cut[~np.isin(cut, words.starts)]  # a row may end where the next begins
        starts, ends = np.sort(np.concatenate([words.starts, cut])), np.sort(np.concatenate([words.ends, cut]))
        folded, exact = piece.prefix_hash(fold=True), piece.prefix_hash(fold=False)
        hashes = piece.range_hash(folded, starts, ends)
        # special tokens are spelt with "<|" and told apart by case
        special = np.flatnonzero((piece.data[:-1] == 60) & (piece.data[1:] == 124))
        if len(special):
            of = np.unique(np.searchsorted(starts, special, side="right") - 1)
            hashes[of] = mix(piece.range_hash(exact, starts[of], ends[of]) + _U(1))
        checks = mix(hashes + _first_last(piece.data, starts, ends))
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > TABLE_PARTS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            self._learn(piece, keys[~known], checks[first[~known]], starts[first[~known]], ends[first[~known]])
            at = np.searchsorted(self.keys, keys)
        if (self.checks[at] != checks[first]).any():
            raise ValueError("two different words have one 64-bit hash")
        place = at[back]
        counts = self.counts[place]
        flat, _ = ragged_positions(self.begins[place], counts)
        totals = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[flat], totals[np.searchsorted(starts, piece.offsets)]

    def _learn(self, piece: TextSlice, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw, ids, counts = piece.data.tobytes(), [], np.zeros(len(keys), dtype=np.int64)
        plain = np.ones(len(keys), dtype=bool)
        parts = [raw[a:b] for a, b in zip(starts, ends)]
        for k, part in enumerate(parts):
            plain[k] = b"<|" not in part
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain = int(plain.sum())
        for k in range(0, n_plain, 500):
            group = order[k : min(k + 500, n_plain)]
            got = np.array(self.tokenizer.encode((_MARK.join(parts[i] for i in group) + _MARK).decode(), add_special_tokens=False).ids, dtype=np.uint32)
            stops = np.flatnonzero(got == self.mark)
            counts[group] = np.diff(np.concatenate([[-1], stops])) - 1
            ids.append(got[got != self.mark])
        for k in order[n_plain:]:
            got = np.array(self.tokenizer.encode(parts[k].decode(), add_special_tokens=False).ids, dtype=np.uint32)
            counts[k] = len(got)
            ids.append(got)
        begins = np.empty(len(keys), dtype=np.int64)
        begins[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *ids])
        keys, checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        begins, counts = np.concatenate([self.begins, begins]), np.concatenate([self.counts, counts])
        sort = np.argsort(keys)
        self.keys, self.checks, self.begins, self.counts = keys[sort], checks[sort], begins[sort], counts[sort]


_CODES = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]


def _first_last(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second, order-free hash of each part: length and the sum of its bytes' codes."""
    total = np.concatenate([[_U(0)], np.cumsum(_CODES[data] * (_CODES[data] >> _U(7)), dtype=np.uint64)])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


_readers: dict[str, TokenReader] = {}


def reader(path: str) -> TokenReader:
    """The reader of this worker process for the file at ``path``."""
    if path not in _readers:
        _readers[path] = TokenReader(path)
    return _readers[path]
