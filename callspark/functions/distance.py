"""Edit distance of long texts, exact: furthest places reached on each diagonal while the texts are close, else rows of bits."""

from __future__ import annotations

import numpy as np


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """The edit distance in characters, or -1 if it is over ``most``.

    Common ends are cut. Texts that ``replaced`` settles take time with their length. Close texts of a thousand characters and more (up to a sixteenth of their length changed; a thirty-second below 4,096) take time with the square of their distance,
    not with their length times it; others with the product of their lengths divided by the bits of a word.
    """
    head = _shared(a, b, 0, 0)
    a, b = a[head:], b[head:]
    tail = _shared(a[::-1], b[::-1], 0, 0)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        d = max(len(a), len(b))
    elif (d := replaced(a, b)) is None:
        # a step of the furthest places takes as long as the rows of bits of some thirty characters
        longer = max(len(a), len(b))
        close = 0 if longer < 1_024 else longer // (32 if longer < 4_096 else 16)
        close = close if most is None else min(close, most)
        d = _near(a, b, close) if close else None
        if d is None and (most is None or close < most):
            d = _far(a, b, most)
    return -1 if d is None or most is not None and d > most else d


def replaced(a: str, b: str) -> int | None:
    """The places at which two texts of one length differ, if no character that ``a`` has there is one that ``b`` has at any of them; else None.

    It is the edit distance then: each of those characters is one too many in its text, and an edit takes at most one from either.
    """
    if len(a) != len(b):
        return None
    one, two = _codes(a), _codes(b)
    differ = np.flatnonzero(one != two)
    return None if np.isin(np.unique(one[differ]), two[differ]).any() else len(differ)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _shared(a: str, b: str, i: int, j: int) -> int:
    """How many characters ``a`` from ``i`` and ``b`` from ``j`` share: in steps that double, then halve."""
    n, step, most = 0, 16, min(len(a) - i, len(b) - j)
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = n + step, 2 * step
    n = min(n, most)
    while step:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
        step >>= 1
    return n


def _packed(codes: np.ndarray, sign: int) -> np.ndarray:
    """Four characters from each place as one number; ``sign`` follows the last."""
    long = np.concatenate([codes, np.full(4, sign)]).astype(np.uint64)
    return long[:-3] | long[1:-2] << np.uint64(16) | long[2:-1] << np.uint64(32) | long[3:] << np.uint64(48)


def _near(a: str, b: str, most: int) -> int | None:
    """The distance if it is at most ``most``: with each edit, the furthest place on each diagonal."""
    n, m = len(a), len(b)
    goal = m - n
    signs, codes = np.unique(np.concatenate([_codes(a), _codes(b)]), return_inverse=True)
    if abs(goal) > most or len(signs) > 65_000:
        return None
    one, two = _packed(codes[:n], 65_534), _packed(codes[n:], 65_535)
    reached = np.full(2 * most + 5, -2, dtype=np.int64)
    middle = most + 2
    for edits in range(most + 1):
        low, high = max(-edits, -n, goal - most + edits), min(edits, m, goal + most - edits)
        k = np.arange(low, high + 1)
        if edits:
            at = slice(middle + low, middle + high + 1)
            i = np.maximum(np.maximum(reached[at], reached[middle + low + 1 : middle + high + 2]) + 1, reached[middle + low - 1 : middle + high])
            i = np.minimum(np.minimum(i, n), m - k)
        else:
            i = np.zeros(1, dtype=np.int64)
        going = np.arange(len(i))
        while len(going):
            place = i[going]
            differ = one[place] ^ two[place + k[going]]
            same = differ == 0
            low_bit = differ & (~differ + np.uint64(1))
            i[going] = place + np.where(same, 4, np.log2(np.where(same, np.uint64(1), low_bit).astype(np.float64)).astype(np.int64) // 16)
            going = going[same]
            if 0 < len(going) <= 8:
                for g in going:
                    i[g] += _shared(a, b, int(i[g]), int(i[g] + k[g]))
                break
        reached[middle + low : middle + high + 1] = i
        if low <= goal <= high and reached[middle + goal] >= n:
            return edits
    return None


def _far(a: str, b: str, most: int | None = None) -> int:
    """Myers' and Hyyrö's rows of bits: one addition and a few operations on numbers as wide as the shorter text for each character of the longer.

    Ends as soon as the distance is sure to be over ``most``; what is returned then is over it, too.
    """
    if len(a) < len(b):
        a, b = b, a
    equal: dict[str, int] = {}
    bit = 1
    for c in b:
        equal[c] = equal.get(c, 0) | bit
        bit <<= 1
    all_bits, top, d = bit - 1, bit >> 1, len(b)
    up, down = all_bits, 0
    # each character that is left can take back one
    limit = (len(a) if most is None else most) + len(a)
    for c in a:
        if d > limit:
            return d
        limit -= 1
        same = equal.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        same |= down
        plus = down | (all_bits & ~(across | up))
        minus = up & across
        d += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1 | 1) & all_bits, (minus << 1) & all_bits
        up, down = minus | (all_bits & ~(same | plus)), plus & same
    return d
