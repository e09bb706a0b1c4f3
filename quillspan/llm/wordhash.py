"""Vectorised hashes of words, straight from UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Multipliers of the polynomial and of the finisher; any odd 64-bit numbers do.
_BASE, _MIX_1, _MIX_2, _CHAIN = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at once.
SLICE = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _MIX_1
    x ^= x >> _U(27)
    x = x * _MIX_2
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of the base; the table grows with the longest word."""

    table = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            out = np.full(max(n, 2 * len(cls.table), 4096), _BASE, np.uint64)
            out[0] = 1
            cls.table = np.multiply.accumulate(out)
        return cls.table


def _hashes(raw: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of raw, none of which crosses a cut; index of the first word at or after each cut."""
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    at = np.arange(len(raw), dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    at[space] = 0
    value = (_LOWER[raw] if lower else raw).astype(np.uint64)
    value += _U(1)
    value *= Powers.of(int(at.max()) + 1)[at]
    value[space] = 0
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(starts, cuts)


def word_hashes(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: (from, to, hashes of all their words, bounds of each text's words).

    A text of more than SLICE bytes stands alone and is hashed in slices that
    end at white space, so memory follows its words, not its bytes. Nulls
    have no words.
    """
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, len(texts))
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * SLICE:
            h, bounds = _hashes(raw[a:b], offsets[i : j + 1] - a, lower)
            bounds[-1] = len(h)
            yield i, j, h, bounds
        else:
            parts, p = [], a
            while p < b:
                q = min(b, p + SLICE)
                while q < b and not _SPACE[raw[q]]:  # on to the end of the word
                    step = raw[q : q + 4096]
                    ends = np.flatnonzero(_SPACE[step])
                    q += int(ends[0]) if len(ends) else len(step)
                parts.append(_hashes(raw[p:q], np.zeros(1, np.int64), lower)[0])
                p = q
            h = np.concatenate(parts)
            yield i, j, h, np.array([0, len(h)])
        i = j


def text_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """Hashes of one text's words."""
    found = [h for _, _, h, _ in word_hashes(pa.array([data.decode("utf-8", "replace")], pa.large_string()), lower)] if len(data) > SLICE else [_hashes(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), lower)[0]] if data else []
    return found[0] if found else np.zeros(0, np.uint64)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of `size` words; with fewer words, of the whole sequence; none without words."""
    if not len(h):
        return h
    n = min(size, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _CHAIN
        out += h[k : len(h) - n + 1 + k]
    return mixed(out + _U(n))
