"""Pieces of whole pre-tokens, cut and looked up in numpy: a text costs few Python objects."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from .wordhash import SLICE, Powers, mixed

_U = np.uint64
#: Classes of bytes: beyond what is listed, letters, digits, signs, apostrophe, space, other white space.
_OTHER, _LETTER, _DIGIT, _SIGN, _MARK, _SPACE, _BREAK = range(7)
#: Characters of which some need not be in one of those classes.
BEYOND = re.compile("[^\x00-ʯ]")


def _classes() -> np.ndarray:
    k = np.full(256, _OTHER, np.uint8)
    k[:128] = _SIGN
    k[ord("a") : ord("z") + 1] = k[ord("A") : ord("Z") + 1] = _LETTER
    k[ord("0") : ord("9") + 1] = _DIGIT
    k[ord("'")], k[ord(" ")], k[0x09:0x0E] = _MARK, _SPACE, _BREAK
    k[0x1C:0x20] = _OTHER  # white space to some, signs to others
    return k


def _borders() -> np.ndarray:
    """By the classes before and after a place: 1 for a border, 2 for one if no white space comes before the break."""
    cut = np.zeros((8, 8), np.uint8)
    some = [_LETTER, _DIGIT, _SIGN, _MARK, _SPACE, _BREAK]
    for before in (_LETTER, _DIGIT):
        cut[before, [k for k in some if k != before]] = 1
    cut[_SIGN, [_LETTER, _DIGIT, _SPACE, _BREAK]] = 1
    cut[_MARK, [_DIGIT, _SPACE, _BREAK]] = 1
    cut[_BREAK, [_LETTER, _DIGIT, _SIGN, _MARK]] = 2
    return cut.ravel()


_CLASS, _BORDER = _classes(), _borders()


def classes(raw: np.ndarray) -> np.ndarray:
    kind = _CLASS[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xCA))
    if len(lead):  # U+00C0 to U+02AF are letters but for two signs
        a, b = raw[lead], raw[lead + 1]
        letter = ~((a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xCA) & (b >= 0xB0))
        kind[lead] = kind[lead + 1] = np.where(letter, _LETTER, _OTHER)
    return kind


def borders(raw: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 bytes of texts that start at `firsts`.

    A piece is one pre-token or several whole ones, and its pre-tokens are the
    same alone as in the text, whether a pre-token takes a space before it or
    white space is dropped: none goes from a letter or digit to another class,
    from a sign to white space or (but for the apostrophe of a contraction) to
    a letter, or over a single line break.
    """
    kind = classes(raw)
    cut = _BORDER[kind[:-1] * np.uint8(8) + kind[1:]]
    first = np.zeros(len(raw), bool)
    first[1:] = cut == 1
    first[firsts] = True
    broken = np.flatnonzero(cut == 2)
    if len(broken):  # the break is at `broken`, what comes after it one further
        before = kind[np.maximum(broken - 1, 0)]
        alone = first[broken] & (((before != _SPACE) & (before != _BREAK) & (before != _OTHER)) | np.isin(broken, firsts))
        first[broken[alone] + 1] = True
    return np.flatnonzero(first)


#: By n, the bits of a little-endian word's first n bytes.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longest piece that two words hold beside its length.
_SHORT = 15


def hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece; pieces cover all bytes.

    The bytes and length of a piece of up to 15 are two words, read at its
    start, so no two such pieces meet; longer ones have two independent hashes.
    """
    size = np.diff(np.append(starts, len(raw)))
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    words = np.ndarray(len(raw) + 9, "<u8", padded, strides=(1,))
    two = words[starts + 8]
    two &= _FIRST_BYTES[np.clip(size - 8, 0, 7)]
    two |= size.astype(np.uint64) << _U(56)
    one = words[starts]
    one &= _FIRST_BYTES[np.minimum(size, 8)]
    one ^= two * _U(0x9E3779B97F4A7C15)
    one = mixed(one)
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        n = size[long]
        firsts = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        at -= np.repeat(firsts, n)
        one[long], two[long] = _long_hashes(raw[at + np.repeat(starts[long], n)], at, firsts)
    return np.maximum(one, _U(1)), two


def _long_hashes(raw: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the bytes of pieces and the place of each in its piece."""
    power = Powers.of(int(at.max()) + 1)[at]
    value = raw.astype(np.uint64)
    value += _U(1)
    one = np.add.reduceat(value * power, starts)
    power *= power  # another base: the square of the first
    power += _U(0x632BE59BD9B4E019)
    return mixed(one), np.add.reduceat(value * power, starts)


def runs(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """About SLICE bytes at once of texts that aren't empty: the bytes, where each part starts, and the text it is of.

    A longer text is cut before a space after a letter, so memory follows SLICE and the longest stretch without one.
    """
    parts, owners, held = [], [], 0

    def done():
        return b"".join(parts), np.cumsum([0, *map(len, parts[:-1])]), np.array(owners)

    for i, data in enumerate(texts):
        p = 0
        while p < len(data):
            q = len(data)
            if q - p > SLICE:
                found = re.compile(rb"[A-Za-z] ").search(data, p + SLICE)
                q = found.start() + 1 if found else q
            parts.append(data[p:q])
            owners.append(i)
            held += q - p
            p = q
            if held >= SLICE:
                yield done()
                parts, owners, held = [], [], 0
    if parts:
        yield done()


class Table:
    """A compact hash table from pairs of hashes to numbers: open addressing in three arrays, at most half full."""

    def __init__(self, most: int):
        self.mask = (2 << max(4, int(most).bit_length())) - 1
        self.one, self.two, self.value = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.size = 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each, -1 where there is none."""
        out = np.full(len(one), -1, np.int64)
        todo, place = np.arange(len(one)), (one & _U(self.mask)).astype(np.int64)
        while len(todo):
            key = self.one[place]
            hit = (key == one[todo]) & (self.two[place] == two[todo])
            out[todo[hit]] = self.value[place[hit]]
            more = ~hit & (key != 0)
            todo, place = todo[more], (place[more] + 1) & self.mask
        return out

    def add(self, one: np.ndarray, two: np.ndarray, value: np.ndarray) -> None:
        """Pairs that differ and aren't there yet."""
        self.size += len(one)
        place = (one & _U(self.mask)).astype(np.int64)
        while len(one):  # of those that meet at a free place one is put there in a round, the others go on to the next place
            free = np.flatnonzero(self.one[place] == 0)
            slot, first = np.unique(place[free], return_index=True)
            at = free[first]
            self.one[slot], self.two[slot], self.value[slot] = one[at], two[at], value[at]
            left = np.ones(len(one), bool)
            left[at] = False
            one, two, value, place = one[left], two[left], value[left], (place[left] + 1) & self.mask


def distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The place of one row of each distinct pair."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    return order[new]


class Encoder:
    """Ids of texts whose characters are up to U+02AF, piece by piece; what `encode` says of a piece is kept.

    Over `most` pieces the table starts anew with those that were asked for
    again, if these fill at most half of it, so a worker's memory is bounded.
    """

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.table, self.used = Table(self.most), 0
        self.starts, self.counts, self.ids = np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, np.int32), np.zeros(1 << 16, np.uint32)
        self.again = np.zeros(self.most + 1, bool)  # the last place is of pieces that aren't there

    def renew(self) -> None:
        old, keep = self.table, np.flatnonzero(self.again[: self.table.size])
        starts, n, ids = self.starts[keep], self.counts[keep], self.ids
        self.clear()
        if not 0 < len(keep) <= self.most // 2:
            return
        to = np.cumsum(n, dtype=np.int64)
        self.used = int(to[-1])
        self.ids = np.zeros(max(1 << 16, 2 * self.used), np.uint32)
        self.ids[: self.used] = ids[np.arange(self.used) + np.repeat(starts - (to - n), n)]
        self.starts[: len(keep)], self.counts[: len(keep)] = to - n, n
        place = np.flatnonzero(old.one)
        slot = np.zeros(old.size, np.int64)
        slot[old.value[place]] = place
        self.table.add(old.one[slot[keep]], old.two[slot[keep]], np.arange(len(keep)))

    def numbers(self, data: bytes, starts: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found = self.table.find(one, two)
        self.again[found] = True
        miss = np.flatnonzero(found < 0)
        if not len(miss):
            return found
        new = miss[distinct(one[miss], two[miss])]
        if self.table.size + len(new) > self.most:
            self.renew()
            found = self.table.find(one, two)
            miss = np.flatnonzero(found < 0)
            new = miss[distinct(one[miss], two[miss])]
            if self.table.size + len(new) > self.most:
                miss = np.arange(len(one))
                new = distinct(one, two)
                if len(new) > self.most:
                    self.most = 2 * len(new)
                self.clear()
        ends = np.append(starts[1:], len(data))
        flat: list[int] = []
        to = []
        for a, b in zip(starts[new].tolist(), ends[new].tolist()):
            flat += self.encode(data[a:b].decode())
            to.append(len(flat))
        n = np.diff(np.array(to), prepend=0)
        own = slice(self.table.size, self.table.size + len(new))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[own], self.counts[own] = self.used + np.cumsum(n) - n, n
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.table.add(one[new], two[new], np.arange(own.start, own.stop))
        found[miss] = self.table.find(one[miss], two[miss])
        return found

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = [np.zeros(0, np.uint32)] * len(texts)
        for data, firsts, owners in runs([t.encode() for t in texts]):
            raw = np.frombuffer(data, np.uint8)
            starts = borders(raw, firsts)
            number = self.numbers(data, starts, *hashes(raw, starts))
            n = self.counts[number].astype(np.int64)
            ends = np.cumsum(n)
            flat = self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[number] - (ends - n), n)]
            cuts = np.append(ends - n, ends[-1])[np.searchsorted(starts, firsts)]
            for i, ids in zip(owners.tolist(), np.split(flat, cuts[1:])):
                out[i] = np.concatenate([out[i], ids]) if len(out[i]) else ids
        return out
