"""A context-mixing range coder for token ids, run over many blocks at once."""

from __future__ import annotations

import numpy as np

#: Ids in a block; a block's model starts anew, so blocks are decoded independently.
BLOCK = 2048
#: About so many blocks are coded side by side.
LANES = 4096


def groups(blocks: int) -> list[tuple[int, int]]:
    """Even ranges of about LANES blocks: a few left over are no group of their own."""
    n = max(1, round(blocks / LANES))
    return [(blocks * k // n, blocks * (k + 1) // n) for k in range(n)] if blocks else []


#: Bits of a file's order-0 frequencies, unless it has more different ids, and of the chance that a prediction holds.
FREQUENCY_BITS, CHANCE_BITS = 20, 12
_ONE = 1 << CHANCE_BITS
#: Places for contexts in a block's tables of order 1 and of order 2, and the greatest confidence.
_SLOTS, _SURE = 512, 7
_U = np.uint64
_WORD, _LOW = _U(32), _U((1 << 32) - 1)


def _curves() -> tuple[np.ndarray, np.ndarray]:
    """stretch(p) = ln(p / (1 - p)) by p in 1/4096, and its inverse by x in 1/64 from -8, in 1/4096, never 0 or 1."""
    p = np.clip(np.arange(4096), 1, 4095)
    squash = 4096 / (1 + np.exp(-(np.arange(1025) - 512) / 64))
    # rounded, so that machines whose last bits of exp and log differ agree
    return (np.rint(np.log(p / (4096 - p)) * 4096) / 4096).astype(np.float32), np.clip(np.rint(squash), 1, _ONE - 1).astype(np.int32)


_STRETCH, _SQUASH = _curves()
#: A prediction's first chance, in 1/65536, by how often orders 2 and 1 were right in a row and whether they agree.
_FIRST = np.array([min(60000, 2500 * (1 + 3 * two + one) * (1 + same)) for two in range(8) for one in range(8) for same in range(2)], np.int32)


class Frequencies:
    """Order 0 of a file: frequencies of its ranks, out of 2^bits, from their counts' logarithms in 1/8 bits.

    bits follow from the number of ids: twice as many points at the least, so each rank has one.
    """

    def __init__(self, levels: np.ndarray, ids: int):
        self.bits = max(min(FREQUENCY_BITS, max(12, ids.bit_length() + 1)), len(levels).bit_length() + 1)
        weight = np.floor(np.exp2(np.arange(256) / 8) * 16)[levels]
        # at least one each; the rest by weight; what rounding leaves goes to the first of the heaviest
        self.size = (1 + np.floor(weight * (((1 << self.bits) - len(levels)) / max(1.0, float(weight.sum()))))).astype(np.int64)
        if len(levels):
            self.size[int(weight.argmax())] += (1 << self.bits) - int(self.size.sum())
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def levels(counts: np.ndarray) -> np.ndarray:
        return np.rint(8 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


class _Orders:
    """The frequencies of several files, one after the other; a lane's rank r is at base + r, its point p at points + p."""

    def __init__(self, files: list[Frequencies], owner: np.ndarray):
        self.files, bits = files, np.array([f.bits for f in files], np.int64)
        self.kind = np.uint16 if all(len(f.size) <= 1 << 16 for f in files) else np.uint32  # of ranks
        first = lambda n: (np.cumsum(n) - n)[owner]
        self.base, self.points = first(np.array([len(f.size) for f in files], np.int64)), first(np.int64(1) << bits)
        self.bits, self.whole = bits[owner].astype(np.uint64), (np.int64(1) << (bits + 32))[owner].astype(np.uint64)
        size, start = np.concatenate([f.size for f in files]), np.concatenate([f.start for f in files])
        self.packed = size.astype(np.uint64) << _WORD | start.astype(np.uint64)
        self.stretch = np.concatenate([_STRETCH[np.clip(f.size << 12 >> f.bits, 1, 4095)] for f in files])

    def ranks(self) -> np.ndarray:
        """The rank at each point."""
        return np.concatenate([np.repeat(np.arange(len(f.size), dtype=self.kind), f.size) if len(f.size) else np.zeros(1 << f.bits, self.kind) for f in self.files])


class _Model:
    """One model for each lane.

    Orders 1 and 2 each predict the next rank, the one last seen after the
    same one or two, and how often in a row that was right; the prediction of
    order 2 is taken where it was right before, else that of order 1. Order 0
    predicts every rank by the file's frequencies. A logistic mixer weighs
    what orders 1 and 2 together and order 0 say of the prediction, with
    chances and weights learned in the lane; if it fails, order 0 spells the
    rank.
    """

    def __init__(self, orders: _Orders):
        lanes = len(orders.base)
        self.orders = orders
        # row 0 is order 2, row 1 order 1; a context's place in a lane's table holds rank << 3 | times right
        self.slots, self.contexts = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * _SLOTS, np.arange(lanes, dtype=np.int64) * 128
        self.seen, self.last = np.zeros(2 * lanes * _SLOTS, np.int32), np.zeros((2, lanes), np.int32)
        self.hits = np.tile(_FIRST, lanes)
        self.w1, self.w0, self.step = np.full(lanes, 0.8 * 64, np.float32), np.full(lanes, 0.2 * 64, np.float32), 0

    def predict(self, n: int) -> np.ndarray:
        """How much of 1/4096 the prediction gets."""
        self.at = self.slots[:, :n] + (self.last[:, :n] & (_SLOTS - 1))
        v = self.v = self.seen.take(self.at)
        c = self.c = v & _SURE
        self.p = np.where(c[0] > 0, v[0], v[1]) >> 3
        self.i = self.contexts[:n] + (c[0] << 4)
        self.i += c[1] << 1
        self.i += (v[0] ^ v[1]) <= _SURE
        self.q = self.hits.take(self.i)
        self.s1, self.s0 = _STRETCH.take(self.q >> 4), self.orders.stretch.take(self.orders.base[:n] + self.p, mode="clip")
        x = self.w1[:n] * self.s1
        x += self.w0[:n] * self.s0
        x += np.float32(512)
        self.a = _SQUASH.take(x.astype(np.int32), mode="clip")
        return self.a

    def update(self, n: int, rank: np.ndarray, hit: np.ndarray) -> None:
        """rank is what came; hit: whether it was predicted."""
        self.step += 1
        if self.step % 2 == 0:
            self.hits[self.i] = self.q + ((hit * np.int32(65535) - self.q) >> 3)
        if self.step % 4 == 0:
            error = (hit * np.float32(_ONE) - self.a) * np.float32(4 / _ONE)
            self.w1[:n] += error * self.s1
            self.w0[:n] += error * self.s0
        fresh = rank << 3
        self.seen[self.at] = np.where((self.v ^ fresh) <= _SURE, self.v + (self.c < _SURE), fresh)
        self.last[0, :n] = self.last[1, :n] * np.int32(613) + rank
        self.last[1, :n] = rank


def _sorted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by falling size, and how many are still running at each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")


def _narrow(low: np.ndarray, span: np.ndarray, bits: np.ndarray, packed: np.ndarray) -> None:
    unit = span >> bits
    low += unit * (packed & _LOW)
    np.multiply(unit, packed >> _WORD, out=span)


def _spent(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes with less than a word of span left, their low, and the span that has one leading word."""
    at = (span <= _LOW).nonzero()[0]
    l, s = low.take(at), span.take(at)
    return at, l, np.where((l ^ (l + s)) > _LOW, (~l + _U(1)) & _LOW, s)


def encode(blocks: list[np.ndarray], files: list[Frequencies], owner: list[int]) -> list[bytes]:
    """Each block of ranks as bytes, by the frequencies of the file that owns it; at most LANES blocks."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, running = _sorted(sizes)
    lanes = len(blocks)
    orders = _Orders(files, np.array(owner, np.int64)[order])
    x = np.zeros((len(running), lanes), orders.kind)
    for i, k in enumerate(order):
        x[: sizes[k], i] = blocks[k]
    model, low, span = _Model(orders), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.zeros((lanes, 256), np.uint32)
    used = np.zeros(lanes, np.int64)
    for t, n in enumerate(running.tolist()):
        rank = x[t, :n].astype(np.int32)
        lo, sp = low[:n], span[:n]
        bound = (sp >> _U(CHANCE_BITS)) * model.predict(n).astype(np.uint64)
        hit = rank == model.p
        lo += np.where(hit, _U(0), bound)
        sp[:] = np.where(hit, bound, sp - bound)
        _narrow(lo, sp, orders.bits[:n], np.where(hit, orders.whole[:n], orders.packed.take(orders.base[:n] + rank)))
        at, l, s = _spent(lo, sp)
        if len(at):
            u = used.take(at)
            if int(u.max()) + 4 > out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], axis=1)
            out[at, u] = l >> _WORD
            used[at] = u + 1
            lo[at], sp[at] = l << _WORD, s << _WORD
        model.update(n, rank, hit)
    tails = low.astype(">u8")
    words = out.astype(">u4")
    result: list[bytes] = [b""] * lanes
    for i, k in enumerate(order):
        result[k] = words[i, : used[i]].tobytes() + tails[i : i + 1].tobytes() if sizes[k] else b""
    return result


def decode(data: list[bytes], sizes: list[int], files: list[Frequencies], owner: list[int]) -> list[np.ndarray]:
    """The blocks that encode() was given; of damaged bytes, some ranks."""
    if not data:
        return []
    with np.errstate(all="ignore"):
        return _decoded(data, sizes, files, owner)


def _decoded(data: list[bytes], sizes: list[int], files: list[Frequencies], owner: list[int]) -> list[np.ndarray]:
    want = np.array(sizes, np.int64)
    order, running = _sorted(want)
    lanes = len(data)
    width = max(map(len, data), default=0) // 4 + 4
    raw = np.zeros((lanes, width), np.uint32)
    for i, k in enumerate(order):
        own = np.frombuffer(data[k], ">u4", len(data[k]) // 4)
        raw[i, : len(own)] = own
    code = raw[:, 0].astype(np.uint64) << _WORD | raw[:, 1].astype(np.uint64)
    used = np.full(lanes, 2, np.int64)
    orders = _Orders(files, np.array(owner, np.int64)[order])
    ranks = orders.ranks()
    model, low, span = _Model(orders), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    x = np.zeros((len(running), lanes), orders.kind)
    for t, n in enumerate(running.tolist()):
        lo, sp, co = low[:n], span[:n], code[:n]
        bound = (sp >> _U(CHANCE_BITS)) * model.predict(n).astype(np.uint64)
        here = co - lo
        hit = here < bound
        skipped = np.where(hit, _U(0), bound)
        lo += skipped
        here -= skipped
        sp[:] = np.where(hit, bound, sp - bound)
        v = (here // (sp >> orders.bits[:n])).view(np.int64)
        rank = np.where(hit, model.p, ranks.take(orders.points[:n] + v, mode="clip").astype(np.int32))
        _narrow(lo, sp, orders.bits[:n], np.where(hit, orders.whole[:n], orders.packed.take(orders.base[:n] + rank, mode="clip")))
        at, l, s = _spent(lo, sp)
        if len(at):
            u = used.take(at)
            co[at] = co.take(at) << _WORD | raw[at, np.minimum(u, width - 1)]
            used[at] = u + 1
            lo[at], sp[at] = l << _WORD, s << _WORD
        x[t, :n] = rank
        model.update(n, rank, hit)
    result: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for i, k in enumerate(order):
        result[k] = x[: want[k], i].astype(np.int64)
    return result
