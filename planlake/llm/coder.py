"""Adaptive context-mixing range coder for token ids.

A block is coded on its own: its models start empty, and a checksum of its ids is kept with it. Four
predictions of the next id are mixed. Order 0 is a distribution over all ids: what the block held so far,
counted anew after growing stretches, and a prior that falls with the id, since vocabularies are in order
of frequency. Order 1 names the two ids that last followed the id before, order 2 the one that last
followed the two ids before. The mixture

    p(id) = w0 * p0(id) + w1 * [id = first] + w2 * [id = second] + w3 * [id = third]

drives a 64-bit range coder with carries and 16-bit output words. Its weights depend on how often the
order-1 and order-2 predictions held before, and are learnt while coding: each moves towards its
prediction's share in the probability of the id that came (online expectation maximisation).

Many blocks are coded side by side, one numpy lane each; a lane's output does not depend on the others.
Only element-wise IEEE operations on 32-bit floats (weights, the prior) precede the integer frequencies, so
every machine computes the same ones.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PLB4"
BLOCK = 32768
#: Bits that order-0 frequencies stay below, and of the mixture's. A mixture gives the three named ids at most 15 of 16 parts.
BITS0, BITS = 26, 30
#: Contexts of the order-1 and order-2 tables of a block; stretches of the order-0 frequencies that a search starts from.
ONE, TWO, STEPS = 4096, 16384, 1024
_HEAD = struct.Struct("<4sIIII")  # magic, ids, coded bytes, crc32 of the ids, ids that order 0 knows (256 each)
_U = np.uint64
_LOW, _16 = _U(1 << 48), _U(16)
_NAMED, _RATE = np.float32(15 / 16 * (1 << BITS)), np.float32(0.02)
#: Frequency of an id that came once. The prior counts for _PRIOR ids, and falls like 1 / (id + _FLAT).
_ONCE, _PRIOR, _FLAT = 1024, 300, 100


def _recounts(n: int) -> list[int]:
    """Places in a block where order 0 is counted anew."""
    out, at = [0], 64
    while at < n:
        out.append(at)
        at = min(at * 5 // 4, at + 1024)
    return out


class _Lanes:
    """Models of the lanes, all at the same id. Table entries are an id and, in the two low bits, how often it held."""

    def __init__(self, n: int, known: int):
        self.known, self.wide = known, known + 1
        prior = np.float32(1) / (np.arange(known, dtype=np.float32) + np.float32(_FLAT))
        prior = (prior * np.float32(_ONCE * _PRIOR * 0.14)).astype(np.int32) + 1  # 1 / 0.14 is about the sum of the falling shares
        self.cum = np.tile(np.concatenate([np.zeros(1, np.int32), np.cumsum(prior, dtype=np.int32)]), (n, 1))
        self.total = self.less = int(self.cum[0, -1])
        self.steps = np.zeros((n, STEPS + 1), np.int32)
        self.weight = np.full((3, n * 16), 0.05, np.float32)
        self.one, self.older, self.two = np.zeros(n * ONE, np.int32), np.zeros(n * ONE, np.int32), np.zeros(n * TWO, np.int32)
        self.a, self.b = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        lane = np.arange(n)
        self.base, self.one0, self.two0, self.sixteen, self.step0 = lane * self.wide, lane * ONE, lane * TWO, lane * 16, lane * (STEPS + 1)

    def recount(self, m: int, ids: np.ndarray, before: int, search: bool) -> None:
        """Order 0 of the first m lanes with the ids (rows of lanes) since the last time; before: ids seen until now."""
        self.total = self.less + _ONCE * before
        edges = (np.arange(STEPS + 1) * self.total) // STEPS
        for i in range(m):
            cum = self.cum[i]
            if len(ids):
                came = np.sort(ids[:, i])
                # so many of them are below each id
                cum += np.repeat(np.arange(0, _ONCE * (len(came) + 1), _ONCE, dtype=np.int32), np.diff(came, prepend=-1, append=self.known))
            if search:
                self.steps[i] = np.searchsorted(cum, edges, "right") - 1

    def begin(self, m: int) -> None:
        """Predictions of the first m lanes and their masses for the next id."""
        b = self.b[:m] * np.uint32(0x9E3779B1)
        self.i1 = self.one0[:m] + (b >> np.uint32(20))
        self.i2 = self.two0[:m] + (((self.a[:m] * np.uint32(0x85EBCA6B)) ^ b) * np.uint32(0xC2B2AE35) >> np.uint32(18))
        self.e1, self.e2 = self.one.take(self.i1), self.two.take(self.i2)
        self.named = np.minimum(np.stack((self.e2 >> 2, self.e1 >> 2, self.older.take(self.i1))), self.known - 1)
        self.which = self.sixteen[:m] + ((self.e2 & 3) << 2 | (self.e1 & 3))
        self.start = self.weight.take(self.which, 1)
        self.mass = (self.start * _NAMED).astype(np.int64)
        self.rest = (((1 << BITS) - self.mass[0] - self.mass[1] - self.mass[2]) << BITS0) // self.total

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and frequency of ids."""
        at = self.base[: len(x)] + x
        low, high = (self.cum.reshape(-1).take(np.stack((at, at + 1))) * self.rest) >> BITS0
        under, same = self.mass * (self.named < x), self.mass * (self.named == x)
        self.same = same
        self.freq = high - low + same[0] + same[1] + same[2]
        return (low + under[0] + under[1] + under[2]).astype(np.uint64), self.freq.astype(np.uint64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The ids whose frequencies hold q."""
        m, cum, n, mass = len(q), self.cum.reshape(-1), self.named, self.mass
        at = self.base[:m] + n
        low, high = (cum.take(np.stack((at, at + 1))) * self.rest) >> BITS0
        under, same = ((f(n[:, None], n[None]) * mass[:, None]).sum(0) for f in (np.less, np.equal))
        low += under
        high += under + same
        past = mass * (high <= q)
        goal = ((((q - past[0] - past[1] - past[2]) + 1) << BITS0) - 1) // self.rest
        goal = np.minimum(goal, self.total - 1)
        step = self.step0[:m] + np.minimum(goal * STEPS // self.total, STEPS - 1)
        lo, hi = self.steps.reshape(-1).take(np.stack((step, step + 1))).astype(np.int64)
        hi += 1
        live = np.flatnonzero(hi - lo > 1)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            right = cum.take(self.base[live] + mid) <= goal[live]
            lo[live] = np.where(right, mid, lo[live])
            hi[live] = np.where(right, hi[live], mid)
            live = live[(hi - lo)[live] > 1]
        inside = (low <= q) & (q < high)
        return np.where(inside[0], n[0], np.where(inside[1], n[1], np.where(inside[2], n[2], lo)))

    def learn(self, x: np.ndarray) -> None:
        """Take in the ids that came, after bounds()."""
        m, x = len(x), x.astype(np.int32)
        share = self.same.astype(np.float32) / self.freq.astype(np.float32)
        self.weight[:, self.which] = self.start + (share - self.start) * _RATE
        g2, g1, g0 = self.named
        e1, e2 = self.e1, self.e2
        # a right prediction gains, one that held before loses its standing, any other is replaced
        self.two[self.i2] = np.where(g2 == x, np.minimum(e2 + 1, e2 | 3), np.where((e2 & 3) > 1, e2 & ~3, x << 2))
        right, stays = g1 == x, (e1 & 3) > 1
        self.older[self.i1] = np.where(right, g0, np.where(stays, x, g1))
        self.one[self.i1] = np.where(right, np.minimum(e1 + 1, e1 | 3), np.where(stays, e1 & ~3, x << 2))
        self.a[:m] = self.b[:m]
        self.b[:m] = x


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded form, with header, of every block of ids below 65536."""
    out: list[bytes] = [b""] * len(blocks)
    limit = [-(-(int(b.max(initial=0)) + 1) // 8192) * 32 for b in blocks]  # few different ones, so that blocks go together
    if max(limit, default=0) > 256:
        raise ValueError("ids must be below 65536")
    for known in sorted(set(limit)):
        at = [i for i, k in enumerate(limit) if k == known]
        for i, coded in zip(at, _encode([blocks[i] for i in at], known)):
            out[i] = coded
    return out


def _encode(blocks: list[np.ndarray], known: int) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    n = len(order)
    sizes = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((int(sizes[0]), n), np.int32)
    for r, i in enumerate(order):
        ids[: sizes[r], r] = blocks[i]
    words, filled = np.zeros((n, int(sizes[0]) + 4096), np.uint16), np.zeros(n, np.int64)
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    lanes, lane = _Lanes(n, known * 256), np.arange(n)
    recounts = [*_recounts(len(ids)), len(ids)]
    for last, at, to in zip([0, *recounts], recounts, recounts[1:]):
        if int(filled.max()) + 2 * (to - at) + 8 > words.shape[1]:
            words = np.pad(words, ((0, 0), (0, words.shape[1])))
        m = int(np.searchsorted(-sizes, -at, "left"))  # lanes with more than so many ids
        lanes.recount(m, ids[last:at, :m], at, False)
        for t in range(at, to):
            m = int(np.searchsorted(-sizes, -t, "left"))
            x = ids[t, :m].astype(np.int64)
            lanes.begin(m)
            start, freq = lanes.bounds(x)
            lanes.learn(x)
            r = span[:m] >> _U(BITS)
            step = r * start
            now, size = low[:m] + step, r * freq
            for i in np.flatnonzero(now < step):  # a carry; it rarely runs on
                k = filled[i] - 1
                while words[i, k] == 0xFFFF:
                    words[i, k] = 0
                    k -= 1
                words[i, k] += 1
            which = np.flatnonzero(size < _LOW)
            while len(which):
                words[which, filled[which]] = now[which] >> _U(48)
                filled[which] += 1
                now[which] <<= _16
                size[which] <<= _16
                which = which[size[which] < _LOW]
            low[:m], span[:m] = now, size
    for half in (48, 32, 16, 0):
        words[lane, filled] = (low >> _U(half)).astype(np.uint16)
        filled += 1
    out: list[bytes] = [b""] * n
    for r, i in enumerate(order):
        body = words[r, : filled[r]].astype("<u2").tobytes() if sizes[r] else b""
        out[i] = _HEAD.pack(MAGIC, int(sizes[r]), len(body), zlib.crc32(np.asarray(blocks[i]).astype("<u4").tobytes()), known) + body
    return out


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The blocks' ids; raises ValueError where the header, the length or the checksum is wrong."""
    heads = []
    for c in coded:
        head = _HEAD.unpack_from(c) if len(c) >= _HEAD.size else (b"", 0, 0, 0, 0)
        if head[0] != MAGIC or head[2] != len(c) - _HEAD.size or head[2] % 2 or not 1 <= head[4] <= 256:
            raise ValueError("not a coded block")
        heads.append(head)
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(coded)
    for known in sorted({h[4] for h in heads}):
        at = [i for i, h in enumerate(heads) if h[4] == known]
        for i, ids in zip(at, _decode([coded[i] for i in at], [heads[i][1] for i in at], known)):
            out[i] = ids
    for ids, head in zip(out, heads):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[3]:
            raise ValueError("a block's checksum is wrong")
    return out


def _decode(coded: list[bytes], sizes: list[int], known: int) -> list[np.ndarray]:
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    n = len(order)
    sizes = np.array([sizes[i] for i in order])
    longest = max(map(len, coded)) // 2 + 6
    words = np.zeros((n, longest), np.uint16)
    for r, i in enumerate(order):
        w = np.frombuffer(coded[i], "<u2", offset=_HEAD.size)
        words[r, : len(w)] = w
    taken = np.full(n, 4, np.int64)
    value = np.zeros(n, np.uint64)
    for i in range(4):
        value = value << _16 | words[:, i]
    span = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    lanes = _Lanes(n, known * 256)
    ids = np.zeros((int(sizes[0]), n), np.int32)
    recounts = [*_recounts(len(ids)), len(ids)]
    for last, at, to in zip([0, *recounts], recounts, recounts[1:]):
        m = int(np.searchsorted(-sizes, -at, "left"))
        lanes.recount(m, ids[last:at, :m], at, True)
        for t in range(at, to):
            m = int(np.searchsorted(-sizes, -t, "left"))
            lanes.begin(m)
            r = span[:m] >> _U(BITS)
            x = lanes.find(np.minimum(value[:m] // r, _U((1 << BITS) - 1)).astype(np.int64))
            start, freq = lanes.bounds(x)
            lanes.learn(x)
            v, size = value[:m] - r * start, r * freq
            which = np.flatnonzero(size < _LOW)
            while len(which):
                v[which] = v[which] << _16 | words[which, np.minimum(taken[which], longest - 1)]
                size[which] <<= _16
                taken[which] += 1
                which = which[size[which] < _LOW]
            value[:m], span[:m] = v, size
            ids[t, :m] = x
    out: list[np.ndarray] = [np.empty(0, np.int32)] * n
    for r, i in enumerate(order):
        out[i] = np.ascontiguousarray(ids[: sizes[r], r])
    return out
