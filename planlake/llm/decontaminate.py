"""Benchmark decontamination by q-gram lemma filtering.

Items and documents are compared with A-Z lower-cased and white space runs as one space. Every run of SPAN
bytes of an item is a window (a shorter item is one window itself). A stretch of a document within k edits
of a window of w bytes shares at least w - q + 1 - k * q of its q-grams with it, all on diagonals (document
position minus item position) that differ by at most k: so shared q-grams are gathered for every item in
overlapping diagonal bands, twice as wide as k, and only windows that hold enough of a band's are aligned
(banded dynamic programming over the band's diagonals). Any stretch within the budget of any window is
found; so is every verbatim quote of SPAN normalised bytes or more, wherever it starts in its item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import written

SPAN, RATE, Q = 80, 0.075, 10
#: Bytes of items that one pass indexes and broadcasts; more items take more passes.
BLOCK_BYTES = 8 << 20
#: Windows that are aligned at a time, and shared q-grams that are gathered at a time.
_ALIGNED, _HITS = 4096, 1 << 21
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def normal(text: str | bytes | None) -> bytes:
    data = text.encode() if isinstance(text, str) else bytes(text or b"")
    return _SPACE.sub(b" ", data.translate(_LOWER)).strip(b" ")


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value of every run of q bytes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, x = np.zeros(n, np.uint64), data.astype(np.uint64)
    for i in range(q):
        out = out * np.uint64(0x100000001B3) + x[i : i + n] + np.uint64(1)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    number: np.ndarray  # of each item with windows: its number
    base: np.ndarray  # where its bytes start
    windows: np.ndarray  # how many; the i-th starts at its i-th byte
    size: np.ndarray  # of its windows
    edits: np.ndarray  # budget of its windows
    least: np.ndarray  # q-grams that a stretch within the budget must share
    flat: np.ndarray  # bytes of all items, and of a window more
    keys: np.ndarray  # sorted q-gram values
    place: np.ndarray  # of each key, in flat
    seen: np.ndarray  # table of hashed keys for a quick no
    q: int
    span: int

    @cached_property
    def rank(self) -> np.ndarray:
        """Of each key, how many different keys there are before it."""
        return np.cumsum(np.concatenate([[0], self.keys[1:] != self.keys[:-1]])) if len(self.keys) else np.empty(0, np.int64)

    @cached_property
    def ranked(self) -> np.ndarray:
        """Rank and place of each key in one number; these ascend."""
        return self.rank << 32 | self.place.astype(np.int64)

    # window by window, for those who compare with all of them
    @cached_property
    def items(self) -> np.ndarray:
        return np.repeat(self.number, self.windows)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.arange(self.windows.sum()) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.repeat(self.size, self.windows)

    @cached_property
    def budget(self) -> np.ndarray:
        return np.repeat(self.edits, self.windows)

    @cached_property
    def text(self) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.flat, self.span)[np.repeat(self.base, self.windows) + self.starts]


def build_index(texts: list[str | None], q: int = Q, span: int = SPAN, rate: float = RATE) -> Index:
    """Windows of all items. Items shorter than q bytes cannot be told from chance and have none."""
    rows, parts, keys, place, at = [], [], [], [], 0
    for i, t in enumerate(texts):
        data = np.frombuffer(normal(t), np.uint8)
        if len(data) < q:
            continue
        size = min(len(data), span)
        k = int(size * rate)
        while k and size - q + 1 - k * q < 1:
            k -= 1
        g = grams(data, q)
        keys.append(g)
        place.append(np.arange(at, at + len(g)))
        rows.append((i, at, len(data) - size + 1, size, k, size - q + 1 - k * q))
        parts.append(data)
        at += len(data)
    cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
    key = cat(keys, np.uint64)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(1 << 20, bool)
    seen[(key >> np.uint64(44)).astype(np.int64)] = True
    num = np.array(rows, np.int64).reshape(-1, 6).T
    return Index(*num, cat([*parts, np.zeros(span, np.uint8)], np.uint8), key[order], cat(place, np.int64)[order].astype(np.int32), seen, q, span)


def align(ix: Index, doc: np.ndarray, item: np.ndarray, start: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window (its item, its start in flat) against stretches of doc on the diagonals low .. low + width, and where the best ends."""
    n = len(item)
    cell = np.arange(width + 1, dtype=np.int32)
    size = ix.size[item]
    big = np.int32(1 << 20)
    at = low.astype(np.int32)[:, None] + cell  # document position before row 0, by diagonal
    padded = np.concatenate([np.zeros(1, np.int16), doc.astype(np.int16), np.zeros(1, np.int16)])
    padded[[0, -1]] = -1
    now = np.where((at >= 0) & (at <= len(doc)), np.int32(0), big)
    best, end = np.full(n, big), np.full(n, -1)
    down = np.full((n, width + 1), big + 1, np.int32)
    for i in range(1, int(size.max(initial=0)) + 1):
        pos = at + np.int32(i)  # after the document byte that a diagonal step reads
        byte = padded[np.clip(pos, 0, len(doc) + 1)]
        down[:, :-1] = now[:, 1:] + 1  # a window byte without partner
        new = np.minimum(np.where(byte < 0, big, now + (byte != ix.flat[start + i - 1][:, None])), down)
        new = np.minimum.accumulate(new - cell, 1) + cell  # document bytes without partner
        now = np.where((pos >= 0) & (pos <= len(doc)), new, big)
        done = size == i
        if done.any():
            j = now[done].argmin(1)
            best[done] = now[done, j]
            end[done] = low[done] + j + i
    return best, end


def find(ix: Index, text: str | bytes | None, first: bool = False) -> list[tuple[int, int, int, int]]:
    """(item number, edits, start, end) of every window of an item that the text holds within its budget; positions in bytes of the normalised text. first: some of them are enough."""
    doc = np.frombuffer(normal(text), np.uint8)
    if not len(ix.keys) or len(doc) < ix.q:
        return []
    g = grams(doc, ix.q)
    hit = ix.seen[(g >> np.uint64(44)).astype(np.int64)]
    pos = np.flatnonzero(hit)
    if not len(pos):
        return []
    left, right = np.searchsorted(ix.keys, g[pos], "left"), np.searchsorted(ix.keys, g[pos], "right")
    real = right > left
    pos, left, right = pos[real], left[real], right[real]
    need = int(ix.least.min())
    if len(pos) < need:
        return []
    # the bound itself, before looking at windows: so many hits within one window and its budget
    reach = ix.span + int(ix.edits.max())
    near = np.searchsorted(pos, pos + reach, "right") - np.searchsorted(pos, pos - reach, "left")
    keep = near >= need
    pos, left, right = pos[keep], left[keep], right[keep]
    found: dict[int, tuple[int, int, int, int]] = {}
    total, at = np.cumsum(right - left), 0
    while at < len(pos) and not (first and found):
        # stretches of the document that start here, with all that they can reach
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _HITS, "right")))
        end = int(np.searchsorted(pos, pos[upto - 1] + reach, "right"))
        _gather(ix, doc, pos[at:end], left[at:end], right[at:end], 0, len(ix.flat), first, found)
        at = upto
    return [(int(ix.number[j]), e, max(0, a), z) for _, (j, e, a, z) in sorted(found.items())]


def _gather(ix: Index, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, lo: int, hi: int, first: bool, found: dict[int, tuple[int, int, int, int]]) -> None:
    """Add to found what a part of the document holds of the windows that start at lo .. hi - 1 of the index.

    pos: the part's q-grams that the index has, at its entries left .. right - 1; of those, the ones that
    such windows hold count. Too many of them (a q-gram of thousands of items) are halved by place.
    """
    if first and found:
        return
    base = ix.rank[left] << 32
    left, right = np.searchsorted(ix.ranked, base + lo), np.searchsorted(ix.ranked, base + min(hi + ix.span, len(ix.flat)))
    n = right - left
    if int(n.sum()) > _HITS and hi - lo > 2 * ix.span:
        mid = (lo + hi) // 2
        _gather(ix, doc, pos, np.searchsorted(ix.ranked, base), right, lo, mid, first, found)
        _gather(ix, doc, pos, np.searchsorted(ix.ranked, base), right, mid, hi, first, found)
        return
    pos, left, n = pos[n > 0], left[n > 0], n[n > 0]
    if not len(pos):
        return
    k = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = ix.place[k].astype(np.int64)
    item = np.searchsorted(ix.base, place, "right") - 1
    diagonal = np.repeat(pos, n) - (place - ix.base[item])
    half = int(ix.edits.max()) + 1
    least = int(diagonal.min())
    base = (diagonal - least) // half
    wide = int(base.max()) + 2
    # band b covers the diagonals of base b - 1 and b; of each, the distinct q-grams of the item
    group = np.concatenate([item, item]) * wide + np.concatenate([base + 1, base])
    order = np.lexsort((both := np.concatenate([place, place]), group))
    group, place = group[order], both[order]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (place[1:] != place[:-1])])
    group, place = group[new], place[new]
    item = group // wide
    # windows that hold the least number of q-grams: those around each run of so many
    upto = np.arange(len(group)) + ix.least[item] - 1
    ok = np.flatnonzero(upto < len(group))
    ok = ok[group[upto[ok]] == group[ok]]
    group, item, high, low = group[ok], item[ok], place[ok], place[upto[ok]]
    low = np.maximum(low - ix.size[item] + ix.q, ix.base[item])
    high = np.minimum(high, ix.base[item] + ix.windows[item] - 1)
    low, high = np.maximum(low, lo), np.minimum(high, hi - 1)
    # both ends rise within a group, so what an earlier run has is what lies at or before its high
    low[1:] = np.where(group[1:] == group[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
    n = np.maximum(high - low + 1, 0)
    group, item = np.repeat(group, n), np.repeat(item, n)
    start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    band = group % wide
    order = np.argsort(band, kind="stable")
    band, item, start = band[order], item[order], start[order]
    exact = np.empty(0, np.int64)  # windows that no later band can better
    at = 0
    while at < len(start):
        s, i, b = start[at : at + _ALIGNED], item[at : at + _ALIGNED], band[at : at + _ALIGNED]
        at += _ALIGNED
        if len(exact):
            rest = ~np.isin(s, exact)
            s, i, b = s[rest], i[rest], b[rest]
        best, end = align(ix, doc, i, s, least + (b - 2) * half + s - ix.base[i], 4 * half)
        ok = best <= ix.edits[i]
        exact = np.union1d(exact, s[ok & (best == 0)])
        for w, j, e, z in zip(s[ok].tolist(), i[ok].tolist(), best[ok].tolist(), end[ok].tolist()):
            if w not in found or (e, z) < found[w][1::2]:
                found[w] = (j, e, z - int(ix.size[j]), z)
        if first and found:
            break


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[tuple[list, Index]]]:
    """The items in blocks of about block_bytes, one at a time on the driver."""
    items = benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))

    def each():
        for i in range(n):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
            yield [r["item_id"] for r in rows], build_index([r["text"] for r in rows])

    return n, each()


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_windows, edits, doc_start, doc_end: one row for each document row and item with a window in it.

    edits: the least of the windows found. Null and empty texts match nothing; so do items of fewer
    than Q bytes. Repeated rows of docs come back as often. Items that share an id are separate texts
    whose rows are both returned. Empty tables give no rows.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    out = None
    n, blocks = _blocks(benchmark, block_bytes)
    for ids, index in blocks:
        known = docs.sparkSession.sparkContext.broadcast((ids, index))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            ids, ix = known.value
            for b in batches:
                got: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                    per: dict[int, list] = {}
                    for item, e, a, z in find(ix, text):
                        per.setdefault(item, []).append((e, a, z))
                    got += [(doc_id, ids[i], len(x), min(y[0] for y in x), min(y[1] for y in x), max(y[2] for y in x)) for i, x in sorted(per.items())]
                if got:
                    cols = list(zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1]), *(pa.array(c, pa.int32()) for c in cols[2:])], ["doc_id", "item_id", "n_windows", "edits", "doc_start", "doc_end"])

        part = rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, n_windows int, edits int, doc_start int, doc_end int")
        if n > 1:  # a pass is written, so one index at a time is held
            part = written(part, "matches").leave()
            known.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of any item. Null texts stay."""
    at, out = docs.columns.index("text"), docs
    n, blocks = _blocks(benchmark, block_bytes)
    for _, index in blocks:
        known = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(at).cast(pa.binary()).to_pylist()
                yield b.filter(pa.array([not find(known.value, t, first=True) for t in texts], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        if n > 1:
            out = written(out, "clean").leave()
            known.destroy()
    return out
