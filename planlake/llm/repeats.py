"""Exact substring dedup with fixed-block anchors.

Words are maximal runs of non-space bytes, unchanged. A stretch of SPAN words holds a whole aligned
block of SPAN // 2 words of whichever document it is in. So the aligned blocks of all documents are
indexed, every rolling window of that many words probes them, and a window that meets a block of another
document is an anchor (``anchors``). Each anchor is extended to both sides: the windows of SPAN words
that hold it are compared with those of all other documents around their anchors, whatever the number of
documents that share them, and consecutive ones that a document with a smaller id holds join to maximal
repeats (``repeats``).

Words are told apart by two independent hashes of 64 bits, windows by two hashes of 64 bits, each made
of one of the word hashes by mixing halves (not a polynomial, so no pattern of words cancels out): 128
bits for a comparison. Words of up to eight bytes of one length never share either hash.

Scale: hashes travel in packed columns, some five bytes for each word, dealt by hash ranges whose number
follows the corpus (BUCKET entries each). A map task folds what it sees of one hash in several
documents to one entry, so a passage that a third of all documents share costs one entry a task, and no
pairs of documents are ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import written

SPAN = 50
#: Entries of a hash range that one task holds, words at the most that a map task folds together.
BUCKET, UNIT = 2_000_000, 400_000
#: Hash ranges whose replies one task gathers by document, hashes of repeated windows that a map task remembers.
REPLIES, REMEMBERED = 2, 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03))
#: Bytes of a word that are hashed by eights side by side; longer ones go one by one.
_SIDE = 64
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64 = _SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of every data[start:end] (bytes); spans of one length up to eight bytes never share it."""
    eight = np.zeros(len(data) + _SIDE, np.uint64)
    eight[: len(data)] = data
    for i in (1, 2, 4):
        eight[:-i] |= eight[i:] << _U(8 * i)
    size = end - start
    out = _mix(seed + size.astype(np.uint64) * _U(0xA24BAED4963EE407))
    left = np.arange(len(size))
    for at in range(0, _SIDE, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        out[left] = _mix((out[left] ^ (eight[start[left] + at] & _KEEP[np.minimum(size[left] - at, 8)])) * seed + _U(at))
    for i in np.flatnonzero(size > _SIDE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), int(seed))
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray, seeds=_SEEDS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each seed the hash of every word of the texts data[bounds[i]:bounds[i + 1]], one after the other, and the words of each text."""
    if not len(data):
        return [np.empty(0, np.uint64) for _ in seeds], np.zeros(len(bounds) - 1, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds - bounds[0]] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return [span_hashes(data, start, end, s) for s in seeds], np.diff(np.searchsorted(start, bounds - bounds[0]))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k values of h: runs of 1, 2, 4 .. are mixed of their halves, k of two that overlap."""
    n = 1
    while 2 * n <= k:
        h = _mix(h[:-n] * _U(0x9FB21C651E98DF25) + (h[n:] ^ (h[n:] >> _U(29))) * _U(0xC2B2AE3D27D4EB4F) + _U(n))
        n *= 2
    return h if n == k else _mix(h[: len(h) - (k - n)] * _U(0x165667B19E3779F9) + (h[k - n :] ^ (h[k - n :] >> _U(29))) * _U(0x27D4EB2F165667C5))


def rolling(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of k words within one text: its hash, its text's number, and its place in the text."""
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    if not len(doc):
        return np.empty(0, np.uint64), doc, doc
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return run_hashes(h, k)[first[doc] + place], doc, place


class _Remembered:
    """Hashes (two for each) that a map task met in several documents, with a number each; the oldest half goes when it is full."""

    def __init__(self):
        self.keys = self.more = np.empty(0, np.uint64)
        self.values = np.empty(0, np.int64)

    def find(self, g: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is remembered, and its number."""
        if not len(self.keys):
            return np.zeros(len(g), bool), np.zeros(len(g), np.int64)
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        return (self.keys[at] == g) & (self.more[at] == more), self.values[at]

    def add(self, g: np.ndarray, more: np.ndarray, values: np.ndarray) -> None:
        keep = slice(0, REMEMBERED // 2 if len(g) + len(self.keys) > REMEMBERED else None)
        keys, more, values = (np.concatenate(x)[keep] for x in ((g, self.keys), (more, self.more), (values, self.values)))
        self.keys, at = np.unique(keys, return_index=True)
        self.more, self.values = more[at], values[at]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of x, all lowest first: high planes of small numbers are runs of zeros that shuffle compression takes away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("variants", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_PACKED_SQL = "part int, kind int, docs binary, variants binary, counts binary, gaps binary, low binary, high binary"
#: Kinds of packed rows: entries to compare; hashes that several documents hold (no reply is due); places already known.
_ENTRY, _SHARED, _KNOWN = 0, 1, 2


def _pack(part: np.ndarray, kind: int, ids: np.ndarray, variants: np.ndarray, doc: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[dict]:
    """One row for each part: documents, their numbers of entries, gaps between places, hash words. doc indexes ids."""
    if not len(part):
        return []
    order = np.lexsort((place, doc, part))
    part, doc, place = part[order], doc[order], place[order]
    low, high = (x[order] if len(x) else x for x in (low, high))
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    rows = []
    for a, b in zip(cut, cut[1:]):
        d, p = doc[a:b], place[a:b]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        gap = np.diff(p, prepend=0)
        gap[begin] = p[begin]
        of = d[begin]
        v = variants[of]
        rows.append({
            "part": int(part[a]), "kind": kind, "docs": _planes(ids[of]), "variants": _planes(v) if v.any() else b"", "counts": _planes(np.diff(np.append(begin, b - a)).astype(np.uint32)),
            "gaps": _planes(gap.astype(np.uint32)), "low": _planes(low[a:b]) if len(low) else b"", "high": _planes(high[a:b]) if len(high) else b"",
        })
    return rows


def _unpack(t: pa.Table, kind: int, low=np.uint32, high=None):
    """Documents (ids, variants) of all rows of a kind, and of every entry its document's number, place and hash words."""
    ids, variants, docs, places, lows, highs, n = [], [], [], [], [], [], 0
    for r in t.filter(pc.equal(t["kind"], kind)).to_pylist():
        i = _unplanes(r["docs"], np.int64)
        c = _unplanes(r["counts"], np.uint32).astype(np.int64)
        run = np.cumsum(_unplanes(r["gaps"], np.uint32).astype(np.int64))
        first = np.cumsum(c) - c
        # gaps of a document start from its first place
        base = np.where(first > 0, run[np.maximum(first - 1, 0)], 0)
        ids.append(i)
        variants.append(_unplanes(r["variants"], np.int64) if r["variants"] else np.zeros(len(i), np.int64))
        docs.append(np.repeat(np.arange(n, n + len(i)), c))
        places.append(run - np.repeat(base, c))
        if r["low"]:
            lows.append(_unplanes(r["low"], low))
        if r["high"]:
            highs.append(_unplanes(r["high"], high))
        n += len(i)
    cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
    return cat(ids, np.int64), cat(variants, np.int64), cat(docs, np.int64), cat(places, np.int64), cat(lows, low), cat(highs, high or np.uint64)


def _by_document(ids, variants, doc, place) -> pa.RecordBatch:
    """Rows doc_id, variant, places (uint32 bytes) of the entries."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order].astype(np.uint32)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
    of = doc[begin[:-1]] if len(doc) else np.empty(0, np.int64)
    body = [place[a:b].tobytes() for a, b in zip(begin, begin[1:])]
    return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(variants[of]), pa.array(body, pa.binary())], ["doc_id", "variant", "places"])


_FOUND_SQL = "doc_id long, variant long, places binary"


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and the group number of each row in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _units(batches: Iterator[pa.RecordBatch], extra: int = 0):
    """Texts of the batches in units of about UNIT words: ids, variants, extra columns, word hashes (one, with an extra column two), word counts."""
    for b in batches:
        text = b.column(2).cast(pa.large_binary())
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        body = text.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        ids, variants = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + 6 * UNIT, "right")) - 1)
            h, n = word_hashes(data[offs[at] : offs[to]], offs[at : to + 1], _SEEDS[: 1 + extra])
            yield ids[at:to], variants[at:to], [b.column(3 + i).slice(at, to - at) for i in range(extra)], h, n
            at = to


def _probe(parts: int, block: int):
    """Packed probes of all rolling windows; what one unit holds in several documents goes as one entry and its places as known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered()
        for ids, variants, _, (h,), n in _units(batches):
            g, doc, place = rolling(h, n, block)
            if not len(g):
                continue
            again, _ = known.find(g, g)
            home = _home(ids, parts)
            none = np.empty(0, np.uint32)
            rows = _pack(home[doc[again]], _KNOWN, ids, variants, doc[again], place[again], none, none)
            g, doc, place = g[~again], doc[~again], place[~again]
            if not len(g):
                yield pa.RecordBatch.from_pylist(rows, _PACKED)
                continue
            order, group = _groups(g)
            owner = ids[doc[order]]
            size = group[-1] + 1
            low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
            np.minimum.at(low, group, owner)
            np.maximum.at(high, group, owner)
            shared = np.zeros(len(g), bool)
            shared[order] = (low < high)[group]
            part, key = ((g >> _U(32)) % _U(parts)).astype(np.int64), g.astype(np.uint32)
            one = ~shared
            rows += _pack(part[one], _ENTRY, ids, variants, doc[one], place[one], key[one], none)
            if shared.any():
                first = order[np.flatnonzero(np.diff(group, prepend=-1))]
                first = first[shared[first]]
                rows += _pack(part[first], _SHARED, ids, variants, doc[first], place[first], key[first], none)
                rows += _pack(home[doc[shared]], _KNOWN, ids, variants, doc[shared], place[shared], none, none)
                known.add(g[first], g[first], np.zeros(len(first), np.int64))
            yield pa.RecordBatch.from_pylist(rows, _PACKED)

    return run


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    """The part that gathers what is found of a document."""
    return (_mix(ids.view(np.uint64) + _U(1)) % _U(homes)).astype(np.int64)


def _replies(ids: np.ndarray, variants: np.ndarray, doc: np.ndarray, place: np.ndarray, homes: int) -> pa.Table:
    """The places found, packed by the part that gathers them."""
    none = np.empty(0, np.uint32)
    return pa.Table.from_pylist(_pack(_home(ids, homes)[doc], _KNOWN, ids, variants, doc, place, none, none), _PACKED)


def _gather(t):
    """doc_id, variant, places of every document of one part of packed replies, each place once."""
    ids, variants, doc, place, _, _ = _unpack(t, _KNOWN)
    if not len(doc):
        return pa.Table.from_batches([_by_document(ids, variants, doc, place)])
    order, owner = _groups(ids, variants)
    number = np.empty(len(ids), np.int64)
    number[order] = owner
    first = order[np.flatnonzero(np.diff(owner, prepend=-1))]
    pairs = np.unique(np.stack([number[doc], place], 1), axis=0)
    return pa.Table.from_batches([_by_document(ids[first], variants[first], pairs[:, 0], pairs[:, 1])])


def _meet_anchors(block: int, homes: int):
    """Of one hash range: places whose hash is an aligned block of some document and stands in another one too."""

    def run(t):
        ids, variants, doc, place, key, _ = _unpack(t, _ENTRY)
        s_ids, _, s_doc, _, s_key, _ = _unpack(t, _SHARED)
        k_ids, k_variants, k_doc, k_place, _, _ = _unpack(t, _KNOWN)
        n = len(key)
        if n:
            order, group = _groups(np.concatenate([key, s_key]))
            owner = np.concatenate([ids[doc], s_ids[s_doc]])[order]
            size = group[-1] + 1
            low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
            np.minimum.at(low, group, owner)
            np.maximum.at(high, group, owner)
            # what a unit holds several times counts as indexed: at worst windows are compared in vain
            indexed = np.zeros(size, bool)
            indexed[group[np.concatenate([place % block == 0, np.ones(len(s_key), bool)])[order]]] = True
            several = low < high
            several[group[(np.arange(n + len(s_key)) >= n)[order]]] = True
            hit = np.zeros(n + len(s_key), bool)
            hit[order] = (indexed & several)[group]
            hit = hit[:n]
        else:
            hit = np.zeros(0, bool)
        return _replies(np.concatenate([ids, k_ids]), np.concatenate([variants, k_variants]), np.concatenate([doc[hit], k_doc + len(ids)]), np.concatenate([place[hit], k_place]), homes)

    return run


def _places(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.uint32).astype(np.int64) for x in column.to_pylist()]


def _windows(parts: int, span: int, block: int):
    """Packed windows of span words around the flagged anchors of each text; a window's first document in the unit speaks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered()
        for ids, variants, (found,), (h, h2), n in _units(batches, 1):
            near = np.zeros(int(np.maximum(n - span + 1, 0).sum()) + 1, np.int64)
            first = np.cumsum(np.maximum(n - span + 1, 0)) - np.maximum(n - span + 1, 0)
            for i, p in enumerate(_places(found)):
                windows = int(n[i]) - span + 1
                if windows > 0 and len(p):
                    a, b = np.clip(p - (span - block), 0, windows), np.clip(p + 1, 0, windows)
                    np.add.at(near, first[i] + a, 1)
                    np.add.at(near, first[i] + b, -1)
            g, doc, place = rolling(h, n, span)
            g2 = rolling(h2, n, span)[0]
            ok = np.cumsum(near)[:-1] > 0
            g, g2, doc, place = g[ok], g2[ok], doc[ok], place[ok]
            if not len(g):
                continue
            order, group = _groups(g, g2)
            owner = ids[doc[order]]
            least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, owner)
            # what an earlier unit of this task held counts too
            first = order[np.flatnonzero(np.diff(group, prepend=-1))]
            again, before = known.find(g[first], g2[first])
            early = again & (before < least)
            floor = np.where(early, before, least)
            late = np.zeros(len(g), bool)
            late[order] = owner > floor[group]
            several = np.bincount(group) > 1
            if several.any():
                known.add(g[first[several]], g2[first[several]], floor[several])
            part = (g2 >> _U(32)) % _U(parts)
            one = ~late
            rows = _pack(part[one].astype(np.int64), _ENTRY, ids, variants, doc[one], place[one], g2[one], g[one])
            if late.any():
                home = _home(ids, parts)
                none = np.empty(0, np.uint32)
                rows += _pack(home[doc[late]], _KNOWN, ids, variants, doc[late], place[late], none, none)
            yield pa.RecordBatch.from_pylist(rows, _PACKED)

    return run


def _meet_windows(homes: int):
    """Of one hash range: places of windows that a document with a smaller id holds too."""

    def run(t):
        ids, variants, doc, place, low, high = _unpack(t, _ENTRY, np.uint64, np.uint64)
        k_ids, k_variants, k_doc, k_place, _, _ = _unpack(t, _KNOWN)
        late = np.zeros(len(low), bool)
        if len(low):
            order, group = _groups(high, low)
            owner = ids[doc[order]]
            least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, owner)
            late[order] = owner > least[group]
        return _replies(np.concatenate([ids, k_ids]), np.concatenate([variants, k_variants]), np.concatenate([doc[late], k_doc + len(ids)]), np.concatenate([place[late], k_place]), homes)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, variant, text. variant tells texts of one id apart; it is 0 where no id repeats."""
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    variant = F.lit(0).cast("long") if several else F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), variant.alias("variant"), F.col("text").cast("string").alias("text"))


def _repeated(keyed: DataFrame, span: int) -> DataFrame:
    """doc_id, variant, places: first words of the windows to remove (uint32 bytes)."""
    block = span // 2
    texts = keyed.where("doc_id is not null and text is not null")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // (6 * BUCKET)))
    homes = -(-parts // REPLIES)
    probes = texts.mapInArrow(_probe(parts, block), _PACKED_SQL)
    hits = probes.groupBy("part").applyInArrow(_meet_anchors(block, homes), _PACKED_SQL)
    anchors = written(hits.groupBy("part").applyInArrow(_gather, _FOUND_SQL), "anchors")
    near = texts.join(anchors.df.hint("merge"), ["doc_id", "variant"]).select("doc_id", "variant", "text", "places")
    late = near.mapInArrow(_windows(parts, span, block), _PACKED_SQL).groupBy("part").applyInArrow(_meet_windows(homes), _PACKED_SQL)
    out = written(late.groupBy("part").applyInArrow(_gather, _FOUND_SQL), "repeats")
    anchors.drop()
    return out.leave()


def removed_mask(n_words: int, places: np.ndarray, span: int) -> np.ndarray:
    """Which words the windows that start at places cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + span, n_words), -1)
    return np.cumsum(edge)[:-1] > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept of every row of docs (doc_id, text).

    spans: maximal stretches of words (start, end) that windows of span words cover which a document
    with a smaller doc_id holds too; kept: the other words joined by one space. All is judged on the
    input. Null and empty texts have no words and an empty kept. Rows that share a doc_id never remove
    each other's words. Rows with a null doc_id neither lose nor remove any. Empty tables give no rows.
    """
    if span < 2:
        raise ValueError("a span has two words at least")
    keyed = _keyed(docs)
    found = _repeated(keyed, span).select(F.col("doc_id").alias("_d"), F.col("variant").alias("_v"), "places")
    rows = keyed.join(found.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("variant") == F.col("_v")), "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, p in zip(b.column(1).cast(pa.binary()).to_pylist(), _places(b.column(2))):
                words = (text or b"").split()
                mask = removed_mask(len(words), p, span)
                n_words.append(len(words))
                n_removed.append(int(mask.sum()))
                spans.append([{"start": a, "end": z} for a, z in spans_of(mask)])
                kept.append(b" ".join(w for w, gone in zip(words, mask.tolist()) if not gone) if len(p) else b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
