"""Token-ID output: documents to ids, ids to files of coded blocks, and back.

A file set is a table of segments in the order of doc_id. A segment holds whole documents, about
SEGMENT ids: their doc_ids and lengths, and their ids in blocks of coder.BLOCK that are coded
independently and checksummed. (What a task holds of little data is cut into shorter blocks, so that
LANES of them can be coded side by side.) Spark's commit protocol writes it, so a lost executor's half-written
files never count, and any split of it can be read alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import coder
from ._io import written

SEGMENT = 1 << 20
#: Segments whose blocks are coded side by side, and blocks that it takes to do so well.
TOGETHER, LANES = 10, 256
#: Bytes of text that one task encodes.
PART_BYTES = 24 << 20
END = 2
_CACHE = 100_000
#: Texts that split_pieces can split: characters below U+0250 but the apostrophe.
_PLAIN = re.compile("[\x00-&(-ɏ]*")


#: Where a long text can be cut: a blank between letters always starts a piece.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters that a packed piece can have; masks of the bits of so many of them in a word.
_PACKED, _BITS = 12, np.array([(1 << 10 * i) - 1 for i in range(7)], np.uint64)
#: Longer pieces than this are not kept.
_KEPT = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed_pieces(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words that hold the characters (below U+0250) of pieces of up to _PACKED of them, ten bits each."""
    c = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(_PACKED, np.uint64)])
    six = c.copy()
    for i in range(1, 6):
        six[:-i] |= c[i:] << np.uint64(10 * i)
    return six[start] & _BITS[np.minimum(size, 6)], six[start + 6] & _BITS[np.clip(size - 6, 0, 6)]


_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_CLASS = np.array([_LETTER if regex.match(r"\p{L}", chr(c)) else _NUMBER if regex.match(r"\p{N}", chr(c)) else _SPACE if regex.match(r"\s", chr(c)) else _OTHER for c in range(0x250)], np.uint8)


def split_pieces(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of texts laid end to end, and each piece's text. For code points below U+0250 without apostrophes.

    A piece is a run of letters, numbers or other signs, with one blank before it if there is one. Of a
    run of white space before something else, all but the last sign are a piece, and the last is one
    unless it is that blank; at the end of a text the run is one piece.
    """
    n = len(codes)
    kind = _CLASS[codes]
    ends = np.cumsum(sizes)
    first = np.zeros(n + 1, bool)
    first[ends - sizes] = True
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:-1]
    at = np.flatnonzero(last)
    start[at] = True
    start[at[codes[at] == 0x20] + 1] = False
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(ends, starts, "right")


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary encodes each piece of the pre-tokenizer's split by itself, so distinct pieces are
    encoded once and kept: short ones packed into two words, which are found by a hash and compared
    whole, longer ones as strings, very long ones not at all. Texts with characters beyond U+024F, with
    an apostrophe (which has rules of its own) or with a special token's string go through the library
    whole, as do texts with a piece whose hash another piece has.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys = self.first = self.second = np.empty(0, np.uint64)
        self.entry, self.long = np.empty(0, np.int64), {}
        self.pool, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _add(self, pieces: list[str]) -> np.ndarray:
        """Entries of new pieces."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        entry = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(ids))
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        return entry

    def _short(self, joined: str, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of packed pieces, and which of them are other pieces than their hash's."""
        first, second = packed_pieces(codes, start, size)
        key, at, back = np.unique(_mixed(first + _mixed(second + np.uint64(0x9E3779B97F4A7C15))), return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, key)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == key[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            at = at[fresh]
            entry = self._add([joined[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist())])
            keys = np.concatenate([self.keys, key[fresh]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.first, self.second = np.concatenate([self.first, first[at]])[order], np.concatenate([self.second, second[at]])[order]
            self.entry = np.concatenate([self.entry, entry])[order]
            found = np.searchsorted(self.keys, key)
        found = found[back]
        return self.entry[found], (self.first[found] != first) | (self.second[found] != second)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts that split_pieces can split."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return [np.empty(0, np.int32)] * len(texts)
        if len(self.ends) > _CACHE:
            self.clear()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start, text = split_pieces(codes, sizes)
        size = np.diff(np.append(start, len(codes)))
        entry, odd = np.empty(len(start), np.int64), np.zeros(len(start), bool)
        short = size <= _PACKED
        entry[short], odd[short] = self._short(joined, codes, start[short], size[short])
        long = np.flatnonzero(~short)
        pieces = [joined[a : a + n] for a, n in zip(start[long].tolist(), size[long].tolist())]
        new = [p for p in dict.fromkeys(pieces) if p not in self.long]
        once = dict(zip(new, self._add(new).tolist())) if new else {}
        entry[long] = [self.long[p] if p in self.long else once[p] for p in pieces]
        self.long.update((p, e) for p, e in once.items() if len(p) <= _KEPT)
        begin, size = self.ends[entry], self.ends[entry + 1] - self.ends[entry]
        done = np.cumsum(size)
        flat = self.pool[np.repeat(begin - done + size, size) + np.arange(done[-1])]
        pieces = np.bincount(text, minlength=len(texts))
        cut = np.concatenate([[0], done])[np.cumsum(pieces)]
        out = np.split(flat, cut[:-1])
        for i in np.unique(text[odd]).tolist():
            out[i] = self._whole(texts[i])
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def encode(self, texts: list[str], chunk: int = 1 << 20) -> list[np.ndarray]:
        """Ids of every text; about chunk characters are split at a time, also of a longer text."""
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        part: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            if not plain[i]:
                out[i] = self._whole(t)
            elif len(t) > chunk:
                out[i] = np.concatenate([self._ids([piece])[0] for piece in _stretches(t, chunk)])
            else:
                part.append(i)
                held += len(t)
            if part and (held >= chunk or i == len(texts) - 1):
                for k, ids in zip(part, self._ids([texts[k] for k in part])):
                    out[k] = ids
                part, held = [], 0
        return out


def _stretches(text: str, chunk: int) -> Iterator[str]:
    """A plain text in stretches of about chunk characters that start with a piece."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + chunk)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder: what it knows lasts from task to task."""
    return Encoder(path)


def _schema(kind: str) -> str:
    return f"part int, segment int, doc_ids array<{kind}>, doc_sizes array<int>, n_ids long, block_ids int, blocks array<binary>"


def write_ids(docs: DataFrame, tokenizer: str, block: int = coder.BLOCK, segment: int = SEGMENT):
    """Encode docs (doc_id, text) and write them as a file set; returns the written table.

    Documents go by ascending doc_id (null first, equal ids by text). Null text is empty: only the end
    id. Repeated rows are written as often as they come.
    """
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), pa.int64()

    def encoded(batches):
        """doc_id and ids of every row, some hundred rows at a time."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for name, x in zip(some.column(0).to_pylist(), encoder(tokenizer).encode([t or "" for t in some.column(1).to_pylist()])):
                    yield name, np.append(x, END).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ready: list[tuple[list, list[np.ndarray]]] = []
        ids, docs, held = [], [], 0

        def flush(ready):
            nonlocal n
            cut, total = [], sum(len(d) for _, x in ready for d in x)
            size = min(block, max(1024, -(-total // LANES)))
            for _, x in ready:
                flat = np.concatenate(x)
                cut.append([flat[i : i + size] for i in range(0, len(flat), size)])
            coded = iter(coder.encode_blocks([b for c in cut for b in c]))
            rows = []
            for (names, x), c in zip(ready, cut):
                rows.append({"part": part, "segment": n, "doc_ids": names, "doc_sizes": [len(d) for d in x], "n_ids": sum(map(len, x)), "block_ids": size, "blocks": [next(coded) for _ in c]})
                n += 1
            return rows

        out_type = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(id_type)), ("doc_sizes", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("blocks", pa.list_(pa.binary()))])
        for name, x in encoded(batches):
            ids.append(name)
            docs.append(x)
            held += len(x)
            if held >= segment:
                ready.append((ids, docs))
                ids, docs, held = [], [], 0
                if len(ready) == TOGETHER:
                    yield pa.RecordBatch.from_pylist(flush(ready), out_type)
                    ready = []
        if ids:
            ready.append((ids, docs))
        if ready:
            yield pa.RecordBatch.from_pylist(flush(ready), out_type)

    if kind not in ("bigint", "int"):
        id_type = pa.string()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if kind == "int":
        rows, kind = rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), "bigint"
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranged = rows.repartitionByRange(max(1, -(-total // PART_BYTES)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ranged.mapInArrow(run, _schema(kind)), "token-ids")


def decode_segments(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list[np.ndarray]]]:
    """(row, doc_ids, ids of each document) of the segments of a batch of a file set."""
    blocks = batch.column("blocks").to_pylist()
    at = 0
    while at < len(blocks):
        group = blocks[at : at + TOGETHER]
        ids = iter(coder.decode_blocks([x for b in group for x in b]))
        for i, b in enumerate(group):
            row = at + i
            flat = np.concatenate([next(ids) for _ in b])
            sizes = batch.column("doc_sizes")[row].as_py()
            if len(flat) != sum(sizes) or len(flat) != batch.column("n_ids")[row].as_py():
                raise ValueError("a segment's ids and its documents' sizes differ")
            yield row, batch.column("doc_ids")[row].as_py(), np.split(flat, np.cumsum(sizes)[:-1])
        at += TOGETHER


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a file set, from its decoded ids.

    start counts the ids of all documents before it: parts are added up first, then segments in a part.
    """
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    before_part = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    small = files.select("part", "segment", "n_ids")
    parts = small.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("base"))
    starts = small.join(parts.hint("merge"), "part").select("part", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, names, ids in decode_segments(b):
                sizes = np.array([len(x) for x in ids], np.int64)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                n = len(names)
                cols = [pa.array(np.full(n, b.column(i)[row].as_py(), np.int32)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, b.schema.field("doc_ids").type.value_type), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    # as many tasks as wrote the files, so that each has many blocks to decode side by side
    whole = files.coalesce(max(1, parts.count()))
    read = whole.mapInArrow(run, f"part int, segment int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts.hint("merge"), ["part", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs' ids and return read_ids() of the files. An empty table gives no rows."""
    return read_ids(write_ids(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json")).leave())
