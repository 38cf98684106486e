"""Exact ranked lexical search by a document FP-tree and branch and bound.

A document keeps only those of its terms that some item has, in order of falling document frequency. A
shard of documents in the order of these vectors is a prefix tree: documents that begin alike share a path,
and every subtree is a range of documents. A node knows the largest tf of each term and the smallest m in
its subtree, hence a score that no document below it can exceed. Each item goes down the tree depth first,
best child first, and leaves out a subtree only if it cannot reach the item's k-th best score; documents
of small subtrees are scored exactly, all at once. Best scores are carried from shard to shard of a task.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import written

#: Best documents of an item; documents and postings of a shard; documents of a subtree that is scored whole.
K, SHARD, POSTINGS, BUCKET = 10, 16_384, 2_000_000, 16
#: Bytes of item texts of one pass; more items go in several passes over the documents.
PASS_BYTES = 4 << 20
#: Parts that an item's candidates are dealt to before they meet.
PARTS = 64
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, A-Z lower-cased, a piece at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text[at:end].lower())  # bytes lower only A-Z
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gain(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score; never less for more tf or less m."""
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Tree:
    """FP-tree of some documents: ids, m, and vectors as offsets into term and tf. Terms are numbered by falling document frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, offs: np.ndarray, term: np.ndarray, tf: np.ndarray):
        rows = [term[a:z].astype(">u4").tobytes() for a, z in zip(offs, offs[1:])]
        order = sorted(range(len(rows)), key=rows.__getitem__)
        size = np.diff(offs)[order]
        take = np.repeat(offs[:-1][order] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        self.ids, self.m, self.term, self.tf = ids[order], m[order], term[take], tf[take]
        self.offs = np.concatenate([[0], np.cumsum(size)])
        alike = [0] * len(order)  # terms that a document shares with the one before it
        for i in range(1, len(order)):
            a, b = rows[order[i - 1]], rows[order[i]]
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                n = int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())
            alike[i] = n // 4
        self.alike = np.array(alike)
        #: by node: range of documents, least m, children; and by term: nodes that have it below them, with the largest tf
        self.low, self.high, self.children = [], [], []
        self._grow(len(order))
        found = self._maxima()
        node = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        what, most = (np.concatenate(x) for x in zip(*found))
        sort = np.lexsort((node, what))
        self.node, self.most = node[sort], most[sort]
        self.what, cut = np.unique(what[sort], return_index=True)
        self.cut = np.append(cut, len(self.node))

    def _grow(self, n: int) -> None:
        """Nodes over n documents, each before its children; a path without branches is one node."""
        todo = [(0, n, -1)]
        while todo:
            a, z, parent = todo.pop()
            if parent >= 0:
                self.children[parent].append(len(self.low))
            me = len(self.low)
            self.low.append(a), self.high.append(z), self.children.append([])
            if z - a > BUCKET:
                todo += [(lo, hi, me) for lo, hi in self._parts(a, z)]

    def _parts(self, a: int, z: int) -> list[tuple[int, int]]:
        """Subtrees where documents a .. z part after the path that all share; small neighbours stay together."""
        inner = self.alike[a + 1 : z]
        cuts = [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist(), z]
        out = [(a, cuts[1])]
        for lo, hi in zip(cuts[1:], cuts[2:]):
            if hi - out[-1][0] <= BUCKET:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    def _maxima(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and largest tf below every node, from the last to the first; also sets least m."""
        out: list = [None] * len(self.low)
        least = np.empty(len(self.low), np.int64)
        for me in range(len(self.low) - 1, -1, -1):
            if self.children[me]:
                t, f = (np.concatenate(x) for x in zip(*(out[c] for c in self.children[me])))
                least[me] = least[self.children[me]].min()
            else:
                some = slice(self.offs[self.low[me]], self.offs[self.high[me]])
                t, f = self.term[some], self.tf[some]
                least[me] = self.m[self.low[me] : self.high[me]].min()
            order = np.lexsort((-f, t))
            first = order[np.flatnonzero(np.diff(t[order], prepend=-1))]
            out[me] = (t[first], f[first])
        self.least = least
        return out

    def search(self, terms: np.ndarray, w: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Put an item's documents among its best, a heap of (score, -id)."""
        at = np.searchsorted(self.what, terms)
        here = (at < len(self.what)) & (self.what[np.minimum(at, len(self.what) - 1)] == terms) if len(self.what) else np.zeros(len(terms), bool)
        terms, w, at = terms[here], w[here], at[here]
        if not len(terms):
            return
        bound = np.zeros(len(self.low), np.int64)
        for i, x in zip(at.tolist(), w):
            n = self.node[self.cut[i] : self.cut[i + 1]]
            bound[n] += gain(x, self.most[self.cut[i] : self.cut[i + 1]], self.least[n])
        todo = [0]
        while todo:
            me = todo.pop()
            floor = best[0][0] if len(best) == k else 1
            if bound[me] < floor:
                continue
            if self.children[me]:
                todo += sorted((c for c in self.children[me] if bound[c] >= floor), key=bound.__getitem__)
                continue
            a, z = self.low[me], self.high[me]
            some = slice(self.offs[a], self.offs[z])
            t = self.term[some]
            i = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            hit = np.flatnonzero(terms[i] == t)
            row = np.repeat(np.arange(z - a), np.diff(self.offs[a : z + 1]))[hit]
            score = np.zeros(z - a, np.int64)
            np.add.at(score, row, gain(w[i[hit]], self.tf[some][hit], self.m[a:z][row]))
            for r in np.flatnonzero(score >= floor).tolist():
                entry = (int(score[r]), -int(self.ids[a + r]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


_VECTOR = "doc_id long, n long, term array<int>, tf array<long>"


def _vectors(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and numbers and tf of those terms that are known."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            n, ts, fs = [], [], []
            for text in b.column(1):
                count: Counter = Counter()
                for piece in terms(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    count.update(map(number, piece))
                n.append(count.total())
                count.pop(None, None)
                ts.append(list(count.keys())), fs.append(list(count.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ts, pa.list_(pa.int32())), pa.array(fs, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _VECTOR)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in shards of at most SHARD documents and about POSTINGS terms."""
    waiting, n, size = [], 0, 0
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            postings = len(part.column(2).flatten())
            if waiting and (n + part.num_rows > SHARD or size + postings > POSTINGS):
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, n, size = [], 0, 0
            waiting.append(part)
            n, size = n + part.num_rows, size + postings
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The search for items (item_id, text) whose texts fit one pass."""
    wanted: dict[int, set[bytes]] = {}
    for r in items.toLocalIterator():
        for piece in terms((r["text"] or "").encode()):
            wanted.setdefault(r["item_id"], set()).update(piece)
    known = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
    vectors = written(_vectors(docs, known), "lexical-vectors").leave()
    n_docs, total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict.fromkeys(range(len(known)), 0) | {r[0]: r[1] for r in vectors.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator()}
    place = np.empty(len(known), np.int32)
    place[sorted(df, key=lambda t: (-df[t], t))] = np.arange(len(known), dtype=np.int32)
    asked = []
    for item, words in wanted.items():
        own = sorted((int(place[known[t]]), weight(n_docs, df[known[t]])) for t in words)
        asked.append((item, np.array([p for p, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast((place, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asked = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for t in _shards(batches):
            lists = t["term"].combine_chunks()
            term = place[lists.values.to_numpy()].astype(np.int64)
            tf, offs = t["tf"].combine_chunks().values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(t.num_rows), np.diff(offs))
            order = np.lexsort((term, row))
            tree = Tree(t["doc_id"].to_numpy(), t["m"].to_numpy(), offs, term[order], tf[order])
            for (_, terms_, w), own in zip(asked, best):
                tree.search(terms_, w, own, k)
        rows = [(item, -i, s) for (item, *_), own in zip(asked, best) for s, i in own]
        for at in range(0, len(rows), 10_000):
            cols = list(zip(*rows[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

    m = F.expr(f"10 + cast((cast(90 as decimal(3)) * n * cast({n_docs} as decimal(16))) div cast({max(total, 1)} as decimal(20)) as long)").alias("m")
    ready = vectors.where("size(term) > 0 and doc_id is not null").select("doc_id", m, "term", "tf")
    return ready.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of every item (item_id, text) the k documents (doc_id, text) with the highest scores above 0.

    Rows that share an item_id are one item with the terms of all; null item_ids are left out. Rows that
    share a doc_id are documents of their own and may both be named; rows with a null doc_id count in the
    statistics and are never named. Null and empty texts have no terms and are no documents of N. Equal
    scores go by ascending doc_id. Fewer documents give fewer ranks, empty tables no rows; other columns
    do not matter. Items beyond pass_bytes of text go in several passes, each over all documents.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    passes = max(1, -(-size // pass_bytes))
    out = None
    for i in range(passes):
        found = _pass(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i), k)
        out = out.unionByName(found) if out is not None else found
    # every task of the last pass names k documents an item: they meet in PARTS first
    out = out.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for by in (["item_id", "_part"], ["item_id"]):
        order = W.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id")
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
with t as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
s as (select count(*) as n, cast(sum(len(terms)) as bigint) as l from t where len(terms) > 0),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where item_id is not null),
p as (select row, term, count(*) as tf from (select row, unnest(terms) as term from t) x group by row, term),
w as (select term, cast(floor(1000 * ln(cast(2 * s.n + 2 as double) / (2 * count(*) + 1))) as bigint) as w from p, s where term in (select term from q) group by term, s.n),
d as (select doc_id, row, 10 + (90 * len(terms) * s.n) // s.l as m from t, s where len(terms) > 0 and doc_id is not null),
r as (
  select q.item_id, d.row, d.doc_id, cast(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * d.m))) as bigint) as score
  from q join w on w.term = q.term join p on p.term = q.term join d on d.row = p.row group by q.item_id, d.row, d.doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from r where score > 0 qualify rank <= 10
"""
