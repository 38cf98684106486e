"""Exact top-k inner products by an impact-ordered score-at-a-time index.

A component's impact is its magnitude, quantised to LEVELS bands that halve. The index of a shard of
vectors holds one posting segment a band and dimension: the vectors with a component of that impact
there, and the components. For a block of queries the segments are processed by descending impact, each
adding to the scores of its own vectors only. After each band a query's score is known to within |query| *
|rest of the vector|; a vector stays a possible member while its upper end is not below the k-th best
lower end. A query stops once so few vectors are possible that rescoring them is cheaper than the next
band, or the bands are through, and only on that proof; possible members are rescored exactly, over all
components. Other queries of the block go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import written

K, LEVELS, SHARD, QUERIES, FEW = 5, 4, 8192, 256, 0.02
#: Bytes of queries that are broadcast, or that one block of them has: more queries go in blocks, which are joined with the shards.
PASS_BYTES = 32 << 20
#: Parts that the shards are dealt to for each block of queries.
DEALT = 64
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: vectors as doubles. Those that are null or hold null, NaN or infinite components are left out, no others."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    return rows.where(F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))))


def dense(lists: pa.Array) -> np.ndarray:
    """Rows of components; short vectors are padded with zeros, which add nothing to an inner product."""
    flat, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(offs)
    out = np.zeros((len(size), int(size.max(initial=0))))
    if len(flat):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], size)] = flat[offs[0] : offs[-1]]
    return out


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x); for numbers too large to hold that as a double, infinity."""
    with np.errstate(over="ignore"):
        return np.floor(x * 256)


def whole(row: np.ndarray) -> list[int]:
    """floor(256 * x) of finite doubles of any size, as Python integers."""
    return [256 * int(c) if abs(c) > 2.0**60 else int(np.floor(c * 256)) for c in row.tolist()]


class Shard:
    """Posting segments of some vectors by descending impact, and what is left of each vector after each band."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        self.ids, self.x = ids, x
        size = np.abs(x)
        top = float(size.max(initial=0))
        self.bands, self.rest = [], []
        done = np.zeros(x.shape, bool)
        for e in [*(top / 2 ** (i + 1) for i in range(levels - 1)), 0.0]:
            now = (size > e) & ~done
            done |= now
            dim, row = np.nonzero(now.T)
            cut = np.searchsorted(dim, np.arange(x.shape[1] + 1))
            self.bands.append([(j, row[a:z], x[row[a:z], j]) for j, (a, z) in enumerate(zip(cut, cut[1:])) if z > a])
            self.rest.append(np.sqrt((np.where(done, 0, x) ** 2).sum(1)) * (1 + 1e-9))

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        """Possible members by (query row, vector row), with their exact scores; every top-k member is among them. floor: scores already reached k times."""
        norm = np.sqrt((q**2).sum(1)) * (1 + 1e-9)
        live, score = np.arange(len(q)), np.zeros((len(self.x), len(q)))
        out = []
        for level, (band, rest) in enumerate(zip(self.bands, self.rest)):
            by_dim = np.ascontiguousarray(q[live].T)
            for j, rows, values in band:
                score[rows] += values[:, None] * by_dim[j]
            slack = rest[:, None] * norm[live] + 1e-3
            own = self.ids[:, None] == q_ids[live]
            low = np.where(own, -np.inf, score - slack)
            bar = np.partition(low, -k, axis=0)[-k] if len(low) >= k else np.full(len(live), -np.inf)
            possible = (score + slack >= np.maximum(bar, floor[live])) & ~own
            stops = (possible.mean(0) <= FEW) | (level == len(self.bands) - 1)
            r, c = np.nonzero(possible[:, stops])
            out.append((live[stops][c], r))
            live, score = live[~stops], np.ascontiguousarray(score[:, ~stops])
            if not len(live):
                break
        c, r = (np.concatenate(x) for x in zip(*out))
        return c, r, np.einsum("ij,ij->i", q[c], self.x[r])


def _best(q: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query: highest score, then smaller vec_id."""
    order = np.lexsort((vec, ~score, q))
    q, vec, score = q[order], vec[order], score[order]
    begin = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    keep = rank < k
    return q[keep], vec[keep], score[keep]


class Search:
    """The best k so far of a block of queries against the shards it meets."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int):
        self.numbers, self.ids, self.raw, self.q, self.k = numbers, ids, q, quantised(q), k
        self.best = [(np.empty(0, np.int64),) * 3 for _ in range(0, len(ids), QUERIES)]

    def _keep(self, i: int, c: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        q, v, s = self.best[i]
        self.best[i] = _best(np.concatenate([q, c]), np.concatenate([v, vec]), np.concatenate([s, score]), self.k)

    def meet(self, ids: np.ndarray, raw: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        wide = max(raw.shape[1], self.q.shape[1], 1)
        pad = lambda a: np.pad(a, ((0, 0), (0, wide - a.shape[1])))
        x, q = pad(quantised(raw)), pad(self.q)
        most = 2.0 ** ((52 - np.ceil(np.log2(wide))) // 2)  # sums of products up to here are exact doubles
        plain, usual = np.abs(x).max(1) < most, np.abs(q).max(1) < most
        shard = Shard(ids[plain], x[plain]) if plain.any() else None
        for i, at in enumerate(range(0, len(self.ids), QUERIES)):
            some = np.arange(at, min(at + QUERIES, len(self.ids)))
            if shard and usual[some].any():
                rows = some[usual[some]]
                bq, _, bs = self.best[i]
                floor = np.full(QUERIES, np.inf)
                np.minimum.at(floor, bq, bs.astype(float))
                floor[np.bincount(bq, minlength=QUERIES) < self.k] = -np.inf
                c, r, s = shard.search(self.ids[rows], q[rows], floor[rows - at], self.k)
                self._keep(i, rows[c] - at, shard.ids[r], s.astype(np.int64))
            # what is too large for doubles goes by Python integers
            for c in some.tolist():
                for r in (np.flatnonzero(~plain) if usual[c] else np.arange(len(ids))).tolist():
                    if ids[r] != self.ids[c]:
                        score = sum(a * b for a, b in zip(whole(self.raw[c]), whole(raw[r])))
                        self._keep(i, np.array([c - at]), ids[r : r + 1], np.array([min(max(score, -_LONG - 1), _LONG)], np.int64))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, (c, v, s) in enumerate(self.best):
            if len(c):
                c = c + i * QUERIES
                yield pa.RecordBatch.from_arrays([pa.array(self.numbers[c]), pa.array(self.ids[c]), pa.array(v), pa.array(s)], ["number", "query_id", "vec_id", "score"])


_FOUND = "number long, query_id long, vec_id long, score long"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and components of SHARD rows at a time (vec_id, v)."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        waiting.append(b)
        if sum(w.num_rows for w in waiting) >= SHARD:
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
            yield t["vec_id"].to_numpy(), dense(t["v"].combine_chunks())
    if waiting:
        t = pa.Table.from_batches(waiting).combine_chunks()
        if t.num_rows:
            yield t["vec_id"].to_numpy(), dense(t["v"].combine_chunks())


def _packed_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, x in _shards(batches):
        yield pa.RecordBatch.from_pylist([{"ids": ids.tobytes(), "x": x.tobytes()}], pa.schema([("ids", pa.binary()), ("x", pa.binary())]))


def _matrix(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(x, np.float64).reshape(len(ids), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: of every row of queries the k rows of vectors with the highest inner product of floor(256 * component).

    Both have vec_id, v (arrays of doubles, see usable). A row is no candidate for a query of its own id.
    Ties go to the smaller vec_id. Rows that share an id are queries and candidates of their own, so such
    a query_id has every rank several times. Rows with a null id take no part. Scores beyond a long are given, and
    ranked, as its ends. Fewer candidates than k give fewer rows; empty tables give none.

    Queries of up to pass_bytes are broadcast. More go in blocks of that size, each joined with all
    shards of vectors: a stated query set against all rows, in blocks.
    """
    vectors, queries = vectors.where("vec_id is not null"), queries.where("vec_id is not null").select("vec_id", "v")
    asked = written(queries.withColumn("number", F.monotonically_increasing_id()), "queries").leave()
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    if size <= pass_bytes:
        rows = asked.toArrow().combine_chunks()
        known = vectors.sparkSession.sparkContext.broadcast((rows["number"].to_numpy(), rows["vec_id"].to_numpy(), dense(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(*known.value, k)
            for ids, x in _shards(batches):
                search.meet(ids, x)
            yield from search.rows()

        out = vectors.select("vec_id", "v").mapInArrow(run, _FOUND)
    else:
        blocks = -(-size // pass_bytes)

        def packed(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            body = dense(t["v"].combine_chunks())
            return pa.table({"block": t["block"][:1], "numbers": [t["number"].to_numpy().tobytes()], "q_ids": [t["vec_id"].to_numpy().tobytes()], "q": [body.tobytes()]})

        def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, now = None, None
            for b in batches:
                for r in b.to_pylist():
                    if r["block"] != now:
                        if search:
                            yield from search.rows()
                        search, now = Search(np.frombuffer(r["numbers"], np.int64), *_matrix(r["q_ids"], r["q"]), k), r["block"]
                    search.meet(*_matrix(r["ids"], r["x"]))
            if search:
                yield from search.rows()

        block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
        dealt = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("dealt")
        cut = written(asked.withColumn("block", block).groupBy("block").applyInArrow(packed, "block int, numbers binary, q_ids binary, q binary"), "query-blocks").leave()
        shards = written(vectors.select("vec_id", "v").mapInArrow(_packed_shards, "ids binary, x binary"), "shards").leave()
        left = shards.withColumn("dealt", F.pmod(F.xxhash64("ids"), F.lit(DEALT)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))
        out = left.join(cut.select("*", dealt).hint("merge"), ["block", "dealt"]).mapInArrow(tiles, _FOUND)
    order = W.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
