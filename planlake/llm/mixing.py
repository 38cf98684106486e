"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source may be taken target / size-of-source times. The whole part is taken as it
is; the fractional part is a probability that pivotal rounding settles: two open documents exchange
words of expected mass, in a random direction, until one of them is in or out, which leaves the
source's expected words as they are. Leaves of the reduction tree are buckets of about LEAF documents
of one source (a hot source only has more buckets, and rows that repeat are dealt over them); each sends
on at most one open document, and levels of FAN buckets are combined until each source has one open
document, which is in with the probability that it has come to. So every document is taken with its own
probability, and the source's words miss its target by less than that last document.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import BROADCAST_BYTES, free, written

WORD = r"[^\x20\x09-\x0D]+"
LEAF, FAN = 2048, 1024
#: Rows that one row of repeats is spread to at a time.
SPREAD = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (of the text), rows: rows of docs that are alike in these are one."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    return rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("rows"))


def targets(by_source: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table source, source_size.

    Sources in order of code points, null last, take the weights in turn. A source's target stops at
    most times its size; what it cannot take is shared by weight among the others. In order of
    size / weight, a source is full exactly if the level that the rest would get without it is above
    its own, so two running sums replace the repeated sharing.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    x = by_source.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("level", F.col("cap") / F.col("weight"))
    fill = W.orderBy("level", F.col("source").asc_nulls_last())
    every = W.partitionBy()
    x = x.withColumn("before", F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("open_weight", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    x = x.withColumn("offer", (F.col("total") - F.coalesce("before", F.lit(0.0))) / F.col("open_weight"))
    x = x.withColumn("shared", F.max(F.when(F.col("offer") < F.col("level"), F.col("offer"))).over(every))
    return x.select("source", "source_size", F.when(F.col("shared").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("shared") * F.col("weight"))).alias("target"))


def settle(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one bucket in the given order: p settled to 0 or 1 but for one index (-1: none)."""
    p, open_ = p.astype(float).copy(), -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if open_ < 0:
            open_ = j if 0 < p[j] < 1 else -1
            continue
        i = open_
        up_i = min(size[i] * (1 - p[i]), size[j] * p[j])
        up_j = min(size[i] * p[i], size[j] * (1 - p[j]))
        if draws[j] * (up_i + up_j) < up_j:
            one, other, moved = i, j, up_i
        else:
            one, other, moved = j, i, up_j
        fills, empties = size[one] * (1 - p[one]), size[other] * p[other]
        p[one] = 1.0 if fills <= empties else p[one] + moved / size[one]
        p[other] = 0.0 if empties <= fills else p[other] - moved / size[other]
        left = [k for k in (i, j) if 1e-12 < p[k] < 1 - 1e-12]
        for k in (i, j):
            if k not in left:
                p[k] = round(p[k])
        open_ = left[0] if left else -1
    return p, open_


def spread(rows: DataFrame, times: str, nth: str, most: int) -> DataFrame:
    """rows, each as often as its column times says (at least once, most times at most), numbered nth from 0; large numbers are dealt over tasks."""
    part = free("part", rows.columns)
    last = F.col(times) - 1
    parts = rows.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / SPREAD))))
    if most > SPREAD:
        parts = parts.repartition(F.xxhash64(*parts.columns))
    from_ = F.col(part) * SPREAD
    return parts.withColumn(nth, F.explode(F.sequence(from_, F.least(last, from_ + SPREAD - 1)))).drop(part)


_STATE = "doc_id {kind}, source string, size long, h long, bucket long, whole int, p double, open boolean"


def _combine(rows: DataFrame, kind: str, seed: int, level: int, last: bool) -> DataFrame:
    """One level of the tree: rows of equal (source, bucket) settle, one stays open (on the last level none)."""

    def run(key, t):
        source, bucket = (x.as_py() for x in key)
        size, p = t.column("size").to_numpy().astype(float), t.column("p").to_numpy()
        tie = t.column("doc_id").cast(pa.string()).fill_null("").to_numpy(zero_copy_only=False).astype(str)
        order = np.lexsort((p, t.column("h").to_numpy(), tie, -size))  # large ones first: what stays open at the end is small
        rng = np.random.default_rng([seed, level, zlib.crc32(repr((source, bucket)).encode()), len(size)])
        p, at = settle(size[order], p[order], rng)
        if last and at >= 0:
            p[at], at = float(rng.random() < p[at]), -1
        out = t.take(pa.array(order))
        is_open = np.zeros(len(p), bool)
        if at >= 0:
            is_open[at] = True
        return out.set_column(out.schema.get_field_index("p"), "p", pa.array(p)).set_column(out.schema.get_field_index("open"), "open", pa.array(is_open))

    return rows.groupBy("source", "bucket").applyInArrow(run, _STATE.format(kind=kind))


def _settled(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """doc_id, source, size, h, source_size, target, copies of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = written(sizes(docs), "sizes").leave()
    per = known.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    aim = written(targets(per, weights, share, most).join(per.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets").leave()
    found = aim.agg(F.count("*"), F.max("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    small = found[0] * 64 + found[2] <= BROADCAST_BYTES
    aim = F.broadcast(aim) if small else aim.hint("merge")
    rows = spread(known, "rows", "nth", known.agg(F.max("rows")).first()[0] or 0).join(aim.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", F.when(F.col("size") > 0, rate - F.col("whole")).otherwise(0.0))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "h", "nth"), F.ceil(F.col("n") / LEAF)).cast("long")).withColumn("open", F.col("p") > 0)
    cols = ["doc_id", "source", "size", "h", "bucket", "whole", "p", "open"]
    every = rows.where("not open").select(cols)
    now, buckets, level = rows.where("open").select(cols), max(1, -(-(found[1] or 0) // LEAF)), 0
    while True:
        last = buckets == 1
        out = written(_combine(now, kind, seed, level, last), "settled").leave()
        every = every.unionByName(out.where("not open"))
        if last:
            break
        buckets, level = -(-buckets // FAN), level + 1
        now = out.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    every = every.withColumn("copies", (F.col("whole") + F.round("p")).cast("int"))
    out = every.join(aim.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", "size", "h", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs (doc_id, text, source).

    size: words (null text: 0). Rows of size 0 take part in no draw. Rows with one doc_id are separate
    documents; a null source is a source of its own. Draws depend on seed, source, bucket and size only,
    so reruns agree. No row is taken more than most (rounded up) times. Other columns are not read. An
    empty table gives no rows.
    """
    out = _settled(docs, weights, share, most, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of docs as often as mix() takes them, with the columns of docs, whatever their names.

    Rows that share doc_id, source and text pool their copies: all are copies of one of them, the least
    by its other columns as JSON. Null texts have no words and are never taken. An empty table gives no rows.
    """
    plan = _settled(docs, weights, share, most, seed).groupBy("doc_id", "source", "size", "h").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    plan = written(plan.where("copies > 0 and size > 0"), "copies").leave()
    most_copies = plan.agg(F.max("copies")).first()[0] or 0
    names = {c: free(f"mix_{c}", docs.columns) for c in (*plan.columns, "nth", "row")}
    plan = plan.select([F.col(c).alias(names[c]) for c in plan.columns])
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").cast("string").eqNullSafe(F.col(names["source"])) & (F.xxhash64(F.col("text").cast("string")) == F.col(names["h"]))
    rows = docs.join(plan.where(f"{names['rows']} = 1").hint("merge"), same).select(*docs.columns, names["copies"])
    several = plan.where(f"{names['rows']} > 1")
    if not several.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = docs.join(several.hint("merge"), same).groupBy(*[names[c] for c in ("doc_id", "source", "size", "h", "copies")]).agg(F.min_by(row, F.to_json(row)).alias(names["row"]))
        rows = rows.unionByName(one.select(f"{names['row']}.*", names["copies"]))
    return spread(rows, names["copies"], names["nth"], most_copies).select(docs.columns)
