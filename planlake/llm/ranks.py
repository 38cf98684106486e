"""Row numbers over a whole table without a window over it.

Rows are dealt by range and sorted within their parts, written with part and place, and a count by part
(and group) gives every part its offset. Only those counts meet in a window: a row a part and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import written

#: Offsets of at most so many rows are broadcast (some 60 bytes each and the group's name); more are merge-joined.
OFFSETS = 100_000


def ranked(rows: DataFrame, order: Sequence[str], group: str | None = None, tag: str = "ranked") -> DataFrame:
    """rows with rank (from 0, by ascending order, nulls first) and total, both within group (null is a group) where it is given.

    rows must be a table read from files. Rows alike in group and order may be cut apart between parts
    and get ranks in any order among each other, so no number of them makes a part too large.
    """
    keys = ([group] if group else []) + list(order)
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col("_apart").asc()]
    laid = rows.withColumn("_apart", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_apart")
    laid = laid.withColumn("_at", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    laid = written(laid, tag).leave()
    within = [F.col(group).alias("_g")] if group else [F.lit(0).alias("_g")]
    counts = laid.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy("_g").orderBy("_part")
    offsets = counts.select(
        F.col("_part").alias("_p"), "_g", (F.coalesce(F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(W.partitionBy("_g")).alias("total"),
    )
    offsets = written(offsets, f"{tag}-offsets").leave()
    side = F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets.hint("merge")
    same = laid["_part"] == side["_p"]
    if group:
        same = same & laid[group].eqNullSafe(side["_g"])
    return laid.join(side, same).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_g", "_shift")
