"""Texts as tags: a bare mark and the size written beside it become one tag before elements are looked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.functions import geom as g, text as tx

from . import matching as mt, spatial as sp

FIELDS = ["width_mm", "depth_mm", "depth_alt_mm", "diameter_mm", "thickness_mm", "fold_mm", "sunk_mm"]


def tag_kind() -> Column:
    """size: a parsed text with a section, a diameter or a thickness; mark: one with a mark only; else other."""
    sized = F.col("width_mm").isNotNull() | F.col("diameter_mm").isNotNull() | F.col("thickness_mm").isNotNull()
    return F.when(sized, "size").when(F.col("mark").isNotNull(), "mark").otherwise("other")


def size_candidates(tags: DataFrame, on: Sequence[str], factor: float = 3, turn: float = 5, cell: float = 1000) -> DataFrame:
    """Pairs a (mark), b (size without a mark), score (distance) of parsed tags: at most factor times the mark's height apart, and parallel within turn degrees."""
    col = F.col
    t = tags.withColumn("kind", tag_kind())
    marks = t.where("kind = 'mark'").select(*on, col("id").alias("a"), col("rotation").alias("ra"), (factor * col("text_height")).alias("reach"), *[col(c).alias(k) for k, c in (("x0", "x"), ("x1", "x"), ("y0", "y"), ("y1", "y"))])
    sizes = t.where("kind = 'size' and mark is null").select(*on, col("id").alias("b"), "rotation", "x", "y")
    d = F.hypot(col("x") - col("x0"), col("y") - col("y0"))
    pairs = sp.points_in_boxes(sizes, marks, on, cell, col("reach"), (d <= col("reach")) & (g.direction_difference(col("ra"), col("rotation")) <= turn))
    return pairs.select("a", "b", F.round(d, 6).alias("score"))


def paired_tags(texts: DataFrame, on: Sequence[str], factor: float = 3, turn: float = 5, cell: float = 1000) -> DataFrame:
    """Tags of texts (on, id, text, x, y, text_height, rotation; id unique): a mark takes the nearest size in reach, nearest pairs first, each once.

    Of a pair remains the mark's row with size_id, both texts joined, what either states (the mark's first), the middle of both
    places and the greater height; other texts stay as they are. Null texts are other tags. A text without a place or a height takes no partner.
    """
    col = F.col
    t = mt.kept(tx.parse_tags(texts))  # read three times from here
    taken = mt.greedy_pairs(size_candidates(t, on, factor, turn, cell)).select(col("a").alias("id"), col("b").alias("size_id"))
    s = t.select(col("id").alias("size_id"), F.struct("text", "x", "y", "text_height", "marks", "category_hint", "inverted", *FIELDS).alias("s"))
    pairs = taken.join(s.hint("merge"), "size_id")
    rest = t.join(taken.select(col("size_id").alias("id")).hint("merge"), "id", "left_anti")
    x, two = rest.join(pairs.hint("merge"), "id", "left"), col("size_id").isNotNull()
    mean = lambda c: F.when(two, (col(c) + col(f"s.{c}")) / 2).otherwise(col(c))
    return x.withColumns({
        "text": F.when(two, F.concat(col("text"), F.lit(" | "), col("s.text"))).otherwise(col("text")), "x": mean("x"), "y": mean("y"), "text_height": F.greatest("text_height", "s.text_height"),
        "inverted": col("inverted") | F.coalesce("s.inverted", F.lit(False)), "category_hint": F.coalesce("category_hint", "s.category_hint"), **{c: F.coalesce(c, f"s.{c}") for c in FIELDS},
    }).withColumns({"kind": tag_kind()}).drop("s")
