"""Extraction as one job of stages: entities of drawings to numbered elements with marks and sizes, grids and findings.

Every stage takes all kinds at once, with the role among its keys, and writes its table, so a lost executor costs a
stage at most and no plan grows with the number of stages. Stages: roles of layers; floors by frames; near duplicates
out, in order; texts to tags, marks joined with sizes; tags to elements, one of a kind (mark, size) each, nearest first; sizes by tag, else by outline.

shapes: on, id, layer, kind, ring. texts: on, id, layer, text, x, y, text_height, rotation. lines: on, id, layer, ax, ay, bx, by.
frames: on, floor_id, nth, ring. Ids are strings and unique in all drawings; other columns are left out. Null texts and places belong to nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.functions import diagnostics as dg, geom as g

from . import matching as mt, numbering as nb, selection as sel, spatial as sp, tagging as tg

#: Reach of tags around an element by role: at least so many mm, and so many times its longer side. 0: inside only.
REACH = {"COLUMN": (600.0, 1.5), "BEAM": (600.0, 0.0), "WALL": (600.0, 0.0), "SLAB": (0.0, 0.0), "FOOTING": (600.0, 0.0)}
#: What an element of a role must have, and the finding if it has not.
NEEDS = {"COLUMN": ("width_mm", "COLUMN_NO_SIZE"), "BEAM": ("depth_mm", "BEAM_NO_DEPTH"), "SLAB": ("thickness_mm", "SLAB_NO_THICKNESS"), "FOOTING": ("thickness_mm", "FOOTING_NO_SIZE")}
SIZES = ["width_mm", "depth_mm", "depth_alt_mm", "diameter_mm", "thickness_mm"]


@dataclass(frozen=True)
class Extract:
    elements: DataFrame
    tags: DataFrame
    grids: DataFrame
    findings: DataFrame


def owned(points: DataFrame, frames: DataFrame, on: Sequence[str], cell: float = 200_000) -> DataFrame:
    """points (on, id, x, y and more) with floor_id: the first frame by nth that holds them, or null."""
    f = frames.select(*on, "floor_id", "nth", F.col("ring").alias("_ring"), *[g.bounds(F.col("ring"))[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    met = sp.points_in_boxes(points, f, on, cell, inside=g.holds(F.col("_ring"), F.col("x"), F.col("y")), how="left")
    rest = [c for c in points.columns if c not in (*on, "id")]
    return sp.best(met, [*on, "id"], [F.coalesce("nth", F.lit(0))], {c: F.col(c) for c in (*rest, "floor_id")})


def extract(shapes: DataFrame, texts: DataFrame, lines: DataFrame, frames: DataFrame, rules: DataFrame, on: Sequence[str], same: float = 0.9, mismatch: float = 26, bubble: float = 1200, step: float = 250, cell: float = 4000) -> Extract:
    """Elements, tags, grids and findings of drawings; see the module."""
    col, true = F.col, F.lit(True)
    floor = [*on, "floor_id"]
    s = sel.with_rules(shapes.select(*on, "id", "layer", "kind", "ring"), rules).where(col("role").isin(*REACH) & col("kind").isin("polygon", "polyline") & ~F.array_contains("modifiers", "hidden") & (F.size("ring") >= 3))
    s = s.select(*on, "id", "role", "ring", g.inside_point(col("ring")).alias("p")).withColumns({"x": col("p.x"), "y": col("p.y")}).drop("p")
    s = mt.kept(owned(s, frames, on))
    box = g.bounds(col("ring"))
    e = s.where("floor_id is not null").withColumns({c: box[c] for c in ("x0", "y0", "x1", "y1")}).drop("x", "y")
    pairs = sp.overlaps(e.select(*floor, "role", "id", "x0", "y0", "x1", "y1"), e.select(*floor, "role", "id", "x0", "y0", "x1", "y1"), [*floor, "role"], cell).where("id < b_id").where(sp.iou() >= same)
    keep = mt.ordered_keep(e.select("id"), pairs.select(col("id").alias("early"), col("b_id").alias("late")))
    doubles = mt.kept(e.join(keep.where("not kept").select("id").hint("merge"), "id", "left_semi").select(*floor, "id"))
    e = mt.kept(e.join(doubles.select("id").hint("merge"), "id", "left_anti"))

    t = sel.with_rules(texts.select(*on, "id", "layer", "text", "x", "y", "text_height", "rotation"), rules).withColumn("role", F.regexp_extract("text_role", "^(.*)_TAG$", 1))
    t = owned(t.where(col("role").isin(*REACH)).select(*on, "id", "role", "text", "x", "y", "text_height", "rotation"), frames, on).where("floor_id is not null")
    tags = mt.kept(tg.paired_tags(t, [*floor, "role"]))
    longer = F.greatest(col("x1") - col("x0"), col("y1") - col("y0"))
    reach = reduce(lambda c, k: c.when(col("role") == k, F.greatest(F.lit(REACH[k][0]), REACH[k][1] * longer)), REACH, F.when(F.lit(False), 0.0))
    d2 = sp.box_distance(*map(col, ("x", "y", "x0", "y0", "x1", "y1")))
    near = sp.points_in_boxes(tags.where("kind <> 'other'").select(*floor, "role", col("id").alias("tag_id"), "kind", "x", "y"), e.drop("ring").withColumn("reach", reach), [*floor, "role"], cell, col("reach"), d2 <= col("reach") * col("reach"))
    taken = mt.greedy_pairs(near.select(col("tag_id").alias("a"), F.concat("id", F.lit("|"), "kind").alias("b"), F.round(F.sqrt(d2), 6).alias("score")))
    taken = mt.kept(taken.select(col("a").alias("tag_id"), F.regexp_extract("b", r"^(.*)\|[^|]*$", 1).alias("id"), "score"))

    said = taken.join(tags.select(col("id").alias("tag_id"), "mark", *SIZES).hint("merge"), "tag_id")
    first = lambda c: F.min(F.when(col(c).isNotNull(), F.struct("score", "tag_id", c)))[c].alias(c)
    said = said.groupBy("id").agg(*[first(c) for c in ("mark", *SIZES)], F.count("*").alias("n_tags"))
    x = e.join(said.hint("merge"), "id", "left").withColumns({"w": col("x1") - col("x0"), "h": col("y1") - col("y0")})
    drawn = col("role").isin("COLUMN", "WALL") & col("width_mm").isNull() & col("diameter_mm").isNull()
    x = x.withColumns({
        "size_source": F.when(F.coalesce("width_mm", "diameter_mm", "thickness_mm").isNotNull(), "tag").when(drawn, "outline"), "stated_w": col("width_mm"), "stated_d": col("depth_mm"),
        "width_mm": F.when(drawn, col("w")).otherwise(col("width_mm")), "depth_mm": F.when(drawn, col("h")).otherwise(col("depth_mm")), "n_tags": F.coalesce("n_tags", F.lit(0).cast("long")),
    })
    x = mt.kept(nb.numbered(x, [*floor, "role"], [F.round(col("y0") / step), F.round(col("x0") / step), "id"], "number"))

    ln = sel.with_rules(lines.select(*on, "id", "layer", "ax", "ay", "bx", "by"), rules).where("role = 'GRID'").select(*on, "id", "ax", "ay", "bx", "by", ((col("ax") + col("bx")) / 2).alias("x"), ((col("ay") + col("by")) / 2).alias("y"))
    ln = owned(ln, frames, on).where("floor_id is not null")
    labels = sel.with_rules(texts.select(*on, "id", "layer", "text", "x", "y"), rules).where("text_role = 'GRID_TAG'").select(*on, col("id").alias("label_id"), "text", "x", "y")
    ends = ln.select(*on, "id", F.explode(F.array(g.point(col("ax"), col("ay")), g.point(col("bx"), col("by")))).alias("p")).select(*on, "id", *[col(f"p.{k[0]}").alias(k) for k in ("x0", "y0", "x1", "y1")])
    d2 = sp.box_distance(*map(col, ("x", "y", "x0", "y0", "x1", "y1")))
    label = sp.best(sp.points_in_boxes(labels, ends, on, 4 * bubble, bubble, d2 <= bubble * bubble).withColumn("d2", d2), ["id"], [col("d2"), col("label_id")], {"label": F.btrim("text")})
    axis = F.when(F.abs(col("ax") - col("bx")) < 1, "X").when(F.abs(col("ay") - col("by")) < 1, "Y").otherwise("other")
    grids = mt.kept(ln.join(label.hint("merge"), "id", "left").select(*floor, "id", "label", axis.alias("axis"), "ax", "ay", "bx", "by"))

    off = lambda a, b: F.abs(a - b) > mismatch
    odd = off(F.least("stated_w", "stated_d"), F.least("w", "h")) | off(F.greatest("stated_w", "stated_d"), F.greatest("w", "h"))
    twice = grids.where("label is not null").groupBy(*floor, "axis", "label").agg(F.count("*").alias("n"))
    bare = frames.select(*floor).distinct().join(grids.select(*floor).distinct().hint("merge"), floor, "left_anti")
    found = [
        dg.finding(s, col("floor_id").isNull(), "WARNING", "ELEMENT_OUTSIDE_FLOORS", col("id")),
        dg.finding(doubles, true, "INFO", "DUPLICATE_ENTITY", col("id"), col("floor_id")),
        dg.finding(tags, col("unparsed"), "WARNING", "TAG_UNPARSED", col("id"), col("floor_id")),
        dg.finding(tags.where("kind <> 'other'").join(taken.select(col("tag_id").alias("id")).hint("merge"), "id", "left_anti"), true, "WARNING", "TAG_UNASSIGNED", col("id"), col("floor_id")),
        *[dg.finding(x, (col("role") == role) & (col("stated_w") if role == "COLUMN" else col(need)).isNull() & col("diameter_mm").isNull(), "WARNING", code, col("id"), col("floor_id")) for role, (need, code) in NEEDS.items()],
        dg.finding(x, (col("role") == "COLUMN") & odd, "WARNING", "COLUMN_SIZE_MISMATCH", col("id"), col("floor_id")),
        dg.finding(grids, col("label").isNull(), "WARNING", "GRID_NO_LABEL", col("id"), col("floor_id")),
        dg.finding(twice, col("n") > 1, "WARNING", "GRID_DUPLICATE_LABEL", F.concat_ws(" ", "axis", "label"), col("floor_id")),
        dg.finding(bare, true, "INFO", "NO_GRIDS", F.lit(None), col("floor_id")),
    ]
    shape = [*floor, "role", "id", "number", "mark", *SIZES, "size_source", "n_tags", "x0", "y0", "x1", "y1"]
    return Extract(x.select(*shape), tags.join(taken.select(col("tag_id").alias("id"), col("id").alias("element_id")).hint("merge"), "id", "left"), grids, reduce(DataFrame.unionByName, found))
