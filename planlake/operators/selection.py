"""Which entities an extraction looks at, and which elements a comparison: filters by role, layer, legend and kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.functions import text as tx
from planlake.sources import drawings as dw

from . import spatial as sp

#: Modifiers of layers that show steps inside a bay.
STEPS = ["drop", "fold", "sunk", "hidden"]


def with_rules(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """entities with role, text_role and modifiers of their layer; a layer without a rule is UNKNOWN, its texts NOTE."""
    r = rules.select(F.col("layer").alias("_layer"), "role", "text_role", "modifiers")
    x = entities.join(r.hint("merge"), F.col("layer") == F.col("_layer"), "left").drop("_layer")
    none = F.array().cast("array<string>")
    return x.withColumns({"role": F.coalesce("role", F.lit("UNKNOWN")), "text_role": F.coalesce("text_role", F.lit("NOTE")), "modifiers": F.coalesce("modifiers", none)})


def shapes(entities: DataFrame, rules: DataFrame, role: str, kinds: Sequence[str], bands: DataFrame, on: Sequence[str], key: Sequence[str], cell: float = 2000) -> DataFrame:
    """Entities (key, on, layer, kind, x0, y0, x1, y1) of a role and of kinds, without hidden layers and without those of which a legend band covers half."""
    x = with_rules(entities, rules).where((F.col("role") == role) & F.col("kind").isin(list(kinds)) & ~F.array_contains("modifiers", "hidden"))
    covered = sp.overlaps(x.select(*key, *on, "x0", "y0", "x1", "y1"), bands, on, cell).where(2 * F.col("overlap") >= sp.area())
    return x.join(covered.select(*key).distinct().hint("merge"), list(key), "left_anti")


def texts(entities: DataFrame, rules: DataFrame, text_role: str, bands: DataFrame, on: Sequence[str], cell: float = 2000) -> DataFrame:
    """Texts (on, layer, text, x, y) of a text role that say something, without those in a legend band."""
    x = with_rules(entities, rules).where((F.col("text_role") == text_role) & (F.btrim("text", F.lit(" \t\r\n")) != ""))
    return sp.points_in_boxes(x, bands.select(*on, "x0", "y0", "x1", "y1"), on, cell, how="left_anti")


def sized_dimensions(entities: DataFrame, height: float = 125) -> DataFrame:
    """entities (kind, text, text_height) where dimensions whose text states a size are texts, with a height if they have none."""
    plain = tx.without_inline_codes(F.col("text"))
    sized = (F.col("kind") == "dimension") & tx.size_of_name(plain)["width_mm"].isNotNull()
    return entities.withColumns({
        "kind": F.when(sized, "text").otherwise(F.col("kind")), "text": F.when(sized, plain).otherwise(F.col("text")),
        "text_height": F.when(sized, F.coalesce(F.nullif("text_height", F.lit(0)), F.lit(height))).otherwise(F.col("text_height")),
    })


def slab_edges(entities: DataFrame, rules: DataFrame, least: float = 50, least_area: float = 1e5) -> DataFrame:
    """Edges (i, x1, y1, x2, y2) that close a slab, of entities (layer, kind, ring, area) of role SLAB.

    Closed outlines count with all edges, unless small or on a layer of steps; open lines only if their
    layer shows neither steps nor a projection, and only pieces of least or more.
    """
    x = with_rules(entities, rules).where("role = 'SLAB'")
    step, out = F.arrays_overlap("modifiers", F.array(*map(F.lit, STEPS))), F.array_contains("modifiers", "projection")
    closed = x.where((F.col("kind") == "polygon") & ~step & (F.col("area") >= least_area))
    lines = x.where(F.col("kind").isin("line", "polyline") & ~step & ~out)
    return dw.segments(closed, "ring").unionByName(dw.segments(lines, "ring", least, closed=False))


def drawable(category: Column, kind: Column, outline: Column, diameter: Column, structural: Column) -> Column:
    """Whether an element takes part in a comparison: what a template drawing shows of its category."""
    return (
        F.when(category == "panels", F.coalesce(kind, F.lit("slab")).isin("slab", "cantilever", "ramp")).when(category == "stairs", F.coalesce(F.size(outline), F.lit(0)) > 0)
        .when(category == "piles", F.coalesce(diameter, F.lit(0)) > 0).when(category == "walls", F.coalesce(structural, F.lit(True))).otherwise(True)
    )


def confidence(source_kind: Column, n_parts: Column) -> Column:
    """high for what is drawn as a shape, or as few paired lines."""
    return F.when(source_kind.isin("polyline", "circle", "hatch") | ((source_kind == "paired_lines") & (n_parts <= 4)), "high").otherwise("medium")
