"""Diagnostics: a closed vocabulary of codes, rules as filters into one long table, roll-ups and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Every code, in order, with what it means. -------------------------------------------
CODES = {
    "UNITS_GUESSED": "no unit is given; it was taken from the extent",
    "COORDS_LARGE": "the drawing lies far from its origin",
    "Z_NONZERO": "points have a height, which was dropped",
    "DUPLICATE_ENTITY": "the same entity is drawn several times",
    "LAYER_UNMAPPED": "no rule gives the layer a role",
    "LAYER_LOW_CONFIDENCE": "the role of the layer is a guess",
    "LAYER_HIDDEN": "the layer shows what is hidden and is left out",
    "NO_BOUNDARY": "no frame marks a floor",
    "FLOOR_NO_ORIGIN": "a floor frame holds no origin point",
    "FLOOR_NO_LABEL": "no text names the floor",
    "BOUNDARY_NOT_CLOSED": "a floor frame is open",
    "POLYLINE_NOT_CLOSED": "an outline is open by a small gap, which was closed",
    "POLYLINE_OPEN_REJECTED": "an outline is too open to be one",
    "COLUMN_NO_SIZE": "neither a tag nor a schedule gives the column a size",
    "COLUMN_SIZE_MISMATCH": "tag and outline of the column differ",
    "COLUMN_ODD_SIZE": "the column is unusually thin or thick",
    "COLUMN_WALL_LIKE": "the column is so long that it may be a wall",
    "COLUMN_STARTS_ABOVE": "the column begins at this floor",
    "COLUMN_ABOVE_FLOOR": "the outline belongs to the floor above",
    "COLUMN_LEGS_SPLIT": "a shaped wall was cut into its legs",
    "COLUMN_LEG_TRIMMED": "a leg was cut back where it meets a larger one",
    "COLUMN_MULTI_SIZE": "several sizes are stated for the column",
    "BEAM_NO_DEPTH": "nothing gives the beam a depth",
    "BEAM_NO_SLAB": "the beam takes its depth from a slab, but touches none",
    "BEAM_NO_WIDTH_TAG": "no tag gives the beam a width",
    "BEAM_WIDTH_MISMATCH": "tag and drawn width of the beam differ",
    "BEAM_MULTI_SIZE": "several sizes are stated for the beam",
    "BEAM_UNPAIRED_LINES": "beam edges have no partner",
    "BEAM_DEFAULT_DEPTH": "the beam has the depth of a general note",
    "SLAB_NO_THICKNESS": "nothing gives the slab a thickness",
    "SLAB_NONE_ON_FLOOR": "the floor has no slab tag",
    "SLAB_DEFAULT_THICKNESS": "the slab has the thickness of a general note",
    "FOOTING_NO_SIZE": "nothing gives the footing a thickness",
    "TAG_UNPARSED": "a tag says nothing that is understood",
    "TAG_UNASSIGNED": "a tag belongs to no element",
    "TAG_CATEGORY_MISMATCH": "a tag names another kind of element",
    "SCHEDULE_MARK_MISSING": "a mark is in no schedule",
    "SCHEDULE_PLAN_MISMATCH": "schedule and plan differ",
    "SCHEDULE_PARSE": "a schedule was not understood",
    "GRID_NO_LABEL": "a grid line has no label",
    "GRID_DUPLICATE_LABEL": "several grid lines have one label",
    "GRID_LABEL_QUALIFIER": "a text at most grid lines is no label",
    "LEGEND_ZONE": "shapes in the legend were left out",
    "NO_GRIDS": "the floor has no grid lines",
    "ELEMENT_OUTSIDE_FLOORS": "entities lie in no floor frame",
    "BLOCK_EXPLODED": "block content was taken apart",
    "DEFAULT_APPLIED": "a general note gave a value",
    "LEVELS_MISSING": "no levels are given",
    "LEVEL_ROW_UNMATCHED": "a level row names no floor",
    "STACK_JUMP": "a column stands off the foot of its stack",
    "STACK_ORPHAN": "a column has none below it",
    "STACK_SIZE_CHANGE": "a stack changes its size",
    "SPAN_DROPPED": "a span is too short",
    "SPAN_FREE_END": "a span ends at no support",
    "BEAM_OVERLAP": "beams cover each other",
    "PANEL_NO_TAG": "no tag lies in the panel",
    "PANEL_MULTI_TAG": "tags in the panel differ",
    "PANEL_MULTI_SUNK": "pockets in the panel differ in depth",
    "PANEL_LARGE": "the panel is unusually large",
    "PANEL_TAG_OUTSIDE": "a slab tag lies in no panel",
    "PANEL_NO_LATTICE": "no members close a panel on the floor",
    "FOOTING_NO_COLUMN": "no column stands on the footing",
    "COLUMN_NO_FOOTING": "the lowest column stands on no footing",
    "MARK_FIT": "the mark does not fit its element",
    "SEED_MISSING": "a starting number is missing",
    "NAME_NORMALISED": "a floor name was put in order",
    "PANEL_OFFSET_UNKNOWN": "the level of the panel is not known",
    "BEAM_ALT_DEPTH": "the beam has a second depth",
    "PIT_DEPTH_UNKNOWN": "the depth of the pit is not known",
    "STAIR_ESTIMATED": "treads were counted from lines",
    "FOLD_THICKNESS_UNKNOWN": "the thickness of the fold is not known",
    "PILE_NO_DIAMETER": "the pile has no diameter",
    "RT_FLOOR_NO_ORIGIN": "a frame read again has no origin point",
    "RT_LEVELS_RELATIVE": "levels read again have no elevation, only distances",
    "RT_NO_ID": "an element read again has no id",
    "RT_ORPHAN_MARK": "a mark read again belongs to no element",
    "RT_MISSING": "the drawing lacks an element of the model",
    "RT_ADDED": "the drawing has an element that the model lacks",
    "RT_MOVED": "the element was moved",
    "RT_RESIZED": "the element has another size",
    "RT_MARK_CHANGED": "the element has another mark",
    "RT_MARK_MISMATCH": "the mark states another size than is drawn",
    "RT_MARK_MISSING": "the element lost its mark",
    "RT_COUNT": "model and drawing have different numbers of elements",
    "RT_DUP_MARK": "one mark names two sections",
    "RT_LEVEL_CHANGED": "a level has another elevation",
    "RT_FLOOR_MISSING": "the drawing lacks a floor",
    "REVIT_NO_LEVELS": "there is no level to build on",
    "REVIT_FLOOR_NO_LEVEL": "a floor has no level",
    "REVIT_NO_SIZE": "an element has no size to build",
    "REVIT_COLUMN_NO_TOP": "a column has no level above it",
}
SEVERITIES = ("ERROR", "WARNING", "INFO")
# --------------------------------------------------------------------------------------------------


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES.items()), "code string, meaning string")


def finding(df: DataFrame, when: Column, severity: str, code: str, element: Column, floor: Column | None = None) -> DataFrame:
    """severity, code, floor_id, element_id of the rows of df where when holds. Unknown codes and severities are refused."""
    if code not in CODES or severity not in SEVERITIES:
        raise KeyError(f"unknown diagnostic {severity} {code}")
    floor = F.lit(None).cast("string") if floor is None else floor
    return df.where(when).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), floor.alias("floor_id"), element.cast("string").alias("element_id"))


def unknown(findings: DataFrame) -> DataFrame:
    """Findings whose code is not in the vocabulary; must be empty."""
    return findings.join(F.broadcast(code_table(findings.sparkSession)), "code", "left_anti")  # fixed table of some hundred rows


def rolled_up(findings: DataFrame) -> DataFrame:
    """Counts by (severity, code), by severity and over all (nulls mark totals)."""
    return findings.rollup("severity", "code").agg(F.count("*").alias("n"))


def verdict(findings: DataFrame) -> DataFrame:
    """ok: no errors or warnings."""
    return findings.agg((F.count_if(F.col("severity").isin("ERROR", "WARNING")) == 0).alias("ok"), F.count("*").alias("n"))
