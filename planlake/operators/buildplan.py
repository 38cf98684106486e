"""Build plans: elements of a drawing as ordered, typed actions on the levels that its floors serve.

All elements become rows of one shape first; levels and origins reach them by one join on the drawing and the
floor, whatever the number of kinds. Tables of elements may lack columns; these count as null. Lengths are mm.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlake.functions import diagnostics as dg, geom as g
from planlake.sources.mapping import Mapping, TypeRule

_PLACE = "cx double, cy double, rotation_deg double"
_RING = "outline array<struct<x:double,y:double>>"
#: Columns of the tables of elements, next to the drawing's keys, element_id, floor_id and mark.
TABLES = {
    "grids": "axis string, label string, x1 double, y1 double, x2 double, y2 double",
    "columns": f"{_PLACE}, shape string, diameter_mm double, width_mm double, depth_mm double, stack_id string, stops_here boolean",
    "beams": "x1 double, y1 double, x2 double, y2 double, width_mm double, depth_mm double, top_offset_mm double, inverted boolean, cantilever boolean",
    "panels": f"{_RING}, holes array<array<struct<x:double,y:double>>>, kind string, thickness_mm double, top_offset_mm double, sunk_mm double, slope_ratio string, direction string",
    "footings": f"{_PLACE}, {_RING}, kind string, width_mm double, depth_mm double, thickness_mm double, pit_depth_mm double, pcc_outline array<struct<x:double,y:double>>, pcc_thickness_mm double",
    "piles": f"{_PLACE}, diameter_mm double, pilecap_id string",
    "walls": f"{_PLACE}, thickness_mm double, length_mm double, top_offset_mm double, structural boolean",
    "openings": f"{_RING}, label string",
}
#: Kinds of actions in the order in which they are built.
KINDS = ["grid", "column", "beam", "floor", "footing", "pcc", "pile", "wall", "shaft"]
_STAGED = {
    "kind": "string", "id": "string", "category": "string", "family": "string", "type_name": "string", "base_type": "string", "params": "map<string,double>",
    "points": "array<struct<x:double,y:double>>", "loops": "array<array<struct<x:double,y:double>>>", "rotation_deg": "double", "height_mm": "double",
    "base_offset_mm": "double", "top_offset_mm": "double", "mark": "string", "comment": "string", "sized": "boolean",
}


def to_step(value: Column, step: float) -> Column:
    """value at the nearest multiple of step, halves to the even one; null if that is zero."""
    return F.nullif(F.round(F.bround(value / F.lit(float(step))) * F.lit(float(step)), 1), F.lit(0.0))


def type_text(pattern: str, values: dict[str, Column]) -> Column:
    """pattern with its fields ({w} or {w:.0f}) put in, null as 0.

    A field without a value is "?"; one with a number format, or a pattern that is none, leaves the pattern as it is.
    """
    parts = []
    try:
        fields = list(Formatter().parse(pattern))
    except ValueError:
        return F.lit(pattern)
    for text, name, spec, conversion in fields:
        parts.append(F.lit(text))
        if name is None:
            continue
        digits = re.fullmatch(r"\.(\d+)f", spec or "")
        if conversion or (spec and (not digits or name not in values)):
            return F.lit(pattern)
        v = F.coalesce(values[name], F.lit(0.0)) if name in values else None
        parts.append(F.lit("?") if v is None else v.cast("string") if not digits else F.format_string(f"%.{digits[1]}f", F.bround(v, int(digits[1]))))
    return F.concat(*parts)


def _table(elements: dict[str, DataFrame], name: str, on: Sequence[str]) -> DataFrame | None:
    if name not in elements:
        return None
    df = elements[name]
    wanted = [c.split(" ", 1) for c in re.split(r", (?=\w+ )", f"element_id string, floor_id string, mark string, {TABLES[name]}")]
    has = set(df.columns)
    return df.select(*on, *[(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in wanted])


def _params(rule: TypeRule, values: dict[str, Column]) -> Column:
    names = {"w": rule.width_param, "d": rule.depth_param, "dia": rule.diameter_param, "thk": rule.thickness_param}
    pairs = [c for k, v in values.items() if names[k] for c in (F.lit(names[k]), v)]
    return F.create_map(*pairs).cast("map<string,double>")


def _typed(rule: TypeRule, **values: Column) -> dict[str, Column]:
    """What a rule says of rows with these sizes; sized: whether each is there."""
    sized = F.lit(True)
    for v in values.values():
        sized = sized & v.isNotNull()
    base = rule.fallback_type if rule.family else rule.base_type
    params = _params(rule, values)
    return {"family": F.lit(rule.family), "type_name": type_text(rule.type_name, values), "base_type": F.lit(base), "params": params, "sized": sized}


def _choose(when: Column, a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {k: F.when(when, a[k]).otherwise(b[k]) for k in a}


def _staged(df: DataFrame, on: Sequence[str], kind: str, category: str, **columns: Column) -> DataFrame:
    given = {"kind": F.lit(kind), "category": F.lit(category), "id": F.col("element_id"), "mark": F.col("mark"), "sized": F.lit(True)} | columns
    return df.select(*on, "floor_id", "element_id", *[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in _STAGED.items()])


def stage_elements(elements: dict[str, DataFrame], mapping: Mapping, on: Sequence[str]) -> DataFrame:
    """All elements that the mapping builds as rows of one shape, in their floor's coordinates; grids apart."""
    step, rules, build, col = mapping.round_sizes_to_mm, mapping.rules, mapping.build, F.col
    size = lambda c: to_step(col(c), step)
    zero = lambda c: F.coalesce(col(c), F.lit(0.0))
    centre = F.array(g.point(col("cx"), col("cy")))
    ends = F.array(g.point(col("x1"), col("y1")), g.point(col("x2"), col("y2")))
    out, foundations = [], "Structural Foundations"
    if build.get("columns") and (c := _table(elements, "columns", on)) is not None:
        round_ = F.coalesce((col("shape") == "circle") & (col("diameter_mm") > 0), F.lit(False))
        typed = _choose(round_, _typed(rules["column_round"], dia=size("diameter_mm")), _typed(rules["column"], w=size("width_mm"), d=size("depth_mm")))
        note = F.concat(F.lit("stack "), F.coalesce("stack_id", F.lit("-")), F.when(col("stops_here"), " (stops here)").otherwise(""))
        out.append(_staged(c, on, "column", "Structural Columns", points=centre, rotation_deg=zero("rotation_deg"), comment=note, **typed))
    if build.get("beams") and (b := _table(elements, "beams", on)) is not None:
        note = F.when(col("inverted"), "inverted").when(col("cantilever"), "cantilever")
        out.append(_staged(b, on, "beam", "Structural Framing", points=ends, top_offset_mm=zero("top_offset_mm"), comment=note, **_typed(rules["beam"], w=size("width_mm"), d=size("depth_mm"))))
    if build.get("floors") and (p := _table(elements, "panels", on)) is not None:
        p, thk = p.where(col("kind").isin("slab", "cantilever", "ramp")), size("thickness_mm")
        typed = _choose(col("kind") == "ramp", _typed(rules["ramp_floor"], thk=thk), _typed(rules["floor"], thk=thk))
        typed["params"] = _params(rules["floor"], {})
        sunk = F.when(zero("sunk_mm") != 0, F.format_string(", sunk %.0f", F.bround("sunk_mm"))).otherwise("")
        slope = F.when(F.coalesce(col("slope_ratio"), F.lit("")) != "", F.concat(F.lit(", "), "slope_ratio", F.lit(" "), F.coalesce("direction", F.lit("")))).otherwise("")
        loops = F.concat(F.array("outline"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>")))
        out.append(_staged(p, on, "floor", "Floors", loops=loops, height_mm=thk, top_offset_mm=zero("top_offset_mm"), comment=F.concat("kind", sunk, slope), **typed))
    if build.get("foundations") and (f := _table(elements, "footings", on)) is not None:
        f, thk = f.where(~F.coalesce("kind", F.lit("")).isin("fold", "sunk")), size("thickness_mm")
        slab = F.coalesce(col("kind").isin("raft", "pilecap", "pit"), F.lit(False))
        typed = _choose(slab, _typed(rules["raft"], thk=thk) | {"params": _params(rules["raft"], {})}, _typed(rules["footing"], w=size("width_mm"), d=size("depth_mm"), thk=thk))
        out.append(_staged(
            f, on, "footing", foundations, points=F.when(~slab, centre), loops=F.when(slab, F.array("outline")), height_mm=F.when(slab, thk), rotation_deg=F.when(~slab, zero("rotation_deg")),
            base_offset_mm=F.when(slab, 0.0 - zero("pit_depth_mm")), comment=col("kind"), **typed,
        ))
        if build.get("pcc"):
            lean = size("pcc_thickness_mm")
            under = f.where(typed["sized"] & (F.size(F.coalesce("pcc_outline", F.array().cast("array<struct<x:double,y:double>>"))) > 0) & (col("pcc_thickness_mm") > 0))
            out.append(_staged(
                under, on, "pcc", foundations, id=F.concat("element_id", F.lit("-PCC")), loops=F.array("pcc_outline"), height_mm=lean, mark=F.lit("PCC"), comment=F.concat(F.lit("under "), F.coalesce("mark", F.lit("-"))),
                base_offset_mm=0.0 - (F.coalesce(thk, F.lit(0.0)) + zero("pit_depth_mm")), **_typed(rules["pcc"], thk=lean) | {"params": _params(rules["pcc"], {}), "sized": F.lit(True)},
            ))
    if build.get("piles") and (p := _table(elements, "piles", on)) is not None:
        note = F.concat(F.lit("cap "), F.coalesce("pilecap_id", F.lit("-")))
        out.append(_staged(p.where("diameter_mm > 0"), on, "pile", "Structural Columns", points=centre, mark=F.lit("PILE"), comment=note, **_typed(rules["pile"], dia=size("diameter_mm")) | {"sized": F.lit(True)}))
    if build.get("walls") and (w := _table(elements, "walls", on)) is not None:
        thk, half, turn = size("thickness_mm"), col("length_mm") / 2, F.radians(zero("rotation_deg"))
        w = w.where(thk.isNotNull() & (col("length_mm") != 0) & (F.coalesce("structural", F.lit(False)) | F.lit(not mapping.structural_only)))
        dx, dy = F.cos(turn) * half, F.sin(turn) * half
        line = F.array(g.point(col("cx") - dx, col("cy") - dy), g.point(col("cx") + dx, col("cy") + dy))
        out.append(_staged(w, on, "wall", "Walls", points=line, top_offset_mm=zero("top_offset_mm"), comment=F.lit("RCC wall"), **_typed(rules["wall"], thk=thk) | {"params": _params(rules["wall"], {})}))
    if build.get("shafts") and (o := _table(elements, "openings", on)) is not None:
        words = F.array(*map(F.lit, mapping.shaft_from)).cast("array<string>")
        o = o.where(F.exists(words, lambda word: F.contains(F.upper(F.coalesce("label", F.lit(""))), word)))
        out.append(_staged(o, on, "shaft", "Shaft Openings", loops=F.array("outline"), mark=col("label"), comment=F.lit("cut-out through the floor")))
    if not out:
        raise ValueError("the mapping builds none of the given elements")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def sites(levels: DataFrame, floors: DataFrame, on: Sequence[str]) -> DataFrame:
    """Floors with each level they serve (level_id, top_level_id above it, nth of the floor) and their origin ox, oy.

    Floors without a level stay, with nulls; levelled: whether the drawing has a level at all.
    levels: on, level_id, elevation_mm, floor_id (may be null); floors: on, floor_id, ox, oy. Levels go by elevation, then id.
    """
    up = W.partitionBy(*on).orderBy("elevation_mm", "level_id")
    above = levels.select(*on, "level_id", "elevation_mm", F.col("floor_id").cast("string").alias("floor_id"), F.lead("level_id").over(up).alias("top_level_id"))
    f = floors.select(*on, F.col("floor_id").cast("string").alias("floor_id"), "ox", "oy", F.lit(True).alias("drawn"))
    s = f.join(above.hint("merge"), [*on, "floor_id"], "full")
    nth = F.row_number().over(W.partitionBy(*on, "floor_id").orderBy("elevation_mm", "level_id"))
    levelled = F.coalesce(F.bool_or(F.col("level_id").isNotNull()).over(W.partitionBy(*on)), F.lit(False))
    nought = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return s.select(*on, "floor_id", "level_id", "top_level_id", "elevation_mm", nth.alias("nth"), levelled.alias("levelled"), F.coalesce("drawn", F.lit(False)).alias("drawn"), nought("ox"), nought("oy"))


def _placed(rows: DataFrame) -> DataFrame:
    """points and loops in the drawing's coordinates, loops to two places."""
    moved = lambda p, digits: F.struct(digits(p["x"] + F.col("ox")).alias("x"), digits(p["y"] + F.col("oy")).alias("y"))
    return rows.withColumns({
        "points": F.transform("points", lambda p: moved(p, lambda v: v)),
        "loops": F.transform("loops", lambda ring: F.transform(ring, lambda p: moved(p, lambda v: F.round(v, 2)))),
    })


def build_plan(elements: dict[str, DataFrame], levels: DataFrame, floors: DataFrame, mapping: Mapping, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Actions and findings of drawings (keys on, at least one): elements by the names of TABLES.

    Columns, beams, floors and walls are built on every level that their floor serves, the rest on its lowest;
    columns, walls and shafts reach up to the level above, and a column without one is left out. stage, then
    element_id and elevation_mm, give the order of building. A drawing without levels has one finding and no
    action. Grids come once for each axis and label, from the first floor by id.
    """
    at, col = sites(levels, floors, on), F.col
    rows = stage_elements(elements, mapping, on).join(at.hint("merge"), [*on, "floor_id"])
    one, fan = col("nth") == 1, col("kind").isin("column", "beam", "floor", "wall")
    placed = rows.where(col("level_id").isNotNull() & (fan | one))
    topped = (col("kind") != "column") | col("top_level_id").isNotNull()
    actions = _placed(placed.where(col("sized") & topped)).withColumns({
        "action_id": F.when(fan, F.concat("id", F.lit("@"), "level_id")).otherwise(col("id")),
        "top_level_id": F.when(col("kind").isin("column", "wall", "shaft"), col("top_level_id")),
        "stage": F.array_position(F.array(*map(F.lit, KINDS)), col("kind")).cast("int"),
    })
    shape = [*on, "stage", "action_id", "element_id", "elevation_mm", "level_id", "top_level_id", *[c for c in _STAGED if c not in ("id", "sized")]]
    actions = actions.select(*shape)
    if mapping.build.get("grids") and mapping.create_grids and (grids := _table(elements, "grids", on)) is not None:
        first = F.min_by(F.struct("floor_id", "element_id", "x1", "y1", "x2", "y2"), F.struct("floor_id", "element_id"))
        grids = grids.where(F.coalesce("label", F.lit("")) != "").groupBy(*on, "axis", "label").agg(first.alias("g")).select(*on, "label", "g.*")
        grids = grids.join(at.where(one).select(*on, "floor_id", "levelled", "ox", "oy").hint("merge"), [*on, "floor_id"]).where("levelled")
        ends = F.array(g.point(col("x1"), col("y1")), g.point(col("x2"), col("y2")))
        drawn = _staged(grids.withColumn("mark", F.concat(F.lit(mapping.grid_prefix), "label")).select(*on, "floor_id", "element_id", "mark", "x1", "y1", "x2", "y2", "ox", "oy"), [*on, "ox", "oy"], "grid", "Grids", points=ends)
        drawn = _placed(drawn).withColumns({"stage": F.lit(1), "action_id": col("id"), "elevation_mm": F.lit(None), "level_id": F.lit(None), "top_level_id": F.lit(None)})
        types = dict(actions.dtypes)
        actions = actions.unionByName(drawn.select(*[col(c).cast(types[c]).alias(c) for c in shape]))
    once = col("levelled") & F.when(col("kind").isin("beam", "floor"), one).when(col("kind") == "column", col("top_level_id").isNotNull()).otherwise(one & col("level_id").isNotNull())
    found = [
        dg.finding(at.groupBy(*on).agg(F.bool_or("levelled").alias("any")), ~col("any"), "ERROR", "REVIT_NO_LEVELS", F.concat_ws(" ", *on)),
        dg.finding(at, col("levelled") & col("drawn") & col("level_id").isNull(), "WARNING", "REVIT_FLOOR_NO_LEVEL", F.lit(None), col("floor_id")),
        dg.finding(placed, ~topped, "INFO", "REVIT_COLUMN_NO_TOP", col("element_id")),
        dg.finding(rows, ~col("sized") & once, "WARNING", "REVIT_NO_SIZE", col("element_id"), col("floor_id")),
    ]
    findings = found[0]
    for f in found[1:]:
        findings = findings.unionByName(f)
    return actions, findings


def planned_levels(levels: DataFrame, mapping: Mapping, on: Sequence[str]) -> DataFrame:
    """Levels to create, with the mapping's prefix, and their place from below."""
    nth = F.row_number().over(W.partitionBy(*on).orderBy("elevation_mm", "level_id"))
    return levels.select(*on, "level_id", F.concat(F.lit(mapping.level_prefix), "name").alias("name"), "elevation_mm", nth.alias("nth"))


def types_to_create(actions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Types that actions ask for, with the parameters and the type they are made of, and how many actions take each."""
    t = actions.where("type_name is not null").withColumn("params", F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))
    return t.groupBy(*on, "category", "family", "type_name", "base_type", "params").agg(F.count("*").alias("n"))
