"""Queries with spatial and other joins (section E of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlake.functions import text as tx
from planlake.operators import matching as mt, spatial as sp, sweeps as sw, tagging as tg
from planlake.sources.proxies import view

from .registry import query

#: What tells outlines apart: ids repeat in the proxy.
BOX = ["rect_id", "x0", "y0", "x1", "y1"]
KINDS = {"column": 1, "beam": 2, "slab": 3, "footing": 4, "opening": 5, "region": 6, "wall": 7}


def boxes(spark, sf, kind: str | None = None, wide: int = 1):
    """Outlines (of one kind), their sides multiplied by wide."""
    r = view(spark, sf, "vR")
    if kind:
        r = r.where(F.col("rect_id") % 10 == KINDS[kind])
    return r.select("rect_id", "floor_id", "x0", "y0", (F.col("x0") + F.col("w") * wide).alias("x1"), (F.col("y0") + F.col("h") * wide).alias("y1"))


def _b(kind: str | None = None, wide: int = 1) -> str:
    where = f" where rect_id % 10 = {KINDS[kind]}" if kind else ""
    return f"(select rect_id, floor_id, x0, y0, x0 + w * {wide} as x1, y0 + h * {wide} as y1 from {{vR}} r{where})"


FRAMES = "(select n_nationkey as frame_no, concat('F', n_nationkey) as frame_id, cast((n_nationkey % 5) * 40000 as bigint) as x0, cast(n_nationkey // 5 * 40000 as bigint) as y0, cast((n_nationkey % 5) * 40000 + 38000 as bigint) as x1, cast(n_nationkey // 5 * 40000 + 38000 as bigint) as y1 from nation)"
IN = "p.x > b.x0 and p.x < b.x1 and p.y > b.y0 and p.y < b.y1"


def frames(spark, sf):
    n, k = view(spark, sf, "nation"), F.col("n_nationkey").cast("long")
    return n.select(F.col("n_nationkey").alias("frame_no"), F.concat(F.lit("F"), k).alias("frame_id"), (k % 5 * 40000).alias("x0"), (F.floor(k / 5) * 40000).alias("y0"), (k % 5 * 40000 + 38000).alias("x1"), (F.floor(k / 5) * 40000 + 38000).alias("y1"))


def in_frames(points, fr, how="inner"):
    """Each point with the frame of lowest number that holds it."""
    pairs = sp.points_in_boxes(points, fr, cell=40000, how=how)
    rest = [F.col(c).alias(c) for c in points.columns]
    return sp.best(pairs, points.columns, [F.col("frame_no")], {"frame_no": F.col("frame_no"), "frame_id": F.col("frame_id"), "fx": F.col("x0"), "fy": F.col("y0")}).select(*rest, "frame_no", "frame_id", "fx", "fy")


@query(f"select frame_id, count(*) as n from (select p.rect_id, p.x, p.y, arg_min(b.frame_id, b.frame_no) as frame_id from (select distinct rect_id, x0 + w // 2 as x, y0 + h // 2 as y from {{vR}} r) p left join {FRAMES} b on {IN} group by 1, 2, 3) t group by frame_id")
def e01_floor_assign(spark, sf):
    mid = view(spark, sf, "vR").select("rect_id", F.expr("x0 + w div 2").alias("x"), F.expr("y0 + h div 2").alias("y")).distinct()
    return in_frames(mid, frames(spark, sf), "left").groupBy("frame_id").agg(F.count("*").alias("n"))


@query(f"select b.frame_id, coalesce(arg_min(p.x, p.note_id), any_value(b.x0)) as ox, coalesce(arg_min(p.y, p.note_id), any_value(b.y0)) as oy, count(p.note_id) > 0 as has_origin from {FRAMES} b left join {{vN}} p on {IN} group by b.frame_id")
def e02_floor_origin(spark, sf):
    points = view(spark, sf, "vN").select("note_id", "x", "y")
    first = sp.best(in_frames(points, frames(spark, sf)), ["frame_id"], [F.col("note_id")], {"px": F.col("x"), "py": F.col("y")})
    out = frames(spark, sf).join(first.hint("merge"), "frame_id", "left")
    return out.select("frame_id", F.coalesce("px", "x0").alias("ox"), F.coalesce("py", "y0").alias("oy"), F.col("px").isNotNull().alias("has_origin"))


@query(f"""select b.frame_id, coalesce(arg_min(p.text, row(-p.prio, -p.size, p.note_id)), concat('Floor ', any_value(b.frame_no))) as floor_name, coalesce(max(p.prio), 0) as priority
from {FRAMES} b left join (select note_id, x, y, trim(text) as text, note_id % 7 as size, case when note_id % 11 = 0 then 3 when contains(text, 'FOUNDATION') then 2 else 1 end as prio from {{vN}} n where (contains(text, 'FLOOR') or contains(text, 'FOUNDATION')) and note_id % 12 < 2) p on {IN} group by b.frame_id""")
def e03_floor_name(spark, sf):
    t = view(spark, sf, "vN").where("note_id % 12 < 2").where(tx.is_floor_label(F.col("text")))
    prio = F.when(F.col("note_id") % 11 == 0, 3).when(F.col("text").contains("FOUNDATION"), 2).otherwise(1)
    t = t.select("note_id", "x", "y", tx.clean(F.col("text")).alias("text"), (F.col("note_id") % 7).alias("size"), prio.alias("prio"))
    named = sp.best(in_frames(t, frames(spark, sf)), ["frame_id"], [-F.col("prio"), -F.col("size"), F.col("note_id")], {"name": F.col("text"), "prio": F.col("prio")})
    out = frames(spark, sf).join(named.hint("merge"), "frame_id", "left")
    return out.select("frame_id", F.coalesce("name", F.concat(F.lit("Floor "), "frame_no")).alias("floor_name"), F.coalesce("prio", F.lit(0)).alias("priority"))


@query(f"""with d as (select note_id, x, y, cast(regexp_extract(text, 'ARE (\\d+)MM', 1) as double) as v from {{vN}} n where contains(text, 'ALL BEAMS ARE'))
select b.frame_id, coalesce(arg_min(p.v, p.note_id), (select arg_min(v, note_id) from d)) as beam_depth_mm, case when count(p.v) > 0 then 'floor' else 'drawing' end as source from {FRAMES} b left join d p on {IN} group by b.frame_id""")
def e04_note_defaults(spark, sf):
    """The first default of a floor, else the first of the drawing."""
    notes = tx.parse_tags(view(spark, sf, "vN").where(F.upper("text").contains("ALL "))).where("note_what = 'beam'").select("note_id", "x", "y", F.col("note_value_mm").alias("v"))
    own = sp.best(in_frames(notes, frames(spark, sf)), ["frame_id"], [F.col("note_id")], {"v": F.col("v")})
    first = notes.agg(F.min_by("v", "note_id").alias("any_v"))  # one row
    out = frames(spark, sf).join(own.hint("merge"), "frame_id", "left").join(F.broadcast(first))
    return out.select("frame_id", F.coalesce("v", "any_v").alias("beam_depth_mm"), F.when(F.col("v").isNotNull(), "floor").otherwise("drawing").alias("source"))


def notes(spark, sf):
    return view(spark, sf, "vN").select("note_id", "floor_id", "x", "y", "text")


def note_places(spark, sf):
    """floor_id, x, y, ids: where notes are, with all their ids in order."""
    return notes(spark, sf).groupBy("floor_id", "x", "y").agg(F.sort_array(F.collect_list("note_id")).alias("ids"))


@query(f"select p.note_id, arg_min(b.rect_id, row((b.x1 - b.x0) * (b.y1 - b.y0), b.rect_id)) as rect_id, count(*) as n_around from {{vN}} p join {_b(wide=6)} b on p.floor_id = b.floor_id and {IN} group by p.note_id")
def e05_smallest_container(spark, sf):
    n, b = notes(spark, sf), boxes(spark, sf, wide=6)
    around = sw.smallest_around(n, b, "floor_id", "rect_id")
    if around is not None:
        met = n.drop("text").join(around.hint("merge"), ["floor_id", "x", "y"])
        return sp.least(met, ["note_id"], F.col("area"), F.col("id"), n_around=F.sum("n")).select("note_id", F.col("second").alias("rect_id"), "n_around")
    pairs = sp.points_in_boxes(n, b, ["floor_id"], 4000)
    return sp.least(pairs, ["note_id"], sp.area(), F.col("rect_id"), n_around=F.count("*")).select("note_id", F.col("second").alias("rect_id"), "n_around")


_D2 = "(greatest(b.x0 - p.x, 0, p.x - b.x1) * greatest(b.x0 - p.x, 0, p.x - b.x1) + greatest(b.y0 - p.y, 0, p.y - b.y1) * greatest(b.y0 - p.y, 0, p.y - b.y1))"
_R = "greatest(600, cast(1.5 * greatest(b.x1 - b.x0, b.y1 - b.y0) as bigint))"
CAND_SQL = f"""select p.note_id, b.rect_id, round(sqrt({_D2}) * case when p.note_id % 3 <> b.rect_id % 3 then 3.0 else 1.0 end * case when p.note_id % 2 <> (b.x0 % 2) then 2.5 else 1.0 end, 3) as score
from {{vN}} p join {_b("column")} b on p.floor_id = b.floor_id and {_D2} <= {_R} * {_R}"""


def candidates(spark, sf, factor: float = 1.0):
    """Notes and columns in reach of each other, with a score: distance, times 3 if sizes differ, times 2.5 if directions do."""
    return scored(notes(spark, sf), boxes(spark, sf, "column"), factor)


def scored(n, columns, factor: float = 1.0, most: float | None = None, more: list[str] = [], cell: float = 2000):  # noqa: B006
    """Candidate pairs of notes and columns, those of a score above most left out. more: columns of the notes that come along."""
    reach = F.greatest(F.lit(600), (1.5 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).cast("long")) * factor
    if most is not None:  # a score is no less than its distance
        reach = F.least(reach, F.lit(most + 1.0))
    d2 = sp.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    pairs = sp.points_in_boxes(n, columns, ["floor_id"], cell, reach, d2 <= reach * reach)
    penalty = F.when(F.col("note_id") % 3 != F.col("rect_id") % 3, 3.0).otherwise(1.0) * F.when(F.col("note_id") % 2 != F.col("x0") % 2, 2.5).otherwise(1.0)
    out = pairs.select("note_id", *more, "rect_id", F.round(F.sqrt(d2) * penalty, 3).alias("score"))
    return out if most is None else out.where(F.col("score") <= most)


def greedy_candidates(spark, sf):
    """a, b, score: notes to columns, one to one, by (score, note, column). Notes in one place whose numbers leave the same remainders have the same scores."""
    n = notes(spark, sf).withColumns({"m2": F.col("note_id") % 2, "m3": F.col("note_id") % 3})
    places = mt.by_place(n, "note_id", ["floor_id", "x", "y", "m2", "m3"])
    columns = boxes(spark, sf, "column").withColumnRenamed("rect_id", "b")

    def pairs(places, columns, most):
        n = places.select("place", "floor_id", "x", "y", F.element_at("tags", 1).alias("note_id"))
        c = scored(n, columns.withColumnRenamed("b", "rect_id"), most=most, more=["floor_id", "place"], cell=4000)
        return c.select("floor_id", "place", F.col("rect_id").alias("b"), "score")

    return mt.greedy_places(places, columns, pairs, ["floor_id"], [0.0, 20.0, 60.0, 150.0, 360.0, 800.0, 2000.0])


@query(CAND_SQL)
def e06_tag_candidates(spark, sf):
    return candidates(spark, sf)


@query(f"""with n as (select p.note_id, b.note_id as other, (p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y) as d2 from {{vN}} p join {{vN}} b on p.floor_id = b.floor_id and abs(p.x - b.x) <= 1500 and abs(p.y - b.y) <= 1500 and p.note_id % 12 in (6, 8) and b.note_id % 12 = 9),
a as (select note_id, arg_min(other, row(d2, other)) as other from n group by note_id), b as (select other, arg_min(note_id, row(d2, note_id)) as note_id from n group by other)
select a.note_id as mark_id, a.other as size_id from a join b on a.note_id = b.note_id and a.other = b.other""")
def e07_mutual_nearest(spark, sf):
    """Mark and size texts that are each other's nearest."""
    n = notes(spark, sf)
    marks, sizes = n.where("note_id % 12 in (6, 8)"), n.where("note_id % 12 = 9").select(F.col("note_id").alias("other"), "floor_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    near = (F.abs(F.col("x") - F.col("x0")) <= 1500) & (F.abs(F.col("y") - F.col("y0")) <= 1500)
    pairs = sp.points_in_boxes(marks, sizes, ["floor_id"], 3000, 1500, near)
    d2 = sp.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    pairs = pairs.select("note_id", "other", d2.alias("d2"))
    a = sp.least(pairs, ["note_id"], F.col("d2"), F.col("other")).select("note_id", F.col("second").alias("best_size"))
    b = sp.least(pairs, ["other"], F.col("d2"), F.col("note_id")).select("other", F.col("second").alias("best_mark"))
    return a.join(b.hint("merge"), (F.col("best_size") == F.col("other")) & (F.col("best_mark") == F.col("note_id"))).select(F.col("note_id").alias("mark_id"), F.col("other").alias("size_id"))


def stacked_texts(spark, sf):
    """Notes of drawings of a thousand orders, with heights and rotations."""
    n = view(spark, sf, "vN").select(F.expr("note_id div 1000").alias("drawing_id"), F.col("note_id").alias("id"), "text", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (125 + 25.0 * (F.col("note_id") % 3)).alias("text_height"), F.when(F.col("note_id") % 5 == 0, 90.0).otherwise(0.0).alias("rotation"))
    return n


@query("""with n as (select note_id as id, note_id // 1000 as drawing, note_id % 12 as m, text, x::double as x, y::double as y, 125 + 25.0 * (note_id % 3) as h, case when note_id % 5 = 0 then 90 else 0 end as r from {vN} n),
t as (select *, case m when 0 then id % 30 when 3 then 75 + 25 * (id % 4) end::double as thk, case when m = 9 then 'H0' when m = 10 then concat('B', id % 50) end as mark from n),
c as (select a.id as a, b.id as b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from t a join t b on a.drawing = b.drawing and a.m = 10 and b.m in (0, 3) and a.r = b.r and abs(a.x - b.x) <= 3 * a.h and abs(a.y - b.y) <= 3 * a.h where d <= 3 * a.h),
p as (select a, arg_min(b, row(d, b)) as b from c group by a intersect select arg_min(a, row(d, a)), b from c group by b)
select t.id, s.id as size_id, case when s.id is not null or t.m in (0, 3, 9) then 'size' when t.m = 10 then 'mark' else 'other' end as kind, case when s.id is not null then concat(t.text, ' | ', s.text) else t.text end as text, t.mark, case when t.m = 9 then 200 + 50 * (t.id % 3) end::double as width_mm,
 case when t.m = 9 then 400 end::double as depth_mm, cast(null as double) as diameter_mm, coalesce(t.thk, s.thk) as thickness_mm, case when s.id is not null then (t.x + s.x) / 2 else t.x end as x, case when s.id is not null then (t.y + s.y) / 2 else t.y end as y, greatest(t.h, s.h)::double as text_height
from t left join p on t.id = p.a left join t s on s.id = p.b where t.id not in (select b from p)""")
def e07_paired_tags(spark, sf):
    """All notes as tags: marks with the size beside them, one to one, the rest as they are."""
    t = tg.paired_tags(stacked_texts(spark, sf), ["drawing_id"])
    return t.select("id", "size_id", "kind", "text", "mark", "width_mm", "depth_mm", "diameter_mm", "thickness_mm", "x", "y", "text_height")


@query(f"""with c as ({CAND_SQL}), wide as (select p.note_id, b.rect_id, {_D2} as d2 from {{vN}} p join {_b("column")} b on p.floor_id = b.floor_id and {_D2} <= 6.25 * {_R} * {_R})
select note_id, arg_min(rect_id, row(d2, rect_id)) as rect_id from wide where note_id not in (select note_id from c) group by note_id""")
def e08_orphans_nearest(spark, sf):
    """Notes without a candidate: the nearest column within two and a half times its reach."""
    near = candidates(spark, sf)
    reach = F.greatest(F.lit(600), (1.5 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).cast("long")) * 2.5
    d2 = sp.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    orphans = notes(spark, sf).join(near.select("note_id").distinct().hint("merge"), "note_id", "left_anti")
    pairs = sp.points_in_boxes(orphans, boxes(spark, sf, "column"), ["floor_id"], 4000, reach, d2 <= reach * reach)
    return sp.least(pairs, ["note_id"], d2, F.col("rect_id")).select("note_id", F.col("second").alias("rect_id"))


def _schedule(spark, sf):
    p = view(spark, sf, "part")
    cat = F.expr("case p_partkey % 3 when 0 then 'column' when 1 then 'wall' else 'beam' end")
    return p.select(F.col("p_partkey").alias("table_no"), cat.alias("category"), F.expr("concat('c', p_size)").alias("mark"), (100 + 10 * F.col("p_size")).alias("width"))


_SCHED = "(select p_partkey as table_no, case p_partkey % 3 when 0 then 'column' when 1 then 'wall' else 'beam' end as category, concat('c', p_size) as mark, 100 + 10 * p_size as width from part)"


@query(f"""select t.tag_id, arg_min(s.table_no, row(case when s.category = 'wall' then 0 else 1 end, s.table_no)) as table_no, arg_min(s.category, row(case when s.category = 'wall' then 0 else 1 end, s.table_no)) as category
from {{vT}} t left join {_SCHED} s on upper(s.mark) = upper(regexp_extract(t.text, '^(C\\d+)-', 1)) where t.text like 'C%-%' group by t.tag_id""")
def e09_schedule_lookup(spark, sf):
    """Schedule row of a mark: of the wanted category first, else any, lowest table first."""
    return _lookup(spark, sf, ["wall"]).select("tag_id", "table_no", "category")


def _lookup(spark, sf, wanted):
    t = view(spark, sf, "vT").where("text like 'C%-%'").select("tag_id", F.upper(tx.group(F.col("text"), r"^(C\d+)-", 1)).alias("_m"))
    s = _schedule(spark, sf).groupBy(F.upper("mark").alias("_s"), "category").agg(F.min("table_no").alias("table_no"), F.min_by("width", "table_no").alias("width"))
    rank = F.lit(len(wanted))
    for i, w in reversed(list(enumerate(wanted))):
        rank = F.when(F.col("category") == w, i).otherwise(rank)
    pairs = t.join(s.hint("merge"), F.col("_m") == F.col("_s"), "left")
    return sp.best(pairs, ["tag_id"], [rank, F.col("table_no")], {"table_no": F.col("table_no"), "category": F.col("category"), "width": F.col("width")})


@query(f"""select t.tag_id, arg_min(s.category, row(case s.category when 'column' then 0 when 'wall' then 1 else 2 end, s.table_no)) as category,
arg_min(s.width, row(case s.category when 'column' then 0 when 'wall' then 1 else 2 end, s.table_no)) as width
from {{vT}} t left join {_SCHED} s on upper(s.mark) = upper(regexp_extract(t.text, '^(C\\d+)-', 1)) where t.text like 'C%-%' group by t.tag_id""")
def e10_chained_lookup(spark, sf):
    """Column schedule, then wall, then any."""
    return _lookup(spark, sf, ["column", "wall"]).select("tag_id", "category", "width")


@query("""with g as (select n_nationkey as label, cast(n_nationkey * 8000 as bigint) as at from nation)
select p.rect_id, p.x0, p.y0, concat(x.label, '/', y.label) as grid_ref from {vR} p join (select r.rect_id, r.x0, arg_min(g.label, row(abs(r.x0 - g.at), g.label)) as label from {vR} r join g on abs(r.x0 - g.at) <= 600 group by r.rect_id, r.x0) x on p.rect_id = x.rect_id and p.x0 = x.x0
join (select r.rect_id, r.y0, arg_min(g.label, row(abs(r.y0 - g.at), g.label)) as label from {vR} r join g on abs(r.y0 - g.at) <= 600 group by r.rect_id, r.y0) y on p.rect_id = y.rect_id and p.y0 = y.y0""")
def e11_grid_intersection(spark, sf):
    lines = view(spark, sf, "nation").select(F.col("n_nationkey").alias("label"), (F.col("n_nationkey").cast("long") * 8000).alias("at"))
    r = view(spark, sf, "vR").select("rect_id", "x0", "y0").withColumn("_row", F.struct("rect_id", "x0", "y0"))
    near = lambda df, v, name: sp.best(sp.near_values(df, lines, v, "at", 600), [c for c in df.columns], [F.abs(F.col(v) - F.col("at")), F.col("label")], {name: F.col("label")})
    # a repeated outline is one group; n restores how often it came
    r = r.groupBy("rect_id", "x0", "y0").agg(F.count("*").alias("n"))
    both = near(near(r, "x0", "gx"), "y0", "gy")
    return both.select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i"), "rect_id", "x0", "y0", F.concat("gx", F.lit("/"), "gy").alias("grid_ref")).drop("_i")


_BANDS = "(select x * 10 - 4500 as x0, y * 10 - 250 as y0, x * 10 + 5000 as x1, y * 10 + 250 as y1, floor_id from {vT} t where starts_with(text, 'INDICATES'))"


def _bands(spark, sf):
    t = view(spark, sf, "vT").where(tx.is_legend_line(F.col("text")))
    x, y = F.col("x") * 10, F.col("y") * 10
    return t.select("floor_id", (x - 4500).alias("x0"), (y - 250).alias("y0"), (x + 5000).alias("x1"), (y + 250).alias("y1"))


@query(f"select floor_id, count(*) as kept from {_b()} a where not exists (select 1 from {_BANDS} b where a.floor_id = b.floor_id and 2 * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= (a.x1 - a.x0) * (a.y1 - a.y0)) group by floor_id")
def e12_not_in_legend(spark, sf):
    """Outlines of which less than half is in any legend band."""
    a = boxes(spark, sf)
    hit = sp.overlaps(a, _bands(spark, sf), ["floor_id"], 5000).where(2 * F.col("overlap") >= sp.area()).select(*BOX).distinct()
    return a.join(hit.hint("merge"), BOX, "left_anti").groupBy("floor_id").agg(F.count("*").alias("kept"))


@query(f"""select t.tag_id, arg_min(b.rect_id, row((t.x - b.cx) * (t.x - b.cx) + (t.y - b.cy) * (t.y - b.cy), b.rect_id)) as swatch_id
from (select tag_id, floor_id, x * 10 as x, y * 10 as y from {{vT}} t where starts_with(text, 'INDICATES')) t join (select *, (x0 + x1) // 2 as cx, (y0 + y1) // 2 as cy from {_b()} b) b
on t.floor_id = b.floor_id and abs(t.y - b.cy) <= 625 and t.x - b.cx between -1000 and 7500 group by t.tag_id""")
def e13_legend_swatch(spark, sf):
    """Nearest swatch in the window left of a legend line."""
    t = view(spark, sf, "vT").where(tx.is_legend_line(F.col("text"))).select("tag_id", "floor_id", (F.col("x") * 10).alias("tx"), (F.col("y") * 10).alias("ty"))
    zone = t.withColumns({"x0": F.col("tx") - 7500, "x1": F.col("tx") + 1000, "y0": F.col("ty") - 625, "y1": F.col("ty") + 625})
    mids = boxes(spark, sf).select("rect_id", "floor_id", F.expr("(x0 + x1) div 2").alias("x"), F.expr("(y0 + y1) div 2").alias("y"))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    pairs = sp.points_in_boxes(mids, zone, ["floor_id"], 5000, inside=inside)
    d2 = (F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")) + (F.col("ty") - F.col("y")) * (F.col("ty") - F.col("y"))
    return sp.least(pairs, ["tag_id"], d2, F.col("rect_id")).select("tag_id", F.col("second").alias("swatch_id"))


@query("select l_orderkey, l_linenumber, l_partkey, case l_returnflag when 'A' then 'sunk' else 'cutout' end as meaning from lineitem where l_returnflag in ('A', 'R') and l_quantity >= 20 and l_linenumber <> 7")
def e14_hatch_meaning(spark, sf):
    legend = spark.createDataFrame([("A", "sunk"), ("R", "cutout"), ("N", "other")], "pattern string, meaning string").where("meaning <> 'other'")
    hatches = view(spark, sf, "lineitem").where("l_quantity >= 20 and l_linenumber <> 7")
    return hatches.join(F.broadcast(legend), F.upper("l_returnflag") == F.col("pattern")).select("l_orderkey", "l_linenumber", "l_partkey", "meaning")


_OV = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"


@query(f"select a.rect_id, a.x0, a.y0, round(max({_OV} / {_AREA}), 6) as cover from {_b('column')} a join {_b('region', 4)} b on a.floor_id = b.floor_id and {_OV} > 0 group by a.rect_id, a.x0, a.y0 having max({_OV} / {_AREA}) >= 0.5")
def e15_stop_columns(spark, sf):
    """Columns of which at least half is under one stop region."""
    pairs = sp.overlaps(boxes(spark, sf, "column"), boxes(spark, sf, "region", 4), ["floor_id"], 2000)
    return pairs.groupBy("rect_id", "x0", "y0").agg(F.max(F.col("overlap") / sp.area()).alias("c")).where("c >= 0.5").select("rect_id", "x0", "y0", F.round("c", 6).alias("cover"))


@query(f"select floor_id, count(*) as kept from {_b('column')} a where not exists (select 1 from {_b('wall', 4)} b where a.floor_id = b.floor_id and 2 * {_OV} >= least({_AREA}, (b.x1 - b.x0) * (b.y1 - b.y0))) group by floor_id")
def e16_own_columns(spark, sf):
    """Columns that no stopping outline covers by half of the smaller one."""
    a = boxes(spark, sf, "column")
    hit = sp.overlaps(a, boxes(spark, sf, "wall", 4), ["floor_id"], 2000).where(2 * F.col("overlap") >= F.least(sp.area(), sp.area("b_"))).select(*BOX).distinct()
    return a.join(hit.hint("merge"), BOX, "left_anti").groupBy("floor_id").agg(F.count("*").alias("kept"))


@query(f"""select coalesce(cast(b.rect_id as varchar), concat('tag', p.note_id)) as slab_id, count(*) as n_tags from {{vN}} p left join (select min(rect_id) as rect_id, floor_id, x0, y0, x1, y1 from {_b('slab', 10)} b group by floor_id, x0, y0, x1, y1) b on p.floor_id = b.floor_id and {IN} group by 1""")
def e17_slab_tags(spark, sf):
    """Tags by the slab around them; tags in none are slabs of their own."""
    slabs = boxes(spark, sf, "slab", 10).groupBy("floor_id", "x0", "y0", "x1", "y1").agg(F.min("rect_id").alias("rect_id"))
    pairs = sp.points_in_boxes(notes(spark, sf), slabs, ["floor_id"], 5000, how="left")
    n = pairs.groupBy("rect_id", F.when(F.col("rect_id").isNull(), F.col("note_id")).alias("note_id")).agg(F.count("*").alias("n_tags"))
    return n.select(F.coalesce(F.col("rect_id").cast("string"), F.concat(F.lit("tag"), "note_id")).alias("slab_id"), "n_tags")


@query(f"select b.rect_id, count(*) as n_tags, min(p.note_id) as first_tag from {{vN}} p join {_b('wall')} b on p.floor_id = b.floor_id and p.x > b.x0 - 1200 and p.x < b.x1 + 1200 and p.y > b.y0 - 1200 and p.y < b.y1 + 1200 group by b.rect_id")
def e18_wall_tags(spark, sf):
    pairs = sp.points_in_boxes(notes(spark, sf), boxes(spark, sf, "wall"), ["floor_id"], 2500, 1200)
    return pairs.groupBy("rect_id").agg(F.count("*").alias("n_tags"), F.min("note_id").alias("first_tag"))


@query(f"select b.rect_id, string_agg(cast(p.note_id as varchar), ' ' order by -p.y, p.x, p.note_id) as label from {{vN}} p join {_b('opening', 8)} b on p.floor_id = b.floor_id and {IN} group by b.rect_id")
def e19_opening_labels(spark, sf):
    """All texts inside an opening in reading order."""
    b = boxes(spark, sf, "opening", 8).withColumn("n", F.count("*").over(W.partitionBy("rect_id")))
    row, at = F.struct((-F.col("y")).alias("up"), "x", "ids"), lambda r: (r["x"], -r["up"])
    held = lambda some: sp.with_points(some, note_places(spark, sf), ["floor_id"], 6400, row, at, "inner")
    label = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("label")
    # an id of several boxes has one label for all of them; only those bring their places together
    alone = held(b.where("n = 1")).select("rect_id", label(F.flatten("held.ids")))
    several = held(b.where("n > 1")).groupBy("rect_id").agg(F.sort_array(F.flatten(F.collect_list("held"))).alias("held"))
    # a place that two boxes hold comes twice, and so does each of its ids
    twice = F.size(F.array_distinct("held")) < F.size("held")
    each = F.flatten(F.transform("held", lambda p: F.transform(p["ids"], lambda i: F.struct(p["up"].alias("up"), p["x"].alias("x"), i.alias("id")))))
    return alone.unionByName(several.select("rect_id", label(F.when(twice, F.sort_array(each)["id"]).otherwise(F.flatten("held.ids")))))


@query(f"select floor_id, count(*) as n_stairs, sum(n) as n_labels from (select b.floor_id, b.rect_id, b.x0, b.y0, b.x1, b.y1, count(p.note_id) as n from (select distinct * from {_b('opening', 2)} b) b left join {{vN}} p on p.floor_id = b.floor_id and p.x > b.x0 - 1000 and p.x < b.x1 + 1000 and p.y > b.y0 - 1000 and p.y < b.y1 + 1000 group by 1, 2, 3, 4, 5, 6) t group by floor_id")
def e20_stair_labels(spark, sf):
    stairs = boxes(spark, sf, "opening", 2).distinct()
    n = sp.points_in_boxes(notes(spark, sf), stairs, ["floor_id"], 2500, 1000).groupBy(*BOX).agg(F.count("*").alias("n"))
    return stairs.join(n.hint("merge"), BOX, "left").groupBy("floor_id").agg(F.count("*").alias("n_stairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_labels"))


@query(f"""with d as (select rect_id, concat(floor_id, ' ', x0, ' ', y0, ' ', x1, ' ', y1) as corners, rect_id % 2 as up from {_b('opening')} b union all select rect_id + 1000000000, concat(floor_id, ' ', x0, ' ', y0, ' ', x1, ' ', y1), 1 - rect_id % 2 from {_b('opening')} b where rect_id % 3 = 0),
g as (select corners, list(rect_id) filter (where up = 1) as us, list(rect_id) filter (where up = 0) as vs from d group by corners),
u as (select unnest(us) as a, vs from g where us is not null and vs is not null), v as (select a, unnest(vs) as b from u)
select least(a, b) as first_id, greatest(a, b) as second_id from v""")
def e21_crosses(spark, sf):
    """Pairs of diagonals, one rising and one falling, of one box: an equi-join on its corners."""
    b = boxes(spark, sf, "opening")
    d = b.withColumn("up", F.col("rect_id") % 2).unionByName(b.where("rect_id % 3 = 0").withColumn("up", 1 - F.col("rect_id") % 2).withColumn("rect_id", F.col("rect_id") + 1_000_000_000))
    key = ["floor_id", "x0", "y0", "x1", "y1"]
    up, down = d.where("up = 1"), d.where("up = 0").withColumnRenamed("rect_id", "other").drop("up")
    return up.join(down, key).select(F.least("rect_id", "other").alias("first_id"), F.greatest("rect_id", "other").alias("second_id"))


@query(f"select p.note_id, arg_min(b.rect_id, row(-greatest(b.x1 - b.x0, b.y1 - b.y0), b.rect_id)) as line_id from {{vN}} p join {_b('beam')} b on p.floor_id = b.floor_id and contains(p.text, 'RAMP') and p.x > b.x0 - 3000 and p.x < b.x1 + 3000 and p.y > b.y0 - 3000 and p.y < b.y1 + 3000 group by p.note_id")
def e22_ramp_line(spark, sf):
    """The longest line in reach of a ramp note."""
    ramps = notes(spark, sf).where(tx.ramp(F.col("text"))["is_ramp"])
    pairs = sp.points_in_boxes(ramps, boxes(spark, sf, "beam"), ["floor_id"], 5000, 3000)
    return sp.least(pairs, ["note_id"], -F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.col("rect_id")).select("note_id", F.col("second").alias("line_id"))


@query(f"select a.rect_id, a.x0, a.y0, round(sum({_OV}) / {_AREA}, 6) as cover from {_b('slab', 6)} a join {_b('opening', 2)} b on a.floor_id = b.floor_id and {_OV} > 0 group by a.rect_id, a.x0, a.y0, a.x1, a.y1")
def e23_panel_cover(spark, sf):
    pairs = sp.overlaps(boxes(spark, sf, "slab", 6).distinct(), boxes(spark, sf, "opening", 2), ["floor_id"], 4000)
    return pairs.groupBy("rect_id", "x0", "y0", "x1", "y1").agg(F.sum("overlap").alias("o")).select("rect_id", "x0", "y0", F.round(F.col("o") / sp.area(), 6).alias("cover"))


@query(f"select a.rect_id, min(b.y1 - b.y0) as min_depth, max(b.y1 - b.y0) as max_depth, count(*) as n_beams from {_b('slab', 6)} a join {_b('beam', 2)} b on a.floor_id = b.floor_id and least(a.x1, b.x1 + 50) >= greatest(a.x0, b.x0 - 50) and least(a.y1, b.y1 + 50) >= greatest(a.y0, b.y0 - 50) group by a.rect_id")
def e24_adjacent_beams(spark, sf):
    pairs = sp.overlaps(boxes(spark, sf, "slab", 6), boxes(spark, sf, "beam", 2), ["floor_id"], 4000, grow=50, touch=True)
    depth = F.col("b_y1") - F.col("b_y0")
    return pairs.groupBy("rect_id").agg(F.min(depth).alias("min_depth"), F.max(depth).alias("max_depth"), F.count("*").alias("n_beams"))


@query(f"select b.rect_id, arg_min(p.text, p.note_id) as hint from {{vN}} p join {_b('slab', 20)} b on p.floor_id = b.floor_id and contains(p.text, 'RAMP') and {IN} group by b.rect_id")
def e25_ramp_in_panel(spark, sf):
    """The first ramp note in each panel: its number by a hash aggregate, its text (an aggregate would sort all pairs for it) by a join."""
    ramps = notes(spark, sf).where(tx.ramp(F.col("text"))["is_ramp"])
    first = sp.points_in_boxes(ramps.select("note_id", "floor_id", "x", "y"), boxes(spark, sf, "slab", 20), ["floor_id"], 10000).groupBy("rect_id").agg(F.min("note_id").alias("note_id"))
    return first.join(ramps.groupBy("note_id").agg(F.array_min(F.collect_set("text")).alias("hint")).hint("merge"), "note_id").select("rect_id", "hint")


@query(f"select a.rect_id, coalesce(max(b.x1 - b.x0), 150) as thickness from {_b('region')} a left join {_b('slab')} b on a.floor_id = b.floor_id and least(a.x1, b.x1 + 400) >= greatest(a.x0, b.x0 - 400) and least(a.y1, b.y1 + 400) >= greatest(a.y0, b.y0 - 400) group by a.rect_id")
def e26_cantilever_thickness(spark, sf):
    """Greatest thickness of a neighbour within 400, else the default."""
    a = boxes(spark, sf, "region")
    pairs = sp.overlaps(a, boxes(spark, sf, "slab"), ["floor_id"], 2000, grow=400, touch=True).groupBy("rect_id").agg(F.max(F.col("b_x1") - F.col("b_x0")).alias("t"))
    return a.select("rect_id").distinct().join(pairs.hint("merge"), "rect_id", "left").select("rect_id", F.coalesce("t", F.lit(150)).alias("thickness"))


@query(f"select b.rect_id, count(p.note_id) as n_stacks, coalesce(string_agg(cast(p.note_id as varchar), ',' order by p.note_id), '') as stacks from (select distinct * from {_b('footing', 8)} b) b left join {{vN}} p on p.floor_id = b.floor_id and {IN} group by b.rect_id, b.x0, b.y0, b.x1, b.y1")
def e27_footing_stacks(spark, sf):
    f = boxes(spark, sf, "footing", 8).distinct()
    out = sp.with_points(f, note_places(spark, sf), ["floor_id"], 5600, F.struct("ids", "x", "y"), lambda r: (r["x"], r["y"]))
    ids = F.coalesce(F.transform(F.sort_array(F.flatten("held.ids")), lambda i: i.cast("string")), F.array().cast("array<string>"))
    return out.select("rect_id", F.size(ids).cast("long").alias("n_stacks"), F.array_join(ids, ",").alias("stacks"))


@query(f"select b.rect_id, count(*) as n_piles, concat(count(*), ' PILES ', max(300 + 50 * (p.note_id % 5)), 'DIA') as line from {{vN}} p join {_b('footing', 10)} b on p.floor_id = b.floor_id and {IN} group by b.rect_id")
def e28_pile_caps(spark, sf):
    pairs = sp.points_in_boxes(notes(spark, sf), boxes(spark, sf, "footing", 10), ["floor_id"], 5000)
    n, dia = F.count("*"), F.max(300 + 50 * (F.col("note_id") % 5))
    return pairs.groupBy("rect_id").agg(n.alias("n_piles"), F.concat(n.cast("string"), F.lit(" PILES "), dia.cast("string"), F.lit("DIA")).alias("line"))


@query(f"select a.rect_id, min(b.rect_id) as raft_id from {_b('region')} a left join {_b('footing', 20)} b on a.floor_id = b.floor_id and a.x0 >= b.x0 and a.x1 <= b.x1 and a.y0 >= b.y0 and a.y1 <= b.y1 group by a.rect_id")
def e29_in_raft(spark, sf):
    a = boxes(spark, sf, "region")
    whole = sp.held_whole(a, boxes(spark, sf, "footing", 20), ["floor_id"], 4000).groupBy("i_rect_id").agg(F.min("rect_id").alias("raft_id")).withColumnRenamed("i_rect_id", "rect_id")
    return a.select("rect_id").distinct().join(whole.hint("merge"), "rect_id", "left")


@query(f"select a.rect_id, max(b.x1 - b.x0) as depth, case when max(b.x1 - b.x0) is null then 'BEAM_NO_SLAB' end as code from {_b('beam')} a left join {_b('slab', 2)} b on a.floor_id = b.floor_id and least(a.x1, b.x1 + 50) >= greatest(a.x0, b.x0 - 50) and least(a.y1, b.y1 + 50) >= greatest(a.y0, b.y0 - 50) group by a.rect_id")
def e30_hidden_beams(spark, sf):
    """A hidden beam is as deep as the thickest slab that it touches."""
    a = boxes(spark, sf, "beam")
    n = sp.overlaps(a, boxes(spark, sf, "slab", 2), ["floor_id"], 2000, grow=50, touch=True).groupBy("rect_id").agg(F.max(F.col("b_x1") - F.col("b_x0")).alias("depth"))
    out = a.select("rect_id").distinct().join(n.hint("merge"), "rect_id", "left")
    return out.withColumn("code", F.when(F.col("depth").isNull(), "BEAM_NO_SLAB"))


@query(f"select a.rect_id, max(a.y1 - a.y0) - max(b.x1 - b.x0) as top_offset from {_b('beam', 2)} a join {_b('slab', 2)} b on a.floor_id = b.floor_id and least(a.x1, b.x1 + 50) >= greatest(a.x0, b.x0 - 50) and least(a.y1, b.y1 + 50) >= greatest(a.y0, b.y0 - 50) group by a.rect_id")
def e31_inverted_offset(spark, sf):
    pairs = sp.overlaps(boxes(spark, sf, "beam", 2), boxes(spark, sf, "slab", 2), ["floor_id"], 2000, grow=50, touch=True)
    return pairs.groupBy("rect_id").agg((F.max(F.col("y1") - F.col("y0")) - F.max(F.col("b_x1") - F.col("b_x0"))).alias("top_offset"))


@query(f"select a.rect_id, arg_min(b.rect_id, row(-(b.y1 - b.y0), b.rect_id)) as beam_id from {_b('wall')} a join {_b('beam', 5)} b on a.floor_id = b.floor_id and 2 * {_OV} >= {_AREA} group by a.rect_id")
def e32_wall_top(spark, sf):
    """The deepest beam that covers at least half of a wall."""
    pairs = sp.overlaps(boxes(spark, sf, "wall"), boxes(spark, sf, "beam", 5), ["floor_id"], 3000).where(2 * F.col("overlap") >= sp.area())
    return sp.least(pairs, ["rect_id"], -(F.col("b_y1") - F.col("b_y0")), F.col("b_rect_id")).select("rect_id", F.col("second").alias("beam_id"))


def _touching(points, supports, reach):
    d2 = sp.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    pairs = sp.points_in_boxes(points, supports, ["floor_id"], 3000, reach, d2 <= reach * reach)
    return sp.least(pairs, ["note_id"], d2, F.col("rect_id")).select("note_id", F.col("second").alias("rect_id"))


@query(f"""with c as (select p.note_id, arg_min(b.rect_id, row({_D2}, b.rect_id)) as id from {{vN}} p join {_b('column')} b on p.floor_id = b.floor_id and {_D2} <= 2250000 group by p.note_id),
r as (select p.note_id, arg_min(b.rect_id, row({_D2}, b.rect_id)) as id from {{vN}} p join {_b('beam')} b on p.floor_id = b.floor_id and {_D2} <= 2250000 group by p.note_id)
select p.note_id, coalesce(c.id, r.id) as support_id, case when c.id is not null then 'column' when r.id is not null then 'beam' end as kind from {{vN}} p left join c on p.note_id = c.note_id left join r on p.note_id = r.note_id""")
def e33_touching_support(spark, sf):
    """Nearest column within reach of a span's end, else nearest run."""
    n = notes(spark, sf)
    c = _touching(n, boxes(spark, sf, "column"), 1500).withColumnRenamed("rect_id", "c")
    r = _touching(n, boxes(spark, sf, "beam"), 1500).withColumnRenamed("rect_id", "r")
    out = n.select("note_id").join(c.hint("merge"), "note_id", "left").join(r.hint("merge"), "note_id", "left")
    return out.select("note_id", F.coalesce("c", "r").alias("support_id"), F.when(F.col("c").isNotNull(), "column").when(F.col("r").isNotNull(), "beam").alias("kind"))


@query(f"select a.rect_id as run_id, b.rect_id as support_id, greatest(a.x0, b.x0) - a.x0 as t1, least(a.x1, b.x1) - a.x0 as t2 from {_b('beam', 8)} a join {_b('column', 2)} b on a.floor_id = b.floor_id and {_OV} > 0 and 4 * {_OV} >= (b.x1 - b.x0) * (b.y1 - b.y0)")
def e34_support_cuts(spark, sf):
    """Interval along a run that each support cuts, if at least a quarter of the support is on it."""
    pairs = sp.overlaps(boxes(spark, sf, "beam", 8), boxes(spark, sf, "column", 2), ["floor_id"], 4000).where(4 * F.col("overlap") >= sp.area("b_"))
    return pairs.select(F.col("rect_id").alias("run_id"), F.col("b_rect_id").alias("support_id"), (F.greatest("x0", "b_x0") - F.col("x0")).alias("t1"), (F.least("x1", "b_x1") - F.col("x0")).alias("t2"))


@query(f"""select a.rect_id as run_id, b.rect_id as by_id, greatest(a.x0, b.x0) - a.x0 as t1, least(a.x1, b.x1) - a.x0 as t2 from {_b('beam', 5)} a join {_b('beam', 5)} b on a.floor_id = b.floor_id and a.rect_id <> b.rect_id and {_OV} > 0
and (b.y1 - b.y0 > a.y1 - a.y0 or (b.y1 - b.y0 = a.y1 - a.y0 and (b.x1 - b.x0 > a.x1 - a.x0 or (b.x1 - b.x0 = a.x1 - a.x0 and b.rect_id < a.rect_id))))""")
def e35_crossing_cuts(spark, sf):
    """Where runs cross, the deeper, then longer, then first one cuts the other."""
    r = boxes(spark, sf, "beam", 5)
    pairs = sp.overlaps(r, r, ["floor_id"], 4000).where("rect_id <> b_rect_id")
    mine = F.struct((F.col("y1") - F.col("y0")).alias("d"), (F.col("x1") - F.col("x0")).alias("l"), (-F.col("rect_id")).alias("i"))
    other = F.struct((F.col("b_y1") - F.col("b_y0")).alias("d"), (F.col("b_x1") - F.col("b_x0")).alias("l"), (-F.col("b_rect_id")).alias("i"))
    return pairs.where(other > mine).select(F.col("rect_id").alias("run_id"), F.col("b_rect_id").alias("by_id"), (F.greatest("x0", "b_x0") - F.col("x0")).alias("t1"), (F.least("x1", "b_x1") - F.col("x0")).alias("t2"))


@query("select o.o_orderkey as level_id, n.n_name as floor_name, n.n_regionkey as plan_id from orders o left join nation n on o.o_custkey % 30 = n.n_nationkey")
def e36_levels_floors(spark, sf):
    """Level rows by floor; several levels may share a plan, levels without one stay."""
    o, n = view(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 30), view(spark, sf, "nation")
    return o.join(n, F.col("k") == F.col("n_nationkey"), "left").select(F.col("o_orderkey").alias("level_id"), F.col("n_name").alias("floor_name"), F.col("n_regionkey").alias("plan_id"))


@query(f"select b.frame_id, count(*) as n_hints, min(p.note_id) as first_hint from {{vN}} p join {FRAMES} b on p.note_id % 12 < 2 and {IN} group by b.frame_id")
def e37_level_hints(spark, sf):
    n = notes(spark, sf).where(tx.level_hint(F.col("text"))["level_name"].isNotNull())
    return in_frames(n, frames(spark, sf)).groupBy("frame_id").agg(F.count("*").alias("n_hints"), F.min("note_id").alias("first_hint"))


MODEL = f"(select rect_id as id, floor_id, min(x0) as x0, min(y0) as y0, min(x1) as x1, min(y1) as y1 from {_b('column')} b group by rect_id, floor_id)"
DRAWN = f"(select case when id % 3 = 0 then id + 5000000000 else id end as id, floor_id, x0 + id % 40 as x0, y0, x1 + id % 40 as x1, y1 + case when id % 9 = 0 then 200 else 0 end as y1 from {MODEL} m where id % 13 <> 0)"


def snapshots(spark, sf):
    """The model's columns, and a drawing of them that was moved, stretched, thinned and in part renumbered."""
    m = boxes(spark, sf, "column").groupBy(F.col("rect_id").alias("id"), "floor_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    shift = F.col("id") % 40
    d = m.where("id % 13 <> 0").select(F.when(F.col("id") % 3 == 0, F.col("id") + 5_000_000_000).otherwise(F.col("id")).alias("id"), "floor_id", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), (F.col("y1") + F.when(F.col("id") % 9 == 0, 200).otherwise(0)).alias("y1"))
    return m, d


def matched(m, d):
    """model id, drawing id: by id, else the unmatched drawing box of best overlap from one half on; ids null where there is none."""
    ids = m.select(F.col("id").alias("m"), F.col("floor_id").alias("_f")).join(d.select(F.col("id").alias("d"), F.col("floor_id").alias("_g")), (F.col("m") == F.col("d")) & (F.col("_f") == F.col("_g"))).select("m", "d")
    rest_m, rest_d = m.join(ids.select(F.col("m").alias("id")).hint("merge"), "id", "left_anti"), d.join(ids.select(F.col("d").alias("id")).hint("merge"), "id", "left_anti")
    pairs = sp.overlaps(rest_m, rest_d, ["floor_id"], 1000).withColumn("iou", sp.iou()).where("iou >= 0.5")
    near = sp.best(pairs, ["id"], [-F.col("iou"), F.col("b_id")], {"d": F.col("b_id")}).select(F.col("id").alias("m"), "d")
    return ids.withColumn("how", F.lit("id")).unionByName(near.withColumn("how", F.lit("overlap")))


_IOU = f"round({_OV} / ({_AREA} + (b.x1 - b.x0) * (b.y1 - b.y0) - {_OV}), 6)"
MATCH_SQL = f"""select a.id as m, b.id as d, 'id' as how from {MODEL} a join {DRAWN} b on a.id = b.id and a.floor_id = b.floor_id
union all select a.id, arg_min(b.id, row(-({_IOU}), b.id)), 'overlap' from {MODEL} a join {DRAWN} b on a.floor_id = b.floor_id and {_IOU} >= 0.5
 where a.id not in (select id from {DRAWN} x) and b.id not in (select id from {MODEL} x) group by a.id"""


@query(MATCH_SQL)
def e38_model_drawing(spark, sf):
    return matched(*snapshots(spark, sf))


@query("select o_orderkey, round(o_totalprice, 2) as was, round(o_totalprice + o_orderkey % 3, 2) as now from orders where o_orderkey % 3 = 2")
def e39_level_changes(spark, sf):
    o = view(spark, sf, "orders")
    now = o.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + F.col("o_orderkey") % 3).alias("now"))
    return o.join(now, F.col("o_orderkey") == F.col("k")).where("abs(now - o_totalprice) > 1.5").select("o_orderkey", F.round("o_totalprice", 2).alias("was"), F.round("now", 2).alias("now"))


@query(f"""with i as (select b.rect_id, min(p.note_id) as id from {_b('footing')} b join {{vN}} p on p.note_id = b.rect_id // 10 and p.note_id % 2 = 0 group by b.rect_id),
c as (select b.rect_id, arg_min(p.note_id, row((2 * p.x - b.x0 - b.x1) * (2 * p.x - b.x0 - b.x1) + (2 * p.y - b.y0 - b.y1) * (2 * p.y - b.y0 - b.y1), p.note_id)) as id from {_b('footing')} b join {{vN}} p on p.floor_id = b.floor_id and {IN} group by b.rect_id),
n as (select b.rect_id, arg_min(p.note_id, row({_D2}, p.note_id)) as id from {_b('footing')} b join {{vN}} p on p.floor_id = b.floor_id and {_D2} <= 2250000 group by b.rect_id)
select r.rect_id, coalesce(i.id, c.id, n.id) as note_id, case when i.id is not null then 'id' when c.id is not null then 'inside' when n.id is not null then 'near' end as how
from (select distinct rect_id from {_b('footing')} b) r left join i on r.rect_id = i.rect_id left join c on r.rect_id = c.rect_id left join n on r.rect_id = n.rect_id""")
def e40_mark_of(spark, sf):
    """A footing's mark: by stored id, else the one inside nearest its centre, else the nearest within 1500."""
    f, n = boxes(spark, sf, "footing"), notes(spark, sf)
    by_id = f.select("rect_id", F.expr("rect_id div 10").alias("k")).join(n.where("note_id % 2 = 0").select("note_id"), F.col("k") == F.col("note_id")).groupBy("rect_id").agg(F.min("note_id").alias("i"))
    off = lambda a, lo, hi: 2 * F.col(a) - F.col(lo) - F.col(hi)
    c2 = off("x", "x0", "x1") * off("x", "x0", "x1") + off("y", "y0", "y1") * off("y", "y0", "y1")
    inside = sp.least(sp.points_in_boxes(n, f, ["floor_id"], 2000), ["rect_id"], c2, F.col("note_id")).select("rect_id", F.col("second").alias("c"))
    d2 = sp.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    near = sp.least(sp.points_in_boxes(n, f, ["floor_id"], 3000, 1500, d2 <= 2250000), ["rect_id"], d2, F.col("note_id")).select("rect_id", F.col("second").alias("n"))
    out = f.select("rect_id").distinct().join(by_id.hint("merge"), "rect_id", "left").join(inside.hint("merge"), "rect_id", "left").join(near.hint("merge"), "rect_id", "left")
    how = F.when(F.col("i").isNotNull(), "id").when(F.col("c").isNotNull(), "inside").when(F.col("n").isNotNull(), "near")
    return out.select("rect_id", F.coalesce("i", "c", "n").alias("note_id"), how.alias("how"))


@query(f"select frame_id, count(*) as n from (select p.note_id, arg_min(b.frame_id, b.frame_no) as frame_id from {{vN}} p left join {FRAMES} b on {IN} group by p.note_id) t group by frame_id")
def e41_owner_floor(spark, sf):
    return in_frames(notes(spark, sf), frames(spark, sf), "left").groupBy("frame_id").agg(F.count("*").alias("n"))


@query(f"""with c as (select p.note_id, b.rect_id, p.note_id % 3 as quality, {_D2} as d2 from {{vN}} p join {_b('beam')} b on p.floor_id = b.floor_id and {_D2} <= 6250000),
l as (select rect_id, arg_min(note_id, row(quality, d2, note_id)) as note_id, arg_min(row(quality, d2), row(quality, d2, note_id)) as k from c group by rect_id)
select note_id as label_id, arg_min(rect_id, row(k, rect_id)) as line_id from l group by note_id""")
def e42_grid_labels(spark, sf):
    """Each line takes its best label (quality, then distance), then each label its best line."""
    d2 = sp.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    pairs = sp.points_in_boxes(notes(spark, sf), boxes(spark, sf, "beam"), ["floor_id"], 5000, 2500, d2 <= 6250000)
    rank = F.col("note_id") % 3 * 6250001 + d2  # quality, then distance, whose square is at most 6250000
    lines = sp.least(pairs, ["rect_id"], rank, F.col("note_id")).select("rect_id", F.col("first").alias("rank"), F.col("second").alias("label_id"))
    return sp.least(lines, ["label_id"], F.col("rank"), F.col("rect_id")).select("label_id", F.col("second").alias("line_id"))


@query(f"select a.floor_id, count(*) as n, count(*) filter (where i.best >= 0.6) as hits, round(avg(case when i.best >= 0.6 then 1.0 else 0.0 end), 6) as rate from {MODEL} a left join (select a.id, a.floor_id, max({_IOU}) as best from {MODEL} a join {DRAWN} b on a.floor_id = b.floor_id and {_OV} > 0 group by a.id, a.floor_id) i on a.id = i.id and a.floor_id = i.floor_id group by a.floor_id")
def e43_match_rate(spark, sf):
    m, d = snapshots(spark, sf)
    top = sp.overlaps(m, d, ["floor_id"], 1000).withColumn("iou", sp.iou()).groupBy("id", "floor_id").agg(F.max("iou").alias("top"))
    hit = F.when(F.col("top") >= 0.6, 1.0).otherwise(0.0)
    return m.join(top.hint("merge"), ["id", "floor_id"], "left").groupBy("floor_id").agg(F.count("*").alias("n"), F.count_if(F.col("top") >= 0.6).alias("hits"), F.round(F.avg(hit), 6).alias("rate"))


@query(f"""select coalesce(floor_id, 'all') as floor_id, sum(n) as n_texts, sum(used) as n_used, sum(boxes) as n_outlines from (
 select p.floor_id, 1 as n, case when exists (select 1 from {_b(wide=6)} b where b.floor_id = p.floor_id and {IN}) then 1 else 0 end as used, 0 as boxes from {{vN}} p
 union all select floor_id, 0, 0, 1 from {{vR}} r) t group by rollup (floor_id)""")
def e44_coverage_audit(spark, sf):
    """Source texts and outlines by floor, texts that an outline holds, and a total row."""
    n = notes(spark, sf)
    held = sp.points_in_boxes(n, boxes(spark, sf, wide=6), ["floor_id"], 4000, how="left_semi").select("floor_id", F.lit(0).alias("n"), F.lit(1).alias("used"), F.lit(0).alias("boxes"))
    every = n.select("floor_id", F.lit(1).alias("n"), F.lit(0).alias("used"), F.lit(0).alias("boxes")).unionByName(held).unionByName(view(spark, sf, "vR").select("floor_id", F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(1).alias("boxes")))
    return every.rollup("floor_id").agg(F.sum("n").alias("n_texts"), F.sum("used").alias("n_used"), F.sum("boxes").alias("n_outlines")).withColumn("floor_id", F.coalesce("floor_id", F.lit("all")))


@query("""with w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents), b as (select distinct item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from benchmark),
s as (select b.item_id, w.doc_id, count(*) as shared from b join w on b.word = w.word and length(b.word) >= 6 group by b.item_id, w.doc_id)
select item_id, arg_min(doc_id, row(-shared, doc_id)) as doc_id, max(shared) as shared from s group by item_id""")
def e45_shared_words(spark, sf):
    """For every benchmark text the document that shares most of its longer words: an equi-join on words, pre-counted."""
    words = lambda df, k: df.select(k, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 6))).alias("word"))
    b, d = words(view(spark, sf, "benchmark"), "item_id").distinct(), words(view(spark, sf, "documents"), "doc_id").distinct()
    shared = d.join(b.hint("merge"), "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return sp.best(shared, ["item_id"], [-F.col("shared"), F.col("doc_id")], {"doc_id": F.col("doc_id"), "shared": F.col("shared")})
