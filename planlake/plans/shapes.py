"""Queries over geometry columns, filters and sources (sections A, B and D of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions import geom as g
from planlake.operators import arcs, matching as mt, spatial as sp
from planlake.sources import drawings as dw
from planlake.sources.proxies import view

from .joins import FRAMES, IN, _b, boxes, frames, in_frames
from .registry import query


def rings(spark, sf):
    """Outlines as rings; every third is an L, every fifth runs clockwise."""
    r = view(spark, sf, "vR")
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    box = g.ring_of_box(x0, y0, x1, y1)
    ell = F.array(g.point(x0, y0), g.point(x1, y0), g.point(x1, y0 + 100), g.point(x0 + 100, y0 + 100), g.point(x0 + 100, y1), g.point(x0, y1))
    ring = F.when(F.col("rect_id") % 3 == 0, ell).otherwise(box)
    return r.withColumn("ring", F.when(F.col("rect_id") % 5 == 0, F.reverse(ring)).otherwise(ring))


_AREA = "case when rect_id % 3 = 0 then w * 100 + (h - 100) * 100 else w * h end"


@query("select rect_id, x0, y0, case when rect_id % 3 = 0 then 6 else 4 end as n_points, 0.0::double as gap_mm from {vR} r")
def d01_clean_ring(spark, sf):
    """Rings with a repeated and a closing point come back without them."""
    r = rings(spark, sf)
    dirty = F.concat(F.slice("ring", 1, 2), F.slice("ring", 2, 5), F.slice("ring", 1, 1))
    return r.select("rect_id", "x0", "y0", F.size(g.cleaned(dirty, 0.5)).alias("n_points"), g.gap(dirty).alias("gap_mm"))


@query(f"""select rect_id, x0, y0, cast({_AREA} as double) as area, round(case when rect_id % 3 = 0 then (w * 100 * (x0 + w / 2.0) + (h - 100) * 100 * (x0 + 50)) / ({_AREA}) else x0 + w / 2.0 end, 3) as cx,
  round(case when rect_id % 3 = 0 then (w * 100 * (y0 + 50) + (h - 100) * 100 * (y0 + 100 + (h - 100) / 2.0)) / ({_AREA}) else y0 + h / 2.0 end, 3) as cy, cast(x0 + w as double) as x1 from {{vR}} r""")
def d02_area_centroid(spark, sf):
    c = g.centroid(F.col("ring"))
    return rings(spark, sf).select("rect_id", "x0", "y0", F.round(g.area(F.col("ring")), 3).alias("area"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"), g.bounds(F.col("ring"))["x1"].alias("x1"))


@query(f"select rect_id, x0, y0, case when rect_id % 3 = 0 then 'polygon' else 'rect' end as shape, cast(w as double) as width, cast(h as double) as depth from {{vR}} r")
def d03_shape_class(spark, sf):
    """Rectangle if the ring fills its box, circle if it fills 78.5 % of a square one, else polygon."""
    b, a = g.bounds(F.col("ring")), g.area(F.col("ring"))
    w, d = b["x1"] - b["x0"], b["y1"] - b["y0"]
    fill = a / (w * d)
    shape = F.when(fill >= 0.98, "rect").when((F.abs(w - d) <= 0.05 * w) & (F.abs(fill - 0.785398) <= 0.03), "circle").otherwise("polygon")
    return rings(spark, sf).select("rect_id", "x0", "y0", shape.alias("shape"), w.alias("width"), d.alias("depth"))


_OV = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"select a.rect_id, b.rect_id as b_rect_id, round({_OV} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_OV}), 6) as iou from {_b('beam', 2)} a join {_b('wall', 2)} b on a.floor_id = b.floor_id and {_OV} > 0")
def d04_overlap_ratio(spark, sf):
    return sp.overlaps(boxes(spark, sf, "beam", 2), boxes(spark, sf, "wall", 2), ["floor_id"], 2000).select("rect_id", "b_rect_id", sp.iou().alias("iou"))


@query("select rect_id, x0, y0, cast(w * h as double) as area, round(x0 + w / 2.0 + sqrt(w * w + h * h) / 2 * cos(atan2(h, w) + radians(rect_id % 90)), 2) as x3 from {vR} r")
def d05_rotated_corners(spark, sf):
    w, h, rot = F.col("w"), F.col("h"), F.col("rect_id") % 90
    ring = g.rectangle(F.col("x0") + w / 2, F.col("y0") + h / 2, w, h, rot)
    return view(spark, sf, "vR").select("rect_id", "x0", "y0", F.round(g.area(ring), 0).alias("area"), F.round(F.element_at(ring, 3)["x"], 2).alias("x3"))


@query("""select seg_id, round(a, 6) as angle, cast(cast(round(a / 5.0) as bigint) % 36 as integer) as bucket, round(least(abs(a - 170), 180 - abs(a - 170)), 6) as off from (
 select seg_id, case when dy = 0 then 0.0 else degrees(atan2(dy, dx)) + case when dy < 0 then 180 else 0 end end as a from (select seg_id, cast(t2 - t1 as double) as dx, cast(seg_id % 41 * 100 - 2000 as double) as dy from {vS} s) s) t""")
def d06_directions(spark, sf):
    a = g.direction(F.col("t2") - F.col("t1"), F.col("seg_id") % 41 * 100 - 2000)
    s = view(spark, sf, "vS").select("seg_id", a.alias("a"))
    return s.select("seg_id", F.round("a", 6).alias("angle"), g.direction_bucket(F.col("a"), 5).alias("bucket"), F.round(g.direction_difference(F.col("a"), F.lit(170.0)), 6).alias("off"))


@query("select seg_id, round(t1 * cos(radians(30)) + line_no * 100 * sin(radians(30)), 3) as t, round(line_no * 100 * cos(radians(30)) - t1 * sin(radians(30)), 3) as o from {vS} s")
def d07_project(spark, sf):
    x, y, a = F.col("t1"), F.col("line_no") * 100, F.lit(30.0)
    return view(spark, sf, "vS").select("seg_id", F.round(g.along(x, y, a), 3).alias("t"), F.round(g.across(x, y, a), 3).alias("o"))


_T = lambda x, y: f"({x}) * cos(radians(20)) + ({y}) * sin(radians(20))"


@query(f"""select rect_id, x0, y0, round({_T('x0', 'y0')}, 3) as t1, round(case when rect_id % 3 = 0 then greatest({_T('x0 + w', 'y0 + 100')}, {_T('x0 + 100', 'y0 + h')}) else {_T('x0 + w', 'y0 + h')} end, 3) as t2 from {{vR}} r""")
def d08_interval(spark, sf):
    """Interval of every ring on an axis: from the lower left corner to the farthest."""
    t = g.interval(F.col("ring"), F.lit(20.0))
    return rings(spark, sf).select("rect_id", "x0", "y0", F.round(t["t1"], 3).alias("t1"), F.round(t["t2"], 3).alias("t2"))


@query(r"select tag_id, round(length(text) * 125 * 0.7, 3) as box_w, cast(125 as double) as box_h, round(x + length(text) * 125 * 0.35, 3) as cx from {vT} t")
def d09_text_boxes(spark, sf):
    b = g.text_box(F.col("text"), F.col("text_height"))
    return view(spark, sf, "vT").select("tag_id", F.round(b["box_w"], 3).alias("box_w"), b["box_h"].cast("double").alias("box_h"), F.round(F.col("x") + b["box_w"] / 2, 3).alias("cx"))


_CX = f"round((w * 100 * (x0 + w / 2.0) + (h - 100) * 100 * (x0 + 50)) / ({_AREA}), 3)"
_CY = f"round((w * 100 * (y0 + 50) + (h - 100) * 100 * (y0 + 100 + (h - 100) / 2.0)) / ({_AREA}), 3)"


@query(f"""select rect_id, x0, y0, case when rect_id % 3 <> 0 then x0 + w / 2.0 when {_CX} < x0 + 100 or {_CY} < y0 + 100 then {_CX} else x0 + 50.0 end as px,
 case when rect_id % 3 <> 0 then y0 + h / 2.0 when {_CX} < x0 + 100 or {_CY} < y0 + 100 then {_CY} else y0 + h / 2.0 end as py from {{vR}} r""")
def d10_representative_point(spark, sf):
    """A point in every outline: the centroid if the outline holds it, else the middle of its widest span half way up."""
    p = g.inside_point(F.col("ring"))
    return rings(spark, sf).select("rect_id", "x0", "y0", F.round(p["x"], 3).alias("px"), F.round(p["y"], 3).alias("py"))


@query("select rect_id, x0, y0, case when 6 * 50 * 0.6 <= w and 50 <= h then 50.0 when 6 * 40 * 0.6 <= w and 40 <= h then 40.0 when 6 * 30 * 0.6 <= w and 30 <= h then 30.0 when 6 * 20 * 0.6 <= w and 20 <= h then 20.0 else 10.0 end::double as height from (select rect_id, x0, y0, w // 4 as w, h from {vR} r) r")
def d11_fit_height(spark, sf):
    r = view(spark, sf, "vR")
    return r.select("rect_id", "x0", "y0", g.largest_fit([50, 40, 30, 20, 10], F.lit("C12-AB"), F.expr("w div 4"), F.col("h")).alias("height"))


@query(f"select b.rect_id, count(*) as n from {{vN}} p join {_b('column', 2)} b on p.floor_id = b.floor_id and {IN} and (b.x1 - b.x0) * (b.y1 - b.y0) <= 3 * length(p.text) * 125 * 125 * 0.7 group by b.rect_id")
def d12_text_boxes_drawn(spark, sf):
    """Outlines that are just a box round a text: at most three times its area."""
    n = view(spark, sf, "vN").select("note_id", "floor_id", "x", "y", F.length("text").alias("len"))
    pairs = sp.points_in_boxes(n, boxes(spark, sf, "column", 2), ["floor_id"], 2000)
    return pairs.where(sp.area() <= 3 * F.col("len") * 125 * 125 * 0.7).groupBy("rect_id").agg(F.count("*").alias("n"))


@query("select seg_id, cast((t2 - t1) * 230 as double) as area, (t1 + t2) / 2.0 as cx from {vS} s")
def d13_span_rectangle(spark, sf):
    ring = g.rectangle((F.col("t1") + F.col("t2")) / 2, F.col("line_no") * 1000, F.col("t2") - F.col("t1"), F.lit(230), F.lit(0))
    return view(spark, sf, "vS").select("seg_id", F.round(g.area(ring), 3).alias("area"), F.round(g.centroid(ring)["x"], 3).alias("cx"))


@query("select rect_id, x0, y0, true as ccw, case when rect_id % 3 = 0 then 6 else 4 end as n from {vR} r")
def d14_normal_rings(spark, sf):
    ring = g.counter_clockwise(F.col("ring"))
    return rings(spark, sf).select("rect_id", "x0", "y0", (g.signed_area(ring) > 0).alias("ccw"), F.size(ring).alias("n"))


@query(f"select a.rect_id, b.rect_id as b_rect_id, case when b.x1 <= a.x0 or b.x0 >= a.x1 then a.x0 when b.x0 <= a.x0 and b.x1 < a.x1 and a.x1 - b.x1 >= 50 then b.x1 when b.x1 >= a.x1 and b.x0 > a.x0 and b.x0 - a.x0 >= 50 then a.x0 end as t1 from {_b('beam', 3)} a join {_b('wall', 3)} b on a.floor_id = b.floor_id and {_OV} > 0")
def d16_shorten(spark, sf):
    """The smaller rectangle pulled back along its axis until clear; null where it is crossed."""
    p = sp.overlaps(boxes(spark, sf, "beam", 3), boxes(spark, sf, "wall", 3), ["floor_id"], 3000)
    return p.select("rect_id", "b_rect_id", g.shorten(F.col("x0"), F.col("x1"), F.col("b_x0"), F.col("b_x1"), 50)["t1"].alias("t1"))


@query("select rect_id, x0 - 75 as x0, y0 - 75 as y0, (w + 150) * (h + 150) as area from {vR} r where rect_id % 10 = 4")
def d17_grow(spark, sf):
    r = boxes(spark, sf, "footing")
    return r.select("rect_id", (F.col("x0") - 75).alias("x0"), (F.col("y0") - 75).alias("y0"), ((F.col("x1") - F.col("x0") + 150) * (F.col("y1") - F.col("y0") + 150)).alias("area"))


@query("""select seg_id, (seg_id % 7 - 3) * 100.0 / sqrt((seg_id % 7 - 3) * (seg_id % 7 - 3) * 10000.0 + (seg_id % 5) * (seg_id % 5) * 10000.0 + 1) >= 0.8 as on_axis from {vS} s""")
def d19_on_axis(spark, sf):
    """Is a label on its line's own axis: cosine of the angle from the end to the label, 0.8 at least."""
    dx, dy = (F.col("seg_id") % 7 - 3) * 100, F.col("seg_id") % 5 * 100
    return view(spark, sf, "vS").select("seg_id", (dx / F.sqrt(dx * dx + dy * dy + 1) >= 0.8).alias("on_axis"))


@query("select rect_id, x0, y0, case when (r + 90) % 180 = 0 then 90.0 else (r + 90) % 180 - 90 end::double as rotation from (select rect_id, x0, y0, rect_id % 360 + case when h > w then 90 else 0 end as r from {vR} r) r")
def d20_mark_rotation(spark, sf):
    """Along the longer side, readable from below or from the right."""
    r = F.col("rect_id") % 360 + F.when(F.col("h") > F.col("w"), 90).otherwise(0)
    return view(spark, sf, "vR").select("rect_id", "x0", "y0", g.upright(r.cast("double")).alias("rotation"))


@query(f"select a.rect_id, b.rect_id as b_rect_id, greatest(a.x0, b.x0) as cx0, greatest(a.y0, b.y0) as cy0, {_OV} as area, b.x0 > a.x0 and b.x1 < a.x1 and b.y0 > a.y0 and b.y1 < a.y1 as is_hole from {_b('slab', 6)} a join {_b('opening', 2)} b on a.floor_id = b.floor_id and {_OV} > 0")
def d21_clip_openings(spark, sf):
    """Openings clipped to a panel: holes if wholly inside, else cuts in its edge."""
    p = sp.overlaps(boxes(spark, sf, "slab", 6), boxes(spark, sf, "opening", 2), ["floor_id"], 8000)
    hole = (F.col("b_x0") > F.col("x0")) & (F.col("b_x1") < F.col("x1")) & (F.col("b_y0") > F.col("y0")) & (F.col("b_y1") < F.col("y1"))
    return p.select("rect_id", "b_rect_id", F.greatest("x0", "b_x0").alias("cx0"), F.greatest("y0", "b_y0").alias("cy0"), F.col("overlap").alias("area"), hole.alias("is_hole"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'N' then concat('L', l_suppkey % 3) else '0' end as own, case when l_returnflag = 'N' then concat('L', l_suppkey % 3) when l_linenumber <= 4 then 'P' else null end as layer from lineitem where l_linenumber <= 4")
def a01_entities(spark, sf):
    """Entities of nested blocks: layer 0 takes the layer of the block around it; deeper than four levels is left out."""
    e = view(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", F.concat(F.lit("L"), F.col("l_suppkey") % 3)).otherwise("0").alias("own"),
        F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.when(i == 1, "P").otherwise("0")).alias("block_layers"),
    )
    return dw.inherit_layers(e, "own", "block_layers").select("l_orderkey", "l_linenumber", "l_partkey", "own", "layer")


@query("select r_regionkey as drawing_id, r_name as title, 5 as n_headers from region")
def a02_headers(spark, sf):
    r = view(spark, sf, "region")
    n = r.select(F.input_file_name().alias("f"), "r_regionkey", "r_name")
    return n.select(F.col("r_regionkey").alias("drawing_id"), F.col("r_name").alias("title"), F.lit(5).alias("n_headers"))


@query("select o_custkey % 50 as drawing_id, count(*) as n_levels, cast(round(sum(o_totalprice), 2) as double) as total from orders group by 1")
def a03_read_projects(spark, sf):
    """Nested project documents back into element rows."""
    o = view(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("drawing_id"), F.col("o_orderkey").alias("element_id"), F.col("o_totalprice").alias("value"))
    rows = dw.read_projects(dw.project_documents(o, "drawing_id", ["element_id", "value"]), "drawing_id bigint, elements array<struct<element_id:bigint,value:double>>")
    return rows.groupBy("drawing_id").agg(F.count("*").alias("n_levels"), F.round(F.sum("value"), 2).alias("total"))


@query("select o_custkey % 50 as drawing_id, cast(count(*) as integer) as n_elements, min(o_orderkey) as first_id from orders group by 1")
def a04_write_projects(spark, sf):
    """Project documents written as files and read back."""
    o = view(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("drawing_id"), F.col("o_orderkey").alias("element_id"))
    folder = mt.scratch(spark)
    dw.write_projects(dw.project_documents(o, "drawing_id", ["element_id"]), folder)
    back = dw.load_projects(spark, folder, "drawing_id bigint, elements array<struct<element_id:bigint>>")
    return back.groupBy("drawing_id").agg(F.count("*").cast("int").alias("n_elements"), F.min("element_id").alias("first_id"))


@query("select n_nationkey, case when n_nationkey % 3 <> 0 then n_nationkey * 100.5 end::double as elevation_mm from nation where n_nationkey % 7 <> 0")
def a05_level_rows(spark, sf):
    """Rows by header; numbers that are none become null; rows without anything are dropped."""
    raw = view(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 7 != 0, F.when(F.col("n_nationkey") % 3 != 0, (F.col("n_nationkey") * 100.5).cast("string")).otherwise("n/a")).alias("elevation"))
    return dw.level_rows(raw, {"elevation": "elevation_mm"}, ["elevation"]).select("n_nationkey", "elevation_mm")


@query("""select n.n_nationkey, coalesce(r.r_regionkey, n.n_regionkey) as level, r.r_regionkey is null as unmatched from nation n left join region r on (n.n_nationkey % 2 = 0 and r.r_regionkey = n.n_nationkey // 2) or (n.n_nationkey % 2 = 1 and upper(r.r_name) = case n.n_nationkey % 3 when 0 then 'ASIA' when 1 then 'EUROPE' else 'NOWHERE' end)""")
def a06_apply_levels(spark, sf):
    """Level rows to floors by id, else by name without regard to case."""
    k = F.col("n_nationkey")
    n = view(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.when(k % 2 == 0, F.expr("n_nationkey div 2")).alias("want_id"), F.when(k % 2 == 1, F.element_at(F.array(F.lit("Asia"), F.lit("europe"), F.lit("nowhere")), (k % 3 + 1).cast("int"))).alias("want_name"))
    r = view(spark, sf, "region")
    by_id = r.select(F.col("r_regionkey").cast("bigint").alias("_i"), F.col("r_regionkey").alias("a"))
    by_name = r.groupBy(F.upper("r_name").alias("_n")).agg(F.min("r_regionkey").alias("b"))
    x = n.join(by_id, F.col("want_id") == F.col("_i"), "left").join(by_name, F.upper("want_name") == F.col("_n"), "left")
    return x.select("n_nationkey", F.coalesce("a", "b", "n_regionkey").alias("level"), F.coalesce("a", "b").isNull().alias("unmatched"))


@query("""select user_id % 20 as g, cast(coalesce(max(case when event_type = 'error' then cast(json_extract_string(props, '$.k') as integer) end), 7) as integer) as error_limit from events group by 1""")
def a07_settings(spark, sf):
    """Key and value rows to one map for each drawing, with defaults."""
    e = view(spark, sf, "events").select((F.col("user_id") % 20).alias("g"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("v"))
    m = e.groupBy("g", "event_type").agg(F.max("v").alias("v")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.select("g", F.coalesce(F.element_at("m", "error"), F.lit(7)).alias("error_limit"))


@query("select n_nationkey, n_name, concat('Level ', n_regionkey) as hint from nation")
def a08_level_template(spark, sf):
    n = view(spark, sf, "nation")
    return n.select("n_nationkey", "n_name", F.concat(F.lit("Level "), "n_regionkey").alias("hint"))


@query("select o_orderkey, concat(o_orderstatus, ', ', o_orderpriority) as tags, round(o_totalprice, 1) as total from orders")
def a09_review_tables(spark, sf):
    """Rows for people: lists as text, numbers with one place."""
    o = view(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.col("o_totalprice").alias("total"))
    return dw.review_table(o)


@query("select l_suppkey % 25 as stack, l_linenumber as floor_no, count(*) as n, cast(max(l_quantity) as double) as size from lineitem group by 1, 2")
def a10_schedule_tables(spark, sf):
    return view(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("stack"), F.col("l_linenumber").alias("floor_no")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("size"))


@query(f"select b.frame_id, p.rect_id, p.x - b.x0 as lx, p.y - b.y0 as ly from (select distinct rect_id, x0 as x, y0 as y from {{vR}} r) p join {FRAMES} b on {IN}")
def b07_localise(spark, sf):
    """Coordinates relative to the floor's origin."""
    p = view(spark, sf, "vR").select("rect_id", F.col("x0").alias("x"), F.col("y0").alias("y")).distinct()
    return in_frames(p, frames(spark, sf)).select("frame_id", "rect_id", (F.col("x") - F.col("fx")).alias("lx"), (F.col("y") - F.col("fy")).alias("ly"))


@query(f"select b.frame_id, p.rect_id, p.x - b.x0 + b.x0 as gx, concat('C2D-', p.rect_id % 10) as layer from (select distinct rect_id, x0 as x, y0 as y from {{vR}} r) p join {FRAMES} b on {IN}")
def a14_overlay_rows(spark, sf):
    """Local coordinates back to the drawing's, routed to a layer by kind."""
    p = view(spark, sf, "vR").select("rect_id", F.col("x0").alias("x"), F.col("y0").alias("y")).distinct()
    local = in_frames(p, frames(spark, sf)).withColumn("lx", F.col("x") - F.col("fx"))
    return local.select("frame_id", "rect_id", (F.col("lx") + F.col("fx")).alias("gx"), F.concat(F.lit("C2D-"), F.col("rect_id") % 10).alias("layer"))


@query("select rect_id, x0, y0, case rect_id % 10 when 1 then 'T-COLUMN' when 2 then 'T-BEAM' when 3 then 'T-SLAB' else 'T-OTHER' end as layer, concat('id=', rect_id, ';kind=', rect_id % 10) as identity from {vR} r")
def a15_template_rows(spark, sf):
    return dw.template_rows(view(spark, sf, "vR")).select("rect_id", "x0", "y0", "layer", "identity")


@query("select rect_id, x0, y0, cast(round(x0 * 25.4, 6) as double) as x_mm, cast(round((x0 + w) * 25.4, 6) as double) as x1_mm from {vR} r")
def b05_scale(spark, sf):
    scaled = F.transform("ring", lambda p: F.struct((p["x"] * 25.4).alias("x"), (p["y"] * 25.4).alias("y")))
    r = rings(spark, sf).withColumn("b", g.bounds(scaled))
    return r.select("rect_id", "x0", "y0", F.round("b.x0", 6).alias("x_mm"), F.round("b.x1", 6).alias("x1_mm"))



@query("select greatest(max(x0 + w) - min(x0), max(y0 + h) - min(y0)) as extent from {vR} r")
def b06_extent(spark, sf):
    return boxes(spark, sf).agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("extent"))


@query("select l_linenumber as layer_no, count(*) filter (where l_discount * 100 % 2 >= 1) as n_raised, max(l_discount) as worst from lineitem group by l_linenumber")
def b08_raised(spark, sf):
    """Entities off the plane by layer, with the worst."""
    return view(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("layer_no")).agg(F.count_if(F.col("l_discount") * 100 % 2 >= 1).alias("n_raised"), F.max("l_discount").alias("worst"))


@query("select o_orderkey, o_totalprice > 400000 as far_away from orders")
def b09_far(spark, sf):
    return view(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 400000).alias("far_away"))


@query("select rect_id, x0, y0 from {vR} r where w * h >= 200000 and least(w, h) >= 300 and greatest(w, h) <= 900")
def b14_size_window(spark, sf):
    w, h = F.col("w"), F.col("h")
    return view(spark, sf, "vR").where((w * h >= 200000) & (F.least(w, h) >= 300) & (F.greatest(w, h) <= 900)).select("rect_id", "x0", "y0")


@query("""select rect_id, x0, y0, i, x1, y1, x2, y2 from (select rect_id, x0, y0, unnest([0, 1, 2, 3]) as i, unnest([x0, x0 + w, x0 + w, x0]) as x1, unnest([y0, y0, y0 + h, y0 + h]) as y1, unnest([x0 + w, x0 + w, x0, x0]) as x2, unnest([y0, y0 + h, y0 + h, y0]) as y2 from {vR} r) s where abs(x2 - x1) + abs(y2 - y1) >= 400""")
def b16_ring_segments(spark, sf):
    """Rings to segments in order; short ones are left out."""
    r = view(spark, sf, "vR")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.col("x0"), F.col("y0")), (F.col("x0") + F.col("w"), F.col("y0")), (F.col("x0") + F.col("w"), F.col("y0") + F.col("h")), (F.col("x0"), F.col("y0") + F.col("h")))])
    return dw.segments(r.withColumn("ring", ring), "ring", 400).select("rect_id", "x0", "y0", "i", "x1", "y1", "x2", "y2")


@query("select rect_id, x0, y0, case when least(w, h) <= 350 and greatest(w, h) >= 2 * least(w, h) then 'beam' when greatest(w, h) < 500 then 'bracket' else 'edges' end as route from {vR} r")
def b17_beam_routing(spark, sf):
    lo, hi = F.least("w", "h"), F.greatest("w", "h")
    return view(spark, sf, "vR").select("rect_id", "x0", "y0", F.when((lo <= 350) & (hi >= 2 * lo), "beam").when(hi < 500, "bracket").otherwise("edges").alias("route"))


@query("select rect_id, x0, y0, case when rect_id % 2 = 0 then 300 else w end as width, case when rect_id % 2 = 0 and abs(w - 300) > 26 then 'COLUMN_SIZE_MISMATCH' end as code, case when rect_id % 2 = 0 then 'high' else 'medium' end as confidence from {vR} r")
def b19_size_source(spark, sf):
    """Tag before outline; a difference beyond 26 is reported; the source gives the confidence."""
    tag = F.when(F.col("rect_id") % 2 == 0, F.lit(300).cast("bigint"))
    code = F.when(F.abs(F.col("w") - tag) > 26, "COLUMN_SIZE_MISMATCH")
    return view(spark, sf, "vR").select("rect_id", "x0", "y0", F.coalesce(tag, "w").alias("width"), code.alias("code"), F.when(tag.isNotNull(), "high").otherwise("medium").alias("confidence"))


@query("select rect_id, x0, y0, greatest(w, h) >= 3 * least(w, h) and greatest(w, h) >= 900 as wall_like, least(w, h) < 230 or greatest(w, h) > 950 as odd_size from {vR} r")
def b20_wall_like(spark, sf):
    w, h = F.col("w"), F.col("h")
    return view(spark, sf, "vR").select("rect_id", "x0", "y0", g.wall_like(w, h, 3, 900).alias("wall_like"), ((F.least(w, h) < 230) | (F.greatest(w, h) > 950)).alias("odd_size"))


@query("""select rect_id, floor_id, 6 as n_points, 1 as n_arcs, round(tan(radians(90 + rect_id % 7 * 15) / 4), 6) as bulge, least(w, h) / 4.0 as radius from (select distinct rect_id, floor_id, min(w) as w, min(h) as h from {vR} r group by 1, 2) r""")
def d18_arcs(spark, sf):
    """Rings with a run of vertices on a known circle get one arc for it, the rest of the ring stays."""
    r = view(spark, sf, "vR").groupBy("rect_id", "floor_id").agg(*[F.min(c).cast("double").alias(c) for c in ("x0", "y0", "w", "h")])
    radius, sweep = F.least("w", "h") / 4, 90 + F.col("rect_id") % 7 * 15
    # a corner of the outline is rounded by twelve steps of an arc round a point far off the others
    cx, cy = F.col("x0") + 10 * F.col("w"), F.col("y0") + 10 * F.col("h")
    arc = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: g.point(cx + radius * F.cos(F.radians(sweep * i / 12)), cy + radius * F.sin(F.radians(sweep * i / 12))))
    ring = F.concat(F.array(g.point(F.col("x0"), cy), g.point(F.col("x0"), F.col("y0")), g.point(cx, F.col("y0"))), arc, F.array(g.point(F.col("x0"), cy + 50)))
    turned = F.concat(F.slice(ring, F.lit(1) + (F.col("rect_id") % 17).cast("int"), F.lit(17)), F.slice(ring, F.lit(1), (F.col("rect_id") % 17).cast("int")))
    circles = F.array(F.struct(cx.alias("x"), cy.alias("y"), radius.alias("r")))
    out = arcs.fitted(r.select("rect_id", "floor_id", turned.alias("ring"), circles.alias("circles"), radius.alias("radius")), 0.5)
    bulges = F.filter("bulges", lambda b: b != 0)
    return out.select("rect_id", "floor_id", F.size("ring").alias("n_points"), F.size(bulges).alias("n_arcs"), F.round(F.element_at(bulges, 1), 6).alias("bulge"), "radius")
