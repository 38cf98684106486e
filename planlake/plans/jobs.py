"""Ordered matching (section J) and the end-to-end jobs (section L of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions import diagnostics as dg, geom as g, rules, text as tx
from planlake.operators import faces, intervals as iv, loops, matching as mt, numbering as nb, outlines as ol, spatial as sp, sweeps as sw
from planlake.sources import drawings as dw
from planlake.sources.proxies import view

from .joins import MATCH_SQL, MODEL, DRAWN, _b, _OV, boxes, candidates, greedy_candidates, matched, snapshots  # noqa: F401  candidates is taken from here by tests
from .registry import query
from .shapes import rings
from .texts import LAYERS_SQL, _layers


@query()
def j01_greedy_match(spark, sf):
    """Tags to columns, one to one, by (score, tag, column)."""
    return greedy_candidates(spark, sf)


@query()
def j03_ordered_keep(spark, sf):
    """Outlines kept in order unless an earlier kept one overlaps them by two fifths."""
    r = boxes(spark, sf, "column", 6).groupBy("rect_id", "floor_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    r = mt.kept(r.withColumnRenamed("rect_id", "id"))
    conflicts = lambda early, late: sp.overlaps(early, late, ["floor_id"], 4000).where((F.col("id") < F.col("b_id")) & (10 * F.col("overlap") >= 4 * sp.area("b_"))).select(F.col("id").alias("early"), F.col("b_id").alias("late"))
    return mt.ordered_keep_in_steps(r, conflicts)


def crowded_pairs(spark, sf):
    """Candidate pairs of parallel edges that lie close together."""
    t1, long = F.col("t1") % 12000, F.col("t2") - F.col("t1")
    lines = view(spark, sf, "vS").select("seg_id", (F.expr("seg_id div 500")).alias("drawing"), (F.col("seg_id") * 613 % 9000).alias("offset"), t1.alias("t1"), (t1 + long).alias("t2"))
    return iv.parallel_pairs(lines, ["drawing"], "seg_id", 100, 1500, 300).withColumnsRenamed({"seg_id": "a", "b_seg_id": "b"})


@query()
def j03_edge_pairs(spark, sf):
    """Parallel edges paired by score, as far as at least half of the shared length is still free on both."""
    return mt.edge_pairs(crowded_pairs(spark, sf), ["drawing"]).select("drawing", "a", "b", "t1", "t2", "width", "score")


@query()
def j02_shared_tags(spark, sf):
    """Tags to columns so that few columns go without one of a kind; kinds are whether a note's number is even."""
    floor, r = ["floor_id"], boxes(spark, sf, "column").groupBy("rect_id", "floor_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    p = mt.by_place(view(spark, sf, "vN").withColumn("kind", F.col("note_id") % 2), "note_id", [*floor, "x", "y", "kind"])
    d2 = sp.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    met = sp.points_in_boxes(p.drop("tags", "kind"), r, floor, 4000, 900, d2 <= 900 * 900, cells=True)
    row = F.struct(F.round(F.sqrt(d2), 3).alias("score"), F.col("rect_id").alias("element"))
    met = met.groupBy(*floor, "_cx", "_cy", "place").agg(F.min(F.when(d2 == 0, F.col("rect_id"))).alias("home"), F.collect_list(F.when(d2 > 0, row)).alias("near"))
    met = met.select("place", "home", F.when(F.col("home").isNull(), F.col("near")).alias("near"))
    return mt.share_places(mt.kept(p.join(met.hint("merge"), "place")), floor)


@query()
def j04_stacks(spark, sf):
    """Columns followed from floor to floor, bottom-up: in (x, y) order each takes the best free column below, by overlap and half the nearness.

    The best is tested after it is found, so a column whose best fails stands alone (orphan) even if
    another would pass. jump: the column's centre is off that of its stack's foot by more than half the tolerance.
    """
    tol, least = 600.0, 0.25
    r = boxes(spark, sf, "column", 10).withColumn("floor_no", F.substring("floor_id", 3, 1).cast("int"))
    r = r.groupBy(F.col("rect_id").alias("id"), "floor_no").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    r = r.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    taken = sw.stacked(r.select("id", "floor_no", "x0", "y0", "x1", "y1"), "floor_no", tol, least)
    out = mt.chain_floors(taken, r.select("id", "floor_no")).join(r.select("id", "floor_no", "cx", "cy").hint("merge"), ["id", "floor_no"])
    foot = r.select(F.col("id").alias("stack"), F.col("cx").alias("fx"), F.col("cy").alias("fy"))
    out = out.join(foot.hint("merge"), "stack").withColumn("jump", F.hypot(F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy")) > tol / 2)
    below = r.select((F.col("floor_no") + 1).alias("floor_no")).distinct().withColumn("below", F.lit(True))
    out = out.join(F.broadcast(below), "floor_no", "left")  # a row for each floor
    return out.select("id", "floor_no", "stack", "jump", ((F.col("id") == F.col("stack")) & F.coalesce("below", F.lit(False))).alias("orphan"))


@query()
def j05_groups(spark, sf):
    """Outlines that touch, directly or through others."""
    return mt.groups(sp.touching_links(boxes(spark, sf, "beam", 4), "rect_id", ["floor_id"], 1000), within=["floor_id"])


@query("""with e as (select seg_id * 2 as id, line_no, t1 as x from {vS} s union all select seg_id * 2 + 1, line_no, t2 from {vS} s),
c as (select *, sum(s) over (partition by line_no order by x, id) as i from (select *, case when x - lag(x) over (partition by line_no order by x, id) <= 5 then 0 else 1 end as s from e) e)
select id, line_no, x, round(avg(x) over (partition by line_no, i), 3) as sx from c""")
def j05_snapped_ends(spark, sf):
    """Ends of pieces moved to the mean of the ends that they are connected with in steps of at most the tolerance."""
    s = view(spark, sf, "vS")
    ends = s.select((F.col("seg_id") * 2).alias("id"), "line_no", F.col("t1").alias("x")).unionByName(s.select((F.col("seg_id") * 2 + 1).alias("id"), "line_no", F.col("t2").alias("x")))
    out = mt.snapped_points(ends.withColumn("y", F.col("line_no").cast("long") * 1000), ["line_no"], 5)
    return out.select("id", "line_no", "x", F.round("sx", 3).alias("sx"))


@query()
def j07_panels(spark, sf):
    """Panels that members enclose, drawing by drawing; members are the pieces of a line grid, forty of them a drawing."""
    s = view(spark, sf, "vS").withColumn("drawing", F.expr("seg_id div 40"))
    flat = s.select("drawing", F.col("t1").alias("x0"), (F.col("seg_id") * 613 % 60000).alias("y0"), (F.col("t1") + 8 * (F.col("t2") - F.col("t1"))).alias("x1"), (F.col("seg_id") * 613 % 60000 + 230).alias("y1"))
    up = s.select("drawing", (F.col("seg_id") * 211 % 100000).alias("x0"), F.expr("t1 div 2").alias("y0"), (F.col("seg_id") * 211 % 100000 + 230).alias("x1"), (F.expr("t1 div 2") + 16 * (F.col("t2") - F.col("t1"))).alias("y1"))
    return faces.panels(flat.unionByName(up), ["drawing"], 1e5, 1e8)


def loose_lines(spark, sf):
    """Loose lines of drawings, forty pieces each: level and upright ones."""
    s = view(spark, sf, "vS").withColumn("drawing", F.expr("seg_id div 40"))
    long, row, column = F.col("t2") - F.col("t1"), F.col("seg_id") * 613 % 60000, F.col("seg_id") * 211 % 100000
    flat = s.select("drawing", (F.col("seg_id") * 2).alias("id"), F.col("t1").alias("x0"), row.alias("y0"), (F.col("t1") + 8 * long).alias("x1"), row.alias("y1"))
    return flat.unionByName(s.select("drawing", (F.col("seg_id") * 2 + 1).alias("id"), column.alias("x0"), F.expr("t1 div 2").alias("y0"), column.alias("x1"), (F.expr("t1 div 2") + 16 * long).alias("y1")))


@query()
def j06_closed_faces(spark, sf):
    """Faces that the loose lines of a drawing close, with the number of their lines and holes."""
    f = loops.faces(loose_lines(spark, sf), ["drawing"], 1.0, 8000)
    return f.select("drawing", "x0", "y0", "x1", "y1", "area", F.size("lines").alias("n_lines"), F.size("holes").alias("n_holes"))


def drawn_shapes(spark, sf):
    """Outlines drawn in six ways, some twice or nearly, some within an enclosure: handle, kind, layer, floor_id, ring."""
    r = view(spark, sf, "vR").groupBy("rect_id", "floor_id").agg(*[F.min(c).cast("double").alias(c) for c in ("x0", "y0", "w", "h")])
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    k, floor = F.col("rect_id") % 6, F.col("floor_id")
    ell = F.array(g.point(x0, y0), g.point(x1, y0), g.point(x1, y0 + 100), g.point(x0 + 100, y0 + 100), g.point(x0 + 100, y1), g.point(x0, y1))
    box = lambda by: g.ring_of_box(x0 + by, y0 + by, x1 + by, y1 + by)
    row = lambda when, kind, ring, n: r.where(when).select(F.concat_ws("-", "rect_id", F.lit(n)).alias("handle"), F.lit(kind).alias("kind"), F.concat(F.lit("S-"), F.col("rect_id") % 97).alias("layer"), floor.alias("floor_id"), ring.alias("ring"))
    side = lambda i: F.array(F.element_at(box(0), i + 1), F.element_at(box(0), (i + 1) % 4 + 1))
    out = row(k == 0, "polygon", ell, 0).unionByName(row(k == 0, "hatch", box(5), 1))
    out = out.unionByName(row(k == 1, "polyline", F.concat(box(0), F.array(g.point(x0, y0 + 3))), 0)).unionByName(row(k == 1, "generic_hatch", box(0), 1))
    for i in range(4):
        out = out.unionByName(row(k == 2, "line", side(i), i))
    out = out.unionByName(row(k == 3, "hatch", box(0), 0)).unionByName(row(k == 3, "solid", box(20), 1))
    wide = g.ring_of_box(x0 - 60, y0 - 60, x1 + x1 - x0 + 100, y1 + 60)
    for i in range(4):
        out = out.unionByName(row(k == 4, "line", F.array(F.element_at(wide, i + 1), F.element_at(wide, (i + 1) % 4 + 1)), 5 + i))
    out = out.unionByName(row(k == 4, "polygon", box(0), 1)).unionByName(row(k == 4, "solid", g.ring_of_box(x1 + 30, y0, x1 + F.col("w") + 30, y1), 2))
    return out.unionByName(row(k == 5, "polyline", F.concat(F.slice(box(0), 1, 3), F.array(g.point(x0, y1), g.point(x0, y0 + 90))), 0)).unionByName(row(k == 5, "generic_hatch", box(400), 1))


@query()
def j10_outlines(spark, sf):
    """Outlines of shapes, near-closed polylines, hatches and loose lines; near duplicates merged, enclosures gone."""
    o = ol.collected(drawn_shapes(spark, sf), ["floor_id"], 90, 4000, 20000, 1e7)
    return o.select("floor_id", "layer", "source_kind", F.array_join("handles", ",").alias("handles"), F.array_join("merged", ",").alias("merged"), F.round("area", 3).alias("area"), "x0", "y0", "x1", "y1")


@query()
def j08_trimmed_junctions(spark, sf):
    """Wall legs cut back where they meet larger ones."""
    r = boxes(spark, sf, "wall", 8).groupBy("rect_id", "floor_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return faces.trim_junctions(r, "rect_id", ["floor_id"], 6000)


@query("""select rect_id, unnest([1, 2]) as leg, unnest([x0, x0])::double as x0, unnest([y0, y0])::double as y0, unnest([x0 + 100, x0 + w])::double as x1, unnest([y0 + h, y0 + 100])::double as y1 from {vR} r where rect_id % 3 = 0
union all select rect_id, 1, x0, y0, x0 + w, y0 + h from {vR} r where rect_id % 3 <> 0""")
def j09_split_legs(spark, sf):
    """All outlines, the shaped ones cut into legs that run through their corner."""
    return faces.split_outlines(rings(spark, sf).select("rect_id", "ring"), "rect_id").drop("outline")


@query("""select rect_id, floor_id, count(*) as n_legs, max(greatest(w, h)) as longest from {vR} r where rect_id % 3 = 0 group by rect_id, floor_id""".replace("count(*) as n_legs", "2 * count(*) as n_legs"))
def d15_maximal_legs(spark, sf):
    """Shaped outlines with the number of their legs and the longest: a leg is as long as the outline on its side."""
    r = rings(spark, sf).where("rect_id % 3 = 0")
    legs = faces.split_outlines(r.withColumn("key", F.concat_ws(" ", "rect_id", "floor_id")).select("key", "ring"), "key")
    key = F.split("key", " ")
    return legs.groupBy(key[0].cast("long").alias("rect_id"), key[1].alias("floor_id")).agg(F.count("*").alias("n_legs"), F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).cast("long").alias("longest"))


DIFF_SQL = f"""with p as ({MATCH_SQL}),
j as (select p.how, m.id, m.floor_id, abs(d.x0 + d.x1 - m.x0 - m.x1) / 2.0 as dx, abs(d.y0 + d.y1 - m.y0 - m.y1) / 2.0 as dy, (d.x1 - d.x0) - (m.x1 - m.x0) as dw, (d.y1 - d.y0) - (m.y1 - m.y0) as dd
 from p join {MODEL} m on p.m = m.id join {DRAWN} d on p.d = d.id and d.floor_id = m.floor_id)
select 'RT_MISSING' as code, floor_id, cast(id as varchar) as element_id from {MODEL} m where id not in (select m from p)
union all select 'RT_ADDED', floor_id, cast(id as varchar) from {DRAWN} d where id not in (select d from p)
union all select 'RT_MOVED', floor_id, cast(id as varchar) from j where dx * dx + dy * dy > 4
union all select 'RT_RESIZED', floor_id, cast(id as varchar) from j where abs(dw) > 2 or abs(dd) > 2
union all select 'RT_NO_ID', floor_id, cast(id as varchar) from j where how = 'overlap'"""


def compare(m, d):
    """Findings of a model (id, floor_id, box) against a drawing of it: missing, added, moved and resized by more than 2, without id."""
    p = matched(m, d)
    col = F.col
    both = p.join(m.hint("merge"), col("m") == col("id")).join(d.select([col(c).alias(f"d_{c}") for c in d.columns]).hint("merge"), (col("d") == col("d_id")) & (col("floor_id") == col("d_floor_id")))
    dx, dy = (col("d_x0") + col("d_x1") - col("x0") - col("x1")) / 2, (col("d_y0") + col("d_y1") - col("y0") - col("y1")) / 2
    dw, dd = (col("d_x1") - col("d_x0")) - (col("x1") - col("x0")), (col("d_y1") - col("d_y0")) - (col("y1") - col("y0"))
    true = F.lit(True)
    found = [
        dg.finding(m.join(p.select(col("m").alias("id")).hint("merge"), "id", "left_anti"), true, "ERROR", "RT_MISSING", col("id"), col("floor_id")),
        dg.finding(d.join(p.select(col("d").alias("id")).hint("merge"), "id", "left_anti"), true, "WARNING", "RT_ADDED", col("id"), col("floor_id")),
        dg.finding(both, dx * dx + dy * dy > 4, "WARNING", "RT_MOVED", col("id"), col("floor_id")),
        dg.finding(both, (F.abs(dw) > 2) | (F.abs(dd) > 2), "WARNING", "RT_RESIZED", col("id"), col("floor_id")),
        dg.finding(both, col("how") == "overlap", "INFO", "RT_NO_ID", col("id"), col("floor_id")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query(DIFF_SQL)
def l03_diff(spark, sf):
    return compare(*snapshots(spark, sf)).select("code", "floor_id", "element_id")


@query(f"select code, count(*) as n from ({DIFF_SQL}) d group by code")
def a12_verification(spark, sf):
    return compare(*snapshots(spark, sf)).groupBy("code").agg(F.count("*").alias("n"))


_MARK = "concat('C', id % 50, '-', x1 - x0, 'X', y1 - y0)"


@query(f"""select floor_id, case when id % 17 = 0 then concat(floor_id, '-N', lpad(cast(row_number() over (partition by floor_id, id % 17 = 0 order by x0, y0, x1, y1, {_MARK}) as varchar), 5, '0')) else cast(id as varchar) end as element_id,
 cast(x0 as double) as x0, cast(y1 as double) as y1, {_MARK} as mark, id % 17 = 0 as is_new from {MODEL} m""")
def l06_reread(spark, sf):
    """Template rows, some drawn by hand, read again: identities parsed, new rows with ids of their floor."""
    m, _ = snapshots(spark, sf)
    rows = mt.kept(dw.template_of(m.withColumn("mark", F.expr(_MARK)), "T-COLUMN", F.col("id") % 17 != 0))
    return dw.reread(rows, "T-COLUMN", "N").select("floor_id", "element_id", "x0", "y1", "mark", "is_new")


@query(f"select floor_id, count(*) as n_model, count(*) as n_reread, cast(0 as bigint) as n_findings from {MODEL} m group by floor_id")
def l10_round_trip(spark, sf):
    """A model written as template rows, read again and compared: by floor, as many elements and no finding."""
    m, _ = snapshots(spark, sf)
    rows = mt.kept(dw.template_of(m.withColumn("mark", F.expr(_MARK)), "T-COLUMN"))
    back = mt.kept(dw.reread(rows, "T-COLUMN", "N"))
    d = back.select("id", "floor_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])
    found = compare(m, d).groupBy("floor_id").agg(F.count("*").alias("n_findings"))
    n = m.groupBy("floor_id").agg(F.count("*").alias("n_model")).join(back.groupBy("floor_id").agg(F.count("*").alias("n_reread")).hint("merge"), "floor_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return n.join(found.hint("merge"), "floor_id", "left").select("floor_id", zero("n_model"), zero("n_reread"), zero("n_findings"))


@query("""select l.l_orderkey * 10 + l.l_linenumber as action_id, n.n_name as level, case when p.p_partkey % 2 = 0 then 'column' else 'beam' end as kind, concat(case when p.p_partkey % 2 = 0 then 'C ' else 'B ' end, cast(round(p.p_size * 37 / 25.0) * 25 as bigint), ' x ', 300) as type
from lineitem l join nation n on n.n_nationkey = l.l_suppkey % 25 join part p on p.p_partkey = l.l_partkey where p.p_partkey % 2 = 0 or n.n_nationkey > 0""")
def l04_build_plan(spark, sf):
    """Typed actions for each level of an element's plan, types rounded to a step."""
    o = view(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id"), (F.col("l_suppkey") % 25).alias("_n"), "l_partkey")
    n, p = view(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("level")), view(spark, sf, "part").select("p_partkey", "p_size")
    x = o.join(n, F.col("_n") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    even = F.col("p_partkey") % 2 == 0
    side = (F.round(F.col("p_size") * 37 / 25.0) * 25).cast("long")
    return x.where(even | (F.col("n_nationkey") > 0)).select("action_id", "level", F.when(even, "column").otherwise("beam").alias("kind"), F.concat(F.when(even, "C ").otherwise("B "), side, F.lit(" x 300")).alias("type"))


@query("select p_brand, p_type, case when p_partkey % 2 = 0 then 'column' else 'beam' end as kind, count(*) as n from part group by all")
def a13_build_types(spark, sf):
    kind = F.when(F.col("p_partkey") % 2 == 0, "column").otherwise("beam")
    return view(spark, sf, "part").groupBy("p_brand", "p_type", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""select l.layer, l.n, r.role, case r.role {" ".join(f"when '{k}' then '{v}'" for k, v in rules.TEXT_ROLES.items())} else 'NOTE' end as text_role
from (select layer, count(*) as n from {{vL}} l group by layer) l join ({LAYERS_SQL}) r on l.layer = r.layer""")
def l08_inspect(spark, sf):
    """Layers of a drawing with entity counts and roles."""
    r = rules.layer_roles(_layers(spark, sf)).select("layer", "role", "text_role")
    n = view(spark, sf, "vL").groupBy("layer").agg(F.count("*").alias("n"))
    return n.join(r.hint("merge"), "layer").select("layer", "n", "role", "text_role")


@query()
def l01_extract(spark, sf):
    """Entities to columns with sizes: outlines, their tags one to one, sizes by provenance, numbers in reading order."""
    r = boxes(spark, sf, "column").groupBy("rect_id", "floor_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    pairs = greedy_candidates(spark, sf)
    matched = view(spark, sf, "vN").join(pairs.select(F.col("a").alias("note_id"), F.col("b").alias("rect_id")).hint("merge"), "note_id")  # only these are parsed
    t = tx.parse_tags(mt.kept(matched)).select("rect_id", "note_id", "width_mm", "depth_mm")
    x = r.join(t.hint("merge"), "rect_id", "left")
    x = x.select("rect_id", "floor_id", "x0", "y0", "note_id", F.coalesce("width_mm", (F.col("x1") - F.col("x0")).cast("double")).alias("width_mm"), F.coalesce("depth_mm", (F.col("y1") - F.col("y0")).cast("double")).alias("depth_mm"), F.when(F.col("width_mm").isNotNull(), "tag").otherwise("outline").alias("size_source"))
    return nb.numbered(x, ["floor_id"], [F.round(F.col("y0") / 250.0), F.round(F.col("x0") / 250.0), "rect_id"], "number")


@query(f"""select floor_id, count(*) as n_runs, sum(n_parts) as n_parts, cast(sum(t2 - t1) as bigint) as length from (select floor_id, row_no, min(t1) as t1, max(t2) as t2, count(*) as n_parts from (
 select *, sum(s) over (partition by floor_id, row_no order by t1, t2, rect_id) as i from (select *, case when t1 <= max(t2) over (partition by floor_id, row_no order by t1, t2, rect_id rows between unbounded preceding and 1 preceding) + 800 then 0 else 1 end as s
 from (select rect_id, floor_id, y0 // 1000 as row_no, x0 as t1, x1 as t2 from {_b('beam')} b) a) b) c group by floor_id, row_no, i) d group by floor_id""")
def l02_runs(spark, sf):
    """Beams in a row merged to runs, and their length by floor."""
    b = boxes(spark, sf, "beam").select("floor_id", F.expr("y0 div 1000").alias("row_no"), F.col("x0").alias("t1"), F.col("x1").alias("t2"))
    return iv.merged(b, ["floor_id", "row_no"], 800).groupBy("floor_id").agg(F.count("*").alias("n_runs"), F.sum("n_parts").alias("n_parts"), F.sum(F.col("t2") - F.col("t1")).alias("length"))
