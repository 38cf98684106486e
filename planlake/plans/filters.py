"""Queries over selections, profiles and marks in comparisons (A16, A17, B10-B22 and the mark codes of L03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions import diagnostics as dg, rules, text as tx
from planlake.operators import selection as sel
from planlake.sources import profiles
from planlake.sources.proxies import view

from .joins import _OV, _b, boxes
from .registry import query
from .texts import LAYERS_SQL, _layers

_LAYER = "case {0} % 5 when 0 then 'S-COLS ' || ({0} % 3) when 1 then 'S-BEAM-HDLN ' || ({0} % 3) when 2 then 'A-FLOR-IDEN ' || ({0} % 3) when 3 then 'S-SLAB SUNK ' || ({0} % 3) else 'no rule' end"
_KIND = "case {0} % 4 when 0 then 'line' when 1 then 'polyline' else 'polygon' end"
_TEXT_ROLE = " ".join(f"when '{k}' then '{v}'" for k, v in rules.TEXT_ROLES.items())
_BANDS = "(select concat('L0', 1 + n_nationkey % 8) as floor_id, cast(n_nationkey * 8000 as bigint) as x0, cast(0 as bigint) as y0, cast(n_nationkey * 8000 + 4000 as bigint) as x1, cast(120000 as bigint) as y1 from nation)"


def _rules(spark, sf):
    return rules.layer_roles(_layers(spark, sf))


def _bands(spark, sf):
    n, k = view(spark, sf, "nation"), F.col("n_nationkey")
    c = lambda v: v.cast("long")
    return n.select(F.concat(F.lit("L0"), 1 + k % 8).alias("floor_id"), c(k * 8000).alias("x0"), c(F.lit(0)).alias("y0"), c(k * 8000 + 4000).alias("x1"), c(F.lit(120000)).alias("y1"))


def _shapes(spark, sf):
    r = boxes(spark, sf).distinct()
    return r.withColumn("layer", F.expr(_LAYER.format("rect_id"))).withColumn("kind", F.expr(_KIND.format("rect_id")))


_SHAPES = f"(select distinct rect_id, floor_id, x0, y0, x1, y1, {_LAYER.format('rect_id')} as layer, {_KIND.format('rect_id')} as kind from {_b()} r)"


@query(f"""select distinct a.rect_id, a.x0, a.y0, a.kind from {_SHAPES} a join ({LAYERS_SQL}) l on l.layer = a.layer
where l.role = 'COLUMN' and a.kind in ('polygon', 'polyline') and not contains(concat(',', l.modifiers, ','), ',hidden,')
 and not exists (select 1 from {_BANDS} b where b.floor_id = a.floor_id and 2 * {_OV} >= (a.x1 - a.x0) * (a.y1 - a.y0))""")
def b10_shapes_of_role(spark, sf):
    """Columns' closed shapes outside the legend."""
    key = ["rect_id", "x0", "y0", "x1", "y1"]
    out = sel.shapes(_shapes(spark, sf).withColumn("id", F.xxhash64("rect_id", "floor_id", "x0", "y0", "x1", "y1")), _rules(spark, sf), "COLUMN", ["polygon", "polyline"], _bands(spark, sf), ["floor_id"], ["id"])
    return out.select(*key, "kind").select("rect_id", "x0", "y0", "kind").distinct()


@query(f"""select p.note_id, p.text from (select *, {_LAYER.format('note_id')} as layer from {{vN}} n) p left join ({LAYERS_SQL}) l on l.layer = p.layer
where case l.role {_TEXT_ROLE} else 'NOTE' end = 'SLAB_TAG' and trim(p.text) <> '' and not exists (select 1 from {_BANDS} b where b.floor_id = p.floor_id and p.x > b.x0 and p.x < b.x1 and p.y > b.y0 and p.y < b.y1)""")
def b11_texts_of_role(spark, sf):
    n = view(spark, sf, "vN").withColumn("layer", F.expr(_LAYER.format("note_id")))
    return sel.texts(n, _rules(spark, sf), "SLAB_TAG", _bands(spark, sf), ["floor_id"], 8000).select("note_id", "text")


@query("""select note_id, case when note_id % 12 = 9 then 'text' else 'dimension' end as kind, case when note_id % 12 = 9 then concat(200 + 50 * (note_id % 3), 'x400') else text end as text,
 cast(case when note_id % 12 = 9 and note_id % 2 = 0 then 125 else note_id % 2 * 90 end as double) as text_height from {vN} n where note_id % 12 in (4, 6, 9, 11)""".replace("note_id % 2 = 0 then 125", "note_id % 2 * 90 = 0 then 125"))
def b12_sized_dimensions(spark, sf):
    """Dimensions whose text states a size become tags; lengths, depths and priorities stay dimensions."""
    n = view(spark, sf, "vN").where("note_id % 12 in (4, 6, 9, 11)").select("note_id", F.lit("dimension").alias("kind"), "text", (F.col("note_id") % 2 * 90).cast("double").alias("text_height"))
    return sel.sized_dimensions(n)


_EDGES = """select rect_id, x0, y0, unnest([0, 1, 2, 3]) as i, unnest([x0, x1, x1, x0]) as ax, unnest([y0, y0, y1, y1]) as ay, unnest([x1, x1, x0, x0]) as bx, unnest([y0, y1, y1, y0]) as by, kind, layer, (x1 - x0) * (y1 - y0) as area from """


@query(f"""select e.rect_id, e.x0, e.y0, e.i, cast(e.ax as double) as x1, cast(e.ay as double) as y1, cast(e.bx as double) as x2, cast(e.by as double) as y2 from ({_EDGES} {_SHAPES} s) e join ({LAYERS_SQL}) l on l.layer = e.layer
where l.role = 'SLAB' and not regexp_matches(concat(',', l.modifiers, ','), ',(drop|fold|sunk|hidden),') and ((e.kind = 'polygon' and e.area >= 200000)
 or (e.kind in ('line', 'polyline') and e.i < 3 and abs(e.bx - e.ax) + abs(e.by - e.ay) >= 400 and not contains(concat(',', l.modifiers, ','), ',projection,')))""")
def b15_slab_edges(spark, sf):
    """Edges of slabs: closed outlines that are large enough, and pieces of open lines; not of layers that show steps."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = _shapes(spark, sf).withColumn("ring", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    s = s.withColumns({"_x": F.col("x0"), "_y": F.col("y0")})
    return sel.slab_edges(s, _rules(spark, sf), 400, 200000).select("rect_id", F.col("_x").alias("x0"), F.col("_y").alias("y0"), "i", "x1", "y1", "x2", "y2")


@query("""select o_orderkey, case o_orderkey % 5 when 0 then coalesce(case o_orderkey % 4 when 0 then 'slab' when 1 then 'shaft' when 2 then 'ramp' end, 'slab') in ('slab', 'cantilever', 'ramp') when 1 then o_orderkey % 3 > 0 when 2 then o_custkey % 2 > 0 when 3 then o_orderstatus <> 'F' else true end as drawable from orders""")
def b18_drawable(spark, sf):
    """Which elements take part in a comparison, by category."""
    k = F.col("o_orderkey")
    category = F.get(F.array(*map(F.lit, ("panels", "stairs", "piles", "walls", "columns"))), (k % 5).cast("int"))
    kind = F.when(k % 4 == 0, "slab").when(k % 4 == 1, "shaft").when(k % 4 == 2, "ramp")
    outline = F.slice(F.array(F.lit(1), F.lit(2)), 1, (k % 3).cast("int"))
    return view(spark, sf, "orders").select("o_orderkey", sel.drawable(category, kind, outline, F.nullif(F.col("o_custkey") % 2, F.lit(0)), F.col("o_orderstatus") != "F").alias("drawable"))


@query("select rect_id, x0, y0, case when rect_id % 4 in (0, 1, 2) or w % 7 <= 4 then 'high' else 'medium' end as confidence from {vR} r")
def b22_confidence(spark, sf):
    """Confidence by what an element was drawn as: shapes, or lines paired of few parts."""
    kind = F.get(F.array(*map(F.lit, ("polyline", "circle", "hatch", "paired_lines"))), (F.col("rect_id") % 4).cast("int"))
    return view(spark, sf, "vR").select("rect_id", "x0", "y0", sel.confidence(kind, F.col("w") % 7).alias("confidence"))


@query(f"""select case when layer < 'M' then 'first' else 'second' end as name, layer, role, case role {_TEXT_ROLE} else 'NOTE' end as text_role, confidence, modifiers from ({LAYERS_SQL}) l""")
def a16_profiles(spark, sf):
    """Suggested rules saved as profile documents and loaded again."""
    r = _rules(spark, sf).withColumn("name", F.when(F.col("layer") < "M", "first").otherwise("second"))
    got = profiles.read_profile_documents(profiles.profile_documents(r, "name"))
    return got.withColumn("modifiers", F.array_join("modifiers", ","))


@query("""select rect_id, x0, y0, case rect_id % 4 when 0 then 'T-COLUMN' when 1 then 'X-BEAM' when 2 then 'X-SLAB' else 'T-OTHER' end as layer, case when h >= 900 then 300.0 when h >= 600 then 200.0 else 120.0 end as text_height from {vR} r""")
def a17_template_spec(spark, sf):
    """Layer and text height of elements by a loaded spec: the largest height that an element has room for three times."""
    spec = profiles.load_spec("{\"layers\": {\"column\": \"T-COLUMN\", \"beam\": \"X-BEAM\", \"slab\": \"X-SLAB\"}, \"text_heights\": [120, 300, 200]}")
    kind = F.get(F.array(*map(F.lit, ("column", "beam", "slab", "pile"))), (F.col("rect_id") % 4).cast("int"))
    heights = F.array(*[F.lit(h) for h in spec.text_heights])
    fits = F.filter(heights, lambda h: 3 * h <= F.col("h"))
    return view(spark, sf, "vR").select("rect_id", "x0", "y0", F.coalesce(tx.lookup(spec.layers, kind), F.lit("T-OTHER")).alias("layer"), F.coalesce(F.try_element_at(fits, F.lit(1)), F.element_at(heights, -1)).alias("text_height"))


_MARKED = f"(select id, floor_id, w, d, concat('C', id % 50, '-', w, 'X', d) as mark from (select rect_id as id, floor_id, min(x1) - min(x0) as w, min(y1) - min(y0) as d from {_b('column')} b group by 1, 2) m)"
_REDRAWN = f"(select id, floor_id, w, d + case when id % 9 = 0 then 200 else 0 end as d, case when id % 7 = 0 then '' when id % 11 = 0 then concat('C', id % 50 + 1, '-', w, 'X', d) when id % 17 = 0 then replace(mark, '-', ' - ') else mark end as mark from {_MARKED} m where id % 13 <> 0 and floor_id <> 'L08')"
_SECTION = "cast(regexp_extract(mark, '(\\d+)X(\\d+)$', {0}) as bigint)"


@query(f"""with m as {_MARKED}, d as {_REDRAWN}, p as (select m.id, m.floor_id, m.mark as was, d.mark as now from m join d on m.id = d.id and m.floor_id = d.floor_id),
s as (select *, least(w, d) as lo, greatest(w, d) as hi, {_SECTION.format(1)} as a, {_SECTION.format(2)} as b, trim(regexp_extract(mark, '^(C\\d+)', 1)) as base from d where mark <> ''),
q as (select *, lag(lo) over (partition by floor_id, base order by id) as plo, lag(hi) over (partition by floor_id, base order by id) as phi from s)
select 'RT_FLOOR_MISSING' as code, floor_id, null as element_id from m group by floor_id having floor_id not in (select floor_id from d)
union all select 'RT_COUNT', coalesce(a.floor_id, b.floor_id), null from (select floor_id, count(*) as n from m group by 1) a full join (select floor_id, count(*) as n from d group by 1) b on a.floor_id = b.floor_id where coalesce(a.n, 0) <> coalesce(b.n, 0)
union all select 'RT_MARK_MISSING', floor_id, cast(id as varchar) from p where was <> '' and now = ''
union all select 'RT_MARK_CHANGED', floor_id, cast(id as varchar) from p where now <> '' and replace(was, ' ', '') <> replace(now, ' ', '')
union all select 'RT_MARK_MISMATCH', floor_id, cast(id as varchar) from s where abs(least(a, b) - lo) > 26 or abs(greatest(a, b) - hi) > 26
union all select 'RT_DUP_MARK', floor_id, cast(id as varchar) from q where abs(plo - lo) > 26 or abs(phi - hi) > 26
union all select 'RT_LEVEL_CHANGED', null, n_name from nation where n_nationkey % 4 > 1""")
def l03_mark_diff(spark, sf):
    """What an edit did to marks, counts, floors and levels."""
    m = boxes(spark, sf, "column").groupBy(F.col("rect_id").alias("id"), "floor_id").agg((F.min("x1") - F.min("x0")).alias("w"), (F.min("y1") - F.min("y0")).alias("d"))
    mark = lambda n: F.concat(F.lit("C"), n.cast("string"), F.lit("-"), "w", F.lit("X"), "d")
    k = F.col("id")
    m = m.withColumn("mark", mark(k % 50))
    now = F.when(k % 7 == 0, "").when(k % 11 == 0, mark(k % 50 + 1)).when(k % 17 == 0, F.replace("mark", F.lit("-"), F.lit(" - "))).otherwise(F.col("mark"))
    d = m.where("id % 13 <> 0 and floor_id <> 'L08'").withColumn("mark", now).withColumn("d", F.col("d") + F.when(k % 9 == 0, 200).otherwise(0))
    n = view(spark, sf, "nation").select("n_name", (F.col("n_nationkey") * 3000.0).alias("elevation"), (F.col("n_nationkey") % 4).alias("moved"))
    return compare_marks(m, d, n.select("n_name", "elevation"), n.select("n_name", (F.col("elevation") + F.col("moved")).alias("elevation"))).select("code", "floor_id", "element_id")


def compare_marks(m, d, m_levels, d_levels, tolerance: float = 26):
    """Findings on floors, counts, marks (id, floor_id, w, d, mark) and levels (n_name, elevation) of a model against a drawing.

    Marks are compared without blanks; null marks are empty. A mark that states a size must be the drawn
    one, whichever way round, and one base must name one section: each element is held against the one of
    its base before it, by id.
    """
    from pyspark.sql import Window as W

    col, none = F.col, F.lit(None).cast("string")
    named = lambda t: t.withColumn("mark", F.btrim(F.coalesce("mark", F.lit(""))))
    m, d = named(m), named(d)
    counts = m.groupBy("floor_id").agg(F.count("*").alias("n")).join(d.groupBy("floor_id").agg(F.count("*").alias("n_d")).hint("merge"), "floor_id", "full")
    both = m.select("id", "floor_id", col("mark").alias("was")).join(d.select("id", "floor_id", col("mark").alias("now")).hint("merge"), ["id", "floor_id"])
    flat = lambda c: F.replace(col(c), F.lit(" "), F.lit(""))
    split = tx.split_mark(col("mark"))
    stated = tx.size(split["stated_size"])
    s = d.where("mark <> ''").select("id", "floor_id", F.least("w", "d").alias("lo"), F.greatest("w", "d").alias("hi"), F.upper(tx.group(split["base"], tx.WRITTEN_BASE, 1)).alias("base"), stated["width_mm"].alias("a"), stated["depth_mm"].alias("b"))
    before = W.partitionBy("floor_id", "base").orderBy("id")
    s = s.withColumns({"plo": F.lag("lo").over(before), "phi": F.lag("hi").over(before)})
    off = lambda a, b: F.abs(col(a) - col(b)) > tolerance
    level = m_levels.join(d_levels.withColumnRenamed("elevation", "now").hint("merge"), "n_name")
    s = s.withColumns({"slo": F.least("a", "b"), "shi": F.greatest("a", "b")})
    found = [
        dg.finding(counts, col("n_d").isNull(), "ERROR", "RT_FLOOR_MISSING", none, col("floor_id")),
        dg.finding(counts, F.coalesce("n", F.lit(0)) != F.coalesce("n_d", F.lit(0)), "WARNING", "RT_COUNT", none, col("floor_id")),
        dg.finding(both, (col("was") != "") & (col("now") == ""), "WARNING", "RT_MARK_MISSING", col("id"), col("floor_id")),
        dg.finding(both, (col("now") != "") & (flat("was") != flat("now")), "WARNING", "RT_MARK_CHANGED", col("id"), col("floor_id")),
        dg.finding(s, col("a").isNotNull() & (off("slo", "lo") | off("shi", "hi")), "WARNING", "RT_MARK_MISMATCH", col("id"), col("floor_id")),
        dg.finding(s, col("base").isNotNull() & (off("plo", "lo") | off("phi", "hi")), "WARNING", "RT_DUP_MARK", col("id"), col("floor_id")),
        dg.finding(level, F.abs(col("elevation") - col("now")) > 1, "WARNING", "RT_LEVEL_CHANGED", col("n_name")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
