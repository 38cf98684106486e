"""Queries with intervals, numbering, windows, top-k and sets (sections G, H and I of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlake.operators import intervals as iv, matching as mt, numbering as nb, spatial as sp, sweeps as sw
from planlake.sources.proxies import view

from .joins import BOX, boxes, _b, _OV, _AREA
from .registry import query


@query("select rect_id, x0, y0, concat(floor_id, '-R', lpad(cast(row_number() over (partition by floor_id order by y0, x0, rect_id, w, h) as varchar), 5, '0')) as element_id from {vR} r")
def g01_ids(spark, sf):
    r = nb.numbered(view(spark, sf, "vR"), ["floor_id"], ["y0", "x0", "rect_id", "w", "h"])
    return r.select("rect_id", "x0", "y0", F.concat("floor_id", F.lit("-R"), F.lpad(F.col("n").cast("string"), 5, "0")).alias("element_id"))


@query("select n_nationkey, row_number() over (order by round(n_nationkey * 37 % 11 * 700 / 1000.0), n_nationkey * 53 % 17, n_nationkey) as floor_order from nation")
def g02_floor_order(spark, sf):
    """Floors from left to right by metre, then from below: one row per floor, so one sort of a small table."""
    k = F.col("n_nationkey")
    order = W.orderBy(F.round(k * 37 % 11 * 700 / 1000.0), k * 53 % 17, k)
    return view(spark, sf, "nation").select("n_nationkey", F.row_number().over(order).alias("floor_order"))


_ISLANDS = """select line_no, min(t1) as t1, max(t2) as t2, count(*) as n_parts from (select *, sum(s) over (partition by line_no order by t1, t2, seg_id) as i from (
 select *, case when t1 <= max(t2) over (partition by line_no order by t1, t2, seg_id rows between unbounded preceding and 1 preceding) + {gap} then 0 else 1 end as s from {{vS}} s) s) s group by line_no, i"""


@query(_ISLANDS.format(gap=800).replace("{{", "{").replace("}}", "}"))
def g03_merge_collinear(spark, sf):
    return iv.merged(view(spark, sf, "vS"), ["line_no"], 800)


_BARRIERS = "(select user_id % 50 as line_no, (event_id * 104729) % 100000 as at from events where event_id % 5 = 0)"


@query(f"""select line_no, min(t1) as t1, max(t2) as t2, count(*) as n_parts from (select *, sum(s) over (partition by line_no order by t1, t2, seg_id) as i from (
 select g.*, case when g.reach is null or g.t1 > g.reach + 800 or (g.t1 > g.reach and exists (select 1 from {_BARRIERS} b where b.line_no = g.line_no and b.at > g.reach and b.at < g.t1)) then 1 else 0 end as s
 from (select *, max(t2) over (partition by line_no order by t1, t2, seg_id rows between unbounded preceding and 1 preceding) as reach from {{vS}} s) g) s) s group by line_no, i""")
def g04_merge_with_barriers(spark, sf):
    e = view(spark, sf, "events").where("event_id % 5 = 0")
    return iv.merged_between_barriers(view(spark, sf, "vS"), e.select((F.col("user_id") % 50).alias("line_no"), (F.col("event_id") * 104729 % 100000).alias("at")), ["line_no"], 800, ["seg_id"])


@query(_ISLANDS.format(gap=0).replace("{{", "{").replace("}}", "}"))
def g05_merge_touching(spark, sf):
    return iv.merged(view(spark, sf, "vS"), ["line_no"])


_DOMAIN = "(select distinct user_id % 50 as line_no, 1000 as s, 90000 as e from events)"
_FREE = f"""select line_no, t2 as t1, next as t2 from (select *, lead(t1) over (partition by line_no order by t1, t2) as next from (
 select line_no, min(t1) as t1, max(t2) as t2 from (select *, sum(s) over (partition by line_no order by t1, t2) as i from (
  select *, case when t1 <= max(t2) over (partition by line_no order by t1, t2 rows between unbounded preceding and 1 preceding) then 0 else 1 end as s from (
   select s.line_no, greatest(t1, 1000) as t1, least(t1 + (t2 - t1) // 40, 90000) as t2 from {{vS}} s where t1 + (t2 - t1) // 40 > 1000 and t1 < 90000 union all select line_no, s, s from {_DOMAIN} d union all select line_no, e, e from {_DOMAIN} d) a) b) c group by line_no, i) m) n where next > t2"""


def _free(spark, sf):
    s = view(spark, sf, "vS").withColumn("t2", F.expr("t1 + (t2 - t1) div 40"))
    domain = s.select("line_no").distinct().withColumn("start", F.lit(1000).cast("long")).withColumn("end", F.lit(90000).cast("long"))
    return iv.complement(s, domain, ["line_no"])


@query(_FREE)
def g06_complement(spark, sf):
    return _free(spark, sf)


@query(f"select line_no, t1, t2, row_number() over (partition by line_no order by t1) as span_no, t2 - t1 < 300 as dropped from ({_FREE}) f")
def g07_spans(spark, sf):
    """Spans of a run between its cuts; short ones are flagged, not lost."""
    return nb.numbered(_free(spark, sf), ["line_no"], ["t1"], "span_no").withColumn("dropped", F.col("t2") - F.col("t1") < 300)


_LINES = "(select seg_id, cast(seg_id % 4 as integer) as bucket, cast((seg_id * 613) % 60000 as bigint) as \"offset\", t1, t2 from {vS} s)"


def _lines(spark, sf):
    return view(spark, sf, "vS").select("seg_id", (F.col("seg_id") % 4).cast("int").alias("bucket"), (F.col("seg_id") * 613 % 60000).alias("offset"), "t1", "t2")


_PAIR = f"""select a.bucket, a.seg_id, b.seg_id as b_seg_id, b."offset" - a."offset" as width, greatest(a.t1, b.t1) as t1, least(a.t2, b.t2) as t2,
 round(least((least(a.t2, b.t2) - greatest(a.t1, b.t1)) / (a.t2 - a.t1), (least(a.t2, b.t2) - greatest(a.t1, b.t1)) / (b.t2 - b.t1)), 6) as cover,
 round((b."offset" - a."offset") / (0.5 + least((least(a.t2, b.t2) - greatest(a.t1, b.t1)) / (a.t2 - a.t1), (least(a.t2, b.t2) - greatest(a.t1, b.t1)) / (b.t2 - b.t1))), 6) as score
 from {_LINES} a join {_LINES} b on a.bucket = b.bucket and b."offset" - a."offset" between 100 and 1500 and a.seg_id <> b.seg_id and least(a.t2, b.t2) - greatest(a.t1, b.t1) >= 300"""


@query(_PAIR)
def g08_parallel_pairs(spark, sf):
    return iv.parallel_pairs(_lines(spark, sf), ["bucket"], "seg_id", 100, 1500, 300)


#: Ids of lines that come again up to which they are told to every task.
FEW_AGAIN = 100_000


@query(f"select p.bucket, p.seg_id, p.b_seg_id, p.width from ({_PAIR}) p join {_LINES} a on a.seg_id = p.seg_id where not exists (select 1 from (select cast(n_nationkey % 4 as integer) as bucket, cast(n_nationkey * 2400 as bigint) as at from nation) j where j.bucket = p.bucket and j.at > a.\"offset\" + 5 and j.at < a.\"offset\" + p.width - 5)")
def g09_pairs_without_barrier(spark, sf):
    """Pairs that reach over no joint line: each line knows the next joint above it, so pairs are only filtered."""
    lines = _lines(spark, sf)
    joints = view(spark, sf, "nation").select((F.col("n_nationkey") % 4).cast("int").alias("bucket"), (F.col("n_nationkey").cast("long") * 2400).alias("at")).groupBy("bucket").agg(F.collect_set("at").alias("_joints"))
    near = F.array_min(F.filter("_joints", lambda j: j > F.col("offset") + 5))
    left = lines.join(F.broadcast(joints), "bucket", "left").withColumn("_next", near).drop("_joints")  # a row for each bucket
    again = mt.kept(lines.groupBy("seg_id").agg(F.count("*").alias("_n")).where("_n > 1"))
    n = again.count()
    if n:  # a line that comes again counts again; where few do, lines are not shuffled for it
        again = F.broadcast(again) if n <= FEW_AGAIN else again.hint("merge")
        left = left.join(again, "seg_id", "left").withColumn("_i", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)).cast("int")))).drop("_n", "_i")
    pairs = iv.parallel_pairs(lines, ["bucket"], "seg_id", 100, 1500, 300, ["offset", "_next"], left)
    return pairs.where("_next is null or _next >= offset + width - 5").select("bucket", "seg_id", "b_seg_id", "width")


@query("""select floor_id, tag_id, dense_rank() over (partition by floor_id order by row_y desc) as row_no, row_number() over (partition by floor_id, row_y order by x, tag_id) as col_no
from (select *, y // 500 * 500 as row_y from {vT} t) t""")
def g10_table_rows(spark, sf):
    """Cells to rows from above: a row takes what is within the tolerance of its first cell."""
    t = view(spark, sf, "vT").select("floor_id", "tag_id", "x", (-F.expr("y div 500 * 500")).alias("ny"))
    return nb.numbered(nb.table_rows(t, ["floor_id"], "ny", 75), ["floor_id", "row_no"], ["x", "tag_id"], "col_no").select("floor_id", "tag_id", "row_no", "col_no")


@query("""select table_no, row_no, max(case when col = 0 then value end) as mark, max(case when col = 1 then value end) as width, max(case when col = 2 then value end) as depth
from (select p_partkey // 10 as table_no, p_partkey % 10 as row_no, unnest([0, 1, 2]) as col, unnest([concat('C', p_size), cast(p_size * 10 as varchar), cast(p_size * 20 as varchar)]) as value from part) t group by table_no, row_no""")
def g11_schedule_tables(spark, sf):
    """Cells under header cells: each takes the nearest header by x, then rows are pivoted."""
    p = view(spark, sf, "part").select(F.expr("p_partkey div 10").alias("table_no"), (F.col("p_partkey") % 10).alias("row_no"), "p_size", "p_partkey")
    cell = lambda x, v: F.struct((F.lit(x) + F.col("p_partkey") % 90).cast("long").alias("x"), v.cast("string").alias("value"))
    cells = p.select("table_no", "row_no", F.explode(F.array(cell(0, F.concat(F.lit("C"), F.col("p_size").cast("string"))), cell(1000, F.col("p_size") * 10), cell(2000, F.col("p_size") * 20))).alias("c")).select("table_no", "row_no", "c.x", "c.value")
    heads = p.select("table_no").distinct().select("table_no", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).cast("long").alias("hx")) for n, x in (("mark", 40), ("width", 1040), ("depth", 2040))])).alias("h")).select("table_no", "h.*")
    pairs = cells.join(heads.hint("merge"), "table_no")
    named = sp.best(pairs, ["table_no", "row_no", "x", "value"], [F.abs(F.col("x") - F.col("hx")), F.col("name")], {"name": F.col("name")})
    return named.groupBy("table_no", "row_no").pivot("name", ["mark", "width", "depth"]).agg(F.min("value"))


@query("select p_size * 10 as width, trim(m) as mark, count(*) as n from (select p_size, unnest(regexp_split_to_array(concat('B', p_size, ', B', p_size + 1, ' & B', p_partkey % 7), '[,/;&]| and ')) as m from part) t group by 1, 2")
def g12_size_lists(spark, sf):
    """Size rows that list their marks, by mark."""
    cell = F.expr("concat('B', p_size, ', B', p_size + 1, ' & B', p_partkey % 7)")
    return view(spark, sf, "part").select((F.col("p_size") * 10).alias("width"), F.explode(F.split(cell, r"[,/;&]| and ")).alias("m")).groupBy("width", F.btrim("m").alias("mark")).agg(F.count("*").alias("n"))


@query("""with o as (select o_orderkey, o_custkey % 20 as g, case when o_orderkey % 4 = 0 then o_orderkey // 4 % 300 + 1 end as given from orders),
u as (select g, given, row_number() over (partition by g order by given) as j from (select distinct g, given from o where given is not null) d),
k as (select *, row_number() over (partition by g order by o_orderkey) as k from o where given is null)
select o_orderkey, g, given as number from o where given is not null union all select o_orderkey, g, k + (select count(*) from u where u.g = k.g and u.given - u.j < k.k) from k""")
def g13_fill_numbers(spark, sf):
    """The unnumbered take the lowest numbers that clients have not given."""
    given = F.when(F.col("o_orderkey") % 4 == 0, F.expr("o_orderkey div 4") % 300 + 1)
    o = view(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("g"), given.alias("given"))
    return nb.fill_numbers(o, ["g"], "given", ["o_orderkey"]).select("o_orderkey", "g", "number")


@query("select rect_id, x0, y0, row_number() over (partition by floor_id order by round(y0 / 250.0), round(x0 / 250.0), rect_id, x0, y0, w, h) as n from {vR} r")
def g14_order_keys(spark, sf):
    """Row-major order in buckets of 250."""
    bucket = lambda c: F.round(F.col(c) / 250.0)
    return nb.numbered(view(spark, sf, "vR"), ["floor_id"], [bucket("y0"), bucket("x0"), "rect_id", "x0", "y0", "w", "h"]).select("rect_id", "x0", "y0", "n")


@query("select seg_id, row_number() over (partition by line_no order by t1, t2, seg_id) as n from {vS} s")
def g15_span_order(spark, sf):
    return nb.numbered(view(spark, sf, "vS"), ["line_no"], ["t1", "t2", "seg_id"]).select("seg_id", "n")


@query("""select o_orderkey, last_known + coalesce(sum(step) over (partition by o_custkey, block order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as elevation, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as above
from (select *, first_value(known) over (partition by o_custkey, block order by o_orderkey) as last_known from (select *, count(known) over (partition by o_custkey order by o_orderkey) as block from (
 select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then o_orderkey % 100 * 1000 end as known, 2800 + o_orderkey % 5 * 100 as step from orders) a) b) c""")
def g16_level_chain(spark, sf):
    """Elevations: the last known one plus the storey heights since; unknown until the first known one."""
    o = view(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 100 * 1000).alias("known"), (2800 + F.col("o_orderkey") % 5 * 100).alias("step"))
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.withColumn("block", F.count("known").over(order)).withColumn("last_known", F.last("known", ignorenulls=True).over(order))
    since = F.sum("step").over(W.partitionBy("o_custkey", "block").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1))
    return o.select("o_orderkey", (F.col("last_known") + F.coalesce(since, F.lit(0))).alias("elevation"), F.lead("o_orderkey").over(order).alias("above"))


@query("select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_totalprice, o_orderkey) as level_above, lead(o_totalprice) over (partition by o_custkey order by o_totalprice, o_orderkey) - o_totalprice > 50000 as tall from orders")
def g17_level_above(spark, sf):
    order = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return view(spark, sf, "orders").select("o_orderkey", F.lead("o_orderkey").over(order).alias("level_above"), (F.lead("o_totalprice").over(order) - F.col("o_totalprice") > 50000).alias("tall"))


@query("""with p as (select distinct o_custkey as stack, extract(month from o_orderdate) as f from orders) select stack, f as floor_no, not coalesce(lag(f) over (partition by stack order by f) = f - 1, false) as starts_here,
 not coalesce(lead(f) over (partition by stack order by f) = f + 1, false) as stops_here from p""")
def g18_starts_stops(spark, sf):
    p = view(spark, sf, "orders").select(F.col("o_custkey").alias("stack"), F.month("o_orderdate").cast("long").alias("floor_no")).distinct()
    order, f = W.partitionBy("stack").orderBy("floor_no"), F.col("floor_no")
    return p.select("stack", "floor_no", (~F.coalesce(F.lag("floor_no").over(order) == f - 1, F.lit(False))).alias("starts_here"), (~F.coalesce(F.lead("floor_no").over(order) == f + 1, F.lit(False))).alias("stops_here"))


@query("""select depth, case rank when 1 then 'ANSI31' when 2 then 'ANSI37' when 3 then 'DOTS' else 'SOLID' end as pattern from (select depth, row_number() over (order by pos, depth) as rank from (
 select cast(l_quantity as bigint) as depth, min(l_orderkey * 10 + l_linenumber) as pos from lineitem group by 1) d) r""")
def g19_depth_patterns(spark, sf):
    """One pattern for each depth in order of appearance; when the palette is through, the default. Depths are few."""
    d = view(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("depth")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    palette = F.array(F.lit("ANSI31"), F.lit("ANSI37"), F.lit("DOTS"))
    return d.select("depth", F.coalesce(F.try_element_at(palette, F.row_number().over(W.orderBy("pos", "depth"))), F.lit("SOLID")).alias("pattern"))


@query("select o_orderkey, o_totalprice / 2 as landing, (select max(h.o_totalprice) from orders h where h.o_custkey = o.o_custkey and h.o_totalprice < o.o_totalprice) as pit_level from orders o")
def g20_landing_pit(spark, sf):
    """Landing at half height; a pit goes to the next level below."""
    o = view(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    lower = W.partitionBy("o_custkey").orderBy("cents").rangeBetween(W.unboundedPreceding, -1)
    return o.select("o_orderkey", (F.col("o_totalprice") / 2).alias("landing"), F.max("o_totalprice").over(lower).alias("pit_level"))


@query("select o_orderkey, case when max(e) over (partition by o_custkey) is null then y - min(y) over (partition by o_custkey) else e end as elevation, max(e) over (partition by o_custkey) is null as relative from (select o_orderkey, o_custkey, o_orderkey % 97 * 100 as y, case when o_custkey % 2 = 0 and o_orderkey % 2 = 0 then o_orderkey % 50 * 10 end as e from orders) t")
def g21_relative_levels(spark, sf):
    """Levels as drawn; relative to the lowest line where a drawing states none."""
    own = W.partitionBy("o_custkey")
    o = view(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 97 * 100).alias("y"), F.when((F.col("o_custkey") % 2 == 0) & (F.col("o_orderkey") % 2 == 0), F.col("o_orderkey") % 50 * 10).alias("e"))
    none = F.max("e").over(own).isNull()
    return o.select("o_orderkey", F.when(none, F.col("y") - F.min("y").over(own)).otherwise(F.col("e")).alias("elevation"), none.alias("relative"))


@query("select floor_id, arg_min(rect_id, row(-(w * h), rect_id)) as rect_id, max(w * h) as area from {vR} r group by floor_id")
def h01_top1(spark, sf):
    r = view(spark, sf, "vR").withColumn("area", F.col("w") * F.col("h"))
    return sp.best(r, ["floor_id"], [-F.col("area"), F.col("rect_id")], {"rect_id": F.col("rect_id"), "area": F.col("area")})


_SEV = "case event_type when 'error' then 0 when 'purchase' then 1 else 2 end"


@query(f"select event_id, event_type, user_id from events order by {_SEV}, user_id, event_type, event_id limit 400")
def h02_first_findings(spark, sf):
    e = view(spark, sf, "events")
    sev = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return e.orderBy(sev, "user_id", "event_type", "event_id").limit(400).select("event_id", "event_type", "user_id")


@query("select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 8")
def h03_top_codes(spark, sf):
    return view(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(8)


@query("select user_id, string_agg(cast(event_id as varchar), ',' order by event_id) as samples from (select *, row_number() over (partition by user_id order by event_id) as k from events) e where k <= 4 group by user_id")
def h04_samples(spark, sf):
    """Four samples of each group: ranks are limited before the shuffle, lists hold four."""
    e = nb.numbered(view(spark, sf, "events"), ["user_id"], ["event_id"], "k").where("k <= 4")
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda i: i.cast("string")), ",").alias("samples"))


@query(f"select seg_id, b_seg_id, row_number() over (partition by bucket, seg_id order by score, b_seg_id) as rank from ({_PAIR}) p")
def h05_candidate_order(spark, sf):
    """Candidates of each line by score; they are ranked in the tasks that find them, so pairs are not shuffled."""
    pairs = iv.parallel_pairs(_lines(spark, sf), ["bucket"], "seg_id", 100, 1500, 300, ["_band", "_at"])
    return nb.numbered(pairs, ["bucket", "_band", "_at", "seg_id"], ["score", "b_seg_id"], "rank").select("seg_id", "b_seg_id", "rank")


@query("select note_id, row_number() over (partition by floor_id order by -y, x, note_id) as n from {vN} t where note_id % 12 = 5")
def h06_reading_order(spark, sf):
    return nb.numbered(view(spark, sf, "vN").where("note_id % 12 = 5"), ["floor_id"], [-F.col("y"), "x", "note_id"]).select("note_id", "n")


@query("select source, count(*) as n, count(*) - count(distinct text) as dropped, count(*) - count(distinct text) >= 20 as warn from documents group by source")
def i01_exact_duplicates(spark, sf):
    """One row of each (source, text) stays; the hash is the shuffle key, the text itself decides."""
    d = view(spark, sf, "documents").groupBy("source", F.xxhash64("text").alias("_h"), "text").agg(F.count("*").alias("n"))
    out = d.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.when(F.col("text").isNull(), 0).otherwise(1)).alias("dropped"))
    return out.withColumn("warn", F.col("dropped") >= 20)


_COL5 = "(select rect_id, floor_id, min(x0) as x0, min(y0) as y0, min(x1) as x1, min(y1) as y1 from " + _b("column", 6) + " b group by 1, 2)"


@query(f"select b.rect_id as later, min(a.rect_id) as kept_by, count(*) as n from {_COL5} a join {_COL5} b on a.floor_id = b.floor_id and a.rect_id < b.rect_id and ({_OV} > 0) and ({_OV} / ({_AREA} + (b.x1 - b.x0) * (b.y1 - b.y0) - {_OV}) >= 0.2 or 10 * {_OV} >= 4 * (b.x1 - b.x0) * (b.y1 - b.y0)) group by b.rect_id")
def i02_near_duplicates(spark, sf):
    """Later outlines that an earlier one overlaps too much, with the first such one."""
    r = boxes(spark, sf, "column", 6).groupBy("rect_id", "floor_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    pairs = sp.overlaps(r, r, ["floor_id"], 4000).where("rect_id < b_rect_id")
    much = (sp.share() >= 0.2) | (10 * F.col("overlap") >= 4 * sp.area("b_"))
    return pairs.where(much).groupBy(F.col("b_rect_id").alias("later")).agg(F.min("rect_id").alias("kept_by"), F.count("*").alias("n"))


@query(f"select a.rect_id, count(*) as n_inside from {_b('slab', 20)} a join {_b('column')} b on a.floor_id = b.floor_id and b.x0 >= a.x0 and b.x1 <= a.x1 and b.y0 >= a.y0 and b.y1 <= a.y1 group by a.rect_id having count(*) >= 2")
def i03_enclosures(spark, sf):
    """Outlines that hold two or more others whole: to be dropped."""
    n = sw.whole_counts(boxes(spark, sf, "column"), boxes(spark, sf, "slab", 20), "rect_id", "floor_id")
    return n.groupBy("rect_id").agg(F.sum("n").alias("n_inside")).where("n_inside >= 2")


@query(f"select floor_id, count(*) as confirmed from {_b('column')} a where exists (select 1 from {_b('region', 3)} b where a.floor_id = b.floor_id and {_OV} > 0) group by floor_id")
def i04_confirmed(spark, sf):
    """Outlines that a hatch confirms; hatches alone make no rows."""
    a = boxes(spark, sf, "column")
    hit = sp.overlaps(a, boxes(spark, sf, "region", 3), ["floor_id"], 2000).select(*BOX).distinct()
    return a.join(hit.hint("merge"), BOX, "left_semi").groupBy("floor_id").agg(F.count("*").alias("confirmed"))


@query("select floor_id, upper(text) as note, min(note_id) as first_id from {vN} n where note_id % 12 in (2, 5, 11) group by floor_id, upper(text)")
def i05_distinct_notes(spark, sf):
    return view(spark, sf, "vN").where("note_id % 12 in (2, 5, 11)").groupBy("floor_id", F.upper("text").alias("note")).agg(F.min("note_id").alias("first_id"))


@query("select text as name, y // 20000 as value, min(note_id) as note_id from {vN} n where note_id % 12 = 1 group by 1, 2")
def i06_distinct_hints(spark, sf):
    return view(spark, sf, "vN").where("note_id % 12 = 1").groupBy(F.col("text").alias("name"), F.expr("y div 20000").alias("value")).agg(F.min("note_id").alias("note_id"))


@query("select line_no as label, min(t1) as first_at, count(*) as n from {vS} s group by line_no")
def i07_distinct_grids(spark, sf):
    return view(spark, sf, "vS").groupBy(F.col("line_no").alias("label")).agg(F.min("t1").alias("first_at"), F.count("*").alias("n"))


@query("select 'model' as side, o_orderkey as id from orders where o_orderkey % 13 = 0 union all select 'drawing', o_orderkey + 1000000000 from orders where o_orderkey % 17 = 0")
def i08_only_in_one(spark, sf):
    m = view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    d = m.where("id % 13 <> 0").unionByName(m.where("id % 17 = 0").select((F.col("id") + 1_000_000_000).alias("id")))
    return m.join(d, "id", "left_anti").withColumn("side", F.lit("model")).unionByName(d.join(m, "id", "left_anti").withColumn("side", F.lit("drawing"))).select("side", "id")


@query(f"select floor_id, count(*) as unused from {{vN}} p where not exists (select 1 from {_b(wide=6)} b where b.floor_id = p.floor_id and p.x > b.x0 and p.x < b.x1 and p.y > b.y0 and p.y < b.y1) group by floor_id")
def i10_unused_tags(spark, sf):
    n = view(spark, sf, "vN").select("note_id", "floor_id", "x", "y")
    return sp.points_in_boxes(n, boxes(spark, sf, wide=6), ["floor_id"], 4000, how="left_anti").groupBy("floor_id").agg(F.count("*").alias("unused"))


@query("select kind, count(*) as n, count(size) as n_sized from (select 'tag' as kind, text_height as size from {vT} t union all select 'outline', w from {vR} r union all select 'piece', t2 - t1 from {vS} s union all select 'note', null from {vN} n) u group by kind")
def i11_union_families(spark, sf):
    t = view(spark, sf, "vT").select(F.lit("tag").alias("kind"), F.col("text_height").cast("long").alias("size"))
    every = t.unionByName(view(spark, sf, "vR").select(F.lit("outline").alias("kind"), F.col("w").alias("size"))).unionByName(view(spark, sf, "vS").select(F.lit("piece").alias("kind"), (F.col("t2") - F.col("t1")).alias("size")))
    return every.unionByName(view(spark, sf, "vN").select(F.lit("note").alias("kind")), allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("size").alias("n_sized"))
