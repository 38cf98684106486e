"""Queries with aggregates and diagnostics (sections F and K of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlake.functions import diagnostics as dg, text as tx
from planlake.operators import spatial as sp
from planlake.sources.proxies import view

from .joins import boxes
from .registry import query
from .texts import TAGS_SQL


@query("select layer, count(*) filter (where entity = 'LINE') as \"LINE\", count(*) filter (where entity = 'HATCH') as \"HATCH\", count(*) as total from {vL} l group by layer")
def f01_layer_counts(spark, sf):
    return view(spark, sf, "vL").groupBy("layer").agg(F.count_if(F.col("entity") == "LINE").alias("LINE"), F.count_if(F.col("entity") == "HATCH").alias("HATCH"), F.count("*").alias("total"))


@query("select coalesce(floor_id, 'all') as floor_id, coalesce(cast(kind as varchar), 'all') as kind, count(*) as n from (select floor_id, rect_id % 10 as kind from {vR} r) r group by rollup (floor_id, kind)")
def f02_totals(spark, sf):
    r = view(spark, sf, "vR").select("floor_id", (F.col("rect_id") % 10).cast("string").alias("kind"))
    return r.rollup("floor_id", "kind").agg(F.count("*").alias("n")).select(F.coalesce("floor_id", F.lit("all")).alias("floor_id"), F.coalesce("kind", F.lit("all")).alias("kind"), "n")


@query("select floor_id, count(*) filter (where rect_id % 10 = 1) as k1, count(*) filter (where rect_id % 10 = 2) as k2, count(*) filter (where rect_id % 10 = 3) as k3 from {vR} r group by floor_id")
def f03_floor_matrix(spark, sf):
    r = view(spark, sf, "vR").withColumn("k", F.concat(F.lit("k"), F.col("rect_id") % 10))
    return r.groupBy("floor_id").pivot("k", ["k1", "k2", "k3"]).count().na.fill(0)


_EVENTS = "(select event_id, user_id, case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' else 'INFO' end as severity, event_type as code from events)"


def _findings(spark, sf):
    sev = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    return view(spark, sf, "events").select("event_id", "user_id", sev.alias("severity"), F.col("event_type").alias("code"))


@query(f"select severity, code, count(*) as n from {_EVENTS} e group by rollup (severity, code)")
def f04_roll_up(spark, sf):
    return dg.rolled_up(_findings(spark, sf))


@query(f"""select floor_id, g, arg_min(width_mm, tag_id) filter (where width_mm is not null) as width_mm, arg_min(thickness_mm, tag_id) filter (where thickness_mm is not null) as thickness_mm,
 cast(count(distinct (width_mm, depth_mm)) filter (where width_mm is not null) as bigint) as n_sizes, count(distinct (width_mm, depth_mm)) filter (where width_mm is not null) > 1 as multi from (select *, tag_id // 4 % 50 as g from ({TAGS_SQL}) t) t group by floor_id, g""")
def f05_merge_tags(spark, sf):
    """The tags of one element: the first that states a field gives it; several sizes are reported."""
    t = tx.parse_tags(view(spark, sf, "vT")).withColumn("g", F.expr("tag_id div 4 % 50"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("tag_id", c)))[c].alias(c)
    sizes = F.count_distinct(F.when(F.col("width_mm").isNotNull(), F.struct("width_mm", "depth_mm")))
    return t.groupBy("floor_id", "g").agg(first("width_mm"), first("thickness_mm"), sizes.alias("n_sizes"), (sizes > 1).alias("multi"))


@query("""select l_suppkey as panel, arg_min(q, row(-n, first_at, q)) as thickness, cast(count(*) as bigint) as n_values, count(*) > 1 as multi from (select l_suppkey, l_quantity as q, count(*) as n, min(l_orderkey * 10 + l_linenumber) as first_at from lineitem group by 1, 2) t group by l_suppkey""")
def f06_common_thickness(spark, sf):
    """The most common value, the first seen on ties."""
    n = view(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("panel"), F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_at"))
    top = F.min(F.struct((-F.col("n")).alias("a"), "first_at", "q"))["q"]
    return n.groupBy("panel").agg(top.alias("thickness"), F.count("*").alias("n_values"), (F.count("*") > 1).alias("multi"))


@query("select l_suppkey as panel, arg_min(depth, row(-area, depth)) as sunk from (select l_suppkey, l_linenumber * 25 as depth, sum(cast(l_quantity as bigint)) as area from lineitem group by 1, 2) t group by l_suppkey")
def f07_sunk_depth(spark, sf):
    d = view(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("panel"), (F.col("l_linenumber") * 25).alias("depth")).agg(F.sum(F.col("l_quantity").cast("long")).alias("area"))
    return sp.best(d, ["panel"], [-F.col("area"), F.col("depth")], {"sunk": F.col("depth")})


@query(r"""select floor_id, mark, count(*) as n, array_to_string(list_slice(list(tag_id order by tag_id), 1, 4), ',') as samples from (select floor_id, tag_id, regexp_extract(text, '^([BC]\d+)[- ]', 1) as mark from {vT} t) t
 where mark <> '' and mark not in (select concat('B', p_size) from part) group by floor_id, mark""")
def f08_unknown_marks(spark, sf):
    t = tx.parse_tags(view(spark, sf, "vT")).where("mark is not null").select("floor_id", "tag_id", "mark")
    known = view(spark, sf, "part").select(F.concat(F.lit("B"), "p_size").alias("mark")).distinct()
    return _sampled(t.join(known.hint("merge"), "mark", "left_anti"), ["floor_id", "mark"], "tag_id")


def _sampled(df, by, item, k=4):
    """Count and the first k items of each group; ranks are limited before lists are made."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    top = df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(item))).where(F.col("_k") <= k)
    s = top.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda i: i.cast("string")), ",").alias("samples"))
    return n.join(s.hint("merge"), list(by))


@query(f"select floor_id, count(*) as n, array_to_string(list_slice(list(tag_id order by tag_id), 1, 5), ',') as samples from ({TAGS_SQL}) t where unparsed group by floor_id")
def f09_unassigned(spark, sf):
    t = tx.parse_tags(view(spark, sf, "vT")).where("unparsed").select("floor_id", "tag_id")
    return _sampled(t, ["floor_id"], "tag_id", 5)


@query("select floor_id, count(*) as n, count(*) filter (where w < 450) as unsized, case when avg(case when w < 450 then 1.0 else 0.0 end) > 0.5 then 'WARNING' else 'INFO' end as severity from {vR} r group by floor_id")
def f10_escalate(spark, sf):
    """Many single infos of a floor become one warning."""
    bad = F.col("w") < 450
    return view(spark, sf, "vR").groupBy("floor_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("unsized"), F.when(F.avg(bad.cast("int")) > 0.5, "WARNING").otherwise("INFO").alias("severity"))


@query("select line_no, count(*) as n, array_to_string(list_slice(list(seg_id order by seg_id), 1, 4), ',') as samples from {vS} s where t2 - t1 < 500 group by line_no")
def f11_unpaired(spark, sf):
    return _sampled(view(spark, sf, "vS").where("t2 - t1 < 500"), ["line_no"], "seg_id")


@query("select label, n from (select floor_id, substr(text, 1, 4) as label, count(*) as n from {vT} t group by 1, 2) t where n > greatest(5, 0.02 * (select count(*) from {vT} u where u.floor_id = t.floor_id))")
def f12_qualifiers(spark, sf):
    """Labels repeated so often on a floor that they name nothing."""
    n = view(spark, sf, "vT").groupBy("floor_id", F.substring("text", 1, 4).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(W.partitionBy("floor_id"))).where(F.col("n") > F.greatest(F.lit(5), 0.02 * F.col("total"))).select("label", "n")


@query("select line_no, max(n) as treads, max(n) + 1 as risers from (select line_no, cast(round((t2 - t1) / 50.0) as bigint) % 36 as b, count(*) as n from {vS} s group by 1, 2) t group by line_no")
def f13_treads(spark, sf):
    n = view(spark, sf, "vS").groupBy("line_no", (F.round((F.col("t2") - F.col("t1")) / 50.0) % 36).alias("b")).agg(F.count("*").alias("n"))
    return n.groupBy("line_no").agg(F.max("n").alias("treads"), (F.max("n") + 1).alias("risers"))


@query("select l_suppkey as stack, count(distinct (l_quantity, l_linenumber)) as n_sizes from lineitem group by 1 having count(distinct (l_quantity, l_linenumber)) > 1")
def f14_size_changes(spark, sf):
    return view(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("stack")).agg(F.count_distinct(F.struct("l_quantity", "l_linenumber")).alias("n_sizes")).where("n_sizes > 1")


@query("""select o_custkey as stack, min(case when o_orderkey % 3 = 0 then concat(o_orderpriority, case when o_orderstatus = 'F' then ' STOP' else '' end) end) as "F0",
 min(case when o_orderkey % 3 = 1 then concat(o_orderpriority, case when o_orderstatus = 'F' then ' STOP' else '' end) end) as "F1", min(case when o_orderkey % 3 = 2 then concat(o_orderpriority, case when o_orderstatus = 'F' then ' STOP' else '' end) end) as "F2" from orders group by o_custkey""")
def f15_column_schedule(spark, sf):
    o = view(spark, sf, "orders").select(F.col("o_custkey").alias("stack"), F.concat(F.lit("F"), F.col("o_orderkey") % 3).alias("f"), F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", " STOP").otherwise("")).alias("t"))
    return o.groupBy("stack").pivot("f", ["F0", "F1", "F2"]).agg(F.min("t"))


@query("select p_brand as family, p_type as type, p_size as size, count(*) as n from part group by all")
def f16_types(spark, sf):
    return view(spark, sf, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("type"), F.col("p_size").alias("size")).agg(F.count("*").alias("n"))


@query("select o_orderstatus as category, count(*) as model, count(*) filter (where o_orderkey % 13 <> 0) as drawing, count(*) filter (where o_orderkey % 13 <> 0) - count(*) as difference from orders group by 1")
def f17_count_difference(spark, sf):
    o = view(spark, sf, "orders")
    m, d = o.groupBy("o_orderstatus").agg(F.count("*").alias("model")), o.where("o_orderkey % 13 <> 0").groupBy("o_orderstatus").agg(F.count("*").alias("drawing"))
    both = m.join(d, "o_orderstatus", "full_outer").na.fill(0, ["model", "drawing"])
    return both.select(F.col("o_orderstatus").alias("category"), "model", "drawing", (F.col("drawing") - F.col("model")).alias("difference"))


@query("select floor_id, min(x0) - 3000 as x0, min(y0) - 3000 as y0, max(x0 + w) + 3000 as x1, max(y0 + h) + 3000 as y1 from {vR} r group by floor_id")
def f18_frame_extents(spark, sf):
    return boxes(spark, sf).groupBy("floor_id").agg((F.min("x0") - 3000).alias("x0"), (F.min("y0") - 3000).alias("y0"), (F.max("x1") + 3000).alias("x1"), (F.max("y1") + 3000).alias("y1"))


@query("select coalesce(a.event_type, b.event_type) as kind, coalesce(a.n, 0) as first, coalesce(b.n, 0) as second from (select event_type, count(*) as n from events where user_id % 2 = 0 group by 1) a full join (select event_type, count(*) as n from events where user_id % 2 = 1 group by 1) b on a.event_type = b.event_type")
def f19_side_by_side(spark, sf):
    e = view(spark, sf, "events")
    n = lambda k, name: e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias(name))
    return n(0, "first").join(n(1, "second"), "kind", "full_outer").na.fill(0, ["first", "second"])


@query("select case when rect_id % 2 = 0 then 'tag' when rect_id % 3 = 0 then 'schedule' else 'outline' end as source, count(*) as n from {vR} r group by 1")
def f20_provenance(spark, sf):
    return view(spark, sf, "vR").groupBy(F.when(F.col("rect_id") % 2 == 0, "tag").when(F.col("rect_id") % 3 == 0, "schedule").otherwise("outline").alias("source")).agg(F.count("*").alias("n"))


@query("select p_brand as block, count(*) as n, array_to_string(list_slice(list_sort(list(distinct p_name)), 1, 3), ', ') as names from part group by p_brand")
def f21_expanded_blocks(spark, sf):
    p = view(spark, sf, "part").select("p_brand", "p_name")
    n = p.groupBy("p_brand").agg(F.count("*").alias("n"))
    names = p.distinct().withColumn("_k", F.row_number().over(W.partitionBy("p_brand").orderBy("p_name"))).where("_k <= 3").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("p_name")), ", ").alias("names"))
    return n.join(names.hint("merge"), "p_brand").select(F.col("p_brand").alias("block"), "n", "names")


@query(r"select distinct 'sunk' as meaning, cast(regexp_extract(text, 'BY (\d+)MM', 1) as double) as value, concat('INDICATES SLAB SUNK BY ', regexp_extract(text, 'BY (\d+)MM', 1), 'MM') as line from {vT} t where starts_with(text, 'INDICATES')")
def f22_legend_rows(spark, sf):
    t = view(spark, sf, "vT").where(tx.is_legend_line(F.col("text")))
    m = tx.meaning(F.col("text"))
    rows = t.select(m["meaning"].alias("meaning"), m["meaning_value_mm"].alias("value")).distinct()
    return rows.withColumn("line", F.format_string("INDICATES SLAB SUNK BY %.0fMM", "value"))


@query("select coalesce(severity, '') as severity, code, n from (select case event_type when 'error' then 'ERROR' else 'INFO' end as severity, event_type as code, count(*) as n from events group by 1, 2) t order by n desc, code limit 8")
def a11_report(spark, sf):
    e = view(spark, sf, "events").select(F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"), F.col("event_type").alias("code"))
    return e.groupBy("severity", "code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code").limit(8)


_K = f"""select severity, code, floor_id, element_id from (
 select 'WARNING' as severity, 'TAG_UNPARSED' as code, floor_id, cast(tag_id as varchar) as element_id from ({TAGS_SQL}) t where unparsed
 union all select 'INFO', 'COLUMN_NO_SIZE', floor_id, cast(tag_id as varchar) from ({TAGS_SQL}) t where category_hint = 'column' and width_mm is null and diameter_mm is null
 union all select 'WARNING', 'COLUMN_ODD_SIZE', floor_id, cast(rect_id as varchar) from {{vR}} r where rect_id % 10 = 1 and (w < 230 or w > 650)
 union all select 'INFO', 'PANEL_LARGE', floor_id, cast(rect_id as varchar) from {{vR}} r where rect_id % 10 = 3 and w * h > 400000) k"""


def findings(spark, sf):
    t, r = tx.parse_tags(view(spark, sf, "vT")), view(spark, sf, "vR")
    col = lambda c: F.col(c)
    rules = [
        dg.finding(t, col("unparsed"), "WARNING", "TAG_UNPARSED", col("tag_id"), col("floor_id")),
        dg.finding(t, (col("category_hint") == "column") & col("width_mm").isNull() & col("diameter_mm").isNull(), "INFO", "COLUMN_NO_SIZE", col("tag_id"), col("floor_id")),
        dg.finding(r, (col("rect_id") % 10 == 1) & ((col("w") < 230) | (col("w") > 650)), "WARNING", "COLUMN_ODD_SIZE", col("rect_id"), col("floor_id")),
        dg.finding(r, (col("rect_id") % 10 == 3) & (col("w") * col("h") > 400000), "INFO", "PANEL_LARGE", col("rect_id"), col("floor_id")),
    ]
    out = rules[0]
    for x in rules[1:]:
        out = out.unionByName(x)
    return out


@query(_K)
def k01_findings(spark, sf):
    return findings(spark, sf)


_MEANINGS = ", ".join(f"('{c}', '{m}')" for c, m in dg.CODES.items())
_RAISED = f"""select case when event_id % 3 = 0 then upper(event_type) else list_extract([{", ".join(f"'{c}'" for c in dg.CODES)}], cast(event_id % {len(dg.CODES)} as integer) + 1) end as code from events"""


@query(f"select code, count(*) as n from ({_RAISED}) e where code not in (select code from (values {_MEANINGS}) m(code, meaning)) group by code")
def k02_closed_vocabulary(spark, sf):
    """Codes raised that the vocabulary does not have, with counts; two of three events raise one that it has."""
    codes = F.array(*[F.lit(c) for c in dg.CODES])
    raised = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.get(codes, (F.col("event_id") % len(dg.CODES)).cast("int")))
    return dg.unknown(view(spark, sf, "events").select(raised.alias("code"))).groupBy("code").agg(F.count("*").alias("n"))


@query(f"select severity, code, count(*) as n from ({_K}) k group by rollup (severity, code)")
def k03_roll_up(spark, sf):
    return dg.rolled_up(findings(spark, sf))


@query(f"select count(*) filter (where severity in ('ERROR', 'WARNING')) = 0 as ok, count(*) as n from ({_K}) k")
def k04_verdict(spark, sf):
    return dg.verdict(findings(spark, sf))


@query(f"select k.severity, k.code, m.meaning, count(*) as n from ({_K}) k join (values {_MEANINGS}) m(code, meaning) on k.code = m.code group by 1, 2, 3")
def l11_issue_roll_up(spark, sf):
    """Issues of a run with what they are about."""
    n = findings(spark, sf).groupBy("severity", "code").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(dg.code_table(spark)), "code").select("severity", "code", "meaning", "n")
