"""Queries over texts, layers and units (sections B, C and K of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions import rules, text as tx
from planlake.sources.proxies import view

from .registry import query

_N = "nullif(regexp_extract(text, {}, {}), '')"


@query(r"""
select tag_id, cast(nullif(regexp_extract(text, '(\d+)X(\d+)(?:/(\d+))?', 1), '') as double) as width_mm,
  cast(nullif(regexp_extract(text, '(\d+)X(\d+)(?:/(\d+))?', 2), '') as double) as depth_mm,
  cast(nullif(regexp_extract(text, '(\d+)X(\d+)(?:/(\d+))?', 3), '') as double) as depth_alt_mm from {vT} t""")
def c03_size(spark, sf):
    return view(spark, sf, "vT").select("tag_id", *[c.alias(k) for k, c in tx.size(F.col("text")).items()])


@query(r"""
select tag_id, case when regexp_extract(text, '(\d+)X(\d+)', 1) = '' and cast(nullif(regexp_extract(text, '_(\d+)D', 1), '') as double) >= 100
  then cast(regexp_extract(text, '_(\d+)D', 1) as double) end as diameter_mm from {vT} t""")
def c04_diameter(spark, sf):
    return tx.parse_tags(view(spark, sf, "vT")).select("tag_id", "diameter_mm")


@query(r"""
select tag_id, cast(nullif(regexp_extract(text, '(\d+) THK', 1), '') as double) as thickness_mm, cast(null as double) as fold_mm,
  cast(nullif(regexp_extract(text, 'SUNK BY (\d+)MM', 1), '') as double) as sunk_mm from {vT} t""")
def c05_thickness_fold_sunk(spark, sf):
    return tx.parse_tags(view(spark, sf, "vT")).select("tag_id", "thickness_mm", "fold_mm", "sunk_mm")


@query(r"select note_id, regexp_matches(text, '(?i)\b(INV\.?|INVERTED|UPSTAND|UPTURN)\b') as inverted from (select note_id, case when note_id % 7 = 0 then concat(text, ' INV.') when note_id % 7 = 1 then concat('invert ', text) else text end as text from {vN} n) n")
def c06_inverted(spark, sf):
    n, t = view(spark, sf, "vN"), F.col("text")
    n = n.withColumn("text", F.when(F.col("note_id") % 7 == 0, F.concat(t, F.lit(" INV."))).when(F.col("note_id") % 7 == 1, F.concat(F.lit("invert "), t)).otherwise(t))
    return tx.parse_tags(n).select("note_id", "inverted")


@query(r"""
select note_id, case when regexp_matches(text, 'ALL BEAMS ARE \d+') then 'beam' end as note_what,
  cast(nullif(regexp_extract(text, 'ALL BEAMS ARE (\d+)MM', 1), '') as double) as note_value_mm from {vN} n""")
def c07_note_default(spark, sf):
    return tx.parse_tags(view(spark, sf, "vN")).select("note_id", "note_what", "note_value_mm")


@query(r"""select tag_id, nullif(regexp_extract(text, '^([BC]\d+)[- ]', 1), '') as mark, case when regexp_matches(text, '^[BC]\d+[- ]') then 1 else 0 end as n_marks from {vT} t""")
def c08_marks(spark, sf):
    return tx.parse_tags(view(spark, sf, "vT")).select("tag_id", "mark", F.size("marks").alias("n_marks"))


@query(r"""
select mark_id, mark, case when regexp_matches(mark, '^(SW|W|RW)') then 'wall' when regexp_matches(mark, '^(C[B]|BK|MB|B|GB|FB)') then 'beam'
  when regexp_matches(mark, '^(SC|PC|CL)') then 'column' when regexp_matches(mark, '^(CF|F)') then 'footing' when regexp_matches(mark, '^C') then 'column' when regexp_matches(mark, '^S') then 'slab' end as category
from (select p_partkey as mark_id, concat(case p_partkey % 11 when 0 then 'SW' when 1 then 'CB' when 2 then 'BKT' when 3 then 'CF' when 4 then 'SX' when 5 then 'C' when 6 then 'XB' when 7 then 'SC' when 8 then 'MB' when 9 then 'RW' else 'GB' end, p_size) as mark from part) t""")
def c09_category(spark, sf):
    names = ["SW", "CB", "BKT", "CF", "SX", "C", "XB", "SC", "MB", "RW", "GB"]
    k = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 11 + 1).cast("int"))
    marks = view(spark, sf, "part").select(F.col("p_partkey").alias("mark_id"), F.concat(k, F.col("p_size").cast("string")).alias("mark"))
    return marks.withColumn("category", tx.category_of(F.col("mark")))


TAGS_SQL = r"""
select tag_id, floor_id, text, nullif(regexp_extract(text, '^([BC]\d+)[- ]', 1), '') as mark,
  case when regexp_matches(text, '^C[\d_]') then 'column' when regexp_matches(text, '^B\d') then 'beam' end as category_hint,
  cast(nullif(regexp_extract(text, '(\d+)X(\d+)', 1), '') as double) as width_mm, cast(nullif(regexp_extract(text, '(\d+)X(\d+)', 2), '') as double) as depth_mm,
  cast(nullif(regexp_extract(text, '_(\d+)D', 1), '') as double) as diameter_mm, cast(nullif(regexp_extract(text, '(\d+) THK', 1), '') as double) as thickness_mm,
  cast(nullif(regexp_extract(text, 'SUNK BY (\d+)MM', 1), '') as double) as sunk_mm, not regexp_matches(text, '\d') as unparsed from {vT} t"""


@query(TAGS_SQL)
def c10_tag_parse(spark, sf):
    return tx.parse_tags(view(spark, sf, "vT")).select("tag_id", "floor_id", "text", "mark", "category_hint", "width_mm", "depth_mm", "diameter_mm", "thickness_mm", "sunk_mm", "unparsed")


@query(f"""
select floor_id, count(*) as n_tags, count(width_mm) as n_sized, count(diameter_mm) as n_round, count(thickness_mm) as n_thick, count(*) filter (where unparsed) as n_unparsed,
  round(avg(case when unparsed then 1.0 else 0.0 end), 3) as unparsed_share from ({TAGS_SQL}) t group by floor_id""")
def l12_tag_report(spark, sf):
    """Which tags carry which size and how many could not be read, per floor."""
    bad = F.when(F.col("unparsed"), 1.0).otherwise(0.0)
    return tx.parse_tags(view(spark, sf, "vT")).groupBy("floor_id").agg(
        F.count("*").alias("n_tags"), F.count("width_mm").alias("n_sized"), F.count("diameter_mm").alias("n_round"), F.count("thickness_mm").alias("n_thick"),
        F.count_if("unparsed").alias("n_unparsed"), F.round(F.avg(bad), 3).alias("unparsed_share"),
    )


@query(r"""select note_id, trim(regexp_replace(replace(regexp_replace(replace(text, chr(92) || 'P', chr(10)), '%%[UuOoKk]', '', 'g'), '%%C', 'Ø'), '[ \t]*\n[ \t]*', chr(10), 'g'), ' ' || chr(9) || chr(10)) as clean_text
from (select note_id, regexp_replace(text, '[ \t]+', ' ', 'g') as text from {vN} n) n""")
def c01_clean(spark, sf):
    return view(spark, sf, "vN").select("note_id", tx.clean(F.col("text")).alias("clean_text"))


@query(r"""
select note_id, round(case when regexp_matches(text, '^\d+''-\d+"$') then cast(regexp_extract(text, '^(\d+)', 1) as double) * 304.8 + cast(regexp_extract(text, '-(\d+)"', 1) as double) * 25.4
  when regexp_matches(text, '^\d+ 1/2"$') then (cast(regexp_extract(text, '^(\d+)', 1) as double) + 0.5) * 25.4 end, 3) as length_mm from {vN} n""")
def c02_length(spark, sf):
    return view(spark, sf, "vN").select("note_id", tx.length_mm(F.col("text")).alias("length_mm"))


@query(r"""
select layer, cast(case when w >= 50 and d >= 50 then w end as double) as width_mm, cast(case when w >= 50 and d >= 50 then d end as double) as depth_mm
from (select layer, cast(nullif(regexp_extract(layer, '(\d+)x(\d+)', 1), '') as double) as w, cast(nullif(regexp_extract(layer, '(\d+)x(\d+)', 2), '') as double) as d
  from (select distinct concat('B-', p_size * 5, 'x', 10 * (p_partkey % 60)) as layer from part) t) t""")
def c11_name_size(spark, sf):
    layers = view(spark, sf, "part").select(F.concat(F.lit("B-"), F.col("p_size") * 5, F.lit("x"), 10 * (F.col("p_partkey") % 60)).alias("layer")).distinct()
    return layers.select("layer", *[c.alias(k) for k, c in tx.size_of_name(F.col("layer")).items()])


@query(r"""
select note_id, cast(nullif(regexp_extract(text, '^(\d+)X(SLB|AS)', 1), '') as double) as width_mm,
  case regexp_extract(text, '^(\d+)X(SLB|AS)', 2) when 'SLB' then 'slab_thickness' when 'AS' then 'layout' end as depth_rule from {vN} n""")
def c12_symbolic_size(spark, sf):
    return view(spark, sf, "vN").select("note_id", *[c.alias(k) for k, c in tx.symbolic_size(F.col("text")).items()])


@query(r"""
select note_id, case note_id % 12 when 0 then concat(note_id % 30, 'TH FLOOR LVL.') when 1 then 'FOUNDATION LVL.' end as level_name,
  case note_id % 12 when 0 then round(cast(concat(3 + note_id % 60, '.', 100 + note_id % 800) as double) * 1000, 1) when 1 then -(1000.0 * (1 + note_id % 9) + 500) end as elevation_mm
from {vN} n""")
def c13_level_hint(spark, sf):
    return view(spark, sf, "vN").select("note_id", *[c.alias(k) for k, c in tx.level_hint(F.col("text")).items()])


@query(r"""
select note_id, length(text) >= 12 and regexp_matches(text, '(?i)^(NOTES?\b|ALL\b|REFER\b|FOR\b|UNLESS\b|\*|\d{1,2}\s*[).:-])') as is_note,
  trim(regexp_replace(regexp_replace(text, '(?i)^NOTES?\s*[:\-]?\s*', ''), '^\s*(?:\d{1,2}\s*[).:-]\s*|\*\s*)', '')) as body
from {vN} n where note_id % 12 in (2, 4, 5, 7, 11)""")
def c14_notes(spark, sf):
    n = view(spark, sf, "vN").where("note_id % 12 in (2, 4, 5, 7, 11)")  # the kinds of text the twin can clean
    return n.select("note_id", tx.is_note(F.col("text")).alias("is_note"), tx.without_note_number(F.col("text")).alias("body"))


@query(r"""
select note_id, contains(text, 'RAMP') as is_ramp, case when contains(text, 'RAMP') then concat('1:', regexp_extract(text, '1:(\d+)', 1)) end as slope,
  case when contains(text, 'RAMP') then regexp_extract(text, '(UP|DN)$', 1) end as direction from {vN} n""")
def c15_ramp(spark, sf):
    return view(spark, sf, "vN").select("note_id", *[c.alias(k) for k, c in tx.ramp(F.col("text")).items()])


@query(r"""
select note_id, contains(text, 'PCC') as is_pcc, cast(nullif(regexp_extract(text, '\) (\d+)MM THK', 1), '') as double) as pcc_thickness_mm,
  cast(nullif(regexp_extract(text, 'THK (\d+) PROJECTION', 1), '') as double) as pcc_projection_mm from {vN} n""")
def c16_lean_concrete(spark, sf):
    return view(spark, sf, "vN").select("note_id", *[c.alias(k) for k, c in tx.lean_concrete(F.col("text")).items()])


@query(r"select note_id, cast(nullif(regexp_extract(text, '(\d+) DEEP', 1), '') as double) as depth_mm from {vN} n")
def c17_depth_note(spark, sf):
    return view(spark, sf, "vN").select("note_id", tx.stated_depth(F.col("text")).alias("depth_mm"))


@query(r"""
select note_id, case note_id % 12 when 9 then concat(200 + 50 * (note_id % 3), 'x400') when 10 then concat('B', note_id % 50, ' Beam NO') when 3 then substr(text, 1) else text end as words
from {vN} n""")
def c18_inline_codes(spark, sf):
    return view(spark, sf, "vN").select("note_id", tx.without_inline_codes(F.col("text")).alias("words"))


@query(f"""
select floor_words, count(*) as n from (
  select doc_id, ({' or '.join(f"contains(lower(text), '{w}')" for w in tx.FLOOR_WORDS)}) and not (regexp_matches(text, '(?i)\\bSCALE\\b|^\\s*1\\s*:\\s*\\d+\\s*$') and not contains(lower(text), 'level') and not contains(lower(text), 'floor')) as floor_words
  from documents where text is not null) t group by floor_words""")
def c19_floor_labels(spark, sf):
    docs = view(spark, sf, "documents").where("text is not null")
    return docs.select(tx.is_floor_label(F.col("text")).alias("floor_words")).groupBy("floor_words").agg(F.count("*").alias("n"))


@query(r"""
select tag_id, case when contains(text, 'SUNK') then 'sunk' else 'other' end as meaning, cast(nullif(regexp_extract(text, 'SUNK BY (\d+)MM', 1), '') as double) as meaning_value_mm,
  starts_with(text, 'INDICATES') as is_legend from {vT} t""")
def c20_legend_meaning(spark, sf):
    t = F.col("text")
    return view(spark, sf, "vT").select("tag_id", *[c.alias(k) for k, c in tx.meaning(t).items()], tx.is_legend_line(t).alias("is_legend"))


@query(r"select floor_id, count(*) filter (where starts_with(text, 'INDICATES')) as n_legend, count(*) as n from {vT} t group by floor_id")
def c21_legend_lines(spark, sf):
    return view(spark, sf, "vT").groupBy("floor_id").agg(F.count_if(tx.is_legend_line(F.col("text"))).alias("n_legend"), F.count("*").alias("n"))


@query(r"""
select p_partkey as cell_id, case p_partkey % 7 when 0 then 'mark' when 1 then 'width' when 2 then 'thickness' when 3 then 'mark' when 4 then 'diameter' when 5 then 'size' end as header,
  case when p_partkey % 3 = 0 then 'footing' when p_partkey % 3 = 1 then 'wall' end as category from part""")
def c22_headers(spark, sf):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    head, title = pick([" Beam No:", "BREADTH", "Thk.", "mark:", "dia", "Size", "remark"]), pick(["Foundation column schedule", "SHEAR WALLS", "list"])
    return view(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), tx.header_name(head).alias("header"), tx.title_category(title).alias("category"))


@query(r"""select cell_id, unnest(list_filter(list_transform(regexp_split_to_array(cell, '[,/;&]| and '), lambda m: trim(m)), lambda m: m <> '')) as mark
from (select p_partkey as cell_id, concat('B', p_size, case p_partkey % 3 when 0 then ', ' when 1 then ' and ' else '/' end, 'B', p_size + 1, case when p_partkey % 2 = 0 then ' & B99;' else '' end) as cell from part) t""")
def c23_split_cells(spark, sf):
    p = view(spark, sf, "part")
    cell = F.expr("concat('B', p_size, case p_partkey % 3 when 0 then ', ' when 1 then ' and ' else '/' end, 'B', p_size + 1, case when p_partkey % 2 = 0 then ' & B99;' else '' end)")
    return p.select(F.col("p_partkey").alias("cell_id"), F.explode(F.filter(F.transform(F.split(cell, r"[,/;&]| and "), lambda m: F.btrim(m)), lambda m: m != "")).alias("mark"))


def _layers(spark, sf):
    counts = view(spark, sf, "vL").groupBy("layer", "entity").agg(F.count("*").alias("n"))
    return counts.groupBy("layer").agg(F.map_from_entries(F.collect_list(F.struct("entity", "n"))).alias("entity_counts"))


_ROLE_CASE = "\n".join(f"when regexp_matches(low, '{p}') then '{r}'" for p, r, _ in rules.ROLES)
_CONF_CASE = "\n".join(f"when regexp_matches(low, '{p}') then '{c}'" for p, _, c in rules.ROLES)
_MOD_LIST = ",\n".join(f"case when regexp_matches(low, '{p}') then '{m}' end" for p, m in rules.MODIFIERS)
LAYERS_SQL = f"""
select layer, coalesce(role, case when n_hatch >= 5 and n_hatch >= 0.5 * n then 'HATCH_GENERIC' else 'UNKNOWN' end) as role,
  coalesce(confidence, case when n_hatch >= 5 and n_hatch >= 0.5 * n then 'low' else 'none' end) as confidence,
  array_to_string(list_filter(mods, lambda m: m is not null and not (m = 'tag_layer' and coalesce(role, '') in ({", ".join(f"'{r}'" for r in rules.STRUCTURAL)}))), ',') as modifiers
from (select layer, n, n_hatch, case {_ROLE_CASE} end as role, case {_CONF_CASE} end as confidence, [{_MOD_LIST}] as mods
  from (select layer, lower(trim(layer)) as low, count(*) as n, count(*) filter (where entity = 'HATCH') as n_hatch from {{vL}} l group by layer) l) l"""


@query(LAYERS_SQL)
def c24_layer_roles(spark, sf):
    return rules.layer_roles(_layers(spark, sf)).select("layer", "role", "confidence", F.array_join("modifiers", ",").alias("modifiers"))


@query(f"""select layer, case role {" ".join(f"when '{k}' then '{v}'" for k, v in rules.TEXT_ROLES.items())} else 'NOTE' end as text_role from ({LAYERS_SQL}) t""")
def c25_text_role(spark, sf):
    return rules.layer_roles(_layers(spark, sf)).select("layer", "text_role")


@query(r"""select n_nationkey, concat(case n_nationkey % 3 when 0 then 'GROUND FLOOR' when 1 then '1ST FLOOR' else 'TERRACE' end, ' LVL.') as floor_name,
  concat(case n_nationkey % 3 when 0 then 'GROUND FLOOR' when 1 then '1ST FLOOR' else 'TERRACE' end, ' LEVEL') as title from nation""")
def c26_floor_names(spark, sf):
    raw = F.element_at(F.array(F.lit("Layout plan at  Ground Floor Level (T1)"), F.lit("1st Flr"), F.lit("LAYOUT AT TERRACE LVL Scale 1:100")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    name = tx.floor_name(raw)
    return view(spark, sf, "nation").select("n_nationkey", name.alias("floor_name"), tx.plan_title(name).alias("title"))


@query(r"""select tag_id, case when text like 'C%-%X%' then regexp_extract(text, '^(C\d+)-', 1) else text end as base, case when text like 'C%-%X%' then regexp_extract(text, '-(\d+X\d+)$', 1) else '' end as stated_size from {vT} t""")
def c27_split_mark(spark, sf):
    return view(spark, sf, "vT").select("tag_id", *[c.alias(k) for k, c in tx.split_mark(F.col("text")).items()])


def _marks(spark, sf):
    w, d, n = F.col("l_quantity") * 10 + 100, F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") * 100.0), F.col("l_suppkey")
    beam = F.concat(tx.mark_text("B", n, "-", ("X", w), ("", d)), F.when(F.col("l_linenumber") == 2, "-INV").otherwise(""))
    return view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), d.alias("d"), n.alias("n"), beam.alias("mark"))


@query("""select l_orderkey, l_linenumber, concat('B', l_suppkey, '-', cast(l_quantity * 10 + 100 as bigint), 'X', case when l_linenumber <> 3 then cast(cast(l_linenumber * 100 as bigint) as varchar) else '?' end,
  case when l_linenumber = 2 then '-INV' else '' end) as mark from lineitem""")
def c28_format_marks(spark, sf):
    return _marks(spark, sf).select("l_orderkey", "l_linenumber", "mark")


@query("""select l_orderkey, l_linenumber, concat('B', l_suppkey) as base, case when l_linenumber <> 3 then l_quantity * 10 + 100 end as width_mm, case when l_linenumber <> 3 then cast(l_linenumber * 100 as double) end as depth_mm,
  l_linenumber = 2 as inverted from lineitem""")
def c29_parse_marks(spark, sf):
    """Reading back what c28 wrote gives the values that went in (none where the mark has a question mark)."""
    return tx.parse_marks(_marks(spark, sf), "mark").select("l_orderkey", "l_linenumber", "base", "width_mm", "depth_mm", "inverted")


@query(r"""select tag_id, case when text like 'C%-%X%' then text else 'none' end as full_mark from {vT} t""")
def c30_full_mark(spark, sf):
    """The stored mark where the drawn one abbreviates it: the drawn is its start, or each word of it is inside."""
    t = view(spark, sf, "vT").withColumn("drawn", F.regexp_extract("text", r"^(C\d+)-", 1)).withColumn("stored", F.col("text"))
    ok = F.col("stored").startswith(F.col("drawn")) | F.forall(F.split("drawn", r"\s+"), lambda w: F.col("stored").contains(w))
    return t.select("tag_id", F.when((F.col("drawn") != "") & ok, F.col("stored")).otherwise("none").alias("full_mark"))


@query("select p_partkey, concat('B', p_size) as c2_id, case when p_partkey % 2 = 0 then 'beam' end as kind from part")
def c31_pairs(spark, sf):
    raw = F.expr("concat('id=B', p_size, case when p_partkey % 2 = 0 then ';kind=beam' else '' end)")
    p = view(spark, sf, "part").select("p_partkey", tx.pairs_of(raw).alias("m"))
    return p.select("p_partkey", F.element_at("m", "id").alias("c2_id"), F.element_at("m", "kind").alias("kind"))


@query("select rect_id, case when rect_id % 3 = 0 then h else w end as b, case when rect_id % 3 = 0 then w else h end as d from {vR} r")
def c32_tagged_size(spark, sf):
    """b x D of an outline in the order of the client's tag, whose sides may be given the other way round."""
    r = view(spark, sf, "vR").withColumn("tag_w", F.when(F.col("rect_id") % 3 == 0, F.col("h"))).withColumn("tag_d", F.when(F.col("rect_id") % 3 == 0, F.col("w")))
    same = (F.least("tag_w", "tag_d") == F.least("w", "h")) & (F.greatest("tag_w", "tag_d") == F.greatest("w", "h"))
    return r.select("rect_id", F.when(same, F.col("tag_w")).otherwise(F.col("w")).alias("b"), F.when(same, F.col("tag_d")).otherwise(F.col("h")).alias("d"))


@query(r"select label_id, case when regexp_matches(label, '^(?:[A-Z]{1,2}\d?|\d{1,3}[A-Z]?|[A-Z]\d{1,2})$') then 0 when length(label) <= 4 then 1 else 2 end as rank from (select p_partkey as label_id, case p_partkey % 4 when 0 then chr(65 + p_size % 26) when 1 then concat(p_size, 'A') when 2 then concat('x', p_size) else p_name end as label from part) t")
def c33_grid_label_rank(spark, sf):
    label = F.expr("case p_partkey % 4 when 0 then chr(65 + p_size % 26) when 1 then concat(p_size, 'A') when 2 then concat('x', p_size) else p_name end")
    return view(spark, sf, "part").select(F.col("p_partkey").alias("label_id"), tx.grid_label_rank(label).alias("rank"))


@query("select p_partkey, concat('C ', cast(round((p_size * 37 + 100) / 25.0) * 25 as bigint), ' x ', cast(round((p_partkey % 900 + 200) / 50.0) * 50 as bigint)) as type_name from part")
def c34_type_names(spark, sf):
    step = lambda c, s: F.round(c / F.lit(s)) * s
    w, d = step(F.col("p_size") * 37 + 100, 25.0), step(F.col("p_partkey") % 900 + 200, 50.0)
    return view(spark, sf, "part").select("p_partkey", F.format_string("C %.0f x %.0f", w, d).alias("type_name"))


@query(r"select tag_id, case when length(text) * 125 * 0.6 <= 0.95 * (x % 1500) then text when text like 'C%-%X%' or text like 'B%(%' then regexp_extract(text, '^([BC]\d+)', 1) else text end as shown from {vT} t")
def c35_short_marks(spark, sf):
    """A mark that is longer than its span is cut to its base."""
    fits = F.length("text") * F.col("text_height") * 0.6 <= 0.95 * (F.col("x") % 1500)
    base = tx.group(F.col("text"), r"^([A-Z]+\d+)[-\s]", 1)
    return view(spark, sf, "vT").select("tag_id", F.when(fits, F.col("text")).otherwise(F.coalesce(base, F.col("text"))).alias("shown"))


@query("""select p_partkey, cast(coalesce(case p_partkey % 9 when 0 then 1.0 when 1 then 304.8 end, case p_size when 1 then 25.4 when 2 then 304.8 when 4 then 1.0 when 5 then 10.0 when 6 then 1000.0 when 10 then 914.4 when 13 then 0.001 when 14 then 100.0 when 15 then 10000.0 when 16 then 100000.0 end,
  case when p_retailprice * 20 > 20000 then 1.0 when p_retailprice * 20 > 2000 then 25.4 else 1000.0 end) as double) as scale_to_mm,
  case when p_partkey % 9 < 2 then 'override' when p_size in (1, 2, 4, 5, 6, 10, 13, 14, 15, 16) then 'insunits' else 'heuristic' end as unit_source,
  case when p_partkey % 9 < 2 or p_size in (1, 2, 4, 5, 6, 10, 13, 14, 15, 16) then 'high' else 'low' end as unit_confidence from part""")
def b01_units(spark, sf):
    override = F.expr("case p_partkey % 9 when 0 then ' MM' when 1 then 'Foot' end")
    u = rules.unit_scale(override, F.col("p_size"), F.col("p_retailprice") * 20, F.lit(0), F.lit(0))
    return view(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in u.items()])


@query("select o_orderkey, cast(case when e <= 0 then 1.0 when e > 20000 then 1.0 when e > 2000 then 25.4 when o_orderkey % 5 > o_orderkey % 3 then 304.8 else 1000.0 end as double) as scale_to_mm from (select o_orderkey, o_totalprice / 10 - 500 as e from orders) t")
def b02_unit_guess(spark, sf):
    u = rules.unit_scale(F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("o_totalprice") / 10 - 500, F.col("o_orderkey") % 5, F.col("o_orderkey") % 3)
    return view(spark, sf, "orders").select("o_orderkey", u["scale_to_mm"].alias("scale_to_mm"))


@query("select p_partkey, cast(case p_partkey % 4 when 0 then 1.0 when 1 then 1000.0 when 2 then 304.8 end as double) as scale_to_mm, p_partkey % 4 = 3 as unknown from part")
def b03_unit_names(spark, sf):
    name = F.element_at(F.array(F.lit(" Millimetres "), F.lit("M"), F.lit("feet"), F.lit("cubit")), (F.col("p_partkey") % 4 + 1).cast("int"))
    s = rules.unit_by_name(name)
    return view(spark, sf, "part").select("p_partkey", s.alias("scale_to_mm"), s.isNull().alias("unknown"))


@query("select floor_id, count(*) filter (where contains(text, chr(39)) or contains(text, chr(34))) as imperial, count(*) filter (where contains(upper(text), 'MM') or contains(upper(text), 'THK')) as metric from {vN} n group by floor_id")
def b04_unit_votes(spark, sf):
    t, up = F.col("text"), F.upper("text")
    return view(spark, sf, "vN").groupBy("floor_id").agg(F.count_if(t.contains("'") | t.contains('"')).alias("imperial"), F.count_if(up.contains("MM") | up.contains("THK")).alias("metric"))


@query(f"select layer, case when modifiers = '' then null else split_part(modifiers, ',', 1) end as modifier from ({LAYERS_SQL}) t")
def b13_first_modifier(spark, sf):
    return rules.layer_roles(_layers(spark, sf)).select("layer", F.try_element_at("modifiers", F.lit(1)).alias("modifier"))


_FOOT = ["FOLD", "RAFT FOLD", "RAFT", "LIFT PIT", "PILE", "PILE CAP", "FOOTING", "SUNK SLAB"]


@query("""select p_partkey, case p_partkey % 8 when 0 then 'fold' when 1 then 'fold' when 2 then 'raft' when 3 then 'pit' when 4 then 'pile' when 5 then 'pilecap' when 7 then 'sunk' else case when p_size >= 2 then 'combined' else 'footing' end end as kind from part""")
def b21_footing_kind(spark, sf):
    t = F.element_at(F.array(*map(F.lit, _FOOT)), (F.col("p_partkey") % 8 + 1).cast("int"))
    has = lambda w: t.rlike(w)
    kind = F.when(has("FOLD"), "fold").when(has("SUNK"), "sunk").when(has("RAFT"), "raft").when(has(r"\bPIT\b"), "pit").when(has("PILE ?CAP"), "pilecap").when(has(r"\bPILES?\b"), "pile").when(F.col("p_size") >= 2, "combined").otherwise("footing")
    return view(spark, sf, "part").select("p_partkey", kind.alias("kind"))


@query("select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'sunk' when l_linenumber = 2 then 'cantilever' else 'flush' end as rule, case when l_linenumber = 1 then -l_quantity when l_linenumber = 2 then case when l_returnflag <> 'N' then -(l_quantity * 10 - 100) end else 0.0 end as top_offset_mm from lineitem")
def b23_panel_level(spark, sf):
    """0, or down by the sunk depth, or (cantilever) by support depth less thickness; null if that is unknown."""
    sunk, support = F.when(F.col("l_linenumber") == 1, F.col("l_quantity")), F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 10)
    rule = F.when(sunk.isNotNull(), "sunk").when(F.col("l_linenumber") == 2, "cantilever").otherwise("flush")
    offset = F.when(rule == "sunk", -sunk).when(rule == "cantilever", -(support - 100)).otherwise(0.0)
    return view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rule.alias("rule"), offset.alias("top_offset_mm"))


@query("select p_partkey, p_name, contains(upper(p_name), 'RING') or contains(upper(p_name), 'WIDGET') as is_shaft from part")
def b24_shafts(spark, sf):
    words = F.array(F.lit("RING"), F.lit("WIDGET"))
    return view(spark, sf, "part").select("p_partkey", "p_name", F.exists(words, lambda w: F.upper("p_name").contains(w)).alias("is_shaft"))


@query("select p_partkey, kind from (select p_partkey, case p_partkey % 4 when 0 then 'column' when 1 then 'beam' when 2 then 'stair' else 'grid' end as kind from part) t where kind in ('column', 'beam')")
def b25_build_switches(spark, sf):
    switches = {"column": True, "beam": True, "stair": False, "grid": False}
    kind = F.element_at(F.array(F.lit("column"), F.lit("beam"), F.lit("stair"), F.lit("grid")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return view(spark, sf, "part").select("p_partkey", kind.alias("kind")).where(F.col("kind").isin([k for k, on in switches.items() if on]))


@query(f"select coalesce(u.layer, a.layer) as layer, coalesce(u.role, a.role) as role, case when u.role is not null then 'profile' else 'auto' end as rule_source from ({LAYERS_SQL}) a full join (select distinct concat('s-cols ', p_size % 2) as layer, 'IGNORE' as role from part union all select 'My Layer', 'BEAM') u on lower(a.layer) = lower(u.layer)")
def i09_overlay_rules(spark, sf):
    auto = rules.layer_roles(_layers(spark, sf))
    user = view(spark, sf, "part").select(F.concat(F.lit("s-cols "), F.col("p_size") % 2).alias("layer"), F.lit("IGNORE").alias("role")).distinct()
    user = user.unionByName(spark.createDataFrame([("My Layer", "BEAM")], "layer string, role string"))
    over = rules.overlay_rules(auto, user)
    return over.join(user.select(F.lower("layer").alias("_l"), F.col("layer").alias("_u")), F.lower("layer") == F.col("_l"), "left").select(F.coalesce("_u", "layer").alias("layer"), "role", "rule_source")


@query(f"select role, confidence, count(*) as n_layers from ({LAYERS_SQL}) t group by role, confidence")
def l07_suggest_profile(spark, sf):
    return rules.layer_roles(_layers(spark, sf)).groupBy("role", "confidence").agg(F.count("*").alias("n_layers"))
