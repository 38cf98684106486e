"""Views over the star-schema tables that stand for drawing entities, alike in every SQL engine.

vT: tag texts, vR: axis-aligned outlines, vS: collinear pieces, vN: note texts, vL: layers with entity
counts. They are integers and short texts only, so no engine can round them differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "vT": """
select p_partkey as tag_id, concat('L0', 1 + p_partkey % 4) as floor_id,
 case p_partkey % 6
  when 0 then concat('C', p_partkey % 40, '-', 200 + 50*(p_size % 8), 'X', 300 + 50*(p_partkey % 10))
  when 1 then concat(100 + 25*(p_size % 5), ' THK.')
  when 2 then concat('B', p_partkey % 25, ' (', 200 + 50*(p_size % 3), 'X', 600 + 50*(p_size % 7), '/', 450, ')')
  when 3 then concat('INDICATES SLAB SUNK BY ', 25*(1 + p_size % 6), 'MM.')
  when 4 then p_name
  else concat('C_', 300 + 50*(p_size % 7), 'D') end as text,
 (p_partkey * 131) % 20000 as x, (p_partkey * 977) % 20000 as y, 125 as text_height from {part}""",
    "vR": """
select l_orderkey * 10 + l_linenumber as rect_id, concat('L0', 1 + l_orderkey % 8) as floor_id,
 (l_partkey * 131 + l_linenumber * 17) % 200000 as x0, (l_suppkey * 977 + l_orderkey * 53) % 200000 as y0,
 200 + 10 * cast(l_quantity as bigint) as w, 300 + 100 * l_linenumber as h from {lineitem}""",
    "vS": """
select event_id as seg_id, user_id % 50 as line_no, (event_id * 7919) % 100000 as t1,
 (event_id * 7919) % 100000 + 200 + (event_id * 31) % 1800 as t2 from {events}""",
    "vN": """
select o_orderkey as note_id, concat('L0', 1 + o_orderkey % 4) as floor_id,
 case o_orderkey % 12
  when 0 then concat(o_orderkey % 30, 'TH FLOOR LVL. +', 3 + o_orderkey % 60, '.', 100 + o_orderkey % 800)
  when 1 then concat('FOUNDATION LVL -', 1 + o_orderkey % 9, '.5M')
  when 2 then concat('RAMP 1:', 6 + o_orderkey % 9, case when o_orderkey % 8 = 2 then ' UP' else ' DN' end)
  when 3 then concat('PCC (1:4:8) ', 75 + 25 * (o_orderkey % 4), 'MM THK ', 100, ' PROJECTION')
  when 4 then concat('LIFT PIT ', 1200 + 100 * (o_orderkey % 6), ' DEEP')
  when 5 then concat('NOTE - ', 1 + o_orderkey % 9, ') ALL BEAMS ARE ', 600 + 50 * (o_orderkey % 5), 'MM IN DEPTH U.N.O.')
  when 6 then concat(o_orderkey % 9 + 1, chr(39), '-', o_orderkey % 12, chr(34))
  when 7 then concat(200 + 50 * (o_orderkey % 4), case when o_orderkey % 8 = 3 then 'XSLB THK.' else 'XAS/LAYOUT' end)
  when 8 then concat(o_orderkey % 90 + 10, ' 1/2', chr(34))
  when 9 then concat(chr(123), chr(92), 'H0.7x;', 200 + 50 * (o_orderkey % 3), 'x400', chr(125))
  when 10 then concat('  %%UB', o_orderkey % 50, '%%U', chr(92), 'P Beam', chr(9), ' NO ')
  else o_orderpriority end as text,
 (o_orderkey * 37) % 200000 as x, (o_orderkey * 91) % 200000 as y from {orders}""",
    "vL": """
select concat(case p_partkey % 17
   when 0 then 'Boundary' when 1 then 'S-GRID-IDEN' when 2 then 'S-COLS' when 3 then 'S-BEAM-HDLN' when 4 then 'A-FLOR-IDEN' when 5 then 'A-CUTOUT'
   when 6 then 'S-FND RAFT' when 7 then 'RETAINING WALL' when 8 then 'Stair case' when 9 then 'G-ANNO-TEXT' when 10 then 'COLUMN STOP HATCH'
   when 11 then 'BEAM SCHEDULE' when 12 then 'S-SLAB SUNK' when 13 then 'DEFPOINTS' when 14 then 'EXPANSION JOINT' when 15 then 'PILE CAP' else 'misc' end,
   case when p_partkey % 17 = 0 then '' else concat(' ', p_size % 3) end) as layer,
 case p_partkey % 5 when 0 then 'LINE' when 1 then 'LWPOLYLINE' when 2 then 'HATCH' when 3 then 'TEXT' else 'CIRCLE' end as entity, p_partkey as entity_id from {part}""",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expand(sql: str) -> str:
    """sql with views and table names put in, for an engine that has the tables by name."""
    sql = re.sub(r"\{(v[A-Z])\}", lambda m: f"({VIEWS[m[1]]})", sql)
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in _TABLES else m[0], sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The proxy view of that name, or the table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql})
