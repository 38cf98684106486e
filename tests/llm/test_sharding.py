"""The permutation is one, and can be told without the table; shards against plain counting."""

import zlib
from collections import Counter

import duckdb

from planlake.llm import queries, sharding
from pyspark.sql import functions as F


def test_network_permutes_and_goes_back(spark):
    for n in (0, 1, 2, 3, 7, 64, 65, 1000):
        f = sharding.permutation(spark, n)
        got = spark.range(n).select("id", f.permuted(F.col("id")).alias("p"), f.permuted(f.permuted(F.col("id")), True).alias("back")).collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and all(r["id"] == r["back"] for r in got)
    assert f.permuted(F.lit(1)) is not None and sharding.Feistel(1000, "other").keys() != f.keys()


def test_shuffle_is_even(spark):
    f = sharding.permutation(spark, 8000)
    rows = spark.range(8000).select("id", f.permuted(F.col("id")).alias("p")).collect()
    cells = Counter((r["id"] // 1000, r["p"] % 8) for r in rows)
    assert len(cells) == 64 and sum((c - 125) ** 2 / 125 for c in cells.values()) < 110
    assert sum(r["id"] == r["p"] for r in rows) < 10


def test_shards_of_any_rows(spark, tmp_path):
    texts = ["a", None, "", "é" * 70_000, "a", "a", "B c"] * 9
    rows = [(i // 2 if i % 5 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, rank int")
    got = sharding.sharded(docs).collect()
    sizes = lambda: sorted(((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sizes()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    f = sharding.permutation(spark, len(rows))
    back = spark.createDataFrame([(r["shard"], r["slot"], r["number"]) for r in got], "s int, t long, n long")
    assert back.where(f.number_at(F.col("s"), F.col("t"), 8) != F.col("n")).isEmpty()
    again = sharding.sharded(docs.repartition(5, "text")).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.sharded(docs.limit(0)).collect() == [] and len(sharding.sharded(docs.limit(1)).collect()) == 1


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(queries.SQL["op11_feistel_shards"])
    names = [c[0] for c in cur.description]
    df = queries.QUERIES["op11_feistel_shards"](spark, sf)
    assert sorted(tuple(r[c] for c in names) for r in df.drop("x").collect()) == sorted(cur.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
