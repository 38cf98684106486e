"""The manifest against a plain tree, on any rows."""

import hashlib
import zlib

import duckdb

from planlake.llm import merkle, queries
from pyspark.sql import functions as F


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return digest("".join(map(enc, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))


def tree(nodes):
    """Root and, for each node, what is left and right of it on every level."""
    paths, own, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, at in enumerate(own):
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        level, own = [digest("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [at // 16 for at in own]
    return level[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    root, tops = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for s, (sub, paths), top in zip(order, trees, tops):
        for (_, _, h, r), path in zip(sorted(by[s], key=lambda x: x[:3]), paths):
            path = path + top
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            now = leaf(r, "".join(c.lower() if c.isascii() else c for c in r["text"])) if tampered else h
            for a, z in path:
                now = digest(a + now + z)
            out.append((r["doc_id"], h, sub, root, digest("".join(a + z for a, z in path)), now, now == root))
    return sorted(out, key=repr)


SCHEMA = "text string, n_chars long, source string, lang string, doc_id long, hash string, total int, l string"


def rows_of(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)


def test_manifest_equals_a_plain_tree(spark):
    rows = [("Text É %d" % i if i % 7 else None, i if i % 3 else None, "hot", "en", i, "x", 1, "y") for i in range(300)]
    rows += [("A", 1, s, None, i, "x", 2, "z") for i, s in enumerate([None, "", "a", "é", "=", "Z", *[f"s{k}" for k in range(20)]])]
    rows += [("A long one " * 20_000, 1, "b", "fr", -5, None, None, None), ("twice", 1, None, None, None, "x", 1, "y")] + [("twice", 1, "b", "fr", 9, "x", 1, "y")] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(docs)
    assert got == plain(docs.collect())
    assert {g[6] for g in got} == {True, False}
    assert got == rows_of(docs.repartition(7, "doc_id"))


def test_small_tables(spark):
    one = spark.createDataFrame([("A b", 3, "s", None, 4, "x", 1, "y")], SCHEMA)
    assert rows_of(one) == plain(one.collect()) and rows_of(one.limit(0)) == []
    two = one.unionByName(one.withColumn("source", F.lit(None).cast("string")))
    assert rows_of(two) == plain(two.collect())


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(queries.SQL["op13_merkle_manifest"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in queries.QUERIES["op13_merkle_manifest"](spark, sf).collect()) == want
