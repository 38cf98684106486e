"""The search against brute force, on any rows; the tree on its own."""

import math
import random
import re

import duckdb
import numpy as np

from planlake.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    split = [(d, terms(t)) for d, t in docs]
    N, L = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, t in split:
            if d is None or not t:
                continue
            m = 100 - 90 + (90 * len(t) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in words if x in t)
            if score > 0:
                found.append((-score, d))
        out += [(i, n + 1, d, -s) for n, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], "text string, doc_id long, term string, n int")
    q = spark.createDataFrame([(t, i, 5) for i, t in items], "text string, item_id long, score int")
    return sorted(tuple(r) for r in lexical.search(d, q, **how).collect())


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["É", "über", "日本", "A1"]
    line = lambda n: " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=n))
    docs = [(i, line(rng.randrange(1, 60))) for i in range(400)]
    docs += [(1000 + i, "w1 w2 W3.w4") for i in range(120)] + [(7, "w29 w28"), (7, "w29 w28"), (None, "w1 w1 w1"), (2000, None), (2001, ""), (2002, " -- ")]
    docs += [(3000, ("w5 " * 400_000) + "w33x " * 300_000), (3001, "x" * 3_000_000)]
    items = [(i, line(6)) for i in range(12)] + [(50, "w29 É"), (50, "w28"), (51, None), (52, "unknown"), (None, "w1"), (53, "w1 w2 w3 w4"), (54, "x" * 3_000_000)]
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, pass_bytes=1_000_000) == want
    assert got(spark, [], items) == [] and got(spark, docs, []) == []


def test_subtrees_are_left_out_only_on_proof(monkeypatch):
    """Every node's bound holds for every document below it, and bounds do leave subtrees out."""
    rng = np.random.default_rng(3)
    n = 3000
    size = rng.integers(1, 12, n)
    offs = np.concatenate([[0], np.cumsum(size)])
    term = np.concatenate([np.sort(rng.choice(60, s, replace=False, p=np.arange(60, 0, -1) / 1830)) for s in size])
    tf, m = rng.integers(1, 9, len(term)), rng.integers(10, 500, n)
    tree = lexical.Tree(np.arange(n), m, offs, term, tf)
    assert sorted(tree.ids.tolist()) == list(range(n)) and max(h - a for a, h, c in zip(tree.low, tree.high, tree.children) if not c) <= lexical.BUCKET
    leaves = []
    for asked in ([0, 3, 17], [58, 59], [5]):
        w = np.arange(100, 100 + len(asked))
        score = np.zeros(n, np.int64)
        for t, x in zip(asked, w):
            for i in range(n):
                hit = np.flatnonzero(tree.term[tree.offs[i] : tree.offs[i + 1]] == t)
                if len(hit):
                    score[i] += lexical.gain(x, tree.tf[tree.offs[i] + hit[0]], tree.m[i])
        want = sorted(((int(s), -int(d)) for s, d in zip(score, tree.ids) if s > 0), reverse=True)[:10]
        best, real, seen = [], np.add.at, []
        with monkeypatch.context() as mp:
            mp.setattr(np, "add", type("A", (), {"at": staticmethod(lambda *a: (seen.append(1), real(*a)))}))
            tree.search(np.array(asked), w, best, 10)
        assert sorted(best, reverse=True) == want
        leaves.append(len(seen))
    total = sum(not c for c in tree.children)
    assert min(leaves) < total / 2


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.SQL["op12_lexical_top10"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in queries.QUERIES["op12_lexical_top10"](spark, sf).collect()) == want
