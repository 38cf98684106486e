import math
import random
from fractions import Fraction

import numpy as np

from planlake.llm import topk


def plain(rows, is_query, k=5):
    good = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in [(i, q) for i, q in good if is_query(i)]:
        scored = sorted(((-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), j) for j, v in good if j != i))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * 4 ** rng.randrange(3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [rng.choice([0.0, 0.5]) for _ in range(8)]) for i in range(60)]  # many ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (404, [1.0, 2.0]), (405, []), (7, rows[7][1]), (450, rows[3][1]), (20, [0.25] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as rank").repartition(5)
    v = topk.usable(frame)
    queries = v.where("vec_id % 10 = 0")
    want = plain(rows, lambda i: i % 10 == 0)
    for bytes_ in (1 << 20, 400):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, queries, pass_bytes=bytes_).collect())
        assert got == want
    assert topk.top_k(v.limit(0), queries).count() == 0 and topk.top_k(v, queries.limit(0)).count() == 0
    two = v.where("vec_id in (10, 30)")
    assert topk.top_k(two, two).count() == 2


def test_large_components(spark):
    rows = [(i, [float(2**30 + i), -float(2**20 * i)]) for i in range(20)] + [(30, [2e13, 0.0]), (31, [-2e13, 1.0]), (32, [1e300, 1e-300]), (33, [-1e308, 1e308]), (34, [2.0**44, 0.5])]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("vec_id in (0, 3, 30, 32, 33)")).collect())
    assert got == plain(rows, lambda i: i in (0, 3, 30, 32, 33))
    small = [(1, [1.0, 1.0]), (2, [2e13, 0.0]), (3, [5.0, 1.0])]
    w = topk.usable(spark.createDataFrame(small, "vec_id long, embedding array<double>"))
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(w, w.where("vec_id = 1")).collect()] == [(2, 256 * 256 * 20 * 10**12), (3, 256 * 256 * 6)]


def test_stops_early():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(2000, 16)) * np.exp(rng.normal(size=(2000, 1)) * 2) * 256)
    shard = topk.Shard(np.arange(2000), x)
    q = x[:4]
    r, c, s = shard.search(np.arange(4), q, np.full(4, -np.inf), 5)
    assert len(r) < 4 * 2000 * 0.5
    assert sum(len(rows) for band in shard.bands for _, rows, _ in band) == np.count_nonzero(x)
    full = q @ x.T
    for i in range(4):
        best = sorted((-full[i, j], j) for j in range(2000) if j != i)[:5]
        assert {j for _, j in best} <= set(c[r == i].tolist())
