import numpy as np
from pyspark.sql import functions as F

from planlake.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, rest = share * sum(sizes.values()), {}, set(names)
    while rest:
        level = left / sum(w[s] for s in rest)
        over = {s for s in rest if level * w[s] > most * sizes[s]}
        if not over:
            return full | {s: level * w[s] for s in rest}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
        rest -= over
    return full


def test_targets_match_repeated_sharing(spark):
    rng = np.random.default_rng(4)
    for _ in range(4):
        sizes = {None if i == 3 else f"s{i}": int(rng.integers(0, 1000) ** 2) for i in range(9)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_settling_keeps_mass_and_leaves_one_open():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 500, 300).astype(float)
    p, at = mixing.settle(size, np.full(300, 0.37), rng)
    assert ((p == 0) | (p == 1) | (np.arange(300) == at)).all()
    assert abs((p * size).sum() - 0.37 * size.sum()) < 1e-6 * size.sum()


def test_rounding_is_fair():
    size = np.array([10.0, 7.0, 3.0, 1.0, 1.0])
    runs = []
    for i in range(4000):
        p, at = mixing.settle(size, np.full(5, 0.3), np.random.default_rng(i))
        runs.append(p)
    assert np.abs(np.mean(runs, 0) - 0.3).max() < 0.03


def test_every_document_is_taken_with_its_probability(spark):
    """Through the tree's levels, the last one too: small sources, each drawn many times."""
    rows = [(i, f"s{k}", size, 0, k, 0, p, True) for k in range(3000) for i, (size, p) in enumerate([(10, 0.3), (7, 0.3), (3, 0.3), (1, 0.3), (1, 0.3), (4, 0.6)])]
    frame = spark.createDataFrame(rows, mixing._STATE.format(kind="bigint"))
    got = mixing._combine(frame, "bigint", 5, 0, True).groupBy("doc_id").agg({"p": "avg", "open": "max"}).collect()
    for r in got:
        assert not r["max(open)"] and abs(r["avg(p)"] - (0.6 if r["doc_id"] == 5 else 0.3)) < 0.04
    words = mixing._combine(frame, "bigint", 5, 0, True).selectExpr("source", "p * size as w").groupBy("source").sum("w").collect()
    assert all(abs(r[1] - (22 * 0.3 + 4 * 0.6)) < 10 for r in words)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i, "w " * (i % 17), f"s{i % 5}" if i % 5 else "hot", "c") for i in range(500)] + [(None, "a b", None, "c"), (7, None, "s1", "c"), (7, "a b c", "s1", "c"), (7, "a b c", "s1", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by, aim = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
        aim[r["source"]] = r["target"]
    assert all(abs(by[s] - aim[s]) <= 17 for s in by)
    again = sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert again == sorted(map(repr, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r["source"]] = counts.get(r["source"], 0) + len((r["text"] or "").split())
    assert counts == {s: n for s, n in by.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_repeated_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "SPREAD", 7)
    rows = [(None, "a b c", "s", i % 2, "x") for i in range(100)] + [(1, "a b", "t", 3, "y"), (1, "c d", "t", 3, "y"), (2, None, "t", 3, "y"), (None, "", None, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies int, MIX_ROW string").withColumn("nth", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    taken = sum(r["taken"] for r in got if r["source"] == "s")
    assert abs(taken - next(r["target"] for r in got if r["source"] == "s")) < 3
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    assert words == {s: n for s in ("s", "t") if (n := sum(r["taken"] for r in got if r["source"] == s))}
