"""Operators on small cases with known answers, and against sequential versions."""

import math
import random
import time

import numpy as np
import pytest

from planlake.functions import diagnostics as dg
from planlake.functions import geom as g
from planlake.operators import arcs, buildplan, extract, faces, intervals as iv, loops, matching as mt, numbering as nb, outlines as ol, reports, reread, spatial as sp, tagging, sweeps
from planlake.plans import catalog
from planlake.sources import drawings as dw, mapping, profiles
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_intervals(spark):
    t = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 20.0), (1, 30.0, 40.0)], "k int, t1 double, t2 double")
    assert rows(iv.merged(t, ["k"]), "t1", "t2", "n_parts") == [(0, 20, 2), (30, 40, 1)]
    c = spark.createDataFrame([(1, 10.0, 20.0), (1, 50.0, 60.0)], "k int, t1 double, t2 double")
    d = spark.createDataFrame([(1, 0.0, 100.0), (2, 0.0, 5.0)], "k int, start double, end double")
    assert rows(iv.complement(c, d, ["k"]), "k", "t1", "t2") == [(1, 0, 10), (1, 20, 50), (1, 60, 100), (2, 0, 5)]
    p = spark.createDataFrame([(1, 0.0, 1000.0), (1, 1300.0, 2000.0)], "k int, t1 double, t2 double")
    assert rows(iv.merged(p, ["k"], 400), "t1", "t2") == [(0, 2000)]
    wall = spark.createDataFrame([(1, 1100.0)], "k int, at double")
    assert rows(iv.merged_between_barriers(p, wall, ["k"], 400), "t1", "t2") == [(0, 1000), (1300, 2000)]


def test_parallel_pairs(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 6000.0), (2, 0, 230.0, 0.0, 6000.0), (3, 0, 3000.0, 0.0, 6000.0)], "id int, b int, offset double, t1 double, t2 double")
    assert rows(iv.parallel_pairs(lines, ["b"], "id", 100, 1500, 300), "id", "b_id", "width") == [(1, 2, 230.0)]


def test_parallel_pairs_meet_by_stretches(spark):
    """Against all pairs, with lines far longer than most; and a key besides the band, so that lines far apart never meet."""
    rng = random.Random(5)
    data = [(i, i % 2, rng.randrange(-4000, 4000), t := rng.randrange(-20000, 20000), t + (rng.randrange(100, 900) if i % 50 else 30000)) for i in range(600)] + [(900, 0, 100, 50, 50), (901, 0, 300, 80, 20), (902, 0, None, 5, 900)]
    lines = spark.createDataFrame(data, "id long, b int, offset long, t1 long, t2 long")
    lap = lambda p, q: min(p[4], q[4]) - max(p[3], q[3])
    full = [d for d in data if d[2] is not None and d[4] >= d[3]]
    for least in (300, 0, -50):
        want = sorted((p[0], q[0], lap(p, q)) for p in full for q in full if p[0] != q[0] and p[1] == q[1] and 100 <= q[2] - p[2] <= 1500 and lap(p, q) >= least)
        p = iv.parallel_pairs(lines, ["b"], "id", 100, 1500, least)
        assert sorted((r["id"], r["b_id"], r["t2"] - r["t1"]) for r in p.collect()) == want
    join = next(x for x in p._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in x)
    assert join.count("_at") >= 2
    placed = iv.parallel_pairs(lines, ["b"], "id", 100, 1500, 300, ["_band", "_at"]).withColumn("n", F.row_number().over(W.partitionBy("b", "_band", "_at", "id").orderBy("score", "b_id")))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # those of the two sides



def test_fill_numbers(spark):
    rng = random.Random(1)
    data = [(g, i, rng.choice([None, None, rng.randrange(1, 40)])) for g in range(5) for i in range(30)]
    got = nb.fill_numbers(spark.createDataFrame(data, "g int, i int, given int"), ["g"], "given", ["i"]).collect()
    for g in range(5):
        used = {x for k, _, x in data if k == g and x}
        free = iter(n for n in range(1, 500) if n not in used)
        want = {i: x or next(free) for k, i, x in data if k == g}
        assert {r["i"]: r["number"] for r in got if r["g"] == g} == want


def test_spatial_joins_match_nested_loops(spark):
    rng = random.Random(2)
    box = lambda i: (i, rng.randrange(3), *(lambda x, y: (x, y, x + rng.randrange(1, 60), y + rng.randrange(1, 60)))(rng.randrange(-200, 200), rng.randrange(-200, 200)))
    a, b = [box(i) for i in range(80)], [box(i) for i in range(80)]
    pts = [(i, rng.randrange(3), rng.randrange(-250, 250), rng.randrange(-250, 250)) for i in range(200)]
    fa, fb = (spark.createDataFrame(x, "id int, f int, x0 int, y0 int, x1 int, y1 int") for x in (a, b))
    fp = spark.createDataFrame(pts, "p int, f int, x int, y int")
    over = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])}
    held = {(p[0], q[0]) for p in pts for q in a if p[1] == q[1] and q[2] - 7 < p[2] < q[4] + 7 and q[3] - 7 < p[3] < q[5] + 7}
    for cell in (10, 33, 1000):
        got = rows(sp.overlaps(fa, fb, ["f"], cell), "id", "b_id")
        assert len(got) == len(set(got)) and set(got) == over
        got = rows(sp.points_in_boxes(fp, fa, ["f"], cell, 7), "p", "id")
        assert len(got) == len(set(got)) and set(got) == held
    plan = sp.overlaps(fa, fb, ["f"], 33)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_greedy_and_ordered_keep_match_sequential(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(9), rng.randrange(15), rng.randrange(15)) for _ in range(90)})
    used_a, used_b, want = set(), set(), []
    for s, a, b in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.append((a, b))
    best = {}
    for s, a, b in pairs:
        best.setdefault((a, b), s)
    pairs = [(s, a, b) for (a, b), s in best.items()]
    frame = spark.createDataFrame(pairs, "score int, a int, b int")
    assert rows(mt.greedy_pairs(frame), "a", "b") == sorted(want)
    clash = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b}
    kept = []
    for i in range(40):
        if not any((k, i) in clash for k in kept):
            kept.append(i)
    out = mt.ordered_keep(spark.range(40), spark.createDataFrame(sorted(clash), "early long, late long"))
    assert sorted(r["id"] for r in out.where("kept").collect()) == kept and out.count() == 40


def test_groups_and_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    assert rows(mt.groups(e), "node", "root") == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    el = spark.createDataFrame([(5, 1), (3, 2), (9, 3), (7, 1)], "id int, floor_no int")
    up = spark.createDataFrame([(5, 3), (3, 9)], "low int, high int")
    assert rows(mt.chain_floors(up, el), "id", "stack") == [(3, 5), (5, 5), (7, 7), (9, 5)]


def test_faces(spark):
    beams = spark.createDataFrame([(1, 0, 0, 6460, 230), (1, 0, 5000, 6460, 5230), (1, 0, 0, 230, 5230), (1, 6230, 0, 6460, 5230)], "f int, x0 int, y0 int, x1 int, y1 int")
    got = faces.panels(beams, ["f"], 1e5, 1e9).collect()
    assert [(r["x1"] - r["x0"], r["y1"] - r["y0"], r["area"]) for r in got] == [(6000, 4770, 6000 * 4770)]
    ring = [(0.0, 0.0), (2000.0, 0.0), (2000.0, 200.0), (200.0, 200.0), (200.0, 1500.0), (0.0, 1500.0)]
    assert sorted((r[2] - r[0], r[3] - r[1]) for r in faces.maximal_legs(ring)[1]) == [(200, 1500), (2000, 200)]


def test_legs_of_other_shapes(spark):
    turn = lambda pts, a: [(x * math.cos(a) - y * math.sin(a) + 700, x * math.sin(a) + y * math.cos(a) - 90) for x, y in pts]
    ell = [(0, 0), (2000, 0), (2000, 200), (200, 200), (200, 1500), (0, 1500)]
    tee = [(0, 0), (3000, 0), (3000, 200), (1600, 200), (1600, 2000), (1400, 2000), (1400, 200), (0, 200)]
    for shape, want in ((ell, [(200, 1500), (200, 2000)]), (tee, [(200, 2000), (200, 3000)])):
        for a in (0.0, 0.3, 1.2, -0.7):
            legs = faces.maximal_legs(turn(shape, a))[1]
            assert sorted(tuple(sorted((round(r[2] - r[0]), round(r[3] - r[1])))) for r in legs) == want
    circle = [(500 * math.cos(i / 5), 500 * math.sin(i / 5)) for i in range(31)]
    stairs = [p for i in range(15) for p in ((i * 100, i * 100), (i * 100 + 100, i * 100))] + [(1500, 1500), (0, 1500)]
    for whole in (circle, stairs, [(0, 0), (900, 0), (900, 200), (0, 200)], [(0, 0), (900, 0), (450, 700)]):
        assert faces.maximal_legs([(float(x), float(y)) for x, y in whole])[1] == []
    rows = [(1, [{"x": float(x), "y": float(y)} for x, y in ell]), (2, [{"x": float(x), "y": float(y)} for x, y in circle]), (3, None), (4, [])]
    got = faces.split_outlines(spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>"), "id").collect()
    assert sorted((r["id"], r["leg"]) for r in got) == [(1, 1), (1, 2), (2, 1)] and [len(r["outline"]) for r in got if r["id"] == 2] == [31]


def test_junctions(spark):
    assert faces.shortened((0, 0, 200, 2500), (-100, 2300, 5600, 2500), 100) == (0, 0, 200, 2300.0)
    assert faces.shortened((0, 0, 200, 2500), (-1000, 1000, 1000, 1200), 100) is None
    legs = [(1, "a", 0, 0, 200, 2500), (2, "a", -100, 2300, 5600, 2500), (3, "a", 9000, 0, 9200, 900), (1, "b", 0, 0, 200, 2500), (4, "a", -1000, 1000, 100, 1200)]
    out = faces.trim_junctions(spark.createDataFrame(legs, "id long, floor string, x0 long, y0 long, x1 long, y1 long"), "id", ["floor"], 1000)
    got = {(r["floor"], r["id"]): (r["x0"], r["y0"], r["x1"], r["y1"], r["trimmed"]) for r in out.collect()}
    assert got == {("a", 1): (0, 0, 200, 2300, True), ("a", 2): (-100, 2300, 5600, 2500, False), ("a", 3): (9000, 0, 9200, 900, False), ("b", 1): (0, 0, 200, 2500, False), ("a", 4): (-1000, 1000, 0, 1200, True)}


def test_starved_elements_are_fed(spark):
    """Three elements, three tags: the greedy pass starves one, a chain of two steps feeds it."""
    near = [(10, 0, 1, 1.0, False), (10, 0, 2, 5.0, False), (11, 0, 2, 1.5, False), (11, 0, 1, 2.0, False), (12, 0, 2, 2.0, False), (11, 0, 3, 9.0, False)]
    assert sorted(mt.shared_out(near).items()) == [(10, 1), (11, 3), (12, 2)]
    assert mt.shared_out([(1, 0, 1, 0.0, True), (2, 0, 1, 4.0, False), (2, 0, 2, 9.0, False), (3, 0, 1, 0.0, True)]) == {1: 1, 3: 1, 2: 2}
    both = near + [(t + 100, k, e + 100, s, w) for t, k, e, s, w in near]
    out = mt.share_tags(spark.createDataFrame(both, "tag long, kind long, element long, score double, inside boolean"))
    assert rows(out, "tag", "element") == [(10, 1), (11, 3), (12, 2), (110, 101), (111, 103), (112, 102)]


def test_long_chains_of_pairs_settle(spark):
    pairs = [(i, i, 2 * i) for i in range(130)] + [(i, i + 1, 2 * i + 1) for i in range(129)]
    got = rows(mt.greedy_pairs(spark.createDataFrame(pairs, "a int, b int, score int").coalesce(1)), "a", "b")
    assert got == [(i, i) for i in range(130)]


def test_pairs_in_turn_match_a_sequential_pass(spark):
    rng = random.Random(12)
    pairs = {(rng.randrange(25), rng.randrange(25)): (rng.randrange(6), rng.random() < 0.8) for _ in range(120)}
    turn = {b: rng.random() for b in range(25)}
    used, want = set(), []
    for b in sorted(turn, key=lambda b: (turn[b], b)):
        best = max(((s, -a, ok) for (a, x), (s, ok) in pairs.items() if x == b and a not in used), default=None)
        if best and best[2]:
            used.add(-best[1])
            want.append((-best[1], b))
    frame = spark.createDataFrame([(a, b, turn[b], s, ok) for (a, b), (s, ok) in pairs.items()], "a int, b int, turn double, score int, ok boolean")
    assert rows(mt.pairs_in_turn(frame), "a", "b") == sorted(want)


def test_table_rows_are_anchored_at_their_first_cell(spark):
    cells = [("t", i, y) for i, y in enumerate((0, 40, 70, 80, 150, 156, 300, 301))] + [("u", 9, 5)]
    got = rows(nb.table_rows(spark.createDataFrame(cells, "t string, i int, y int"), ["t"], "y", 75), "i", "row_no")
    assert got == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (7, 4), (9, 1)]


def test_diagnostics(spark):
    df = spark.range(10)
    f = dg.finding(df, F.col("id") > 6, "WARNING", "TAG_UNPARSED", F.col("id"))
    assert f.count() == 3 and dg.unknown(f).isEmpty() and not dg.verdict(f).first()["ok"]
    with pytest.raises(KeyError):
        dg.finding(df, F.col("id") > 6, "WARNING", "NO_SUCH_CODE", F.col("id"))


def test_ends_snap_along_chains(spark):
    points = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 3.0, 4.0), (3, "a", 6.0, 8.0), (4, "a", 50.0, 0.0), (5, "b", 0.0, 0.0)], "id long, k string, x double, y double")
    got = rows(mt.snapped_points(points, ["k"], 5), "id", "sx", "sy")
    assert got == [(1, 3, 4), (2, 3, 4), (3, 3, 4), (4, 50, 0), (5, 0, 0)]


def test_blocks_of_ordered_passes_are_bounded_and_do_not_matter(spark, monkeypatch):
    """Passes cut into small blocks give what one block gives, and no task gets a larger one."""
    rng = random.Random(4)
    boxes = [(i, rng.randrange(2), x := rng.randrange(3000), y := rng.randrange(3000), x + rng.randrange(120, 700), y + rng.randrange(120, 300)) for i in range(220)]
    frame = spark.createDataFrame(boxes, "id long, f int, x0 long, y0 long, x1 long, y1 long")
    cols = ("f", "id", "x0", "y0", "x1", "y1", "trimmed")
    seen, real = [], mt._blocked
    monkeypatch.setattr(mt, "_blocked", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(mt.Rounds, "drop", lambda *a: None)
    assert rows(faces.trim_junctions(frame, "id", ["f"], 500, size=60), *cols) == rows(faces.trim_junctions(frame, "id", ["f"], 500), *cols)
    small, whole = ({(r["f"], r["_block"]): r["n"] for r in t.groupBy("f", "_block").agg(F.count("*").alias("n")).collect()} for t in seen)
    assert len(whole) == 2 and len(small) > 6 and max(small.values()) <= 3 * 60
    clash = sorted({tuple(sorted(rng.sample(range(90), 2))) for _ in range(400)})
    c = spark.createDataFrame(clash, "early long, late long")
    assert rows(mt.ordered_keep(spark.range(90), c, 40), "id", "kept") == rows(mt.ordered_keep(spark.range(90), c), "id", "kept")
    pairs = {(rng.randrange(60), rng.randrange(60)): (rng.randrange(6), rng.random() < 0.8) for _ in range(500)}
    p = spark.createDataFrame([(b % 2, a * 2 + b % 2, b, rng.random() if False else (b * 7919) % 61, s, ok) for (a, b), (s, ok) in pairs.items()], "g int, a int, b int, turn int, score int, ok boolean")
    assert rows(mt.pairs_in_turn(p, ["g"], 30), "a", "b") == rows(mt.pairs_in_turn(p), "a", "b")


def test_groups_beyond_one_task(spark):
    rng = random.Random(6)
    e = spark.createDataFrame([(a, a + 1) for a in range(0, 200) if a % 9] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)], "a int, b int")
    assert rows(mt.groups(e, 10), "node", "root") == rows(mt.groups(e), "node", "root")
    named = e.selectExpr("struct(a % 3 as k, a as id) a", "struct(a % 3 as k, b as id) b")
    assert sorted(map(str, mt.groups(named, 10).collect())) == sorted(map(str, mt.groups(named).collect()))


def test_faces_of_loose_lines(spark):
    """Gaps close, crossings and holes are found, loose ends and bridges do not matter, groups stay apart."""
    square = lambda x, y, a: [(x, y, x + a, y), (x + a, y, x + a, y + a), (x + a, y + a, x, y + a), (x, y + a, x, y)]
    gap = [(0, 0, 1000, 0), (1000, 0.6, 1000, 1000), (1000, 1000, 0, 1000), (0.4, 999.5, 0, 0)]
    crossed = square(0, 0, 600) + [(0, 0, 600, 600), (0, 600, 600, 0), (600, 600, 900, 900)]
    ring = square(0, 0, 1000) + square(300, 300, 200) + square(350, 350, 50) + [(1000, 500, 1400, 500), (0, 0, 300, 300)]
    overlaid = square(0, 0, 500) + [(200, 0, 800, 0), (800, 0, 800, 500), (800, 500, 500, 500)]
    apart = square(0, 0, 1000) + square(300, 300, 200) + square(2000, 0, 100)
    turned = [tuple(round(v * math.cos(0.4) - w * math.sin(0.4) if k % 2 == 0 else u * math.sin(0.4) + v * math.cos(0.4), 6) for k, (u, v, w) in enumerate(((0, l[0], l[1]), (l[0], l[1], 0), (0, l[2], l[3]), (l[2], l[3], 0)))) for l in square(0, 0, 8000) + [(4000, -5, 4000, 8005)]]  # noqa: E741
    soups = {"gap": gap, "crossed": crossed, "ring": ring, "overlaid": overlaid, "apart": apart, "turned": turned, "none": [(0, 0, 5, 0), (9, 9, 9, 9)]}
    lines, n = [], 0
    for k, soup in soups.items():
        for line in soup:
            lines.append((n, k, *map(float, line)))
            n += 1
    out = loops.faces(spark.createDataFrame(lines, "id long, k string, x0 double, y0 double, x1 double, y1 double"), ["k"], 1.0, 700).collect()
    got = {}
    for r in out:
        got.setdefault(r["k"], []).append((round(r["area"]), len(r["ring"]), len(r["holes"])))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["gap"] == [(10**6, 4, 0)]
    assert got["crossed"] == [(90000, 3, 0)] * 4
    assert got["overlaid"] == [(150000, 4, 0), (250000, 4, 0)]
    assert got["apart"] == [(10000, 4, 0), (40000, 4, 0), (960000, 4, 1)]
    assert [a for a, _, _ in got["ring"]] == [2500, 37500, 960000]
    assert [(abs(a - 32e6) < 2e4, n) for a, n, _ in got["turned"]] == [(True, 4)] * 2
    assert "none" not in got
    hole = next(r for r in out if r["k"] == "apart" and r["holes"])
    assert len(hole["lines"]) == 8 and {(p["x"], p["y"]) for p in hole["holes"][0]} == {(300, 300), (500, 300), (500, 500), (300, 500)}


def test_shared_areas_of_turned_and_hollowed_outlines():
    turn = lambda pts, a, dx=0, dy=0: [(x * math.cos(a) - y * math.sin(a) + dx, x * math.sin(a) + y * math.cos(a) + dy) for x, y in pts]
    square = [(-100.0, -100.0), (100.0, -100.0), (100.0, 100.0), (-100.0, 100.0)]
    ell = [(0.0, 0.0), (300.0, 0.0), (300.0, 100.0), (100.0, 100.0), (100.0, 300.0), (0.0, 300.0)]
    # a square and itself turned by 45 degrees share a regular octagon of inradius 100; by 30: eight triangles less
    assert math.isclose(ol.shared_area(square, turn(square, math.pi / 4)), 8 * 100**2 * math.tan(math.pi / 8))
    h = lambda a: 200 / (1 + math.cos(a) + math.sin(a))
    assert math.isclose(ol.shared_area(square, turn(square, math.pi / 6)), 40000 - 4 * h(math.pi / 6) ** 2 * math.sin(math.pi / 6) * math.cos(math.pi / 6) / 2)
    for a in (0.0, math.pi / 6, 2.0):
        for flip in (1, -1):
            at = lambda pts: turn(pts, a, 1e6, -3e5)[::flip]  # noqa: B023, E731
            assert math.isclose(ol.shared_area(at(ell), at(ell)), 50000, rel_tol=1e-6)
            assert math.isclose(ol.shared_area(at(ell), at([(50.0, 50.0), (250.0, 50.0), (250.0, 250.0), (50.0, 250.0)])), 50 * 200 + 50 * 150, rel_tol=1e-6)
            assert ol.shared_area(at(ell), at([(110.0, 110.0), (300.0, 110.0), (300.0, 300.0)])) < 1e-3


def test_outlines_of_a_floor(spark):
    p = lambda *pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    box = lambda x, y, a, b: p((x, y), (x + a, y), (x + a, y + b), (x, y + b))
    turned = lambda a, by=0.0: p(*[(5000 + by + a * math.cos(t), a * math.sin(t)) for t in (0.5, 0.5 + math.pi / 2, 0.5 + math.pi, 0.5 + 1.5 * math.pi)])
    rows = [
        ("a", "polygon", "L", "F", box(0, 0, 300, 600)), ("b", "hatch", "H", "F", box(4, 0, 300, 600)), ("c", "generic_hatch", "H", "F", box(0, 0, 300, 600)), ("d", "generic_hatch", "H", "F", box(1500, 0, 300, 300)),
        ("e", "polyline", "L", "F", p((1000, 0), (1300, 0), (1300, 300), (1000, 300), (1000, 40))), ("f", "polyline", "L", "F", p((2000, 0), (2300, 0), (2300, 300), (2000, 300), (2000, 90))), ("g", "line", "L", "F", p((2000, 90), (2000, 0))),
        ("h", "polygon", "L", "F", turned(300)), ("i", "solid", "L", "F", turned(300, 20)), ("j", "solid", "L", "F", turned(300, 900)),
        *((f"k{i}", "line", "K", f, p(*[((-50, -50), (1350, -50), (1350, 700), (-50, 700), (-50, -50))[i + j] for j in (0, 1)])) for i in range(4) for f in "FG"), ("l", "polygon", "L", "F", box(0, 9000, 20, 600)), ("m", None, "L", "F", box(0, 0, 9, 9)), ("n", "polygon", "L", "F", None), ("o", "line", "L", "F", []),
        ("a", "polygon", "L", "G", box(0, 0, 300, 600)), ("b", "solid", "L", "G", box(100, 100, 100, 400)),
    ]
    t = spark.createDataFrame(rows, f"handle string, kind string, layer string, floor string, ring array<struct<x:double,y:double>>")
    got = sorted((r["floor"], r["source_kind"], *r["handles"], "+", *r["merged"]) for r in ol.collected(t, ["floor"], 90, 3000, 20000, 5e6).collect())
    assert got == [("F", "lines", "f", "g", "+"), ("F", "polygon", "a", "+", "b", "c"), ("F", "polygon", "h", "+", "i"), ("F", "polyline", "e", "+"), ("F", "solid", "j", "+"), ("G", "lines", "k0", "k1", "k2", "k3", "+"), ("G", "polygon", "a", "+", "b")]
    assert [r["element_id"] for r in ol.closed_by_hand(t, 50, 1, F.col("floor")).collect()] == ["e"]
    assert ol.collected(t.limit(0), ["floor"], 90, 3000, 20000, 5e6).isEmpty()


def test_arcs_of_known_circles(spark):
    at = lambda r, *angles, x=0.0, y=0.0: [(x + r * math.cos(math.radians(a)), y + r * math.sin(math.radians(a))) for a in angles]
    quarter = [(0.0, 0.0), *at(100, 0, 30, 60, 90)]
    pts, bulges = arcs.with_bulges(quarter, [(0, 0, 100)], 0.1)
    assert pts == [quarter[0], quarter[1], quarter[4]] and [round(b, 9) for b in bulges] == [0, round(math.tan(math.pi / 8), 9), 0]
    for k in range(5):  # wherever the ring begins
        p, b = arcs.with_bulges(quarter[k:] + quarter[:k], [(0, 0, 100)], 0.1)
        assert set(p) == set(pts) and sorted(b) == sorted(bulges)
    back, b = arcs.with_bulges(quarter[::-1], [(0, 0, 100)], 0.1)
    assert sorted(round(x, 9) for x in b) == [round(-math.tan(math.pi / 8), 9), 0, 0]
    long = [(0.0, 0.0), *at(100, *range(0, 271, 30))]
    assert math.isclose(max(arcs.with_bulges(long, [(0, 0, 100)], 0.1)[1]), math.tan(math.radians(270) / 4))
    full = at(50, *range(0, 360, 20), x=7, y=9)
    assert arcs.with_bulges(full, [(7, 9, 50)], 0.1) == ([full[0], full[9]], [1.0, 1.0])
    assert arcs.with_bulges(full[::-1], [(7, 9, 50)], 0.1)[1] == [-1.0, -1.0]
    two = [*at(100, -60, 0, 60), *at(100, 120, 180, 240, x=0)]
    assert arcs.with_bulges(two, [(0, 0, 100)], 0.1)[1] == [1.0, 1.0]
    lens = [*at(100, -40, 0, 40), *at(100, 140, 180, 220, x=400)]
    assert [round(b, 6) for b in arcs.with_bulges(lens, [(0, 0, 100), (400, 0, 100)], 0.1)[1]] == [round(math.tan(math.radians(20)), 6), 0, round(math.tan(math.radians(20)), 6), 0]
    assert arcs.with_bulges(quarter, [], 0.1) == (quarter, [0.0] * 5) and arcs.with_bulges([], [(0, 0, 1)], 1) == ([], [])
    t = spark.createDataFrame([(1, None, [(0.0, 0.0, 1.0)]), (2, quarter, None)], "id int, ring array<struct<x:double,y:double>>, circles array<struct<x:double,y:double,r:double>>")
    assert sorted((r["id"], r["ring"] and len(r["ring"]), r["bulges"]) for r in arcs.fitted(t, 1).collect()) == [(1, None, None), (2, 5, [0.0] * 5)]


def test_points_inside_hollowed_outlines(spark):
    ring = lambda *pts: [(float(x), float(y)) for x, y in pts]
    shapes = [
        ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((0, 0), (100, 0), (100, 10), (10, 10), (10, 100), (0, 100)), ring((0, 0), (100, 0), (100, 100), (90, 100), (90, 10), (30, 10), (30, 100), (0, 100)),
        ring((0, 0), (100, 0), (100, 60), (90, 60), (90, 50), (80, 50), (80, 10), (10, 10), (10, 100), (0, 100)),
    ]
    t = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(shapes)], "id int, ring array<struct<x:double,y:double>>").withColumn("p", g.inside_point(F.col("ring")))
    got = {r["id"]: tuple(r["p"]) for r in t.collect()}
    assert got[0] == (5, 5) and got[1] == (5, 50) and got[2] == (15, 50) and t.where(~g.holds(F.col("ring"), F.col("p.x"), F.col("p.y"))).isEmpty()


def test_edge_pairs_in_small_blocks(spark):
    rng = random.Random(8)
    pairs = [(0, a, b, t1 := rng.randrange(50), t1 + rng.randrange(0, 40), rng.randrange(9)) for a in range(12) for b in range(12, 20) if rng.random() < 0.6]
    t = spark.createDataFrame(pairs, "k int, a int, b int, t1 int, t2 int, score int")
    given, want = {}, []
    for _, a, b, t1, t2, s in sorted(pairs, key=lambda p: (p[5], p[1], p[2])):
        if t2 > t1 and all(sum(max(0, min(z, t2) - max(x, t1)) for x, z in given.get(e, [])) <= 0.5 * (t2 - t1) for e in (a, b)):
            for e in (a, b):
                given.setdefault(e, []).append((t1, t2))
            want.append((a, b))
    assert rows(mt.edge_pairs(t, ["k"]), "a", "b") == rows(mt.edge_pairs(t, ["k"], size=9), "a", "b") == sorted(want)


def test_entities_are_read_with_their_schema(spark, tmp_path):
    pts = "array(named_struct('x', 1.0D, 'y', 2.0D))"
    spark.sql(f"select 'd' drawing_id, 'p' prim_id, 'line' kind, '0' layer, 'h' handle, 'LINE' dxftype, {pts} pts, false closed").write.parquet(str(tmp_path / "e"))
    got = dw.read_entities(spark, str(tmp_path / "e"))
    assert got.columns == [c.split()[0] for c in dw.ENTITIES.split(", ")] and got.first()["pts"][0]["y"] == 2.0 and got.first()["block_layers"] is None


def test_profiles_are_saved_and_loaded(spark):
    text = """{"name": "p", "units_override": "mm", "layers": {"S-COLS": {"role": "COLUMN", "text_role": "COLUMN_TAG", "confidence": "high", "modifiers": ["stop"]}},
      "tolerances": {"ring_close": 75.0}, "size_sources": {"column": "outline"}}"""
    p = profiles.load_profile(text)
    assert p.tolerances.ring_close == 75 and p.tolerances.grid_ref == 600 and p.size_sources.column == "outline" and p.size_sources.beam == "tag"
    assert profiles.load_profile(profiles.save_profile(p)) == p and [tuple(r) for r in p.rules(spark).collect()] == [("S-COLS", "COLUMN", "COLUMN_TAG", "high", ["stop"])]
    for bad in ('{"nam": 1}', '{"tolerances": {"x": 1}}', '{"size_sources": {"beam": "guess"}}'):
        with pytest.raises(ValueError):
            profiles.load_profile(bad)


def test_build_plan_of_a_small_drawing(spark):
    """Levels, the fan-out over them, sizes that are missing, a round column, and a drawing without levels."""
    place = "drawing string, element_id string, floor_id string, cx double, cy double"
    columns = spark.createDataFrame(
        [("a", "c1", "F1", 10.0, 20.0, "rect", 301.0, 448.0, None), ("a", "c2", "F1", 0.0, 0.0, "circle", None, None, 512.5), ("a", "c3", "F2", 0.0, 0.0, "rect", 300.0, None, None), ("b", "c4", "F1", 0.0, 0.0, "rect", 300.0, 300.0, None)],
        f"{place}, shape string, width_mm double, depth_mm double, diameter_mm double",
    )
    piles = spark.createDataFrame([("a", "p1", "F1", 1.0, 2.0, 600.0), ("a", "p2", "F1", 1.0, 2.0, None)], f"{place}, diameter_mm double")
    levels = spark.createDataFrame([("a", "L1", 0.0, "F1"), ("a", "L2", 3000.0, "F1"), ("a", "L3", 6000.0, "F2")], "drawing string, level_id string, elevation_mm double, floor_id string")
    floors = spark.createDataFrame([("a", "F1", 100.0, 0.0), ("a", "F2", 0.0, 0.0), ("a", "F3", 0.0, 0.0), ("b", "F1", 0.0, 0.0)], "drawing string, floor_id string, ox double, oy double")
    acts, found = buildplan.build_plan({"columns": columns, "piles": piles}, levels, floors, mapping.Mapping(), ["drawing"])
    rows = {r["action_id"]: r for r in acts.collect()}
    assert sorted(rows) == ["c1@L1", "c1@L2", "c2@L1", "c2@L2", "p1"]
    c = rows["c1@L2"]
    assert (c["type_name"], c["params"], c["top_level_id"], c["points"][0]["x"]) == ("300 x 450mm", {"b": 300.0, "h": 450.0}, "L3", 110.0)
    assert rows["c2@L1"]["type_name"] == "510mm" and rows["p1"]["level_id"] == "L1"  # 102.5 steps: the even one
    got = sorted((r["code"], r["element_id"] or r["floor_id"]) for r in found.collect())
    assert got == [("REVIT_COLUMN_NO_TOP", "c3"), ("REVIT_FLOOR_NO_LEVEL", "F3"), ("REVIT_NO_LEVELS", "b")]
    types = {(r["type_name"], r["n"]) for r in buildplan.types_to_create(acts, ["drawing"]).collect()}
    assert types == {("300 x 450mm", 2), ("510mm", 2), ("600mm", 1)}
    none, nothing = buildplan.build_plan({"columns": columns.limit(0)}, levels.limit(0), floors.limit(0), mapping.Mapping(), ["drawing"])
    assert none.count() == 0 and nothing.count() == 0


def test_mappings_are_loaded_and_refused(spark):
    usual = mapping.load_mapping("")
    assert usual == mapping.Mapping() == mapping.load_mapping(mapping.save_mapping(usual))
    m = mapping.load_mapping('{"beam": {"family": "X"}, "build": {"walls": false}, "shaft_from": ["PIT"]}')
    assert m.rules["beam"].family == "X" and m.rules["beam"].width_param == "b" and not m.build["walls"] and m.build["beams"] and m.shaft_from == ("PIT",)
    for bad in ('{"beem": {}}', '{"beam": {"famly": "X"}}', '{"build": {"roofs": true}}', '{"round_sizes_to_mm": 0}'):
        with pytest.raises(ValueError):
            mapping.load_mapping(bad)
    v = {"w": F.lit(300.0), "d": F.lit(None).cast("double")}
    texts = ["{w:.0f} x {d:.0f}", "{w}", "{z}", "{z:.0f}", "{w", "100%", "{w:.1f}{{}}"]
    got = spark.range(1).select(*[buildplan.type_text(t, v).alias(str(i)) for i, t in enumerate(texts)]).first()
    assert list(got) == ["300 x 0", "300.0", "?", "{z:.0f}", "{w", "100%", "300.0{}"]


def test_template_drawings_are_read_again(spark):
    """Two floors and an elevation: ids, hand-drawn rows, marks by id and by place, circles, a turned beam, lean concrete, cut-outs, grids, levels."""
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    turned = [(20000 + x * math.cos(math.pi / 6) - y * math.sin(math.pi / 6), 20000 + x * math.sin(math.pi / 6) + y * math.cos(math.pi / 6)) for x, y in box(-2000, -150, 2000, 150)]
    L, n = reread.LAYERS, iter(range(1000))
    row = lambda key, kind, pts, text=None, identity=None, radius=None, height=None: ("d", f"H{next(n):03d}", L.get(key, key), kind, [tuple(map(float, p)) for p in pts], radius, text, height, 0.0, identity)
    data = [
        row("boundary", "polygon", box(0, 0, 50000, 50000), identity="floor=F1;name=GROUND"), row("origin", "point", [(1000, 1000)]), row("text", "text", [(5, 5)], "PLAN - FIRST LEVEL", height=500.0), row("text", "text", [(5, 5)], " 1) CLEAR COVER 40", "kind=note", height=200.0),
        row("boundary", "polygon", box(60000, 0, 110000, 50000)), row("text", "text", [(60005, 5)], "PLAN - FIRST LEVEL", height=500.0),
        row("boundary", "polygon", box(200000, 0, 230000, 50000)), row("level", "line", [(201000, 0), (210000, 0)], identity="plan=F1"), row("level", "line", [(201000, 3000), (210000, 3000)]), row("level_mark", "text", [(201500, 3010)], "ROOF"),
        row("column", "polygon", box(5000, 5000, 5300, 5900), identity="id=C7;stack=1"), row("column_mark", "text", [(9000, 9000)], "C12", "id=C7;mark=C12-300X900"),
        row("column", "polygon", box(7000, 5000, 7300, 5900)), row("column_mark", "text", [(7200, 5950)], "C13-300X900"), row("column", "circle", [(65000, 5000)], radius=300.0, identity="id=C8"),
        row("column_mark", "text", [(40000, 40000)], "C99"), row("beam", "polygon", turned, identity="id=B1"), row("beam_mark", "text", [(20000, 20000)], "B1-300X600"),
        row("slab", "polygon", box(10000, 10000, 30000, 30000), identity="id=S1"), row("slab", "polygon", box(12000, 12000, 16000, 16000), identity="id=S2"), row("slab_mark", "text", [(14000, 14000)], "CS2-200THK"), row("cutout", "polygon", box(13000, 13000, 13500, 13500), identity="id=O1;label=LIFT"),
        row("footing", "polygon", box(31000, 31000, 33000, 33000), identity="id=F1"), row("footing_mark", "text", [(31500, 31500)], "PC1-900THK"), row("pcc", "polygon", box(30900, 30900, 33100, 33100), identity="id=F1;thk=75"), row("pile", "circle", [(31500, 31500)], radius=250.0, identity="id=P1;cap=F1"),
        row("grid", "line", [(5000, 500), (5000, 49000)]), row("grid_mark", "text", [(5000, 300)], " A "), row("nobody's layer", "polygon", box(0, 0, 5, 5)), row("column", "polygon", box(0, 0, 0, 9)), row("column", "polygon", box(150000, 0, 150300, 300)),
    ]
    kind = "drawing string, handle string, layer string, kind string, pts array<struct<x:double,y:double>>, radius double, text string, text_height double, rotation double, identity string"
    r = reread.read_template(spark.createDataFrame(data, kind), ["drawing"])
    floors = {f["floor_id"]: f for f in r.floors.collect()}
    assert sorted(floors) == ["F1", "L02"] and (floors["F1"]["ox"], floors["F1"]["name"], floors["F1"]["notes"]) == (1000, "GROUND", ["CLEAR COVER 40"])
    assert (floors["L02"]["ox"], floors["L02"]["name"], floors["L02"]["title"]) == (60000, "FIRST LVL.", "PLAN - FIRST LEVEL")
    e = {x["element_id"]: x for x in r.elements.collect()}
    assert sorted(e) == ["B1", "C7", "C8", "F1", "F1-CNEW-H012", "O1", "P1", "S1", "S2"]
    assert (e["C7"]["mark"], e["C7"]["width_mm"], e["C7"]["depth_mm"], e["C7"]["cx"]) == ("C12-300X900", 300, 900, 4150)
    assert (e["F1-CNEW-H012"]["mark"], e["F1-CNEW-H012"]["is_new"]) == ("C13-300X900", True)
    assert (e["C8"]["floor_id"], e["C8"]["shape"], e["C8"]["diameter"], e["C8"]["cx"], e["C8"]["mark"]) == ("L02", "circle", 600, 5000, None)
    b = e["B1"]
    assert (b["shape"], b["width"], b["depth"], b["rotation"], b["width_mm"]) == ("rect", 300, 4000, 30, 300) and math.isclose(b["start"]["x"], 19000 - 2000 * math.cos(math.pi / 6), abs_tol=0.02)
    assert (e["S2"]["kind"], e["S2"]["thickness_mm"], e["S1"]["kind"], e["O1"]["panel_id"], e["O1"]["label"]) == ("cantilever", 200, "cantilever", "S2", "LIFT")
    assert (e["F1"]["kind"], e["F1"]["lean_mm"], e["F1"]["lean_outline"][0]["x"], e["P1"]["pilecap_id"], e["P1"]["diameter"]) == ("pilecap", 75, 29900, "F1", 500)
    assert [(x["label"], x["axis"], x["offset_mm"]) for x in r.grids.collect()] == [("A", "X", 4000)]
    assert sorted((x["level_id"], x["name"], x["elevation_mm"], x["floor_to_floor_mm"], x["plan_floor_id"]) for x in r.levels.collect()) == [("LV00", "ROOF", 0, 3000, "F1"), ("LV01", "ROOF", 3000, None, None)]
    found = sorted((x["code"], x["floor_id"] or "", x["element_id"] or "") for x in r.findings.collect())
    assert found == [("RT_FLOOR_NO_ORIGIN", "L02", ""), ("RT_LEVELS_RELATIVE", "", "d"), ("RT_NO_ID", "", "H030"), ("RT_NO_ID", "F1", "H012"), ("RT_ORPHAN_MARK", "F1", "H015")]
    empty = reread.read_template(spark.createDataFrame([], kind), ["drawing"])
    assert empty.elements.count() == empty.findings.count() == empty.levels.count() == 0


def test_marks_take_the_nearest_free_size(spark):
    """Contested sizes against a plain greedy pass; texts that are turned, without a place or alike."""
    r = random.Random(4)
    kind = "drawing int, id long, text string, x double, y double, text_height double, rotation double"
    data = [(r.randrange(2), i, r.choice(["C%d" % (i + 1), "B%d" % (i + 1), "300X600", "150 THK", "C5-200X300", "", None]), float(r.randrange(0, 3000, 50)), float(r.randrange(0, 1000, 50)), float(r.choice([100, 125])), float(r.choice([0, 3, 178, 90]))) for i in range(400)]
    data += [(0, 1000, "C1", None, None, 125.0, 0.0), (0, 1001, "300X600", 0.0, 0.0, None, None)]
    got = {x["id"]: x for x in tagging.paired_tags(spark.createDataFrame(data, kind), ["drawing"], factor=2).collect()}
    bare, sizes = [d for d in data if d[2] and d[2][0] in "CB" and "-" not in d[2] and d[3] is not None], [d for d in data if d[2] in ("300X600", "150 THK") and d[6] is not None]
    turn = lambda a, b: min((a - b) % 180, (b - a) % 180)
    pairs = sorted((round(math.hypot(m[3] - s[3], m[4] - s[4]), 6), m[1], s[1]) for m in bare for s in sizes if m[0] == s[0] and turn(m[6], s[6]) <= 5 and math.hypot(m[3] - s[3], m[4] - s[4]) <= 2 * m[5])
    taken, used = {}, set()
    for _d, m, s in pairs:
        if m not in taken and s not in used:
            taken[m] = s
            used.add(s)
    assert {k: x["size_id"] for k, x in got.items() if x["size_id"] is not None} == taken and len(taken) > 20 and len(pairs) > 2 * len(taken)
    assert set(got) == {d[1] for d in data} - used
    m, s = next(iter(taken.items()))
    assert got[m]["kind"] == "size" and got[m]["text"] == f"{data[m][2]} | {data[s][2]}" and got[m]["x"] == (data[m][3] + data[s][3]) / 2


def test_reports(spark):
    """Headers that are broken or there twice, hints that share words equally or not at all, floors without elements, the first findings in order."""
    kind = "drawing string, handle string, kind string, layer string, attribs map<string,string>"
    e = spark.createDataFrame([("a", "2", "header", "0", {"$INSUNITS": "6"}), ("a", "1", "header", "0", {"$INSUNITS": "4", "$EXTMIN": "1,2", "$EXTMAX": "x"}), ("a", "3", "line", "L", None), ("b", "1", "text", None, None), ("c", None, "header", "0", {})], kind)
    got = {r["drawing"]: (r["units_code"], r["x0"], r["y0"], r["x1"], r["n_entities"], r["n_layers"]) for r in reports.headers(e, ["drawing"]).collect()}
    assert got == {"a": (4, 1, 2, None, 1, 1), "b": (None, None, None, None, 1, 0), "c": (None, None, None, None, 0, 0)}
    floors = spark.createDataFrame([("d", "1", "Second Floor Plan", None), ("d", "2", "Terrace level", None), ("d", "3", "2ND LVL.", 3000.0), ("d", "4", None, None)], "drawing string, floor_id string, name string, elevation_mm double")
    hints = spark.createDataFrame([("d", 5, "SECOND FLOOR", 6000.0, "t5"), ("d", 4, "SECOND LVL. AT", 5000.0, "t4"), ("x", 1, "TERRACE", 9000.0, "t1")], "drawing string, hint_id int, name string, elevation_mm double, text string")
    rows_ = {r["floor_id"]: (r["elevation_mm"], r["note"]) for r in reports.level_template(floors, hints, ["drawing"]).collect()}
    assert rows_ == {"1": (5000, "from text 't4', to be confirmed"), "2": (None, "elevation_mm is to be filled in"), "3": (3000, ""), "4": (None, "elevation_mm is to be filled in")}
    f = spark.createDataFrame([("INFO", "RT_NO_ID", "F1", "1"), ("WARNING", "RT_MOVED", "F2", "2"), ("ERROR", "RT_MISSING", None, "9"), ("WARNING", "RT_MOVED", "F1", "3")], "severity string, code string, floor_id string, element_id string")
    assert [r["element_id"] for r in reports.first_findings(f, 3).collect()] == ["9", "3", "2"]
    table = {r["floor_id"]: (r["beam"], r["errors"], r["warnings"]) for r in reports.floor_table(spark.createDataFrame([("F1", "beam"), ("F3", "beam")], "floor_id string, kind string"), f.where("floor_id is not null"), ["beam"], ["floor_id"]).collect()}
    assert table == {"F1": (1, 0, 1), "F2": (0, 0, 1), "F3": (1, 0, 0)}
    assert {(r["floor_id"], r["ok"]) for r in reports.verification(f, ["floor_id"]).collect()} == {("F1", False), ("F2", False), (None, False)}
    assert reports.by_code(f.limit(0)).count() == 0


def test_extraction_of_nothing_and_of_odd_rows(spark):
    """Empty tables; entities without a rule, a place, a text or a ring; a shape outside of all floors; a column that names its own clashing columns."""
    on = "drawing string"
    ring = "ring array<struct<x:double,y:double>>"
    shapes = f"{on}, id string, layer string, kind string, {ring}, role string, x double"
    texts = f"{on}, id string, layer string, text string, x double, y double, text_height double, rotation double, floor_id string"
    lines, frames, rules = f"{on}, id string, layer string, ax double, ay double, bx double, by double", f"{on}, floor_id string, nth int, {ring}", "layer string, role string, text_role string, modifiers array<string>"
    none = [spark.createDataFrame([], k) for k in (shapes, texts, lines, frames, rules)]
    x = extract.extract(*none, ["drawing"])
    assert x.elements.count() == x.findings.count() == x.grids.count() == 0
    box = lambda x0, y0, w, h: [(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h)]
    s = [("d", "c1", "COL", "polygon", box(100.0, 100.0, 300.0, 600.0), "?", 1.0), ("d", "c2", "COL", "polygon", box(9e6, 0.0, 300.0, 300.0), None, None), ("d", "c3", "COL", "polygon", None, None, None), ("d", "c4", None, "polygon", box(0.0, 0.0, 300.0, 300.0), None, None)]
    t = [("d", "t1", "COL", "C1-300X600", 110.0, 110.0, 50.0, 0.0, "F9"), ("d", "t2", "COL", None, 110.0, 110.0, None, None, None), ("d", "t3", "COL", "C2", None, None, 50.0, 0.0, None), ("d", "t4", "COL", "C1-300X600", 110.0, 110.0, 50.0, 0.0, "F9")]
    data = [s, t, [("d", "g1", "GRID", 5.0, 0.0, 5.0, 900.0)], [("d", "F1", 1, box(0.0, 0.0, 50000.0, 50000.0))], [("COL", "COLUMN", "COLUMN_TAG", []), ("GRID", "GRID", "GRID_TAG", None)]]
    x = extract.extract(*[spark.createDataFrame(d, k) for d, k in zip(data, (shapes, texts, lines, frames, rules))], ["drawing"])
    assert rows(x.elements, "id", "floor_id", "number", "mark", "width_mm", "size_source", "n_tags") == [("c1", "F1", 1, "C1", 300.0, "tag", 1)]
    assert rows(x.findings, "code", "element_id") == [("ELEMENT_OUTSIDE_FLOORS", "c2"), ("GRID_NO_LABEL", "g1"), ("TAG_UNASSIGNED", "t4"), ("TAG_UNPARSED", "t2")]


def test_share_of_boxes_apart_is_no_division_by_zero(spark):
    # 20 by 10 apart, which is as much as both areas: a filter on the share may be tried before that on the overlap
    a = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 100, 100, 110, 110)], "id int, x0 int, y0 int, x1 int, y1 int")
    b = spark.createDataFrame([(7, 30, 20, 40, 30), (8, 100, 100, 110, 110)], "id int, x0 int, y0 int, x1 int, y1 int")
    pairs = sp.overlaps(a, b, [], 1000).withColumn("iou", sp.iou()).where("iou >= 0.5")
    assert rows(pairs, "id", "b_id", "iou") == [(2, 8, 1.0)]
    assert rows(sp.overlaps(a, b, [], 1000).where(sp.iou() >= 0.9), "id", "b_id") == [(2, 8)]


def test_queries_on_columns_apart_by_as_much_as_their_areas(spark, tmp_path):
    from planlake.plans import catalog

    part, supp = (lambda x: (x - 17) * pow(131, -1, 200000) % 200000), (lambda y, order: (y - 53 * order) * pow(977, -1, 200000) % 200000)

    def written(name, *places):
        rows = [(o, part(x), supp(y, o), 1, 0.0) for o, x, y in places]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        return f"{tmp_path}/{name}"

    # six times 200 by 400: 2400 apart on both axes
    wide = written("wide", (8, 100, 2000), (16, 3700, 6800))
    assert catalog.QUERIES["i02_near_duplicates"](spark, wide).collect() == []
    # 200 by 400, one new in the drawing (divisible by 3, so renumbered): 400 apart on both axes
    small = written("small", (104, 100, 300), (112, 712, 1100))
    for name in ("e38_model_drawing", "l03_diff", "a12_verification", "a12_verdicts", "a12_first_findings"):
        assert catalog.QUERIES[name](spark, small).collect() is not None


def test_least_takes_pairs_as_they_come(spark):
    rng = random.Random(5)
    sizes = [0, 1, 2**28, 2**29, 2**33 - 1, 2**33, 2**40, 2**61 - 1]
    data = [(rng.randrange(40), rng.choice([-1, 1]) * rng.choice(sizes), rng.choice([-1, 1, 1]) * rng.choice([*sizes, 2**63 - 1])) for _ in range(400)] + [(99, None, None)]
    df = spark.createDataFrame(data, "k long, a long, b long")
    got = {r.k: (r["first"], r["second"], r.n) for r in sp.least(df, ["k"], F.col("a"), F.col("b"), n=F.count("*")).collect()}
    want = {k: (*min((a, b) for x, a, b in data if x == k and a is not None), sum(x == k for x, _, _ in data)) for k in {r[0] for r in data} - {99}}
    assert got == want | {99: (None, None, 1)}


def test_nearest_queries_do_not_sort_their_pairs(spark, sf):
    from planlake.plans import catalog

    for name in ("e42_grid_labels", "e05_smallest_container", "e08_orphans_nearest", "e13_legend_swatch", "e22_ramp_line", "e25_ramp_in_panel", "e32_wall_top", "e33_touching_support", "e40_mark_of"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name


def test_slab_tags_are_counted_by_numbers(spark, sf):
    from planlake.plans import catalog

    plan = catalog.QUERIES["e17_slab_tags"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "keys=[slab_id" not in plan and "keys=[coalesce" not in plan


def test_greedy_in_steps_is_the_greedy_pass(spark):
    rng = random.Random(8)
    pairs = {(rng.randrange(150), rng.randrange(90)): float(rng.randrange(60)) for _ in range(1500)}
    p = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, score double")
    asked = []

    def candidates(a, b, most):
        c = p.join(a, "a", "left_semi").join(b, "b", "left_semi")
        asked.append((most, (c if most is None else c.where(F.col("score") <= most)).count()))
        return c if most is None else c.where(F.col("score") <= most)

    used_a, used_b, want = set(), set(), []
    for (a, b), s in sorted(pairs.items(), key=lambda r: (r[1], *r[0])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b, s))
    for few in (100, 10**6):
        del asked[:]
        got = mt.greedy_in_steps(p.select("a").distinct(), p.select("b").distinct(), candidates, [5.0, 20.0], few)
        assert rows(got, "a", "b", "score") == sorted(want)
        assert [m for m, _ in asked] == ([None, 5.0, 20.0, None] if few == 100 else [None, None])
        assert few > 100 or max(n for _, n in asked[1:]) < len(pairs) / 2


def test_groups_within_a_drawing_need_no_rounds(spark, monkeypatch):
    """Groups that no drawing shares are found by the task of their drawing, however many edges there are in all; batches are contracted as they come."""
    e = [(d, d * 100 + i, d * 100 + (i + 7) % 30 + 30 * (i // 30)) for d in range(20) for i in range(60)]
    edges = spark.createDataFrame(e, "d long, a long, b long")
    want = sorted((a, a - a % 100 + 30 * (a % 100 // 30)) for _, a, _ in e)
    written, real = [], mt.Rounds.settled
    monkeypatch.setattr(mt.Rounds, "settled", lambda self, df: written.append(1) or real(self, df))
    assert rows(mt.groups(edges, 60, within=["d"]), "node", "root") == want and len(written) == 2
    assert rows(mt.groups(edges, 14, within=["d"]), "node", "root") == want  # a drawing is too large: rounds
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([x[1]]), pa.array([x[2]])], ["a", "b"]) for x in e]
    assert sorted((r["node"], r["root"]) for b in mt._contracted(iter(batches), 50) for r in b.to_pylist()) == want


def test_links_of_touching_boxes(spark):
    """Links connect what all overlapping pairs connect, and boxes drawn over each other have few."""
    rng = random.Random(8)
    boxes = [(i, i % 2, x := rng.randrange(-3000, 3000), y := rng.randrange(-3000, 3000), x + rng.randrange(0, 600), y + rng.randrange(0, 400)) for i in range(150)]
    boxes += [(i, 5, 10, 10, 450, 450) for i in range(200, 300)] + [(300, 5, 450, 10, 700, 450), (301, 5, 449, 449, 460, 460)]
    frame = spark.createDataFrame(boxes, "id long, f int, x0 long, y0 long, x1 long, y1 long")
    pairs = sp.overlaps(frame, frame, ["f"], 300).where("id < b_id").select(F.col("id").alias("a"), F.col("b_id").alias("b"))
    links = sp.touching_links(frame, "id", ["f"], 100)
    assert rows(mt.groups(links), "node", "root") == rows(mt.groups(pairs), "node", "root")
    assert pairs.where("a >= 200").count() > 4950 and links.where("f = 5").count() < 120


def test_ends_in_one_place_are_one_node(spark, monkeypatch):
    points = spark.createDataFrame([(i, "a", float(i % 3 * 4), 0.0) for i in range(300)] + [(900, "a", None, 0.0)], "id long, k string, x double, y double")
    edges, real = [], mt.groups
    monkeypatch.setattr(mt, "groups", lambda e, *a, **k: edges.append(e.count()) or real(e, *a, **k))
    got = {r["id"]: (r["sx"], r["sy"]) for r in mt.snapped_points(points, ["k"], 5).collect()}
    assert len(got) == 301 and got[0] == got[299] == (4.0, 0.0) and got[900] == (None, 0.0)
    assert edges == [2]  # not one for each pair of 300 points


def test_boxes_held_whole(spark):
    """Edges count, on cell borders too; the inner side is not spread over cells."""
    rng = random.Random(9)
    boxes = [(i, i % 2, x := rng.randrange(-20, 20) * 50, y := rng.randrange(-20, 20) * 50, x + rng.randrange(0, 12) * 50, y + rng.randrange(0, 12) * 50) for i in range(120)]
    frame = spark.createDataFrame(boxes, "id long, f int, x0 long, y0 long, x1 long, y1 long")
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] == b[1] and a[2] >= b[2] and a[3] >= b[3] and a[4] <= b[4] and a[5] <= b[5])
    pairs = sp.held_whole(frame, frame, ["f"], 100)
    assert rows(pairs, "i_id", "id") == want
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2  # x and y of the outer side


def _stacked_naively(boxes, tol, least):
    out = []
    middle = lambda b: ((b[2] + b[4]) / 2, (b[3] + b[5]) / 2)
    for f in sorted({b[1] for b in boxes}):
        used = set()
        for b in sorted((b for b in boxes if b[1] == f), key=lambda b: (*middle(b), b[0])):
            best = []
            for a in boxes:
                if a[1] == f - 1 and a[0] not in used:
                    w, h = (max(0, min(a[4 + k], b[4 + k]) - max(a[2 + k], b[2 + k])) for k in (0, 1))
                    d, size = math.dist(middle(a), middle(b)), lambda c: (c[4] - c[2]) * (c[5] - c[3])
                    if d <= tol or w * h:
                        best.append((-round(w * h / (size(a) + size(b) - w * h) + (1 - min(d, tol) / tol) / 2, 6), a[0], d))
            if best and min(best)[0] < 0 and (-min(best)[0] >= least or min(best)[2] <= tol):
                used.add(min(best)[1])
                out.append((min(best)[1], b[0]))
    return sorted(out)


def test_stacks_in_strips_are_those_of_a_plain_pass(spark):
    rng = random.Random(8)
    boxes = [(i, 1 + i % 3, x := rng.randrange(3000), y := rng.randrange(1500), x + rng.randrange(120, 900), y + rng.randrange(120, 900)) for i in range(300)]
    frame = spark.createDataFrame(boxes, "id long, f int, x0 long, y0 long, x1 long, y1 long")
    want = _stacked_naively(boxes, 90.0, 0.25)
    assert len(want) > 60
    for size in (25, 200_000):
        assert rows(sweeps.stacked(frame, "f", 90.0, 0.25, size), "low", "high") == want


def test_crowded_stacks_and_junctions_make_no_pairs(spark, monkeypatch):
    """A few million pairs overlap here; the passes get boxes."""
    monkeypatch.setattr("planlake.operators.spatial.overlaps", lambda *a, **k: pytest.fail("all pairs are made"))
    boxes = [(i, 1 + i % 2, i, 0, i + 4000, 900 + i % 7) for i in range(3000)]
    frame = spark.createDataFrame(boxes, "id long, f int, x0 long, y0 long, x1 long, y1 long")
    assert sweeps.stacked(frame, "f", 600.0, 0.25).count() > 1490
    out = faces.trim_junctions(frame, "id", ["f"], 5000)
    assert out.count() == 3000 and out.where("trimmed").count() > 2000


def test_boxes_get_their_points_without_rows_for_pairs(spark):
    """Also boxes far larger than a cell, with the points strictly inside in order."""
    rng = random.Random(9)
    boxes = [(i, "a", x := rng.randrange(-500, 500), y := rng.randrange(-500, 500), x + rng.choice([3, 40, 300, 1000]), y + rng.choice([0, 7, 90, 1000])) for i in range(80)]
    points = [(i, rng.choice("ab"), rng.randrange(-500, 900), rng.randrange(-500, 900)) for i in range(150)]
    b, p = spark.createDataFrame(boxes, "id long, f string, x0 long, y0 long, x1 long, y1 long"), spark.createDataFrame(points, "n long, f string, x long, y long")
    want = {i: [n for n, g, x, y in points if g == f and x0 < x < x1 and y0 < y < y1] for i, f, x0, y0, x1, y1 in boxes}
    for how in ("left", "inner"):
        out = sp.with_points(b, p, ["f"], 50, F.struct("n", "x", "y"), lambda r: (r["x"], r["y"]), how)
        got = {r["id"]: [h["n"] for h in r["held"] or []] for r in out.collect()}
        assert got == {i: w for i, w in want.items() if w or how == "left"}


def test_labels_shuffle_no_pairs(spark, sf):
    """Footings are not aggregated at all, openings only where an id has several boxes."""
    plan = catalog.QUERIES["e27_footing_stacks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("SortMergeJoin")]
    assert "Aggregate" not in after and "Exchange" not in after


def test_ordered_keep_in_steps_writes_few_pairs(spark, monkeypatch):
    """Of crowded rows that a plain pass keeps few of, the steps make few of the conflicts, and keep the same."""
    frame, near = spark.range(600).withColumn("x", F.col("id") * 37 % 100), 9
    want = []
    for i in range(600):
        if not any(abs(i * 37 % 100 - k * 37 % 100) < near for k in want):
            want.append(i)
    seen, real = [], mt.ordered_keep
    monkeypatch.setattr(mt, "ordered_keep", lambda rows, c, *a: seen.append(c.count()) or real(rows, c, *a))

    def conflicts(early, late):
        late = late.select(F.col("id").alias("late"), F.col("x").alias("_x"))
        return early.join(late, (F.abs(F.col("x") - F.col("_x")) < near) & (F.col("id") < F.col("late"))).select(F.col("id").alias("early"), "late")

    out = mt.ordered_keep_in_steps(frame, conflicts, 40)
    assert sorted(r["id"] for r in out.where("kept").collect()) == want and out.count() == out.select("id").distinct().count() == 600
    assert len(seen) > 3 and sum(seen) < conflicts(frame, frame).count() / 20


def test_free_cells_of_a_large_drawing_are_not_walked_one_by_one():
    """Two million cells round 700 posts within a frame: one hole. A walk over the cells takes several seconds."""
    n = 700
    frame = [(-10, -10, 10 * n + 10, -5), (-10, 10 * n + 5, 10 * n + 10, 10 * n + 10), (-10, -10, -5, 10 * n + 10), (10 * n + 5, -10, 10 * n + 10, 10 * n + 10)]
    boxes = np.array(frame + [(10 * i + 2, 10 * i + 2, 10 * i + 5, 10 * i + 5) for i in range(n)], float)
    start = time.process_time()
    assert faces.holes(boxes) == [(-5, -5, 10 * n + 5, 10 * n + 5, (10 * n + 10) ** 2 - 9 * n)]
    assert time.process_time() - start < 2


def test_arcs_of_a_table_are_those_of_each_ring(spark):
    """Rings on none, one or several circles, null rings, null circles and empty ones, in one batch and in slices of it."""
    rng, rows_ = random.Random(10), [(0, None, None), (1, [], []), (2, None, [(0.0, 0.0, 5.0)])]
    for i in range(3, 60):
        circles = [(float(rng.randrange(50)), float(rng.randrange(50)), 10.0) for _ in range(rng.randrange(4))]
        ring = [(float(rng.randrange(90)), float(rng.randrange(90))) for _ in range(rng.randrange(6))]
        for x, y, r in circles[: rng.randrange(4)]:
            ring += [(x + r * math.cos(a / 3), y + r * math.sin(a / 3)) for a in range(rng.randrange(1, 8))]
        rows_.append((i, ring, circles if i % 7 else None))
    t = spark.createDataFrame(rows_, "id int, ring array<struct<x:double,y:double>>, circles array<struct<x:double,y:double,r:double>>").coalesce(1)
    want = {i: (None, None) if ring is None else arcs.with_bulges(ring, circles or [], 0.01) for i, ring, circles in rows_}
    for t in (t, t.where("id % 3 > 0").orderBy("id")):
        got = {r["id"]: (r["ring"] and [tuple(p) for p in r["ring"]], r["bulges"]) for r in arcs.fitted(t, 0.01).collect()}
        assert len(got) > 30 and got == {i: want[i] for i in got}


def test_only_pairs_that_can_be_alike_are_clipped(spark):
    """Bounds that share too little are left out before rings go to Python; what is left has the same areas."""
    tri = lambda x, y, w: [(x, y), (x + w, y), (x, y + w)]
    rows = [(i, "L01", tri(float(i * 37 % 400), float(i * 91 % 400), 100.0 + i % 3)) for i in range(60)] + [(60, "L01", tri(37.0, 91.0, 101.0))]
    o = spark.createDataFrame([(i, f, [{"x": x, "y": y} for x, y in r]) for i, f, r in rows], "id long, floor string, ring array<struct<x:double,y:double>>")
    o = ol._bounded(o)
    share = F.col("overlap") >= 0.6 * (F.col("area") + F.col("b_area") - F.col("overlap"))
    can = (F.col("id") < F.col("b_id")) & (F.col("overlap") * ol._ROUNDED >= 0.6 * (F.col("area") + F.col("b_area") - F.col("overlap")))
    every, few = ol.ring_overlaps(o, o, ["floor"], 100), ol.ring_overlaps(o, o, ["floor"], 100, can)
    key = lambda df: sorted((r["id"], r["b_id"], round(r["overlap"], 6)) for r in df.where(share & (F.col("id") < F.col("b_id"))).collect())
    assert key(every) == key(few) and (1, 60, 5100.5) in key(few)
    assert few.count() < every.count() / 4


def _places(rng, n=12):
    """Places with the same candidates for all their tags, and the pairs of each tag: (tag, kind, element, score, inside)."""
    places, pairs, tags = [], [], rng.sample(range(100), 4 * n)
    for i in range(n):
        kind, own = i % 2, sorted(tags[4 * i : 4 * i + rng.randrange(1, 5)])
        near = sorted((round(rng.randrange(1, 9) / 2, 1), e) for e in rng.sample(range(12), rng.randrange(0, 5)))
        home = rng.randrange(12) if rng.random() < 0.3 else None
        places.append((i, "f", kind, own, home, None if home is not None else near))
        pairs += [(t, kind, e, s, False) for t in own for s, e in near if e != home] + [(t, kind, home, 0.0, True) for t in own if home is not None]
    return places, pairs


def test_tags_in_one_place_are_shared_out_without_their_pairs(spark):
    """Places give what all pairs of their tags do; searches that lead nowhere are not made again."""
    shape = "place long, f string, kind int, tags array<long>, home long, near array<struct<score:double,element:long>>"
    for seed in range(200):
        places, pairs = _places(random.Random(seed))
        held = {}
        for _, _, kind, own, home, _ in places:
            if home is not None:
                held[home, kind] = held.get((home, kind), 0) + len(own)
        want = mt.shared_out(pairs)
        got = dict(mt.shared_places([(p[2], p[3], p[5]) for p in places if p[4] is None], held))
        assert got == {t: e for t, e in want.items() if not any(t in p[3] for p in places if p[4] is not None)}
        if seed < 2:
            assert rows(mt.share_places(spark.createDataFrame(places, shape), ["f"]), "tag", "element") == sorted(want.items())


def test_shared_tags_make_no_pairs_of_tags_that_lie_inside(spark, sf, monkeypatch):
    monkeypatch.setattr(mt, "share_tags", lambda *a, **k: pytest.fail("all pairs are made"))
    assert catalog.QUERIES["j02_shared_tags"](spark, sf).count() > 0


def test_places_are_matched_as_all_their_tags_would_be(spark):
    """Also where many pairs are alike in score, a pair has two scores, and the pass goes by steps."""
    rng = random.Random(14)
    for n in range(6):
        places = [(i, "ab"[i % 2], sorted(rng.sample(range(1000 * i, 1000 * i + 900), rng.randrange(1, 5)))) for i in range(40)]
        rng.shuffle(ids := list(range(40)))
        places = [(i, f, [t + 50_000 * ids[i] % 7000 for t in tags]) for i, f, tags in places]
        pairs = [(f, i, 2 * rng.randrange(25) + "ab".index(f), rng.randrange(8) / 2) for i, f, _ in places for _ in range(rng.randrange(9))]
        used, want = set(), []
        for s, a, b in sorted((s, a, b) for _, i, b, s in pairs for a in places[i][2]):
            if ("a", a) not in used and ("b", b) not in used:
                used |= {("a", a), ("b", b)}
                want.append((a, b, s))
        if len({t for p in places for t in p[2]}) < sum(len(p[2]) for p in places):
            continue  # a tag is in one place
        p = spark.createDataFrame(pairs, "f string, place long, b long, score double")
        t = spark.createDataFrame(places, "place long, f string, tags array<long>")
        b = p.select("f", "b").distinct()
        near = lambda t, b, most: (q := p.join(t.select("place"), "place", "left_semi").join(b.select("b"), "b", "left_semi"), q if most is None else q.where(F.col("score") <= most))[1]
        for few in (10, 10**6) if n < 2 else (10**6,):
            assert rows(mt.greedy_places(t, b, near, ["f"], [0.0, 1.0], few), "a", "b", "score") == sorted(want)


def test_one_place_has_its_pairs_once(spark, sf, monkeypatch):
    """Notes in one place do not bring their pairs each."""
    from planlake.plans import joins

    seen, real = [], joins.scored
    monkeypatch.setattr(joins, "scored", lambda n, *a, **k: seen.append(n) or real(n, *a, **k))
    n = joins.notes(spark, sf)
    more = n.unionByName(n.withColumn("note_id", F.col("note_id") + 6_000_000))
    monkeypatch.setattr(joins, "notes", lambda *a: more)
    joins.greedy_candidates(spark, sf)
    assert seen and seen[0].count() == n.select("floor_id", "x", "y", F.col("note_id") % 6).distinct().count()


def test_only_matched_notes_are_parsed(spark, sf, monkeypatch):
    from planlake.plans import jobs

    seen, real = [], jobs.tx.parse_tags
    monkeypatch.setattr(jobs.tx, "parse_tags", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    sized = catalog.QUERIES["l01_extract"](spark, sf).where("note_id is not null").select("note_id").distinct().count()
    assert 0 < sized <= seen[0] < jobs.view(spark, sf, "vN").count() / 2


def test_smallest_boxes_around_places(spark):
    """Also of boxes that reach beyond all places, on edges, alike, on floors without places, and of more places than are told."""
    rng = random.Random(15)
    points = [("ab"[rng.randrange(2)], rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)]
    boxes = [("abc"[rng.randrange(3)], i // 2, x := rng.randrange(-90, 90), y := rng.randrange(-90, 90), x + rng.choice([0, 3, 30, 200]), y + rng.choice([1, 9, 90, 300])) for i in range(120)]
    p, b = spark.createDataFrame(points, "f string, x long, y long"), spark.createDataFrame(boxes, "f string, i long, x0 long, y0 long, x1 long, y1 long")
    want = []
    for f, x, y in set(points):
        held = [((x1 - x0) * (y1 - y0), i) for g, i, x0, y0, x1, y1 in boxes if g == f and x0 < x < x1 and y0 < y < y1]
        if held:
            want.append((f, x, y, *min(held), len(held)))
    assert len(want) > 40
    assert rows(sweeps.smallest_around(p, b, "f", "i"), "f", "x", "y", "area", "id", "n") == sorted(want)
    assert sweeps.smallest_around(p, b, "f", "i", 20) is None
    assert sweeps.smallest_around(p, b.withColumn("x1", F.col("x1") + 2**31), "f", "i") is None


def test_smallest_container_shuffles_no_boxes(spark, sf):
    plan = catalog.QUERIES["e05_smallest_container"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "_cx" not in plan


def test_boxes_held_whole_are_counted_without_their_pairs(spark, monkeypatch):
    """Edges included, also of boxes smaller than an inner one, alike, on several floors and in many strips."""
    monkeypatch.setattr(sp, "held_whole", lambda *a: pytest.fail("all pairs are made"))
    rng = random.Random(16)
    box = lambda most: (x := rng.randrange(-40, 80), y := rng.randrange(-40, 80), x + rng.randrange(most), y + rng.randrange(most))
    inner = [("ab"[i % 2], *box(12)) for i in range(250)]
    outer = [("abc"[i % 3], i // 2, *box(rng.choice([8, 60]))) for i in range(200)]
    want = []
    for f, i, x0, y0, x1, y1 in outer:
        n = sum(g == f and x0 <= a0 and y0 <= b0 and a1 <= x1 and b1 <= y1 for g, a0, b0, a1, b1 in inner)
        want += [(i, n)] if n else []
    assert len(want) > 50
    a, b = spark.createDataFrame(inner, "f string, x0 long, y0 long, x1 long, y1 long"), spark.createDataFrame(outer, "f string, i long, x0 long, y0 long, x1 long, y1 long")
    for size in (9, 10**6):
        assert rows(sweeps.whole_counts(a, b, "i", "f", size), "i", "n") == sorted(want)
    assert sweeps.whole_counts(a, b.where("false"), "i", "f").count() == 0


def test_notes_in_one_place_go_to_labels_together(spark, sf, monkeypatch):
    """Notes that come again do so in labels, in order, also where two boxes of an id hold their place."""
    from planlake.plans import joins

    n = joins.notes(spark, sf)
    more = n.unionByName(n.where("note_id % 3 = 0")).unionByName(n.withColumn("note_id", F.col("note_id") + 7_000_000))
    b = joins.boxes(spark, sf, None).where("rect_id % 10 in (4, 5)").withColumns({"x1": F.col("x1") + 20_000, "y1": F.col("y1") + 20_000})
    b = b.unionByName(b.where("rect_id % 3 = 0").withColumn("x0", F.col("x0") + 1000)).where("rect_id % 4 = 0").limit(60).cache()
    monkeypatch.setattr(joins, "notes", lambda *a: more)
    monkeypatch.setattr(joins, "boxes", lambda spark, sf, kind=None, wide=1: b)
    seen, real = [], sp.with_points
    monkeypatch.setattr(joins.sp, "with_points", lambda boxes, points, *a, **k: seen.append(points) or real(boxes, points, *a, **k))
    points = [(r["floor_id"], r["x"], r["y"], r["note_id"]) for r in more.collect()]
    held, want = {}, []
    for r in b.collect():
        inside = [(-y, x, i) for f, x, y, i in points if f == r["floor_id"] and r["x0"] < x < r["x1"] and r["y0"] < y < r["y1"]]
        held.setdefault(r["rect_id"], []).extend(inside)
    want = sorted((i, " ".join(str(p[2]) for p in sorted(v))) for i, v in held.items() if v)
    assert len(want) > 10 and rows(catalog.QUERIES["e19_opening_labels"](spark, sf), "rect_id", "label") == want
    assert seen[0].count() == n.select("floor_id", "x", "y").distinct().count()


def test_a_pass_over_boxes_holds_the_stretches_of_some_only(monkeypatch):
    """What is near each box is looked up for some boxes at a time, and is the same."""
    rng = np.random.default_rng(17)
    x, y = rng.integers(0, 5000, 300).astype(float), rng.integers(0, 5000, 300).astype(float)
    boxes = np.stack([x, y, x + rng.integers(1, 900, 300), y + rng.integers(1, 900, 300)], 1)
    near, asked, real = sweeps.Near(boxes), [], sweeps.Near.stretches
    monkeypatch.setattr(sweeps.Near, "stretches", lambda self, b, *a: asked.append(len(b)) or real(self, b, *a))
    start, end = real(near, boxes)
    found = {i: sorted(k for s, e in zip(*f) if s < e for k in near.order[s:e].tolist()) for i, _, f in near.each(boxes, 0.0, 70)}
    assert max(asked) <= 70 and len(found) == 300
    for i in range(300):
        assert found[i] == sorted(k for s, e in zip(start[:, i], end[:, i]) if s < e for k in near.order[s:e].tolist())


def test_overlaps_carry_the_sides_of_a_box_once(spark):
    b = spark.createDataFrame([(1, 0, 0, 5, 5), (2, 4, 4, 9, 9), (3, 11, 4, 12, 5)], "id long, x0 long, y0 long, x1 long, y1 long")
    out = sp.overlaps(b, b, [], 4, grow=3).where("id < b_id")
    assert rows(out, "id", "b_id", "overlap") == [(1, 2, 16), (2, 3, 4)]  # the second is 1 by 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_bx0" not in plan and "_by1" not in plan


def test_lines_that_come_again_shuffle_no_others(spark, sf):
    plan = catalog.QUERIES["g09_pairs_without_barrier"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1


def test_outlines_meet_without_their_names(spark, monkeypatch):
    """What is compared is an outline's place and ring; layers, handles and what was merged are not shuffled to each cell."""
    seen, real = [], ol.ring_overlaps
    monkeypatch.setattr(ol, "ring_overlaps", lambda a, b, *r: seen.extend((a.columns, b.columns)) or real(a, b, *r))
    box = lambda x, w: [{"x": float(p), "y": float(q)} for p, q in ((x, 0), (x + w, 0), (x + w, 500), (x, 500))]
    shapes = [("a", "polygon", "S", "L01", box(0, 500)), ("b", "hatch", "S", "L01", box(10, 500)), ("c", "polygon", "T", "L01", box(2000, 300))]
    out = ol.collected(spark.createDataFrame(shapes, "handle string, kind string, layer string, floor_id string, ring array<struct<x:double,y:double>>"), ["floor_id"], 90, 4000, 20000, 1e7)
    assert sorted((r["layer"], *r["handles"], *r["merged"]) for r in out.collect()) == [("S", "a", "b"), ("T", "c")]
    assert len(seen) == 4 and not any({"layer", "handles", "merged"} & set(c) for c in seen)
