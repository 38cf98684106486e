"""Every query with an SQL twin against it on the smallest data, the rest for rows; and at other partition counts."""

import math
import random
import re

import duckdb
import pytest

from planlake.operators import faces, matching as mt
from planlake.plans import catalog
from planlake.plans.jobs import boxes, candidates, compare, crowded_pairs, snapshots
from planlake.plans.reporting import drawing_entities
from planlake.sources.proxies import view

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def least_boxes(spark, sf, kind, wide=1):
    """id, floor: box of the outlines of a kind."""
    out = {}
    for r in boxes(spark, sf, kind, wide).collect():
        k, b = (r["rect_id"], r["floor_id"]), (r["x0"], r["y0"], r["x1"], r["y1"])
        out[k] = tuple(map(min, out[k], b)) if k in out else b
    return out


def overlap(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def size(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def plain_greedy(spark, sf):
    best = {}
    for r in candidates(spark, sf).collect():
        k = (r["note_id"], r["rect_id"])
        best[k] = min(r["score"], best.get(k, r["score"]))
    used, out = set(), []
    for score, a, b in sorted((v, *k) for k, v in best.items()):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((a, b, score))
    return out


def shared_naively(tags, longest=6):
    """The passes of shared_tags over plain lists; chains are tried length by length, in the order of the tags."""
    owner, kind = {}, {t[0]: t[1] for t in tags}
    for score, element, tag in sorted((t[3], t[2], t[0]) for t in tags if t[4]):
        owner.setdefault(tag, element)
    fixed = set(owner)
    free = [(tag, e) for _, tag, e in sorted((t[3], t[0], t[2]) for t in tags if t[0] not in fixed)]
    held = lambda e, k: [t for t, x in owner.items() if x == e and kind[t] == k]
    for tag, e in free:
        if tag not in owner and not held(e, kind[tag]):
            owner[tag] = e
    for tag, e in free:
        owner.setdefault(tag, e)

    def chain(e, k, steps, seen):
        for tag, at in free:
            giver = owner[tag]
            if at == e and kind[tag] == k and giver not in seen:
                if steps == 1 and len(held(giver, k)) > 1:
                    return [(tag, e)]
                rest = chain(giver, k, steps - 1, seen | {giver}) if steps > 1 else None
                if rest:
                    return [(tag, e)] + rest
        return None

    for e, k in sorted({(e, kind[t]) for t, e in free}):
        if not held(e, k):
            owner.update(next(filter(None, (chain(e, k, n, {e}) for n in range(1, longest + 2))), []))
    for e, k in sorted({(e, kind[t]) for t, e in owner.items()}):
        for tag in sorted(held(e, k)):
            if tag not in fixed and len(held(e, k)) > 1:
                for t, other in free:
                    if t == tag and other != e and not held(other, k):
                        owner[tag] = other
                        break
    return owner


def plain_shared(spark, sf):
    """All tags of the table in one pass, where the query goes by connected group."""
    r = least_boxes(spark, sf, "column")
    tags = []
    for n in view(spark, sf, "vN").collect():
        for (e, floor), (x0, y0, x1, y1) in r.items():
            d2 = max(x0 - n["x"], 0, n["x"] - x1) ** 2 + max(y0 - n["y"], 0, n["y"] - y1) ** 2
            if floor == n["floor_id"] and d2 <= 900 * 900:
                tags.append((n["note_id"], n["note_id"] % 2, e, round(math.sqrt(d2), 3), d2 == 0))
    return shared_naively(tags).items()


@pytest.mark.parametrize("seed", range(40))
def test_shared_tags_equal_a_naive_pass(seed):
    rng = random.Random(seed)
    tags = [(t, t % 2, e, round(rng.random(), 2), rng.random() < 0.1) for t in range(rng.randrange(3, 24)) for e in rng.sample(range(9), rng.randrange(1, 5))]
    assert mt.shared_out(tags) == shared_naively(tags)


def plain_keep(spark, sf):
    kept = []
    for (i, floor), b in sorted(least_boxes(spark, sf, "column", 6).items()):
        kept.append((i, floor, b, not any(k and f == floor and 10 * overlap(o, b) >= 4 * size(b) and overlap(o, b) > 0 for _, f, o, k in kept)))
    return [(i, k) for i, _, _, k in kept]


def plain_edges(spark, sf):
    """Pair by pair in order, with the intervals that each edge has given away."""
    given, out = {}, []
    for r in sorted(crowded_pairs(spark, sf).collect(), key=lambda r: (r["score"], r["a"], r["b"])):
        a, b, t1, t2 = r["a"], r["b"], r["t1"], r["t2"]
        if all(sum(max(0, min(z, t2) - max(x, t1)) for x, z in given.get(e, [])) <= 0.5 * (t2 - t1) for e in (a, b)):
            for e in (a, b):
                given.setdefault(e, []).append((t1, t2))
            out.append((a, b, t1, t2))
    return out


def plain_stacks(spark, sf, tol=600.0):
    """Floor by floor, column by column."""
    by_floor, centre = {}, lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    for (i, floor), b in least_boxes(spark, sf, "column", 10).items():
        by_floor.setdefault(int(floor[2]), {})[i] = b
    stack, out = {}, []
    for floor in sorted(by_floor):
        below, used = by_floor.get(floor - 1, {}), set()
        for i, b in sorted(by_floor[floor].items(), key=lambda x: (centre(x[1]), x[0])):
            best = None
            for j, o in below.items():
                d, over = math.dist(centre(b), centre(o)), overlap(b, o)
                if j in used or (d > tol and not over):
                    continue
                score = round(over / (size(b) + size(o) - over) + (1 - min(d, tol) / tol) * 0.5, 6)
                if score > 0 and (best is None or (score, -j) > best[:2]):
                    best = (score, -j, d)
            if best and (best[0] >= 0.25 or best[2] <= tol):
                used.add(-best[1])
                stack[i] = stack[-best[1]]
            else:
                stack[i] = (i, centre(b))
            foot, at = stack[i]
            out.append((i, floor, foot, math.dist(centre(b), at) > tol / 2, foot == i and floor - 1 in by_floor))
    return out


def plain_groups(spark, sf):
    r = sorted({(b["rect_id"], b["floor_id"], (b["x0"], b["y0"], b["x1"], b["y1"])) for b in boxes(spark, sf, "beam", 4).collect()})
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for n, (i, f, b) in enumerate(r):
        for j, g, o in r[:n]:
            if f == g and i != j and overlap(b, o):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [(i, find(i)) for i in root]


def plain_panels(spark, sf):
    """Flood fill from outside over a grid of all corners."""
    drawings = {}
    for s in view(spark, sf, "vS").collect():
        i, t1, long = s["seg_id"], s["t1"], s["t2"] - s["t1"]
        y, x = i * 613 % 60000, i * 211 % 100000
        drawings.setdefault(i // 40, []).extend([(t1, y, t1 + 8 * long, y + 230), (x, t1 // 2, x + 230, t1 // 2 + 16 * long)])
    out = []
    for key, members in drawings.items():
        xs, ys = (sorted({b[k] for b in members for k in (c, c + 2)}) for c in (0, 1))
        free = {(i, j) for i in range(len(xs) - 1) for j in range(len(ys) - 1) if not any(b[0] <= xs[i] and xs[i + 1] <= b[2] and b[1] <= ys[j] and ys[j + 1] <= b[3] for b in members)}
        while free:
            part, todo = set(), [free.pop()]
            while todo:
                i, j = todo.pop()
                part.add((i, j))
                for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if c in free:
                        free.discard(c)
                        todo.append(c)
            if any(i in (0, len(xs) - 2) or j in (0, len(ys) - 2) for i, j in part):
                continue
            area = sum((xs[i + 1] - xs[i]) * (ys[j + 1] - ys[j]) for i, j in part)
            if area >= 1e5:
                out.append((key, xs[min(i for i, _ in part)], ys[min(j for _, j in part)], float(area), area > 1e8))
    return out


def plain_outlines(spark, sf):
    """One pass over each floor's outlines; their rings are level, so boxes between their coordinates make up what they share."""
    from planlake.plans.jobs import drawn_shapes

    def cells(ring):
        xs, ys = (sorted({p[k] for p in ring}) for k in (0, 1))
        for x0, x1 in zip(xs, xs[1:]):
            for y0, y1 in zip(ys, ys[1:]):
                x, y = (x0 + x1) / 2, (y0 + y1) / 2
                if sum(1 for (ax, ay), (_, by) in zip(ring, ring[1:] + ring[:1]) if (ay > y) != (by > y) and ax > x) % 2:
                    yield x0, y0, x1, y1

    floors, lines = {}, {}
    for s in drawn_shapes(spark, sf).collect():
        ring = [(p["x"], p["y"]) for p in s["ring"]]
        kind, handles = s["kind"], [s["handle"]]
        if kind == "line" or (kind == "polyline" and math.dist(ring[0], ring[-1]) > 50):
            lines.setdefault((s["floor_id"], s["layer"], s["handle"].split("-")[0]), []).append((s["handle"], ring))
            continue
        if kind == "polyline" and math.dist(ring[0], ring[-1]) <= 1:
            ring = ring[:-1]
        floors.setdefault(s["floor_id"], []).append((kind, s["layer"], handles, ring))
    for (floor, layer, _), parts in lines.items():
        if len(parts) == 4:
            floors[floor].append(("lines", layer, sorted(h for h, _ in parts), [p[1][0] for p in sorted(parts)]))
    rank, out = {"polygon": 0, "polyline": 0, "solid": 1, "hatch": 2, "lines": 3, "generic_hatch": 4}, []
    for floor, shapes in floors.items():
        rows = []
        for kind, layer, handles, ring in shapes:
            parts = list(cells(ring))
            area, b = sum(map(size, parts)), (min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring))
            if 20000 <= area <= 1e7 and min(b[2] - b[0], b[3] - b[1]) >= 90 and max(b[2] - b[0], b[3] - b[1]) <= 4000:
                rows.append((rank[kind], -area, handles, kind, layer, parts, b, []))
        kept = []
        for r in sorted(rows, key=lambda r: r[:3]):
            shared = lambda o: sum(overlap(p, q) for p in o[5] for q in r[5]) if overlap(o[6], r[6]) else 0  # noqa: B023, E731
            same = next((o for o in kept if (v := shared(o)) and (v >= 0.6 * (-o[1] - r[1] - v) or v >= 0.8 * -r[1])), None)
            if same:
                same[7].extend(r[2])
            elif r[3] != "generic_hatch":
                kept.append(r)
        inner = lambda r: sum(1 for o in kept if o is not r and overlap(o[6], r[6]) and abs(sum(overlap(p, q) for p in o[5] for q in r[5]) + o[1]) < 1e-3)  # noqa: B023, E731
        drop = [r for r in kept if len(kept) > 2 and r[3] in ("lines", "polyline") and inner(r) >= 2]
        out += [(floor, r[4], r[3], ",".join(r[2]), ",".join(sorted(r[7])), round(-r[1], 3), *r[6]) for r in kept if r not in drop]
    return out


def plain_faces(spark, sf):
    """Flood fill from outside over the grid of all coordinates, with lines as walls between cells."""
    drawings, out = {}, []
    for s in view(spark, sf, "vS").collect():
        i, t1, long = s["seg_id"], s["t1"], s["t2"] - s["t1"]
        y, x = i * 613 % 60000, i * 211 % 100000
        drawings.setdefault(i // 40, []).extend([(t1, y, t1 + 8 * long, y), (x, t1 // 2, x, t1 // 2 + 16 * long)])
    for key, lines in drawings.items():
        xs, ys = (sorted({b[k] for b in lines for k in (c, c + 2)}) for c in (0, 1))
        at_x, at_y = {x: i for i, x in enumerate(xs)}, {y: i for i, y in enumerate(ys)}
        level, upright = set(), set()
        for x0, y0, x1, y1 in lines:
            level |= {(i, at_y[y0]) for i in range(at_x[x0], at_x[x1])}
            upright |= {(at_x[x0], j) for j in range(at_y[y0], at_y[y1])} if x0 == x1 else set()
        cells = {(i, j) for i in range(-1, len(xs)) for j in range(-1, len(ys))}
        while cells:
            part, todo = set(), [cells.pop()]
            while todo:
                i, j = todo.pop()
                part.add((i, j))
                for c, wall in (((i + 1, j), (i + 1, j) in upright), ((i - 1, j), (i, j) in upright), ((i, j + 1), (i, j + 1) in level), ((i, j - 1), (i, j) in level)):
                    if c in cells and not wall:
                        cells.discard(c)
                        todo.append(c)
            if (-1, -1) in part:
                continue
            area = sum((xs[i + 1] - xs[i]) * (ys[j + 1] - ys[j]) for i, j in part)
            out.append((key, *(float(v) for v in (xs[min(i for i, _ in part)], ys[min(j for _, j in part)], xs[max(i for i, _ in part) + 1], ys[max(j for _, j in part) + 1], area))))
    return out


def plain_trimmed(spark, sf):
    """Floor by floor in one pass, where the query goes by connected group."""
    done, out = {}, []
    for (i, floor), b in sorted(least_boxes(spark, sf, "wall", 8).items(), key=lambda x: (-size(x[1]), x[0][0])):
        now, cut = tuple(map(float, b)), False
        for o in done.get(floor, []):
            if overlap(now, o) > 1:
                new = faces.shortened(now, o, 100)
                if new is not None:
                    now, cut = new, True
        done.setdefault(floor, []).append(now)
        out.append((i, floor, *now, cut))
    return out


def plain_extract(spark, sf):
    tag = {b: a for a, b, _ in plain_greedy(spark, sf)}
    by_floor = {}
    for (i, floor), (x0, y0, _, _) in least_boxes(spark, sf, "column").items():
        by_floor.setdefault(floor, []).append((math.floor(y0 / 250 + 0.5), math.floor(x0 / 250 + 0.5), i))
    return [(i, floor, tag.get(i, -1), n + 1) for floor, rows in by_floor.items() for n, (_, _, i) in enumerate(sorted(rows))]


#: Queries that SQL cannot say: the columns looked at, and a plain sequential version.
def plain_whole_extract(spark, sf):
    """Elements and findings of drawings by loops over every floor."""
    shapes, texts, lines, frames, rules = (df.collect() for df in drawing_entities(spark, sf))
    role = {r["layer"]: r["role"] for r in rules}
    floors = {}
    for f in frames:
        floors.setdefault(f["drawing_id"], []).append((f["nth"], f["floor_id"], [(p["x"], p["y"]) for p in f["ring"]]))

    def owner(d, x, y):
        return next((name for _n, name, ring in sorted(floors.get(d, [])) if ring[0][0] <= x < ring[2][0] and ring[0][1] <= y < ring[2][1]), None)

    groups, found, size_of = {}, [], {}
    for e in sorted(shapes, key=lambda e: e["id"]):
        b = (e["ring"][0]["x"], e["ring"][0]["y"], e["ring"][2]["x"], e["ring"][2]["y"])
        f = owner(e["drawing_id"], (b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
        if f is None:
            found.append(("ELEMENT_OUTSIDE_FLOORS", e["id"], -1))
            continue
        kept = groups.setdefault((e["drawing_id"], f, role[e["layer"]]), {})
        if any(overlap(b, k) / (size(b) + size(k) - overlap(b, k)) >= 0.9 for k in kept.values()):
            found.append(("DUPLICATE_ENTITY", e["id"], f))
        else:
            kept[e["id"]] = b
    tags, pairs = {}, []
    for t in texts:
        f = owner(t["drawing_id"], t["x"], t["y"])
        if f is None or role[t["layer"]] == "GRID":
            continue
        if t["text"] == "??":
            found.append(("TAG_UNPARSED", t["id"], f))
            continue
        base, rest = re.match(r"(\w+)[- ](.*)", t["text"]).groups()
        n = [float(v) for v in re.findall(r"\d+", rest)]
        tags[t["id"]] = (f, base, *((n[0], n[1], -1) if "X" in rest else (-1, -1, n[0])))
        for k, b in groups.get((t["drawing_id"], f, role[t["layer"]]), {}).items():
            least, factor = {"COLUMN": (600, 1.5), "BEAM": (600, 0), "SLAB": (0, 0), "FOOTING": (600, 0)}[role[t["layer"]]]
            d = math.hypot(max(b[0] - t["x"], 0, t["x"] - b[2]), max(b[1] - t["y"], 0, t["y"] - b[3]))
            if d <= max(least, factor * max(b[2] - b[0], b[3] - b[1])):
                pairs.append((round(d, 6), t["id"], k))
    used = {}
    for _d, t, k in sorted(pairs, key=lambda p: (p[0], p[1], p[2] + "|size")):
        if t not in used and k not in used.values():
            used[t], size_of[k] = k, tags[t][1:]
    found += [("TAG_UNASSIGNED", t, v[0]) for t, v in tags.items() if t not in used]
    out, half = [], lambda v: math.floor(v / 250 + 0.5)
    for (_d, f, kind), kept in groups.items():
        for n, (k, b) in enumerate(sorted(kept.items(), key=lambda kb: (half(kb[1][1]), half(kb[1][0]), kb[0])), 1):
            base, w, d, thk = size_of.get(k, (-1, -1, -1, -1))
            code, lacks = {"COLUMN": ("COLUMN_NO_SIZE", w), "BEAM": ("BEAM_NO_DEPTH", d), "SLAB": ("SLAB_NO_THICKNESS", thk), "FOOTING": ("FOOTING_NO_SIZE", thk)}[kind]
            if lacks == -1:
                found.append((code, k, f))
            dx, dy = b[2] - b[0], b[3] - b[1]
            if kind == "COLUMN" and w != -1 and (abs(min(w, d) - min(dx, dy)) > 26 or abs(max(w, d) - max(dx, dy)) > 26):
                found.append(("COLUMN_SIZE_MISMATCH", k, f))
            w, d = (dx, dy) if kind == "COLUMN" and w == -1 else (w, d)
            out.append((k, f, kind, n, base, w, d, thk, 1 if k in size_of else 0))
    grids, seen = {}, set()
    for g in lines:
        f = owner(g["drawing_id"], g["ax"], (g["ay"] + g["by"]) / 2)
        if f is None:
            continue
        seen.add((g["drawing_id"], f))
        near = [(h["x"] - g["ax"]) ** 2 + min(abs(h["y"] - g[c]) for c in ("ay", "by")) ** 2 for h in texts]
        best = min(((d, h["id"], h["text"]) for d, h in zip(near, texts) if role[h["layer"]] == "GRID" and h["drawing_id"] == g["drawing_id"] and d <= 1200**2), default=None)
        if best is None:
            found.append(("GRID_NO_LABEL", g["id"], f))
        else:
            grids.setdefault((g["drawing_id"], f, best[2]), []).append(g["id"])
    found += [("GRID_DUPLICATE_LABEL", f"X {label}", f) for (_d, f, label), v in grids.items() if len(v) > 1]
    return out, found + [("NO_GRIDS", -1, f) for d, fs in floors.items() for _n, f, _r in fs if (d, f) not in seen]


PLAIN = {
    "l01_all_kinds": (("id", "floor_id", "role", "number", "mark", "width_mm", "depth_mm", "thickness_mm", "n_tags"), lambda *a: plain_whole_extract(*a)[0]),
    "l01_findings": (("code", "element_id", "floor_id"), lambda *a: plain_whole_extract(*a)[1]),
    "j01_greedy_match": (("a", "b", "score"), plain_greedy), "j02_shared_tags": (("tag", "element"), plain_shared), "j03_ordered_keep": (("id", "kept"), plain_keep),
    "j04_stacks": (("id", "floor_no", "stack", "jump", "orphan"), plain_stacks), "j05_groups": (("node", "root"), plain_groups), "j07_panels": (("drawing", "x0", "y0", "area", "oversize"), plain_panels),
    "j03_edge_pairs": (("a", "b", "t1", "t2"), plain_edges),
    "j06_closed_faces": (("drawing", "x0", "y0", "x1", "y1", "area"), plain_faces),
    "j10_outlines": (("floor_id", "layer", "source_kind", "handles", "merged", "area", "x0", "y0", "x1", "y1"), plain_outlines),
    "j08_trimmed_junctions": (("rect_id", "floor_id", "x0", "y0", "x1", "y1", "trimmed"), plain_trimmed), "l01_extract": (("rect_id", "floor_id", "note_id", "number"), plain_extract),
}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name not in catalog.SQL:
        assert name in PLAIN, "a query without SQL needs a plain version"
        got = sorted(tuple(-1 if r[c] is None else r[c] for c in PLAIN[name][0]) for r in df.collect())
        want = sorted(PLAIN[name][1](spark, sf))
        assert got == want and got
        return
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["e05_smallest_container", "g13_fill_numbers", "j01_greedy_match", "f06_common_thickness"])
def test_partitions_do_not_matter(spark, sf, name):
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(repr, catalog.QUERIES[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_edits_raise_their_codes(spark, sf):
    m, _ = snapshots(spark, sf)
    assert compare(m, m).isEmpty()
    first = m.orderBy("id").first()["id"]
    codes = lambda d: {r["code"] for r in compare(m, d).collect()}
    assert codes(m.where(f"id <> {first}")) == {"RT_MISSING"}
    assert codes(m.selectExpr("id", "floor_id", f"x0 + if(id = {first}, 500, 0) x0", "y0", f"x1 + if(id = {first}, 500, 0) x1", "y1")) == {"RT_MOVED"}
    assert codes(m.selectExpr("id", "floor_id", "x0", "y0", "x1", f"y1 + if(id = {first}, 90, 0) y1")) == {"RT_MOVED", "RT_RESIZED"}
    assert codes(m.unionByName(m.where(f"id = {first}").selectExpr("-id id", "floor_id", "x0 - 900000 x0", "y0", "x1 - 900000 x1", "y1"))) == {"RT_ADDED"}


def test_unsplit_outlines_are_handed_back(spark, sf):
    rows = catalog.QUERIES["j09_split_legs"](spark, sf).collect()
    legs = {}
    for r in rows:
        legs.setdefault(r["rect_id"], []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    shapes = {}  # ids repeat
    for r in view(spark, sf, "vR").collect():
        shapes.setdefault(r["rect_id"], []).append((r["x0"], r["y0"], r["x0"] + r["w"], r["y0"] + r["h"]))
    assert set(legs) == set(shapes)
    for i, boxes in shapes.items():
        assert len(legs[i]) == len(boxes) * (2 if i % 3 == 0 else 1)
        for k, f in enumerate((min, min, max, max)):
            assert f(x[k] for x in legs[i]) == f(x[k] for x in boxes)


def test_thin_outlines_keep_their_box(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (300, 0), (300, 40), (0, 40))]
    frame = spark.createDataFrame([(1, ring)], "rect_id long, ring array<struct<x:double,y:double>>")
    assert [tuple(r) for r in faces.split_outlines(frame, "rect_id").drop("outline").collect()] == [(1, 1, 0.0, 0.0, 300.0, 40.0)]
