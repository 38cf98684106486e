"""Runs of a ring's vertices on known circles as arcs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]


def with_bulges(ring: list[Point], circles: list[tuple[float, float, float]], tolerance: float) -> tuple[list[Point], list[float]]:
    """Vertices, and the bulge (tangent of a quarter of the sweep, positive if counter-clockwise) of what leads from each to the next.

    A vertex is on the first circle (x, y, r) that it is within tolerance of. A run of two or more vertices on one circle, round the
    ring's end too, becomes its two ends; three or more tell by the middle one which way round it goes, two go the
    shorter way. A ring all on one circle becomes two half circles; one all on circles is turned to where the circle changes.
    """
    return _reduced(ring, circles, [next((k for k, (x, y, r) in enumerate(circles) if abs(math.dist(p, (x, y)) - r) <= tolerance), None) for p in ring])


def _reduced(ring: list[Point], circles: list[tuple[float, float, float]], on: list[int | None]) -> tuple[list[Point], list[float]]:
    """with_bulges() of vertices whose circles are known."""
    n = len(ring)
    if n < 3 or not any(k is not None for k in on):
        return list(ring), [0.0] * n
    starts = [i for i in range(n) if on[i] != on[i - 1] or on[i] is None]
    if not starts:
        a, z = ring[0], ring[n // 2]
        way = 1.0 if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) > 0 else -1.0
        return [a, z], [way, way]
    points: list[Point] = []
    bulges: list[float] = []
    for i, s in enumerate(starts):
        end = starts[(i + 1) % len(starts)]
        many = (end - s) % n or n
        if on[s] is None or many == 1:
            points.append(ring[s])
            bulges.append(0.0)
            continue
        run = (ring + ring)[s : s + many]
        x, y, _ = circles[on[s]]
        turn = lambda p: (math.atan2(p[1] - y, p[0] - x) - math.atan2(run[0][1] - y, run[0][0] - x)) % (2 * math.pi)  # noqa: B023, E731
        sweep = turn(run[-1])
        forward = turn(run[(len(run) - 1) // 2]) <= sweep if len(run) > 2 else sweep <= math.pi
        points += [run[0], run[-1]]
        bulges += [math.tan((sweep if forward else sweep - 2 * math.pi) / 4), 0.0]
    return points, bulges


def fitted(rings: DataFrame, tolerance: float) -> DataFrame:
    """rings (ring: points, circles: x, y, r, and more) with ring reduced and bulges of its vertices. Null rings stay null; without circles nothing changes."""
    point = "array<struct<x:double,y:double>>"
    src = rings.withColumn("ring", F.col("ring").cast(point)).withColumn("bulges", F.lit(None).cast("array<double>"))
    names = src.columns
    at = {c: names.index(c) for c in ("ring", "circles", "bulges")}

    def flat(lists: pa.ListArray, fields: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts and ends of the lists (alike for null) and the fields of all their structs."""
        at = lists.offsets.to_numpy()
        ends = np.where(lists.is_null().to_numpy(zero_copy_only=False), at[:-1], at[1:])
        return at[:-1], ends, [lists.values.field(f).to_numpy(zero_copy_only=False).astype(float) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings = b.column(at["ring"])
            (start, end, (x, y)), (first, last, circle) = flat(rings, "xy"), flat(b.column(at["circles"]), "xyr")
            # the first circle that each vertex of the batch is on; -1 for none
            of, on = np.repeat(np.arange(len(start)), end - start), np.full(len(x), -1)
            place = np.repeat(start - np.cumsum(end - start) + end - start, end - start) + np.arange(len(of))
            for k in range(int((last - first).max(initial=0))):
                some = (first[of] + k < last[of]) & (on[place] < 0)
                p, c = place[some], first[of[some]] + k
                on[p[np.abs(np.hypot(x[p] - circle[0][c], y[p] - circle[1][c]) - circle[2][c]) <= tolerance]] = k
            points, seen = list(zip(x.tolist(), y.tolist())), [k if k >= 0 else None for k in on.tolist()]
            known, null = list(zip(*(c.tolist() for c in circle))), rings.is_null().to_numpy(zero_copy_only=False)
            out_p, out_b, sizes = [], [], [0]
            for i, j, f, t in zip(start.tolist(), end.tolist(), first.tolist(), last.tolist()):
                pts, bulges = _reduced(points[i:j], known[f:t], seen[i:j])
                out_p += pts
                out_b += bulges
                sizes.append(len(out_p))
            sizes, mask = pa.array(sizes, pa.int32()), pa.array(null)
            xy = np.array(out_p, float).reshape(-1, 2)
            cols = list(b.columns)
            cols[at["ring"]] = pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]), mask=mask)
            cols[at["bulges"]] = pa.ListArray.from_arrays(sizes, pa.array(out_b, pa.float64()), mask=mask)
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields))
