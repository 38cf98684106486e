"""Column expressions over rings (arrays of points x, y), boxes and directions. Degrees; positive is counter-clockwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring_of_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def rectangle(cx: Column, cy: Column, w: Column, d: Column, rotation: Column) -> Column:
    """Corners of a rectangle by centre, sides and rotation."""
    c, s = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
    corner = lambda i, j: point(cx + w / 2 * i * c - d / 2 * j * s, cy + w / 2 * i * s + d / 2 * j * c)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def _following(ring: Column) -> Column:
    """The ring, turned by one: each point's successor."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _edges(ring: Column) -> Column:
    return F.arrays_zip(ring.alias("a"), _following(ring).alias("b"))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def signed_area(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Centroid of the area; of the points if there is none."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    a6 = F.nullif(signed_area(ring) * 6, F.lit(0.0))
    at = lambda k: F.coalesce(_sum(_edges(ring), lambda e: (e["a"][k] + e["b"][k]) * cross(e)) / a6, _sum(ring, lambda p: p[k]) / F.size(ring))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring (edges left of it are crossed an odd number of times)."""
    a, b = (lambda e: e["a"]), (lambda e: e["b"])
    at = lambda e: a(e)["x"] + (y - a(e)["y"]) / (b(e)["y"] - a(e)["y"]) * (b(e)["x"] - a(e)["x"])
    crossed = F.filter(_edges(ring), lambda e: F.when((a(e)["y"] > y) != (b(e)["y"] > y), at(e) > x).otherwise(False))
    return F.size(crossed) % 2 == 1


def interval(ring: Column, angle: Column) -> Column:
    """t1, t2 of a ring's projection on an axis."""
    t = F.transform(ring, lambda p: along(p["x"], p["y"], angle))
    return F.struct(F.array_min(t).alias("t1"), F.array_max(t).alias("t2"))


def inside_point(ring: Column, digits: int = 3) -> Column:
    """A point inside a ring: its centroid (rounded), or else the middle of the widest span that the ring has half way up its box."""
    middle = lambda r: (bounds(r)["y0"] + bounds(r)["y1"]) / 2

    def widest(r: Column) -> Column:
        # a scan line on a vertex would meet it twice or never, so it runs half way to the next vertex above
        above = F.array_min(F.filter(F.transform(r, lambda p: p["y"]), lambda y: y > middle(r)))
        touched = F.exists(r, lambda p: p["y"] == middle(r))
        return _bound(F.when(touched, (middle(r) + above) / 2).otherwise(middle(r)), lambda y: _span(r, y))

    def _span(r: Column, y: Column) -> Column:
        met = F.filter(_edges(r), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        xs = F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])))
        return _bound(xs, lambda x: _best_of(x, y))

    def _best_of(x: Column, y: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1)), F.lit(2)), lambda i: F.struct((F.element_at(x, i + 1) - F.element_at(x, i)).alias("w"), ((F.element_at(x, i) + F.element_at(x, i + 1)) / 2).alias("x")))
        return F.struct(F.array_max(pairs)["x"].alias("x"), y.alias("y"))

    c = _bound(centroid(ring), lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    return _bound(c, lambda p: F.when(holds(ring, p["x"], p["y"]), p).otherwise(widest(ring)))


def bounds(ring: Column) -> Column:
    of = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def gap(ring: Column) -> Column:
    """Distance of a polyline's last point from its first."""
    a, z = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    return F.hypot(a["x"] - z["x"], a["y"] - z["y"])


def cleaned(ring: Column, tolerance: float) -> Column:
    """Points without repeats (within tolerance), the closing point too; null if fewer than three are left or the area is none."""
    keep = F.aggregate(ring, F.array().cast(f"array<{POINT}>"), lambda acc, p: F.when((F.size(acc) > 0) & (F.hypot(F.try_element_at(acc, F.lit(-1))["x"] - p["x"], F.try_element_at(acc, F.lit(-1))["y"] - p["y"]) <= tolerance), acc).otherwise(F.concat(acc, F.array(p))))
    # values that are used more than once are bound by a transform of one item, so they are computed once
    open_ = _bound(keep, lambda k: F.when((F.size(k) > 1) & (gap(k) <= tolerance), F.slice(k, 1, F.size(k) - 1)).otherwise(k))
    return _bound(open_, lambda k: F.when((F.size(k) >= 3) & (area(k) > 0), k))


def _bound(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def direction(dx: Column, dy: Column) -> Column:
    """Direction in [0, 180)."""
    a = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    return F.when(F.round(a, 9) == 180, 0.0).otherwise(a)


def direction_difference(a: Column, b: Column) -> Column:
    """Difference of two directions, in [0, 90]."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180 - d)


def direction_bucket(a: Column, tolerance: float) -> Column:
    return F.pmod(F.round(a / tolerance), F.lit(float(round(180 / tolerance)))).cast("int")


def along(x: Column, y: Column, angle: Column) -> Column:
    return x * F.cos(F.radians(angle)) + y * F.sin(F.radians(angle))


def across(x: Column, y: Column, angle: Column) -> Column:
    return y * F.cos(F.radians(angle)) - x * F.sin(F.radians(angle))


def upright(rotation: Column) -> Column:
    """Rotation of a text that reads from the bottom or the right: in (-90, 90]."""
    r = F.pmod(rotation + 90, F.lit(180.0))
    return F.when(r == 0, 90.0).otherwise(r - 90)


def text_box(text: Column, height: Column, factor: float = 0.7, line: float = 1.5) -> dict[str, Column]:
    """Width and height of a text's box from its longest line and the number of lines."""
    lines = F.split(text, "\n")
    return {"box_w": F.array_max(F.transform(lines, lambda s: F.length(s))) * height * factor, "box_h": height * (1 + (F.size(lines) - 1) * line)}


def largest_fit(ladder: list[float], text: Column, w: Column, d: Column, factor: float = 0.6) -> Column:
    """The largest height of the ladder at which a text fits w x d; the smallest if none does."""
    steps = F.array(*[F.lit(float(h)) for h in ladder])
    ok = F.filter(steps, lambda h: (F.length(text) * h * factor <= w) & (h <= d))
    return F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit(float(ladder[-1])))


def wall_like(w: Column, d: Column, ratio: float, least: float) -> Column:
    """At least ratio times as long as wide and least long."""
    return (F.greatest(w, d) >= ratio * F.least(w, d)) & (F.greatest(w, d) >= least)


def shorten(a0: Column, a1: Column, b0: Column, b1: Column, least: float) -> Column:
    """Interval a pulled back to be clear of b; null where b lies in its middle or too little is left."""
    cut = F.when((b1 <= a0) | (b0 >= a1), F.struct(a0.alias("t1"), a1.alias("t2"))).when((b0 <= a0) & (b1 < a1), F.struct(b1.alias("t1"), a1.alias("t2"))).when((b1 >= a1) & (b0 > a0), F.struct(a0.alias("t1"), b0.alias("t2")))
    return F.when(cut["t2"] - cut["t1"] >= least, cut)
