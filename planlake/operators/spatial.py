"""Spatial joins of points and axis-aligned boxes.

Every join has one plan: both sides get a grid cell as an equi-join key next to the given keys (a drawing
and floor), boxes once for each cell they touch; the exact predicate filters the pairs. A pair of boxes
that shares several cells is kept only in the cell of its overlap's lower left corner, so there is
nothing to de-duplicate. Without the cell a range predicate would be a nested loop. Cells should be
about as wide as the boxes: a box then has about four. The join is a sort-merge join by hint, because
sizes after an explode are guesses; AQE splits a crowded cell.

Boxes have columns x0, y0, x1, y1; points have x, y. Names of the two sides must differ but for the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def with_cells(boxes: DataFrame, size: float, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1", grow: Column | float = 0.0) -> DataFrame:
    """boxes once for each cell (_cx, _cy) that they touch, grown by grow on all sides."""
    g = grow if isinstance(grow, Column) else F.lit(float(grow))
    span = lambda lo, hi: F.sequence(_cell(F.col(lo) - g, size), _cell(F.col(hi) + g, size))
    return boxes.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance of a point from a box, 0 inside."""
    dx = F.greatest(x0 - x, F.lit(0), x - x1)
    dy = F.greatest(y0 - y, F.lit(0), y - y1)
    return dx * dx + dy * dy


def points_in_boxes(points: DataFrame, boxes: DataFrame, on: Sequence[str] = (), cell: float = 1000, grow: Column | float = 0.0, inside: Column | None = None, how: str = "inner", cells: bool = False) -> DataFrame:
    """Pairs of points and the boxes, grown by grow, that hold them strictly inside (or that inside says).

    how: inner, or left (points without a box stay), or left_semi, or left_anti. cells: keep the cell (_cx, _cy) of the point; pairs grouped by on, the cell
    and the point are where they are made, so they are not shuffled.
    """
    g = grow if isinstance(grow, Column) else F.lit(grow)
    p = points.withColumn("_cx", _cell(F.col("x"), cell)).withColumn("_cy", _cell(F.col("y"), cell))
    b = with_cells(boxes, cell, grow=grow).withColumnsRenamed({k: f"_r_{k}" for k in (*on, "_cx", "_cy")})
    keys = [F.col(k) == F.col(f"_r_{k}") for k in (*on, "_cx", "_cy")]
    if inside is None:
        inside = (F.col("x") > F.col("x0") - g) & (F.col("x") < F.col("x1") + g) & (F.col("y") > F.col("y0") - g) & (F.col("y") < F.col("y1") + g)
    out = p.join(b.hint("merge"), [*keys, inside], how)
    return out.drop(*([] if cells else ["_cx", "_cy"]), *[f"_r_{k}" for k in (*on, "_cx", "_cy")])


def with_points(boxes: DataFrame, points: DataFrame, on: Sequence[str], cell: float, row: Column, at: Callable[[Column], tuple[Column, Column]], how: str = "left") -> DataFrame:
    """boxes with held: the rows (a struct of columns of points) of all points strictly inside, in order; empty or null if there are none.

    how: left, or inner (boxes without points go).

    at: x and y of a row. Pairs are not made as rows of their own, so neither shuffled nor sorted: a box is in one place only, the cell of
    its lower left corner, and the points of the cells that it can reach are there as one sorted array. Cells are of the
    given size, or doubled until a box is no larger, so each point is in four cells of every size that occurs.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.when(side > cell, F.ceil(F.log2(side / F.lit(float(cell))))).otherwise(0).cast("int")
    b = boxes.withColumn("_level", level)
    levels = sorted(r["_level"] for r in b.select("_level").distinct().collect()) or [0]  # doublings, so few
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), "_level")
    home = lambda c: F.floor(F.col(c) / size).cast("long")
    b = b.withColumns({"_cx": home("x0"), "_cy": home("y0")})
    near = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])))
    for c, v in (("_cx", "x"), ("_cy", "y")):
        near = near.withColumn(c, F.explode(F.array(home(v), home(v) - 1)))
    keys = [*on, "_level", "_cx", "_cy"]
    around = near.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_around"))
    inside = lambda p: (p[0] > F.col("x0")) & (p[0] < F.col("x1")) & (p[1] > F.col("y0")) & (p[1] < F.col("y1"))
    out = b.join(around.hint("merge"), keys, how)
    if how == "inner":
        out = out.where(F.exists("_around", lambda r: inside(at(r))))  # a filter on held would look at all twice
    return out.withColumn("held", F.filter("_around", lambda r: inside(at(r)))).drop("_around", "_level", "_cx", "_cy")


def overlaps(a: DataFrame, b: DataFrame, on: Sequence[str] = (), cell: float = 1000, grow: float = 0.0, touch: bool = False) -> DataFrame:
    """Pairs of boxes of a and b (columns prefixed b_) that overlap; ox, oy: the overlap's sides, overlap: its area.

    grow: b's boxes are grown by it on all sides first. touch: shared edges count too (area 0).
    """
    b = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    g = F.lit(grow)
    left = with_cells(a, cell)
    right = with_cells(b, cell, "b_x0", "b_y0", "b_x1", "b_y1", grow).withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"})
    lx, ly = F.greatest("x0", F.col("b_x0") - g), F.greatest("y0", F.col("b_y0") - g)  # of the pair, so that grown sides are not shuffled
    ox, oy = F.least("x1", F.col("b_x1") + g) - lx, F.least("y1", F.col("b_y1") + g) - ly
    meets = (ox >= 0) & (oy >= 0) if touch else (ox > 0) & (oy > 0)
    keys = [F.col(k) == F.col(f"b_{k}") for k in on] + [F.col("_cx") == F.col("_rx"), F.col("_cy") == F.col("_ry")]
    one = (F.col("_cx") == _cell(lx, cell)) & (F.col("_cy") == _cell(ly, cell))
    out = left.join(right.hint("merge"), [*keys, meets, one])
    return out.withColumns({"ox": ox, "oy": oy, "overlap": ox * oy}).drop("_cx", "_cy", "_rx", "_ry")


def held_whole(inner: DataFrame, outer: DataFrame, on: Sequence[str], cell: float) -> DataFrame:
    """Pairs of boxes of inner (columns prefixed i_) and of outer that hold them whole, edges included.

    An inner box meets the outer ones in the cell of its lower left corner only, so it is in one place however large it is.
    """
    points = inner.select(*on, *[F.col(c).alias(f"i_{c}") for c in inner.columns if c not in on], F.col("x0").alias("x"), F.col("y0").alias("y"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("y") >= F.col("y0")) & (F.col("i_x1") <= F.col("x1")) & (F.col("i_y1") <= F.col("y1"))
    return points_in_boxes(points, outer, on, cell, inside=inside).drop("x", "y")


def touching_links(boxes: DataFrame, id_col: str, on: Sequence[str], cell: float) -> DataFrame:
    """on, a, b (a < b): links that connect the same boxes as all pairs of boxes that overlap() do, if not all of these pairs.

    A box that covers a cell whole overlaps all that reach into it, so there one link each, to the first such box, will do; boxes alike in
    all sides go as one. Pairs are looked for only in cells that no box covers, which grow rarer as boxes get denser.
    """
    every = boxes.where("x1 > x0 and y1 > y0").select(*on, F.col(id_col).alias("id"), "x0", "y0", "x1", "y1")
    b = every.groupBy(*on, "x0", "y0", "x1", "y1").agg(F.min("id").alias("id"))
    alike = every.join(b.withColumnRenamed("id", "first").hint("merge"), [*on, "x0", "y0", "x1", "y1"]).where("id <> first").select(*on, F.col("first").alias("a"), F.col("id").alias("b"))
    b = with_cells(b, cell).where((F.col("x1") > F.col("_cx") * cell) & (F.col("y1") > F.col("_cy") * cell))
    whole = (F.col("x0") <= F.col("_cx") * cell) & (F.col("x1") >= (F.col("_cx") + 1) * cell) & (F.col("y0") <= F.col("_cy") * cell) & (F.col("y1") >= (F.col("_cy") + 1) * cell)
    keys = [*on, "_cx", "_cy"]
    first = b.where(whole).groupBy(*keys).agg(F.min("id").alias("first"))
    star = b.join(first.hint("merge"), keys).where("id <> first").select(*on, F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
    left = b.join(first.hint("merge"), keys, "left_anti")
    right = left.withColumnsRenamed({c: f"b_{c}" for c in left.columns})
    lx, ly = F.greatest("x0", "b_x0"), F.greatest("y0", "b_y0")
    meets = (F.least("x1", "b_x1") > lx) & (F.least("y1", "b_y1") > ly) & (F.col("_cx") == _cell(lx, cell)) & (F.col("_cy") == _cell(ly, cell))
    pairs = left.join(right.hint("merge"), [*[F.col(k) == F.col(f"b_{k}") for k in keys], F.col("id") < F.col("b_id"), meets])
    return alike.unionByName(star).unionByName(pairs.select(*on, F.col("id").alias("a"), F.col("b_id").alias("b"))).distinct()


def area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def iou() -> Column:
    """Overlap over union of a pair that overlaps() made, to six places."""
    return F.round(share(), 6)


def share() -> Column:
    """Overlap over union. A filter on it may be tried on pairs of a cell that do not overlap, whose "union" can be 0: null there."""
    return F.try_divide(F.col("overlap"), area() + area("b_") - F.col("overlap"))


def near_values(points: DataFrame, lines: DataFrame, value: str, at: str, within: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of points and lines (one axis) whose positions value and at differ by at most within."""
    p = points.withColumn("_c", _cell(F.col(value), within))
    n = lines.withColumn("_rc", F.explode(F.sequence(_cell(F.col(at) - F.lit(within), within), _cell(F.col(at) + F.lit(within), within))))
    n = n.withColumnsRenamed({k: f"_r_{k}" for k in on})
    keys = [F.col("_c") == F.col("_rc"), *[F.col(k) == F.col(f"_r_{k}") for k in on]]
    return p.join(n.hint("merge"), [*keys, F.abs(F.col(value) - F.col(at)) <= within]).drop("_c", "_rc", *[f"_r_{k}" for k in on])


def best(pairs: DataFrame, by: Sequence[str], order: Sequence[Column], take: dict[str, Column]) -> DataFrame:
    """Of every group of by the row that is least in order; take names its columns.

    Tasks sort their pairs before the partial aggregate, as the buffer has no fixed width: for pairs that may be many see least().
    """
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[c.alias(k) for k, c in take.items()]).alias("row"))
    return pairs.groupBy(*by).agg(F.min(row).alias("_m")).select(*by, *[F.col(f"_m.row.{k}").alias(k) for k in take])


#: Bits of the first and the second value of a pair that is packed into a long.
_FIRST, _SECOND = 29, 33


def least(pairs: DataFrame, by: Sequence[str], first: Column, second: Column, **more: Column) -> DataFrame:
    """Of every group of by the least (first, second), both integers; more: further aggregates.

    The pairs go through a hash aggregate as they come, so a task keeps a row for each group, however many
    pairs there are. Two values are packed into one long; those that do not fit go into a decimal (first within 2^61).
    """
    a, b, word = first.cast("long"), second.cast("long"), 1 << 64
    fits = a.between(-(1 << _FIRST), (1 << _FIRST) - 1) & b.between(0, (1 << _SECOND) - 1)
    long = F.when(fits, F.shiftleft(a, _SECOND) + b)
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    wide = F.when(~fits, ((a.cast("decimal(20,0)") + number(1 << 61)).cast("decimal(20,0)") * number(word) + (b.cast("decimal(20,0)") + number(1 << 63))).cast("decimal(38,0)"))
    m = pairs.groupBy(*by).agg(F.min(long).alias("_m"), F.min(wide).alias("_w"), *[c.alias(k) for k, c in more.items()])
    low = F.col("_w") % number(word)
    of_long = F.when(F.col("_m").isNotNull(), F.struct(F.shiftright("_m", _SECOND).alias("first"), F.col("_m").bitwiseAND(F.lit((1 << _SECOND) - 1)).alias("second")))
    of_wide = F.when(F.col("_w").isNotNull(), F.struct((F.expr(f"_w div {word}BD") - F.lit(1 << 61)).alias("first"), (low - number(1 << 63)).cast("long").alias("second")))
    best = F.least(of_long, of_wide)
    return m.select(*by, best["first"].alias("first"), best["second"].alias("second"), *more)
