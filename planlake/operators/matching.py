"""Ordered one-to-one matching, ordered keep and drop, identity across floors, connected groups.

The results are those of a sequential greedy pass under a total order, but made in rounds: a round settles
every pair (row) that nothing before it can still affect, which are independent of each other. Rounds go
on until nothing is left; each settles one pair at least, and few suffice unless a long chain of pairs
depends on each other. Each round is written to the shared checkpoint folder, so lineage and lost executors
cost one round, and what it replaces is deleted.
"""

from __future__ import annotations

import functools
import heapq
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="planlake-")


def _folder(spark: SparkSession) -> str:
    """The shared folder; only a session that runs in one process gets one of its own where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or _own_folder()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with the session."""
    name = f"{_folder(spark)}/planlake/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


class Rounds:
    """Tables written for rounds of one pass."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def _path(self, df: DataFrame):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][1])
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def settled(self, df: DataFrame) -> DataFrame:
        """df, written to the shared folder and read back."""
        path = f"{_folder(self.spark)}/planlake/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # out is held, so that its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, fs = self._path(t)
            fs.delete(path, True)
            del self.paths[id(t)]

    def close(self, *keep: DataFrame) -> None:
        """Delete all tables but those that a result reads, which go with the session."""
        kept = {id(k) for k in keep}
        for key, (t, _) in list(self.paths.items()):
            if key in kept:
                path, fs = self._path(t)
                fs.deleteOnExit(path)
            else:
                self.drop(t)


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, for as long as the session."""
    r = Rounds(df.sparkSession)
    out = r.settled(df)
    r.close(out)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Rounds before what is left is looked at by connected group, and pairs of a group that one task takes in order.
FIRST, GROUP = 4, 50_000


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """a, b, score of the pairs that a greedy pass by (score, a, b) takes, each a and b once.

    A round takes the pairs that are the best of both their ends. What FIRST rounds leave is in groups that
    no pair connects; small ones are gone through in order, each by itself, and only large ones have more rounds.
    """
    r = Rounds(pairs.sparkSession)
    left, out, n = r.settled(pairs.select("a", "b", "score").distinct()), [], 0
    while not left.isEmpty():
        row = F.struct("score", "a", "b")
        first_a = left.groupBy("a").agg(F.min(row).alias("ma"))
        first_b = left.groupBy("b").agg(F.min(row).alias("mb"))
        best = left.join(first_a.hint("merge"), "a").join(first_b.hint("merge"), "b")
        taken = r.settled(best.where((F.struct("score", "a", "b") == F.col("ma")) & (F.col("ma") == F.col("mb"))).select("a", "b", "score"))
        out.append(taken)
        rest = r.settled(left.join(taken.select("a").hint("merge"), "a", "left_anti").join(taken.select("b").hint("merge"), "b", "left_anti").select("a", "b", "score"))
        r.drop(left)
        left, n = rest, n + 1
        if n == FIRST and not left.isEmpty():
            small, large = _in_order(left, r)
            out.append(r.settled(small))
            rest = r.settled(large)
            r.drop(left)
            left = rest
    out = out or [left]
    r.close(*out)
    return _union(out)


#: Candidate pairs up to which greedy_in_steps() takes them all at once.
AT_ONCE = 5_000_000


def greedy_in_steps(a: DataFrame, b: DataFrame, candidates: Callable[[DataFrame, DataFrame, float | None], DataFrame], steps: Sequence[float], few: int = AT_ONCE) -> DataFrame:
    """What greedy_pairs() takes of candidates(a, b, None), whose pairs need never be there all at once.

    candidates gives the pairs (a, b, score) of rows of a and b with a score of at most its last argument (None: all). The
    pass goes by ascending score, so what it takes up to a step does not depend on later pairs, and of those only
    the pairs of rows still free are looked for. A pair may come with several scores. steps: ascending scores, for more than few pairs.
    """
    r, out, last = Rounds(a.sparkSession), [], []
    if candidates(a, b, None).count() > few:
        for most in steps:
            out.append(greedy_pairs(candidates(a, b, most)))
            rest = [r.settled(t.join(out[-1].select(k).hint("merge"), k, "left_anti")) for t, k in ((a, "a"), (b, "b"))]
            r.drop(*last)
            a, b = last = rest
    out.append(greedy_pairs(candidates(a, b, None)))
    r.close()
    return _union(out)


#: Pairs of places that one task of greedy_places() goes through at a time.
IN_GROUP = 3_000_000


def in_turn(score: np.ndarray, place: np.ndarray, element: np.ndarray, tags: Sequence[Sequence], used: list[int], taken: bytearray) -> Iterator[tuple]:
    """place, tag, element, score of what a greedy pass by (score, tag, element) takes, each tag and element once, of pairs of places and elements.

    Every tag of a place (tags: ascending) has the pairs of the place, so those that a place gives away are its first ones; used counts them.
    Elements are numbers in their order; taken marks those that are. Pairs alike in score go by the least tag left (a heap of places).
    """
    order = np.lexsort((element, score))
    start = np.flatnonzero(np.append(True, np.diff(score[order]) != 0)) if len(order) else order
    end = np.append(start[1:], len(order))
    sizes, part = [len(t) for t in tags], 500_000
    for at in range(0, len(start), part):  # numbers of Python's own only for a part at a time
        low, high = int(start[at]), int(end[min(at + part, len(end)) - 1])
        some = order[low:high]
        values, places, elements = score[some].tolist(), place[some].tolist(), element[some].tolist()
        for i, j in zip((start[at : at + part] - low).tolist(), (end[at : at + part] - low).tolist()):
            if j == i + 1:
                p, e = places[i], elements[i]
                if not taken[e] and used[p] < sizes[p]:
                    taken[e] = 1
                    used[p] += 1
                    yield p, tags[p][used[p] - 1], e, values[i]
                continue
            left: dict[int, list[int]] = {}
            for k in range(j - 1, i - 1, -1):  # the least element comes last
                if not taken[elements[k]] and used[places[k]] < sizes[places[k]]:
                    left.setdefault(places[k], []).append(elements[k])
            heap = [(tags[p][used[p]], p) for p in left]
            heapq.heapify(heap)
            while heap:
                tag, p = heap[0]
                mine = left[p]
                while mine and taken[mine[-1]]:
                    mine.pop()
                if mine:
                    taken[mine[-1]] = 1
                    used[p] += 1
                    yield p, tag, mine.pop(), values[i]
                if mine and used[p] < sizes[p]:
                    heapq.heapreplace(heap, (tags[p][used[p]], p))
                else:
                    heapq.heappop(heap)


def by_place(tags: DataFrame, id_col: str, alike: Sequence[str]) -> DataFrame:
    """place, alike, tags: the ids, ascending and each once, of the tags that are alike in alike; written."""
    p = tags.groupBy(*alike).agg(F.array_sort(F.collect_set(id_col)).alias("tags"))
    return kept(p.withColumn("place", F.monotonically_increasing_id()))


def greedy_places(places: DataFrame, b: DataFrame, candidates: Callable[[DataFrame, DataFrame, float | None], DataFrame], on: list[str], steps: Sequence[float], few: int = IN_GROUP) -> DataFrame:
    """a, b, score: what greedy_pairs() takes of the pairs of all tags of places (see by_place) and rows of b (on, b and more).

    candidates gives the pairs (on, place, b, score) with a score of at most its last argument (None: all). Tags in one place have the same
    pairs, so only the pairs of places are made. No pair reaches from one group of on into another, and one task goes
    through the pairs of a group. More than few pairs of a group go by some of the steps, of ascending score: of each only the pairs of
    what is still free are looked for. A pair may come with several scores. b are longs.
    """
    r, out, last, every = Rounds(places.sparkSession), [], [], places.columns
    kind = places.schema["tags"].dataType.elementType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        own = t.column("a").is_valid()
        p, c = t.filter(own).sort_by([("place", "ascending"), ("a", "ascending")]), t.filter(pc.invert(own))
        ids, start = np.unique(p.column("place").to_numpy(), return_index=True)
        flat, cuts = p.column("a").to_pylist(), [*start.tolist(), len(p)]
        elements, element = np.unique(c.column("b").to_numpy(), return_inverse=True)
        place = np.searchsorted(ids, c.column("place").to_numpy())
        tags = [flat[i:j] for i, j in zip(cuts, cuts[1:])]
        rows = list(in_turn(c.column("score").to_numpy(), place, element, tags, [0] * len(ids), bytearray(len(elements))))
        of, a, b, score = zip(*rows) if rows else [()] * 4
        return pa.table([pa.array(ids[list(of)], pa.int64()), pa.array(a, t.schema.field("a").type), pa.array(elements[list(b)], pa.int64()), pa.array(score, pa.float64())], names=["place", "a", "b", "score"])

    def taken(places: DataFrame, pairs: DataFrame) -> DataFrame:
        # plain columns: a null array in most rows takes the JVM far longer to hand over than the pass itself
        rows = places.select(*on, "place", F.explode("tags").alias("a")).unionByName(pairs.select(*on, "place", "b", "score"), allowMissingColumns=True)
        return r.settled(rows.groupBy(*on).applyInArrow(run, f"place long, a {kind}, b long, score double"))

    stage = F.lit(len(steps))
    for i, most in reversed(list(enumerate(steps))):
        stage = F.when(F.col("score") <= most, i).otherwise(stage)
    sizes = candidates(places, b, None).groupBy(*on, stage.alias("_stage")).agg(F.count("*").alias("_n")).groupBy("_stage").agg(F.max("_n").alias("_n"))
    sizes, together, ends = {r["_stage"]: r["_n"] for r in sizes.collect()}, 0, []  # a row for each step
    for i in range(len(steps) + 1):
        together += sizes.get(i, 0)
        if i and together > few:
            ends.append(steps[i - 1])
            together = sizes.get(i, 0)
    if ends:
        for most in ends:
            out.append(taken(places, candidates(places, b, most)))
            n = out[-1].groupBy("place").agg(F.count("*").cast("int").alias("_n"))
            gone = F.coalesce("_n", F.lit(0))
            left = places.join(n.hint("merge"), "place", "left").where(F.size("tags") > gone).withColumn("tags", F.slice("tags", gone + 1, F.size("tags"))).select(*every)
            rest = [r.settled(left), r.settled(b.join(out[-1].select("b").hint("merge"), "b", "left_anti"))]
            r.drop(*last)
            places, b = last = rest
    out.append(taken(places, candidates(places, b, None)))
    r.close(*out)
    return _union(out).select("a", "b", "score")


def _in_order(left: DataFrame, r: Rounds) -> tuple[DataFrame, DataFrame]:
    """What a greedy pass takes of the small groups of left, and the pairs of the large ones."""
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))
    g = groups(left.select(end(0, "a").alias("a"), end(1, "b").alias("b")))
    named = r.settled(left.join(g.where("node.side = 0").select(F.col("node.id").alias("a"), F.col("root").alias("_root")).hint("merge"), "a"))
    sizes = named.groupBy("_root").agg(F.count("*").alias("_n"))
    kinds = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in ("a", "b", "score"))

    def run(t: pa.Table) -> pa.Table:
        t = t.select(["a", "b", "score"]).sort_by([("score", "ascending"), ("a", "ascending"), ("b", "ascending")])
        used_a, used_b, keep = set(), set(), []
        for i, (a, b) in enumerate(zip(t.column("a").to_pylist(), t.column("b").to_pylist())):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                keep.append(i)
        return t.take(pa.array(keep, pa.int64()))

    small = named.join(sizes.where(F.col("_n") <= GROUP).select("_root").hint("merge"), "_root", "left_semi").groupBy("_root").applyInArrow(run, kinds)
    large = named.join(sizes.where(F.col("_n") > GROUP).select("_root").hint("merge"), "_root", "left_semi").select("a", "b", "score")
    return small, large


#: Pairs of a block: what one task of an ordered pass goes through at a time.
BLOCK = 200_000


def _blocked(rows: DataFrame, on: list[str], order: list[str], r: Rounds, size: int) -> DataFrame:
    """rows with _block: 0 in groups of on of at most size rows; larger groups are cut into ranges of order of about size rows, numbered in that order.

    Rows alike in order stay together.
    """
    n = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    large = n.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if not large:
        return r.settled(rows.withColumn("_block", F.lit(0)))
    cut = lambda t: t.repartitionByRange(-(-large // size), *on, *order).withColumn("_block", F.spark_partition_id())
    if not on:
        return r.settled(cut(rows))
    n = n.select(*on).hint("merge")
    return r.settled(cut(rows.join(n, on, "left_semi")).unionByName(rows.join(n, on, "left_anti").withColumn("_block", F.lit(0))))


def settled_in_order(pairs: DataFrame, known: DataFrame, on: list[str], order: list[str], decide: Callable[[pa.Table], Iterable[tuple]], state: dict[str, str], size: int = BLOCK) -> DataFrame:
    """late and its state for every late of pairs, each decided from what was decided of its earlies before it.

    pairs: late, early and what else decide needs; known: early and the state of those that are no late.
    No pair reaches from one group of on into another. Groups, or blocks of about size pairs of larger ones (ranges
    of order, whose columns must say which late a row is of), go through their lates one by one. decide gets a block with the state of the earlies that are known by now and
    yields late and state of those it can tell; a late that hangs on an early of another block waits for the
    next round. So rounds grow with the number of blocks that a chain of dependence passes through, not
    with the chain, and no task holds more than a block.
    """
    r = Rounds(pairs.sparkSession)
    names = list(state)
    left = _blocked(pairs, on, order, r, size)
    kind = pairs.schema["late"].dataType.simpleString()
    shape = ", ".join([f"late {kind}", *(f"{n} {state[n]}" for n in names)])
    left_of = lambda t, seen: t.join(seen.withColumnsRenamed({n: f"_new_{n}" for n in names}).hint("merge"), "early", "left")
    now = r.settled(left_of(left, known).withColumnsRenamed({f"_new_{n}": n for n in names}))
    r.drop(left)

    def run(t: pa.Table) -> pa.Table:
        out = list(decide(t))
        cols = list(zip(*out)) if out else [()] * (1 + len(names))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, [t.schema.field("late"), *(t.schema.field(n) for n in names)])], names=["late", *names])

    out = []
    while not now.isEmpty():
        new = r.settled(now.groupBy(*on, "_block").applyInArrow(run, shape))
        out.append(new)
        rest = now.join(new.select("late").hint("merge"), "late", "left_anti")
        rest = left_of(rest, new.withColumnRenamed("late", "early"))
        nxt = r.settled(rest.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else c for c in now.columns]))
        r.drop(now)
        now = nxt
    if not out:
        r.close(now)
        return now.select("late", *names)
    r.close(*out)
    return _union(out)


def ordered_keep(rows: DataFrame, conflicts: DataFrame, size: int = BLOCK) -> DataFrame:
    """id, kept of a pass over rows (id) in ascending id that keeps a row unless an earlier kept one conflicts with it.

    conflicts: pairs (early, late), early < late.
    """
    rows, c = kept(rows.select("id").distinct()), kept(conflicts.select("early", "late").distinct())
    late = c.select(F.col("late").alias("id")).distinct()
    free = rows.join(late.hint("merge"), "id", "left_anti").withColumn("kept", F.lit(True))

    def decide(t: pa.Table) -> Iterator[tuple]:
        by: dict = {}
        for late, early, state in zip(t["late"].to_pylist(), t["early"].to_pylist(), t["kept"].to_pylist()):
            by.setdefault(late, []).append((early, state))
        known: dict = {}
        for late in sorted(by):
            states = [known.get(e) if s is None else s for e, s in by[late]]
            if True in states:
                known[late] = False
            elif None not in states:
                known[late] = True
        yield from known.items()

    done = settled_in_order(c, free.withColumnRenamed("id", "early"), [], ["late"], decide, {"kept": "boolean"}, size)
    return free.unionByName(rows.join(done.withColumnRenamed("late", "id").hint("merge"), "id"))


#: Rows up to which ordered_keep_in_steps() takes them all at once, and of its first step.
FIRST_ROWS = 200_000


def ordered_keep_in_steps(rows: DataFrame, conflicts: Callable[[DataFrame, DataFrame], DataFrame], first: int = FIRST_ROWS) -> DataFrame:
    """What ordered_keep() gives of rows (id and more) and conflicts(rows, rows), whose pairs need never be there all at once.

    conflicts gives the pairs (early, late), early < late, of its two tables. Rows go by ascending ranges of id, the first of about
    first rows, each further one as long as all before it. Of a range those go first that a row kept before conflicts
    with; only pairs of the others are written. Where rows lie densely what is kept does not, so few others are left.
    """
    r, n = Rounds(rows.sparkSession), rows.count()
    if n <= first:
        return ordered_keep(rows.select("id"), conflicts(rows, rows))
    shares = []
    while first < n:
        shares.append(first / n)
        first *= 2
    cuts = sorted({int(c) for c in rows.approxQuantile("id", shares, 0.1 * shares[0])})
    out, held = [], []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.where(F.col("id") > low)
        part = r.settled(part if high is None else part.where(F.col("id") <= high))
        if held:
            gone = r.settled(conflicts(_union(held), part).select(F.col("late").alias("id")).distinct())
            out.append(gone.withColumn("kept", F.lit(False)))
            free = r.settled(part.join(gone.hint("merge"), "id", "left_anti"))
        else:
            free = part
        done = r.settled(ordered_keep(free.select("id"), conflicts(free, free)))
        held.append(r.settled(free.join(done.where("kept").select("id").hint("merge"), "id", "left_semi")))
        out.append(done)
    result = kept(_union(out))
    r.close()
    return result


def edge_pairs(pairs: DataFrame, on: list[str], free: float = 0.5, size: int = BLOCK) -> DataFrame:
    """The pairs of edges (on, a, b, t1, t2, score and more) that a pass by (score, a, b) takes.

    A pair is taken if its interval is free to a share of at least free on both edges: what pairs taken
    before have of it counts against it, as often as they have it. Intervals of no length are not taken. A pair
    hangs only on the one before it on each of its edges, which hands on the intervals taken so far.
    """
    p = kept(pairs.where("t2 > t1").withColumn("_pair", F.monotonically_increasing_id()))
    sides = [p.select(*on, F.col(c).alias("_edge"), F.lit(c == "a").alias("_own"), "_pair", "score", "a", "b", "t1", "t2") for c in ("a", "b")]
    line = W.partitionBy(*on, "_edge").orderBy("score", "a", "b", "_pair")
    before = F.lag(F.struct(F.col("_pair").alias("pair"), F.col("_own").alias("own"))).over(line)
    steps = sides[0].unionByName(sides[1]).withColumn("_b", before)
    steps = kept(steps.select(*on, F.col("_pair").alias("late"), F.col("_b.pair").alias("early"), F.col("_b.own").alias("_early_own"), "_own", "score", "a", "b", "t1", "t2"))
    spans = "array<struct<t1:double,t2:double>>"
    state = {"taken": "boolean", "on_a": spans, "on_b": spans}

    def decide(t: pa.Table) -> Iterator[tuple]:
        by: dict = {}
        for r in zip(*(t[c].to_pylist() for c in ("score", "a", "b", "late", "_own", "early", "_early_own", "t1", "t2", "taken", "on_a", "on_b"))):
            by.setdefault((*r[:4], r[7], r[8]), []).append((r[4], r[5], r[6], r[9:]))
        done: dict = {}
        for (_, _, _, late, t1, t2), rows in sorted(by.items()):
            held = {}
            for own, early, early_own, known in rows:
                known = known if known[0] is not None else done.get(early)
                held[own] = [] if early is None else known and known[1 if early_own else 2]
            if None in held.values():
                continue
            least = min(1 - sum(max(0.0, min(i["t2"], t2) - max(i["t1"], t1)) for i in spans) / (t2 - t1) for spans in held.values())
            more = [{"t1": float(t1), "t2": float(t2)}] if least >= free else []
            done[late] = (bool(more), held[True] + more, held[False] + more)
            yield late, *done[late]

    none = steps.where("false").select("early", *[F.lit(None).cast(k).alias(c) for c, k in state.items()])
    found = settled_in_order(steps, none, on, ["score", "late"], decide, state, size)
    return p.join(found.where("taken").select(F.col("late").alias("_pair")).hint("merge"), "_pair", "left_semi").drop("_pair")


#: Edges whose groups one task finds by itself.
LOCAL = 2_000_000


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least number of the group of each of n nodes, which edges between a and b connect."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)  # roots hang on lesser roots only, so there is no circle
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _order(node):
    return tuple(v for _, v in node) if isinstance(node, tuple) else node


def _numbered(columns: list[pa.ChunkedArray]) -> tuple[list, list[np.ndarray]]:
    """Nodes in ascending order, and columns by their places in it."""
    if pa.types.is_integer(columns[0].type):
        values, place = np.unique(np.concatenate([c.to_numpy() for c in columns]), return_inverse=True)
    else:
        flat = [tuple(x.items()) if isinstance(x, dict) else x for c in columns for x in c.to_pylist()]
        values = sorted(set(flat), key=_order)
        at = {v: i for i, v in enumerate(values)}
        place = np.array([at[v] for v in flat], np.int64)
    return values, np.split(place, np.cumsum([len(c) for c in columns])[:-1])


def _contracted(batches: Iterator[pa.RecordBatch], most: int = LOCAL) -> Iterator[pa.RecordBatch]:
    """node and least node of the groups that the edges (first two columns) of some batches make; about most edges, or twice the nodes, are held at a time."""
    held, n, limit, t = [], 0, most, None

    def forest():
        t = pa.Table.from_batches(held)
        values, (a, b) = _numbered([t.column(0), t.column(1)])
        root = _labels(a, b, len(values))
        plain = lambda x: dict(x) if isinstance(x, tuple) else x
        for at in range(0, len(root), 50_000):
            some = slice(at, at + 50_000)
            if isinstance(values, np.ndarray):
                cols = [values[some], values[root[some]]]
            else:
                cols = [[plain(v) for v in values[some]], [plain(values[r]) for r in root[some].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.schema.field(0).type) for c in cols], ["node", "root"])

    for b in batches:
        held.append(pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["node", "root"]))
        n += b.num_rows
        if n > limit:
            held = list(forest())
            n = sum(x.num_rows for x in held)
            limit = max(most, 2 * n)
    if held:
        yield from forest()


def groups(edges: DataFrame, local: int = LOCAL, within: Sequence[str] = ()) -> DataFrame:
    """node, root: the least node that edges (a, b) connect each node with.

    within: columns of edges that all edges of a group have alike (a drawing or floor). If no value of them has more than four times
    local edges, each is found whole by the task that it is dealt to. Else up to local edges are one task's. More are first contracted to
    forests part by part; then labels spread and jump until a round changes none, so rounds grow with the logarithm of a path's length.
    """
    r = Rounds(edges.sparkSession)
    edges = edges.select("a", "b", *within)
    edges = r.settled(edges if within else edges.distinct())
    kind = edges.schema["a"].dataType.simpleString()
    shape = f"node {kind}, root {kind}"
    n = edges.count()
    few = n <= local
    if within and not few and edges.groupBy(*within).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] <= 4 * local:
        # four parts for each local edges, so that a task has about local at most
        parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * -(-n // local))
        forest = r.settled(edges.repartition(parts, *within).mapInArrow(_contracted, shape))
        r.close(forest)
        return forest
    edges = edges.select("a", "b")
    forest = r.settled((edges.coalesce(1) if few else edges).mapInArrow(_contracted, shape))
    if few:
        r.close(forest)
        return forest
    edges = forest.withColumnsRenamed({"node": "a", "root": "b"})
    both = r.settled(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = r.settled(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        low = label.join(near.hint("merge"), "node", "left").select("node", F.least("root", "r").alias("root"))
        jump = low.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        nxt = r.settled(low.join(jump.hint("merge"), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
        same = nxt.join(label.withColumnRenamed("root", "was").hint("merge"), "node").where("root <> was").isEmpty()
        r.drop(label)
        label = nxt
        if same:
            r.close(label)
            return label


def pairs_in_turn(pairs: DataFrame, on: list[str] = [], size: int = BLOCK) -> DataFrame:  # noqa: B006
    """a, b, score of what a pass over b in the order of turn takes: each b its best a (highest score, then least a) that is still free.

    pairs: a, b, turn, score, ok. The best pair is taken only if it is ok; if it is not, b goes without
    and a stays free. on: what a and b of a pair have in common, so that groups of it do not matter to each other.
    Groups larger than size pairs are cut into ranges of turn of about that size. A block goes through its b in order; a b
    whose best a may still go to an earlier one of another block, or to one that waits itself, waits for the
    next round. As blocks follow the order, only earlier blocks can make one wait.
    """
    r = Rounds(pairs.sparkSession)
    left, out = _blocked(pairs.select(*on, "a", "b", "turn", "score", "ok"), on, ["turn", "b"], r, size), []
    kinds = {c: left.schema[c].dataType.simpleString() for c in ("a", "b", "score")}

    def run(t: pa.Table) -> pa.Table:
        by: dict = {}
        for row in zip(*(t[c].to_pylist() for c in ("b", "a", "score", "ok", "_early", "_place"))):
            by.setdefault((row[5], row[0]), []).append((-row[2], row[1], row[3], row[4]))
        used, unsure, rows = set(), set(), []
        for (_, b), wanted in sorted(by.items()):
            for score, a, ok, early in sorted(wanted):
                if a in used:
                    continue
                if early or a in unsure:
                    unsure.update(w[1] for w in wanted)
                else:
                    rows.append((a, b, -score, ok))
                    if ok:
                        used.add(a)
                break
            else:
                rows.append((None, b, None, False))
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.Table.from_arrays([pa.array(c, t.schema.field(n).type) for c, n in zip(cols, ("a", "b", "score", "ok"))], names=["a", "b", "score", "ok"])

    place = W.partitionBy(*on, "_block").orderBy("turn", "b")
    first = True
    while not left.isEmpty():
        earliest = left.groupBy("a").agg(F.min("_block").alias("_first"))
        ready = left.join(earliest.hint("merge"), "a").withColumn("_early", F.col("_first") < F.col("_block")).drop("_first")
        if first:
            ready, first = ready.withColumn("_place", F.dense_rank().over(place)).drop("turn"), False
        sure = r.settled(ready.groupBy(*on, "_block").applyInArrow(run, f"a {kinds['a']}, b {kinds['b']}, score {kinds['score']}, ok boolean"))
        out.append(sure)
        rest = ready.join(sure.select("b").hint("merge"), "b", "left_anti").join(sure.where("ok").select("a").hint("merge"), "a", "left_anti")
        rest = r.settled(rest.drop("_early"))
        r.drop(left)
        left = rest
    if not out:
        r.close(left)
        return left.select("a", "b", "score")
    r.close(*out)
    return _union(out).where("ok").select("a", "b", "score")


def shared_out(tags: list[tuple[int, int, int, float, bool]], longest: int = 6) -> dict[int, int]:
    """Element of each tag of one connected group. tags: tag, its kind, element, score, whether it lies inside.

    A tag inside an element is that element's (of the least score, which orders those). The others take, by
    (score, tag, element), an element that has none of their kind; those left take their best. Then each
    element that has candidates of a kind and none of it looks for one along a shortest chain of at most longest
    further elements, each of which gives a tag up for another; tags inside an element never move. At last
    an element with several of a kind gives those up that a neighbour without one can take.
    """
    inside = {}
    for tag, _, element, score, within in sorted(tags, key=lambda r: (r[3], r[2])):
        if within:
            inside.setdefault(tag, element)
    owner, kind = dict(inside), {t[0]: t[1] for t in tags}
    free = sorted((score, tag, element) for tag, _, element, score, _ in tags if tag not in inside)
    holds: dict[tuple[int, int], set[int]] = {}
    for tag, element in owner.items():
        holds.setdefault((element, kind[tag]), set()).add(tag)

    def give(tag: int, element: int) -> None:
        if tag in owner:
            holds[owner[tag], kind[tag]].discard(tag)
        owner[tag] = element
        holds.setdefault((element, kind[tag]), set()).add(tag)

    for crowded in (False, True):
        for _, tag, element in free:
            if tag not in owner and (crowded or not holds.get((element, kind[tag]))):
                give(tag, element)
    wanted: dict[tuple[int, int], list[int]] = {}
    choices: dict[int, list[int]] = {}
    for _, tag, element in free:
        wanted.setdefault((element, kind[tag]), []).append(tag)
        choices.setdefault(tag, []).append(element)

    for slot in sorted(wanted):
        if not holds.get(slot):
            for tag, to in _chain(slot, wanted, owner, holds, longest):
                give(tag, to)
    for slot in sorted(holds):
        for tag in sorted(holds[slot]):
            if len(holds[slot]) > 1 and tag not in inside:
                other = next((e for e in choices[tag] if e != slot[0] and not holds.get((e, slot[1]))), None)
                if other is not None:
                    give(tag, other)
    return owner


def _chain(start: tuple[int, int], wanted: dict, owner: dict, holds: dict, longest: int) -> list[tuple[int, int]]:
    """Moves (tag, element) along a shortest chain that gives start a tag: the last element of it has one to spare. Empty if none has.

    A breadth-first search over (element, kind) slots; of chains alike in length the one whose tags come first in
    the orders of the slots wins.
    """
    came: dict[tuple[int, int], tuple[tuple[int, int], int]] = {}
    steps = {start: 0}
    queue = deque([start])
    while queue:
        slot = queue.popleft()
        for tag in wanted.get(slot, ()):
            giver = (owner[tag], slot[1])
            if giver in steps:
                continue
            steps[giver] = steps[slot] + 1
            came[giver] = (slot, tag)
            if len(holds[giver]) > 1:
                moves = []
                while giver != start:
                    giver, tag = came[giver]
                    moves.append((tag, giver[0]))
                return moves[::-1]
            if steps[giver] <= longest:
                queue.append(giver)
    return []


def share_tags(pairs: DataFrame, longest: int = 6) -> DataFrame:
    """tag, element of candidate pairs (tag, kind, element, score, inside), shared out so that few elements go without (see shared_out).

    Tags and elements that no chain of pairs connects do not matter to each other, so each connected group
    goes alone. tag and element are longs.
    """
    p = pairs.select("tag", "kind", "element", "score", "inside")
    g = groups(p.select((F.col("tag") * 2).alias("a"), (F.col("element") * 2 + 1).alias("b")).distinct())
    p = p.join(g.where("node % 2 = 0").select(F.expr("node div 2").alias("tag"), F.col("root").alias("_root")).hint("merge"), "tag")

    def run(t: pa.Table) -> pa.Table:
        rows = [tuple(r[c] for c in ("tag", "kind", "element", "score", "inside")) for r in t.to_pylist()]
        out = sorted(shared_out(rows, longest).items())
        return pa.table({"tag": pa.array([o[0] for o in out], pa.int64()), "element": pa.array([o[1] for o in out], pa.int64())})

    return p.groupBy("_root").applyInArrow(run, "tag long, element long")


def shared_places(places: list[tuple[int, list[int], list[tuple[float, int]]]], held: dict[tuple[int, int], int], longest: int = 6) -> Iterator[tuple[int, int]]:
    """tag, element as shared_out() has them, of the tags that lie inside no element, by place.

    places: kind, tags (ascending) and the (score, element) that all tags of the place have, ascending. held: the number of tags inside an
    element by (element, kind). A search for a chain looks at each place once, and not again at what an earlier one found to lead nowhere.
    """
    slots = sorted({(e, kind) for kind, _, near in places for _, e in near})
    at = {s: i for i, s in enumerate(slots)}
    within = [held.get(s, 0) for s in slots]
    near = [[at[e, kind] for _, e in found] for kind, _, found in places]
    tags, of = [p[1] for p in places], {t: i for i, p in enumerate(places) for t in p[1]}
    flat = [(s, i, e) for i, p in enumerate(places) for (s, _), e in zip(p[2], near[i])]
    score, place, element = (np.array(c) for c in zip(*flat)) if flat else (np.empty(0), np.empty(0, int), np.empty(0, int))
    used, owner, mine = [0] * len(places), {}, [set() for _ in slots]
    for _, tag, e, _ in in_turn(score, place, element, tags, used, bytearray(n > 0 for n in within)):
        owner[tag] = e
        mine[e].add(tag)
    for i, n in enumerate(used):
        if near[i]:
            owner.update(dict.fromkeys(tags[i][n:], near[i][0]))
            mine[near[i][0]].update(tags[i][n:])
    wanted: list[list[tuple[float, int]]] = [[] for _ in slots]
    for s, i, e in sorted(flat):
        wanted[e].append((s, i))
    nowhere: set[int] = set()

    def asked(slot: int, seen: set[int]) -> Iterator[int]:
        some = wanted[slot]
        k = 0
        while k < len(some):
            j = k + 1
            while j < len(some) and some[j][0] == some[k][0]:
                j += 1
            new = [i for _, i in some[k:j] if i not in seen]
            seen.update(new)
            yield from tags[new[0]] if len(new) == 1 else heapq.merge(*(tags[i] for i in new))
            k = j

    def chain(start: int) -> list[tuple[int, int]]:
        came, steps, queue, seen, whole = {}, {start: 0}, deque([start]), set(), True
        while queue:
            slot = queue.popleft()
            for tag in asked(slot, seen):
                giver = owner[tag]
                if giver in steps or giver in nowhere:
                    continue
                steps[giver] = steps[slot] + 1
                came[giver] = (slot, tag)
                if within[giver] + len(mine[giver]) > 1:
                    moves = []
                    while giver != start:
                        giver, tag = came[giver]
                        moves.append((tag, giver))
                    return moves[::-1]
                if steps[giver] <= longest:
                    queue.append(giver)
                else:
                    whole = False
        if whole:
            nowhere.update(steps)
        return []

    def give(tag: int, slot: int) -> None:
        mine[owner[tag]].discard(tag)
        owner[tag] = slot
        mine[slot].add(tag)

    for slot in range(len(slots)):
        if not within[slot] and not mine[slot]:
            for tag, to in chain(slot):
                give(tag, to)
    for slot in range(len(slots)):
        for tag in sorted(mine[slot]) if within[slot] + len(mine[slot]) > 1 else ():
            if within[slot] + len(mine[slot]) > 1:
                other = next((e for e in near[of[tag]] if not within[e] and not mine[e]), None)
                if other is not None:
                    give(tag, other)
    return ((tag, slots[slot][0]) for tag, slot in owner.items())


def share_places(places: DataFrame, on: Sequence[str], longest: int = 6) -> DataFrame:
    """tag, element as share_tags() has them, of places (on, place, kind, tags, home, near), whose tags have all candidates alike.

    home: the least element that the tags lie in, or null; near: (score, element) of the others. Tags that lie in an element are its and move
    no more, so their other pairs matter to nothing; of the elements in reach of others only the number of these tags is told.
    on: columns that the candidates of a tag share with it.
    """
    r = Rounds(places.sparkSession)
    free = places.where("home is null and size(near) > 0")
    pairs = free.select(*on, (F.col("place") * 2).alias("a"), F.explode(F.transform("near", lambda e: e["element"] * 2 + 1)).alias("b"))
    root = r.settled(groups(pairs, within=on))
    inside = places.where("home is not null")
    n = inside.groupBy(F.col("home").alias("element"), "kind").agg(F.sum(F.size("tags")).cast("long").alias("n"))
    mine = free.select("place", "kind", "tags", "near").join(root.where("node % 2 = 0").select(F.expr("node div 2").alias("place"), "root").hint("merge"), "place").drop("place")
    others = n.join(root.where("node % 2 = 1").select(F.expr("(node - 1) div 2").alias("element"), "root").hint("merge"), "element")

    def run(t: pa.Table) -> pa.Table:
        found, held = [], {}
        for r in t.to_pylist():
            if r["tags"] is None:
                held[r["element"], r["kind"]] = r["n"]
            else:
                found.append((r["kind"], r["tags"], sorted((e["score"], e["element"]) for e in r["near"])))
        out = sorted(shared_places(found, held, longest))
        return pa.table({"tag": pa.array([o[0] for o in out], pa.int64()), "element": pa.array([o[1] for o in out], pa.int64())})

    shared = r.settled(mine.unionByName(others, allowMissingColumns=True).groupBy("root").applyInArrow(run, "tag long, element long"))
    r.close(shared)
    return inside.select(F.explode("tags").alias("tag"), F.col("home").alias("element")).unionByName(shared)


def chain_floors(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """id, stack: elements (id, floor_no) followed from floor to floor along one-to-one pairs (low, high) of neighbouring floors.

    The stack is the id at the bottom. Chains are paths, so each element points at the one below it, and then jumps: rounds grow with the
    logarithm of the number of floors.
    """
    r = Rounds(pairs.sparkSession)
    down = r.settled(pairs.select(F.col("high").alias("id"), F.col("low").alias("stack")))
    while True:
        below = down.select(F.col("id").alias("_id"), F.col("stack").alias("_to"))
        nxt = r.settled(down.join(below.hint("merge"), F.col("stack") == F.col("_id"), "left").select("id", F.coalesce("_to", "stack").alias("stack"), F.col("_to").isNotNull().alias("_moved")))
        still = nxt.where("_moved").isEmpty()
        r.drop(down)
        down = nxt
        if still:
            break
    r.close(down)
    return elements.select("id", "floor_no").join(down.drop("_moved").hint("merge"), "id", "left").select("id", "floor_no", F.coalesce("stack", "id").alias("stack"))


def snapped_points(points: DataFrame, on: list[str], tolerance: float) -> DataFrame:
    """points (id, on, x, y) with sx, sy: the mean of all points of on that steps of at most tolerance connect with them. ids are unique longs.

    Points in one place are one node, so pairs grow with the places, not with the square of what is drawn in one.
    """
    from . import spatial

    places = kept(points.groupBy(*on, "x", "y").agg(F.min("id").alias("id")))
    near = places.select(F.col("id").alias("other"), *on, *[F.col(c).alias(f"{c}{n}") for c in "xy" for n in (0, 1)])
    d2 = spatial.box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
    pairs = spatial.points_in_boxes(places, near, on, 4 * tolerance, tolerance, (d2 <= tolerance * tolerance) & (F.col("id") < F.col("other")))
    g = groups(pairs.select(*on, F.col("id").alias("a"), F.col("other").alias("b")), within=on)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*on, "x", "y")]
    of = places.join(g.withColumnRenamed("node", "id").hint("merge"), "id", "left").select(*[F.col(k).alias(f"_{k}") for k in (*on, "x", "y")], F.coalesce("root", "id").alias("root"))
    named = points.join(of.hint("merge"), same).drop(*[f"_{k}" for k in (*on, "x", "y")])
    mean = named.groupBy("root").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"))
    return named.join(mean.hint("merge"), "root").drop("root")
