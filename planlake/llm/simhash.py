"""SimHash near-duplicates by multi-index hashing.

``fingerprints`` hashes word shingles to SimHash values of 64 or 128 bits. ``link_fingerprints`` finds
distinct fingerprints within ``max_bits`` differing bits: each 64-bit word is cut into segments, and every
fingerprint is entered in a table of each segment under all values of the Hamming ball of radius 1 around
its own. Two fingerprints meet in a table if they differ by two bits or fewer in its segment, since their
balls then touch, and all that meet are verified over the complete fingerprint. Of 64 bits in two segments,
fingerprints within five bits differ by two at most in one of them, so no pair is lost; more bits than
that are a question of recall. Two segments of 32 bits let few pairs meet by chance (one in two million).
``components`` joins links into groups.

Scale: copies share one fingerprint and are folded by a partial aggregate before anything else. A
bucket with many entries is dealt out in chunks. Of a bucket's links only a spanning forest leaves the
task, so groups of thousands of near copies do not make all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import free, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Pairs that are verified at a time; entries that one task makes.
_PAIRS, _ENTRIES = 1 << 19, 1 << 20


def fingerprint(text: bytes, words: int = 4, seed: int = 42, parts: int = 1) -> list[int]:
    """Unsigned SimHash words (of seed, seed + 1 ..) of one UTF-8 text; 0 for a text without words."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return [0] * parts
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    h = xxhash.xxh64_intdigest
    starts, ends = starts[: len(tokens) - k + 1], ends[k - 1 :]
    counts = np.zeros((parts, 64), np.int64)
    for at in range(0, len(starts), 1 << 16):
        shingles = [flat[s:e] for s, e in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())]
        for part in range(parts):
            hashes = np.array([h(s, seed + part) for s in shingles], np.uint64)
            counts[part] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(starts), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def names_of(parts: int) -> list[str]:
    """Columns of a fingerprint's words."""
    return ["fp", "fp2", "fp3", "fp4"][:parts]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, parts: int = 1) -> DataFrame:
    """doc_id, fp (and fp2 ..: the fingerprint's words as signed longs), h (of the text) of every row.

    Null and empty texts have fingerprint 0; texts shorter than a shingle are one shingle. Repeated
    rows stay; a null id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", words, seed, parts) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fps[:, i]) for i in range(parts)), b.column(2)], ["doc_id", *names_of(parts), "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in names_of(parts))}, h long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) of the components of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _link_stream(max_bits: int, parts: int):
    """Rows come sorted by (bucket, chunk), homes first; every row meets the homes before it. Homes of the open group are kept."""
    names = names_of(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, parts), np.uint64))
        for batch in batches:
            bucket, chunk, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            fp = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(parts)], 1).view(np.uint64)
            old = len(kept[0])
            bucket, chunk, fp = (np.concatenate([x, y]) for x, y in zip(kept, (bucket, chunk, fp)))
            home = np.concatenate([np.ones(old, bool), home.astype(bool)])
            if not len(fp):
                continue
            first = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])])
            begin = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            homes = np.bincount(group[home], minlength=len(begin))
            before = np.minimum(homes[group], np.arange(len(fp)) - begin[group])
            rows = np.flatnonzero((np.arange(len(fp)) >= old) & (before > 0))
            n = before[rows]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            total, at = np.cumsum(n), 0
            while at < len(rows):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
                r, k = rows[at:upto], n[at:upto]
                left = np.repeat(r, k)
                right = np.repeat(begin[group[r]], k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
                apart = np.bitwise_count(fp[left] ^ fp[right]).sum(1, dtype=np.int64)
                ok = (apart > 0) & (apart <= max_bits)
                if ok.any():
                    found.append(_forest(left[ok], right[ok]))
                at = upto
            if found:
                a, b = (fp[x].view(np.int64) for x in _forest(*(np.concatenate(x) for x in zip(*found))))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for x in (a, b) for i in range(parts)], [*(f"a_{c}" for c in names), *(f"b_{c}" for c in names)])
            last = (group == group[-1]) & home
            kept = (bucket[last], chunk[last], fp[last])

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = 4, segments: int = 2, chunk: int = 4096) -> DataFrame:
    """a_fp (a_fp2 ..), b_fp ..: edges that join what links of at most max_bits differing bits join (a forest per bucket).

    fps: distinct fingerprints (fp, fp2 .. as there are). segments: of each 64-bit word. chunk: most
    entries of a bucket that one task compares others with. Links are complete if max_bits is less than
    three times all segments; beyond that a pair is missed if it differs by more than two bits in each.
    """
    names = [c for c in names_of(4) if c in fps.columns]
    cuts = [64 * i // segments for i in range(segments + 1)]
    buckets = []
    for w, name in enumerate(names):
        for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            key = F.shiftrightunsigned(name, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < 64 else F.col(name)
            flips = [0, *((1 << j) - (1 << 64 if j == 63 else 0) for j in range(hi - lo))]
            top = F.lit((w * segments + s) << 40 if hi - lo <= 40 else 0)
            buckets.append(F.array(*[top + key.bitwiseXOR(F.lit(x).cast("long")) for x in flips]))
    tasks = -(-fps.count() * len(names) * (64 + segments) // _ENTRIES)
    entries = fps.repartition(max(1, tasks), *names).select(*names, F.explode(F.concat(*buckets)).alias("bucket"))
    hot = written(entries.groupBy("bucket").count().where(F.col("count") > chunk).select("bucket", F.ceil(F.col("count") / chunk).cast("long").alias("chunks")), "hot-buckets")
    if hot.df.isEmpty():
        dealt = entries.withColumn("chunk", F.lit(0).cast("long")).withColumn("home", F.lit(True)).repartition("bucket")
        hot.drop()
    else:
        wide = entries.join(hot.leave().hint("merge"), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64(*names), "chunks")
        # every member meets each chunk of homes; it is itself a home in one of them
        dealt = wide.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("home", F.col("chunk") == own).repartition("bucket", "chunk")
    rows = dealt.select("bucket", "chunk", "home", *names).sortWithinPartitions("bucket", "chunk", F.col("home").desc(), *names)
    return rows.mapInArrow(_link_stream(max_bits, len(names)), ", ".join(f"{x}_{c} long" for x in "ab" for c in names)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the undirected edges a, b.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014) until a round changes
    nothing; each round is a written table. Minima are partial aggregates and joins, never lists of
    neighbours.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = written(small, "edges")
        now.drop()
        now = nxt
        state = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    now = now.leave()
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int, segments: int, parts: int) -> DataFrame:
    """doc_id, h, the fingerprint's words and root (a number of its group) of every row."""
    names = names_of(parts)
    known = written(fingerprints(docs, id_col, text_col, words, parts=parts), "fingerprints").leave()
    distinct = known.select(*names).distinct()
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id() if parts > 1 else F.col("fp")), "distinct").leave()
    edges = link_fingerprints(distinct.select(*names), max_bits, segments)
    if parts > 1:
        for end in "ab":
            node = distinct.select(*[F.col(c).alias(f"{end}_{c}") for c in names], F.col("node").alias(end))
            edges = edges.join(node.hint("merge"), [f"{end}_{c}" for c in names])
    else:
        edges = edges.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    roots = components(edges.select("a", "b"))
    named = distinct.join(roots.hint("merge"), "node", "left").select(*names, F.coalesce("root", "node").alias("root"))
    return known.join(named.hint("merge"), names)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, segments: int = 2, parts: int = 1) -> DataFrame:
    """doc_id, fp (fp2 ..), component_id of every row: the least id that links of at most max_bits bits reach.

    Texts without words share fingerprint 0 and link like any other. Repeated rows come back as often
    as they came; a null id never is the least (component_id is null if a group has no other). An
    empty table gives no rows. Extra columns are not read.
    """
    rows = written(_grouped(docs, id_col, text_col, words, max_bits, segments, parts), "grouped").leave()
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least.hint("merge"), "root").select("doc_id", *names_of(parts), "component_id")


def keep_one_each(docs: DataFrame, words: int = 5, max_bits: int = 22, segments: int = 3, parts: int = 2) -> DataFrame:
    """One row of docs of every group of near duplicates: that of the least doc_id (null last) and, of several texts of that id, the least hash.

    The defaults are for a similarity of 0.8 of five-word shingles and 128-bit fingerprints: at 0.8 the
    expected distance is 19.4 bits with a standard deviation of 4. Rows that repeat doc_id and text
    count as one: the least by its columns as JSON stays. Texts without words are one group. All columns
    of docs come back, whatever their names; an empty table gives no rows.
    """
    rows = written(_grouped(docs, "doc_id", "text", words, max_bits, segments, parts).select("doc_id", "h", "root"), "grouped").leave()
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    keep = rows.groupBy("root").agg(F.min(key).alias("k")).select("k.doc_id", "k.h")
    id_, h, row_, n = (free(f"keep_{c}", docs.columns) for c in ("id", "h", "row", "n"))
    many = rows.join(keep.withColumnsRenamed({"doc_id": id_, "h": h}).hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("h").eqNullSafe(F.col(h)))
    keep = written(many.groupBy(id_, h).agg(F.count("*").alias(n)), "kept").leave()
    text = F.xxhash64(F.col("text").cast("string"))
    kept = lambda some: docs.join(some.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (text == F.col(h)), "inner")
    out, several = kept(keep.where(f"{n} = 1")).select(docs.columns), keep.where(f"{n} > 1")
    if several.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return out.unionByName(kept(several).groupBy(id_, h).agg(F.min_by(row, F.to_json(row)).alias(row_)).select(f"{row_}.*"))
