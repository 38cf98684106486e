"""A Merkle manifest of a table: a tree of 16-fold nodes per source, a tree of the sources' subroots, and proofs.

Every level is one window over runs of 16 nodes. Lag and lead columns at the fixed offsets 1 to 15, masked
by the node's slot and its run's length, hold its siblings; the first child of a run hashes its parent from
its own digest and its leads. Levels are written going up; going down, a node's path (what stands left and
right of it on every level) is its own siblings before its parent's path, by an equi-join on the parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import written
from .ranks import ranked

FAN = 16
_NODE = "key string, rank long, total long, hash string"
_STEP = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]).cast("binary"), 256)


def _siblings(nodes: DataFrame) -> DataFrame:
    """nodes (key, rank, total, hash, ...) of more than one node a key, with _run, _slot, l and r: digests left and right of each in its run."""
    nodes = nodes.withColumns({"_run": F.shiftright("rank", 4), "_slot": F.col("rank").bitwiseAND(FAN - 1)})
    run = W.partitionBy("key", "_run").orderBy("rank")
    length = F.least(F.lit(FAN), F.col("total") - F.col("_run") * FAN)
    left = [F.when(F.col("_slot") >= k, F.lag("hash", k).over(run)).otherwise("") for k in range(FAN - 1, 0, -1)]
    right = [F.when(F.col("_slot") + k < length, F.lead("hash", k).over(run)).otherwise("") for k in range(1, FAN)]
    return nodes.withColumns({"l": F.concat(*left), "r": F.concat(*right)})


def _parents(nodes: DataFrame) -> DataFrame:
    first = _siblings(nodes.where("total > 1")).where("_slot = 0")
    return first.select("key", F.col("_run").alias("rank"), F.expr(f"(total + {FAN - 1}) div {FAN}").alias("total"), F.sha2(F.concat("hash", "r").cast("binary"), 256).alias("hash"))


def _levels(leaves: DataFrame, tag: str) -> list[DataFrame]:
    """leaves and every level above them; a key stops at the level where it has one node."""
    out, most = [leaves], leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        out.append(written(_parents(out[-1]), f"{tag}-{len(out)}").leave())
        most = -(-most // FAN)
    return out


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first of levels with path and what else tops (key, path, ...) has: paths of the nodes that are alone on their level."""
    known = None
    names = [c for c in tops.columns if c not in ("key", "path")]
    for level in reversed(levels):
        here = level.where("total = 1").join(tops.hint("merge"), "key").select(*level.columns, "path", *names)
        if known is not None:
            up = known.select("key", F.col("rank").alias("_run"), F.col("path").alias("_up"), *names)
            below = _siblings(level.where("total > 1")).join(up.hint("merge"), ["key", "_run"])
            path = F.concat(F.array(F.struct("l", "r")), F.col("_up"))
            here = here.unionByName(below.select(*level.columns, path.alias("path"), *names))
        known = here
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and what stands left and right of it on every level make."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text).

    Leaves of a source (null is one) ascend by doc_id (null first), rows of one doc_id by leaf; repeated
    rows are leaves of their own. folded_root is made from the leaf, of the row with A-Z of its text
    lower-cased where tampered says, and the untampered siblings. A table of one row has its leaf as
    root and the digest of nothing as proof. An empty table has no rows; other columns do not matter.
    """
    if tampered is None:
        tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    row = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lower = row | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), leaf(row).alias("hash"), F.when(tampered, leaf(lower)).alias("_other"))
    leaves = ranked(written(rows, "merkle-rows").leave(), ["doc_id", "hash"], "key", "merkle-leaves")
    levels = _levels(leaves, "merkle-level")
    alone = [x.where("total = 1").select("key", "hash") for x in levels]
    subroots = alone[0]
    for x in alone[1:]:
        subroots = subroots.unionByName(x)
    # key is "" for null and else begins with "=", so it orders as the sources do, null first
    subroots = ranked(written(subroots.withColumnRenamed("key", "of"), "merkle-subroots").leave(), ["of"], None, "merkle-sources").withColumn("key", F.lit(""))
    above = _levels(subroots, "merkle-top")
    root = above[-1].select("hash").first()
    top = docs.sparkSession.createDataFrame([("", [], root[0] if root else None)], f"key string, path {_STEP}, root string")
    tops = _paths(above, top).select(F.col("of").alias("key"), "path", F.col("hash").alias("subroot"), "root")
    found = _paths(levels, tops)
    back = folded(F.coalesce("_other", "hash"), F.col("path"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 6) -> str:
    """The same in SQL, for up to 16 ** levels rows a source and 16 ** levels sources."""
    enc = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar)))::varchar || ':' || cast({c} as varchar), '-')"
    digest = lambda text: "sha256(" + " || ".join([*(enc(c) for c in ("doc_id", "source", "lang", "n_chars")), enc(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: cast(ascii(substr(cast(doc_id as varchar), i, 1)) as bigint)), lambda c, b: list_reduce(range(8), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295)"
    parts = [f"""
l0 as (
  select doc_id, coalesce('=' || source, '') as key, {digest('text')} as hash,
    case when xor({crc}, 4294967295) % 5 = 0 then {digest(lower)} end as other from documents),
s0 as (select *, row_number() over (partition by key order by doc_id nulls first, hash) - 1 as rank, count(*) over (partition by key) as total from l0)"""]
    for tree, of in (("s", "key"), ("t", "''")):
        if tree == "t":
            parts.append("subs as (" + " union all ".join(f"select key, hash from s{i} where total = 1" for i in range(levels + 1)) + ")")
            parts.append("t0 as (select key as own, '' as key, hash, row_number() over (order by key) - 1 as rank, count(*) over () as total from subs)")
        for i in range(1, levels + 1):
            parts.append(f"{tree}{i} as (select key, rank // 16 as rank, (any_value(total) + 15) // 16 as total, sha256(string_agg(hash, '' order by rank)) as hash from {tree}{i - 1} where total > 1 group by key, rank // 16)")
    def down(tree: str, top: str, extra: str) -> None:
        for i in range(levels, -1, -1):
            base = f"select x.*, {extra} from {tree}{i} x join {top} p on p.key = x.key where x.total = 1"
            if i == levels:
                parts.append(f"{tree}p{i} as ({base})")
                continue
            win = "over (partition by key, rank // 16 order by rank rows between "
            sib = f"(select *, coalesce(string_agg(hash, '') {win}unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(hash, '') {win}1 following and unbounded following), '') as r from {tree}{i} where total > 1)"
            grown = extra.replace("p.path as path", "list_concat([{'l': x.l, 'r': x.r}], p.path) as path")
            parts.append(f"{tree}p{i} as ({base} union all select x.* exclude (l, r), {grown} from {sib} x join {tree}p{i + 1} p on p.key = x.key and p.rank = x.rank // 16)")
    root = " union all ".join(f"select hash from t{i} where total = 1" for i in range(levels + 1))
    parts.append(f"top as (select '' as key, cast([] as struct(l varchar, r varchar)[]) as path, (select any_value(hash) from ({root}) z) as root)")
    down("t", "top", "p.path as path, p.root as root")
    parts.append("tops as (select own as key, path, hash as subroot, root from tp0)")
    down("s", "tops", "p.path as path, p.subroot as subroot, p.root as root")
    return "with " + ",\n".join(parts) + """
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from (
  select doc_id, hash as leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) as proof_sha256,
    list_reduce(list_transform(path, lambda s: {'l': s.l, 'h': '', 'r': s.r}), lambda a, s: {'l': '', 'h': sha256(s.l || a.h || s.r), 'r': ''}, {'l': '', 'h': coalesce(other, hash), 'r': ''}).h as folded_root
  from sp0) z
"""
