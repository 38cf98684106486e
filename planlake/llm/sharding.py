"""Shards of equal numbers of rows by a keyed permutation of row numbers, in DataFrame functions only.

A row's number is its rank by id. A Feistel network over pairs (left below a, right below b, a * b just
above the number of rows) permutes the numbers; what falls beyond the last row walks on through the
network until it does not. The permuted number modulo the number of shards is the shard, divided by it
the slot, so both can be told from the row's number, and the row's number from them, without the table.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import written
from .ranks import ranked

SHARDS, ROUNDS, SEED = 8, 8, "planlake"
#: Prime of the round function; halves of the network stay below it, so up to 2^61 rows.
PRIME = (1 << 31) - 1


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by)).cast("long")


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. rows - 1. walk: steps of the network that a walk may need beyond its first."""

    rows: int
    seed: str = SEED
    walk: int = 0
    left: int = field(init=False)
    right: int = field(init=False)

    def __post_init__(self):
        left = math.isqrt(max(self.rows, 1) - 1) + 1
        object.__setattr__(self, "left", left)
        object.__setattr__(self, "right", -(-max(self.rows, 1) // left))

    @property
    def domain(self) -> int:
        return self.left * self.right

    def keys(self) -> list[tuple[int, int]]:
        """Two numbers below the prime for each round."""
        out = []
        for i in range(ROUNDS):
            h = hashlib.sha256(f"{self.seed}/{i}".encode()).digest()
            out.append((int.from_bytes(h[:8], "big") % PRIME, int.from_bytes(h[8:16], "big") % PRIME))
        return out

    def once(self, x: Column, back: bool = False) -> Column:
        """One pass through the network, or back through it."""
        half = F.struct(_div(x, self.right).alias("l"), F.pmod(x, F.lit(self.right)).cast("long").alias("r"))
        rounds = list(enumerate(self.keys()))
        keys = F.array(*[F.struct(F.lit(k0).cast("long").alias("a"), F.lit(k1).cast("long").alias("b"), F.lit(i % 2 == 0).alias("even")) for i, (k0, k1) in (rounds[::-1] if back else rounds)])

        def mixed(v: Column, k: Column) -> Column:
            s = F.pmod(v + k["a"], F.lit(PRIME))
            s = F.pmod(s * s + k["b"], F.lit(PRIME))
            return F.pmod(s * s + k["a"], F.lit(PRIME))

        def step(s: Column, k: Column) -> Column:
            add = lambda a, f, m: F.pmod(a - f if back else a + f, F.lit(m))
            l = F.when(k["even"], add(s["l"], mixed(s["r"], k), self.left)).otherwise(s["l"])  # noqa: E741
            r = F.when(k["even"], s["r"]).otherwise(add(s["r"], mixed(s["l"], k), self.right))
            return F.struct(l.alias("l"), r.alias("r"))

        return F.aggregate(keys, half, step, lambda s: s["l"] * F.lit(self.right) + s["r"])

    def permuted(self, x: Column, back: bool = False) -> Column:
        """x through the network, and on until it is below rows."""
        first = self.once(x, back)
        if not self.walk:
            return first
        on = lambda at, _: F.when(at >= F.lit(self.rows), self.once(at, back)).otherwise(at)
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.walk)), first, on)

    def shard_and_slot(self, number: Column, shards: int) -> tuple[Column, Column]:
        at = self.permuted(number)
        return F.pmod(at, F.lit(shards)).cast("int"), _div(at, shards)

    def number_at(self, shard: Column, slot: Column, shards: int) -> Column:
        """Number of the row that is at a slot of a shard."""
        return self.permuted(slot * F.lit(shards) + shard, back=True)


def permutation(spark: SparkSession, rows: int, seed: str = SEED) -> Feistel:
    """The permutation of rows numbers, with as many steps of walk as any number needs.

    Only numbers from rows up to the domain's end (fewer than the root of rows) send a walk on; they are
    followed until all are out, or back where they began: no walk enters such a ring.
    """
    f, walk = Feistel(rows, seed), 0
    out = spark.range(rows, f.domain if rows else 0).select("id", F.col("id").alias("x"))
    while not out.isEmpty():
        walk += 1
        out = out.select("id", f.once(F.col("x")).alias("x")).where((F.col("x") >= rows) & (F.col("x") != F.col("id")))
    return Feistel(rows, seed, walk)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, number of every row of docs (doc_id, text).

    Law ``rows``: counts of shards differ by one at most, slots of each are gapless from 0; grown_shard is
    null, since one more shard moves rows between all. size is the text's UTF-8 bytes and 1; a null text is
    taken as empty. number is the rank by doc_id (null first), text_crc32 and size, whatever the files or
    their order. Repeated rows are rows of their own, and so are equal texts: they are no group under this
    law. Other columns do not matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows").leave()
    f = permutation(spark, slim.count(), seed)
    shard, slot = f.shard_and_slot(F.col("rank"), shards)
    return ranked(slim, ["doc_id", "text_crc32", "size"], tag="shard-numbers").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("rank").alias("number"),
    )


def oracle_sql(shards: int = SHARDS, seed: str = SEED) -> str:
    """The same in SQL: crc32 by its table, the network by a reduction, the walk by recursion."""
    keys = ", ".join(f"{{'a': {a}::bigint, 'b': {b}::bigint, 'e': {str(i % 2 == 0).lower()}, 'l': 0::bigint, 'r': 0::bigint}}" for i, (a, b) in enumerate(Feistel(1, seed).keys()))
    inner = lambda v: f"((({v} + k.a) % {PRIME}) * (({v} + k.a) % {PRIME}) + k.b) % {PRIME}"
    f = lambda v: f"((({inner(v)}) * ({inner(v)}) + k.a) % {PRIME})"
    net = lambda x: (
        f"list_reduce([{keys}], lambda s, k: {{'a': k.a, 'b': k.b, 'e': k.e, 'l': case when k.e then (s.l + {f('s.r')}) % c.a else s.l end, "
        f"'r': case when k.e then s.r else (s.r + {f('s.l')}) % c.b end}}, {{'a': 0::bigint, 'b': 0::bigint, 'e': true, 'l': ({x}) // c.b, 'r': ({x}) % c.b}})"
    )
    return f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
d as (
  select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
s as (
  select doc_id, size, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h as bigint)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295) as c
  from d, crc),
n as (
  select doc_id, size, xor(c, 4294967295) as text_crc32, row_number() over (order by doc_id nulls first, xor(c, 4294967295), size) - 1 as number from s),
c as (select count(*) as n, cast(ceil(sqrt(count(*))) as bigint) as a, cast(ceil(count(*) / ceil(sqrt(count(*)))) as bigint) as b from documents),
w as (
  select number, v.l * c.b + v.r as spot from (select number, {net('number')} as v from n, c) x, c
  union all
  select number, v.l * c.b + v.r from (select number, {net('spot')} as v from w, c where spot >= c.n) x, c)
select doc_id, size, text_crc32, 'rows' as law, cast(spot % {shards} as integer) as shard, spot // {shards} as slot, cast(null as integer) as grown_shard, n.number as number
from n join w on n.number = w.number, c where spot < c.n
"""
