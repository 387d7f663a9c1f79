"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards, each shard with a weight.  A row descends
from the root: at every level each child makes a draw from the row's key and
the child's name, ln(u) / weight, and the greatest draw wins (Efraimidis and
Spirakis 2006; the same rule that storage clusters use).  A draw depends on
nothing but its own child, so a changed weight moves rows only into or out of
the subtree that changed.  A new shard arrives as a region of its own, so
growing by one moves rows into the new shard and nowhere else.

Only DataFrame functions run on the rows: hashes are md5 prefixes, and each
level is one expression.

Behaviour: rows without a key share the draws of an empty key; null texts have
a size of 1 and a CRC of 0; repeated rows go to the same shard, in slots of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash blocks of a shard within which slots are counted: bounds the rows that one task sorts and the table of offsets.
BLOCKS = 1024


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def tree(shards: int, base: int = 16, regions: int = 4, racks: int = 2) -> list[Leaf]:
    """The first `base` shards fill regions and racks evenly; each later one is a region of its own."""
    each = -(-base // (regions * racks))
    out = []
    for s in range(shards):
        rack = s // each
        out.append(Leaf(s, f"r{rack // racks}", f"k{rack % racks}") if s < base else Leaf(s, f"r{regions + s - base}", "k0"))
    return out


def _uniform(key: Column, name: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of key and name."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}/"), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _draw(key: Column, children: dict[str, float], prefix: str) -> Column:
    """The name of the child with the greatest draw; equal draws: the first name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    names = sorted(children)
    best = F.array_max(F.array(*(F.struct((F.log(_uniform(key, f"{prefix}/{n}")) / children[n]).alias("draw"), F.lit(-i).alias("i")) for i, n in enumerate(names))))
    return F.element_at(F.array(*(F.lit(n) for n in names)), 1 - best["i"])


def _block(*columns: str) -> Column:
    """The hash block that a row is counted in, from 0 to BLOCKS - 1: the leading bits of an md5, so that any engine can repeat it."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", *columns)), 1, 8), 16, 10).cast("long"), F.lit(BLOCKS)).cast("int")


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: a descent through region, rack and shard."""
    shape: dict[str, dict[str, dict[str, float]]] = {}
    number = {}
    for x in leaves:
        shape.setdefault(x.region, {}).setdefault(x.rack, {})[str(x.shard)] = x.weight
        number[str(x.shard)] = x.shard
    key = F.coalesce(key.cast("string"), F.lit(""))
    weight = {r: sum(sum(k.values()) for k in racks.values()) for r, racks in shape.items()}

    def choose(by: Column, ways: dict[str, Column]) -> Column:
        out = None
        for name, then in ways.items():
            out = F.when(by == name, then) if out is None else out.when(by == name, then)
        return out

    def rack_of(region: str) -> Column:
        racks = shape[region]
        return choose(_draw(key, {k: sum(s.values()) for k, s in racks.items()}, region), {k: _draw(key, s, f"{region}/{k}") for k, s in racks.items()})

    return choose(_draw(key, weight, ""), {r: rack_of(r) for r in shape}).cast("int")


def shard_rows(rows: DataFrame, key_col: str, shards: int = 16, order: list[str] | None = None) -> DataFrame:
    """rows with shard, grown_shard (with one more shard) and slot: gapless from 0 in each shard.

    Slots are counted in two steps, so that no task holds a whole shard: rows
    are ranked within a hash block of their shard, and a table of at most
    shards * BLOCKS counts gives each block its first slot.
    """
    key = F.col(key_col)
    placed = rows.withColumn("shard", place(key, tree(shards))).withColumn("grown_shard", place(key, tree(shards + 1)))
    parts = placed.withColumn("_block", _block(*(order or [key_col])))
    counts = parts.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(*(order or [key_col])))
    return parts.withColumn("_rank", rank).join(F.broadcast(offsets), ["shard", "_block"]).withColumn("slot", F.col("_first") + F.col("_rank") - 1).drop("_block", "_first", "_rank")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """docs to (doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `key`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard_rows(rows, "doc_id", shards, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
