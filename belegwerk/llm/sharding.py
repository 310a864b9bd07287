"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per shard in the two-level numbering; a window sees one bucket of one shard.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Group:
    """A rack of shards or a region of racks. It weighs what its members weigh."""
    name: str
    members: tuple

    @property
    def weight(self) -> float:
        return sum(m.weight for m in self.members)


def tree(shards: int, per_rack: int = 2, racks: int = 2) -> tuple[Group, ...]:
    """Regions for shards 0, 1, ..: the first 8 (that is 2 regions' worth) fill racks in order, every later shard
    opens a region of its own. So a tree with one more shard differs by one region only, and no other weight changes."""
    base = min(shards, 2 * per_rack * racks)
    packs = [tuple(Shard(n) for n in range(k, min(k + per_rack, base))) for k in range(0, base, per_rack)]
    built = [Group(f"rack{i}", p) for i, p in enumerate(packs)]
    regions = [Group(f"region{i // racks}", tuple(built[i:i + racks])) for i in range(0, len(built), racks)]
    regions += [Group(f"region-of-{n}", (Group(f"rack-of-{n}", (Shard(n),)),)) for n in range(base, shards)]
    return tuple(regions)


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of a digest of key and node: the least draw wins, each node with
    a chance in proportion to its weight. A node's draw depends on its own name and weight alone, so changing one
    weight moves keys only from or to that node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 1.0) / float(2 ** 52)) / F.lit(float(weight))


def _winner(key: Column, nodes: list[tuple[str, float]]) -> Column:
    """Index of the node with the least draw; nodes without weight take nothing."""
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight) in enumerate(nodes)
             if weight > 0]
    return F.array_min(F.array(*draws))["i"] if len(draws) > 1 else F.lit(next(i for i, n in enumerate(nodes) if n[1] > 0))


def _case(chosen: Column, options: list[Column]) -> Column:
    return reduce(lambda c, o: c.when(chosen == o[0], o[1]), list(enumerate(options))[1:], F.when(chosen == 0, options[0]))


def place(rows: DataFrame, key: Column, regions: tuple[Group, ...], name: str = "shard") -> DataFrame:
    """`rows` with the column `name`: the shard of `key` (a string without nulls).

    Law `key`: nothing but the key and the tree decides. When a weight changes, keys move only within the subtrees
    whose weights change, at the level where they do. No shuffle, no state."""
    a, b = f"__{name}_region", f"__{name}_rack"
    out = rows.withColumn(a, _winner(key, [(r.name, r.weight) for r in regions]))
    out = out.withColumn(b, _case(F.col(a), [_winner(key, [(k.name, k.weight) for k in r.members]) for r in regions]))
    shard = _case(F.col(a), [_case(F.col(b), [
        _case(_winner(key, [(f"shard{s.number}", s.weight) for s in k.members]), [F.lit(s.number) for s in k.members])
        for k in r.members]) for r in regions])
    return out.withColumn(name, shard).drop(a, b)


def with_slots(rows: DataFrame, order: list[str], shard: str = "shard", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """`rows` with `slot`: 0, 1, .. without gaps in every shard.

    Rows are numbered by `order` inside (shard, bucket), the bucket being a hash of the `order` columns, and the
    sizes of earlier buckets are added: one narrow shuffle, no task with a whole shard. Rows equal in `order` take
    consecutive slots in any order."""
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
               .select(shard, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*order)
    numbered = dealt.withColumn("__row", F.row_number().over(inside) - 1)
    return (numbered.join(offsets, [shard, "__bucket"]).withColumn("slot", F.col("__offset") + F.col("__row"))
            .select(*rows.columns, "slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row of `docs` in one of `shards` shards: doc_id, size, text_crc32, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. grown_shard: the shard with one shard more, which takes rows
    only into itself. A null doc_id is a key like any other; repeated rows all get a slot; an empty table gives none.
    Texts are measured in the scan and not shuffled; other columns of `docs` are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    rows = place(rows, key, tree(shards), "shard")
    rows = place(rows, key, tree(shards + 1), "grown_shard")
    return with_slots(rows, ["doc_id", "text_crc32", "size"])
