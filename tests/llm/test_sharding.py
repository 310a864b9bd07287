import zlib
from collections import Counter

from belegwerk.llm import sharding
from conftest import make_docs
from pyspark.sql import functions as F


def test_rows_sizes_and_gapless_slots(docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted(
        (repr(d[0]), len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in make_docs())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= r.shard < 8 and r.grown_shard in (r.shard, 8) for r in rows)
    assert sharding.shard_documents(none).collect() == []


def test_only_the_key_decides_and_shares_follow_weights(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    rows = sharding.place(keys, F.col("k"), sharding.tree(8))
    shares = Counter(r.shard for r in rows.collect())
    assert set(shares) == set(range(8)) and max(shares.values()) < 1.1 * 2500 and min(shares.values()) > 0.9 * 2500
    grown = sharding.place(rows, F.col("k"), sharding.tree(9), "grown").collect()
    moved = [r for r in grown if r.shard != r.grown]
    assert {r.grown for r in moved} == {8} and 0.9 < len(moved) / (20000 / 9) < 1.1
    assert sharding.tree(9)[:-1] == sharding.tree(8) and sharding.tree(12)[:4] == sharding.tree(11)[:4]


def test_a_changed_weight_moves_rows_in_its_subtree_only(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    group, shard = sharding.Group, sharding.Shard
    build = lambda w: (group("r0", (group("a", (shard(0), shard(1, w))), group("b", (shard(2), shard(3, 2.0 - w))))),
                       group("r1", (group("c", (shard(4), shard(5))),)))
    both = sharding.place(sharding.place(keys, F.col("k"), build(1.0), "x"), F.col("k"), build(1.5), "y").collect()
    moved = [(r.x, r.y) for r in both if r.x != r.y]
    # The regions keep their weights, so nothing crosses them, and the other region stands still.
    assert moved and all(x < 4 and y < 4 for x, y in moved)


def test_empty_weight_takes_nothing(spark):
    keys = spark.range(200).select(F.col("id").cast("string").alias("k"))
    regions = (sharding.Group("r", (sharding.Group("a", (sharding.Shard(0), sharding.Shard(1, 0.0))),)),)
    assert {r.shard for r in sharding.place(keys, F.col("k"), regions).collect()} == {0}
