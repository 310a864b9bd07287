"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with the same n-gram set are one node. The product is restricted to entries that can reach the bound: an
n-gram order (rare first) gives every node a prefix that any partner must meet, and sizes and positions must fit. A
first product takes each node against one leader per shared n-gram; a second takes what is then still in different
components against the blocks of the other component. Overlaps are accumulated inside tasks and pairs under the bound discarded
there, so a group of m copies costs about m rows, not m * m."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices, text_bytes, written
from .graph import components
from .words import SPACED, gram_values, word_values

#: Cells of the n-gram count sketch: its size is fixed (4 MB as broadcast), whatever the corpus.
SKETCH_BITS = 20
_SKETCH_ROWS = 16
#: Documents per side of one block product.
BLOCK = 512
_HASHES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union, over distinct shingles of `words` words."""
    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n + (-self.percent * n // 100) + 1


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct values of its shingles; a shorter text has its whole word sequence as one."""
    values, bounds = word_values(*text_bytes(column), SPACED)
    grams = gram_values(values, words)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a:b - words + 1])
        else:
            yield gram_values(values[a:b], int(b - a)) if b > a else np.empty(0, np.uint64)


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(given: DataFrame, words: int) -> np.ndarray:
    """How many documents' shingles fall into each cell: an estimate of rarity, exact in what it counts. It only sets
    the order of n-grams, so results do not depend on it."""
    size = (1 << SKETCH_BITS) // _SKETCH_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for batch in slices(batches):
            for own in shingle_sets(batch.column("text"), words):
                held.append(_cells(own))
                n += len(own)
            if n > _HASHES:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        rows = np.minimum(total, 0xFFFF).astype(np.uint16).reshape(_SKETCH_ROWS, size)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_ROWS), pa.int32()),
                                              pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums.setdefault(row, np.zeros(size, np.int64))
                sums[row] += np.frombuffer(counts, np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(
            [np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], ["row", "counts"])

    schema = "row int, counts binary"
    rows = given.select("text").mapInArrow(count, schema).repartition(_SKETCH_ROWS, "row").mapInArrow(add, schema).collect()
    out = np.zeros((_SKETCH_ROWS, size), np.uint32)
    for r in rows:
        out[r.row] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(-1)


def _described(given: DataFrame, rule: Rule) -> DataFrame:
    """Per row: doc_id, text_key, n (set size), node (digest of the set), prefix (its rarest shingles)."""
    sketch = given.sparkSession.sparkContext.broadcast(_sketch(given, rule.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in slices(batches):
            n, nodes, prefixes = [], [], []
            for own in shingle_sets(batch.column("text"), rule.words):
                n.append(len(own))
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                take = rule.prefix(len(own)) if len(own) else 0
                order = np.lexsort((own, counts[_cells(own)]))[:take]
                prefixes.append(own[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "node", "prefix"])

    key = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {key}, text_key bigint, n bigint, node binary, prefix array<bigint>")


def _reaches(n: Column, pos: Column, other: Column, percent: int) -> Column:
    """Size and position bound: a node of n shingles whose first shared one has `pos` rarer ones before it can still
    hold the overlap that a link with a node of `other` shingles needs."""
    return (n - pos) * (100 + percent) >= percent * (n + other)


def _product(members: DataFrame, queries: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between the queries and the members of each block: members and queries are (block, node), block
    any value. A block with many queries is dealt out in chunks, each with its own copy of the members (at most BLOCK
    of them), so one block never fills one task."""
    chunks = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    asked = queries.join(chunks, "block").select(
        "block", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "node")
    held = members.join(chunks, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "node")
    rows = asked.unionAll(held).join(texts, "node").select(
        F.xxhash64("block", "chunk").alias("deal"), F.to_json(F.struct("block")).alias("block"), "chunk", "role", "node", "text")
    rows = rows.repartition("deal").sortWithinPartitions("deal", "block", "chunk", "role")
    percent, words = rule.percent, rule.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, index = None, [], [], None
        for batch in slices(batches):
            left, right = [], []
            own = zip(batch.column("block").to_pylist(), batch.column("chunk").to_pylist(), batch.column("role").to_pylist(),
                      batch.column("node").to_pylist(), shingle_sets(batch.column("text"), words), strict=True)
            for block, chunk, role, node, grams in own:
                if (block, chunk) != key:
                    key, ids, sets, index = (block, chunk), [], [], None
                if role == 0:
                    ids.append(node)
                    sets.append(grams)
                    continue
                if index is None:
                    sizes = np.array([len(s) for s in sets])
                    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], owner[order], sizes
                flat, owner, sizes = index
                lo, hi = np.searchsorted(flat, grams, "left"), np.searchsorted(flat, grams, "right")
                some = np.flatnonzero(hi > lo)
                many = hi[some] - lo[some]
                at = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(some) else some
                overlap = np.bincount(owner[at], minlength=len(sizes))
                for k in np.flatnonzero(100 * overlap >= percent * (sizes + len(grams) - overlap)):
                    if ids[k] != node:
                        left.append(node)
                        right.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n_shingles, component_id (least doc_id reachable by links, its own
    included; nulls come last).

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are `rule.words` words, a shorter text
    is one shingle. Null and empty texts have no shingles, link with nothing and keep their own id. Rows with equal
    sets link with each other, repeated rows included. An empty table gives no rows; other columns are left out. All
    links are found: the prefix bound is exact, and its candidates are all verified or already connected."""
    return _grouped(docs, rule).drop("root")


def _grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    """`jaccard_components` with root, a number of the component (null without shingles)."""
    given = documents(docs)
    described = _described(given, rule)
    rows = written(described.drop("prefix"), "sets")
    # One row per node: the copies of a set go together before anything is compared. The number of a node is fixed
    # where the table is written.
    nodes = described.where("n > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"))
    nodes = written(nodes.withColumnRenamed("node", "set").withColumn("node", F.monotonically_increasing_id()), "nodes")
    reps = nodes.select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_key").alias("r_key"))
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    # Most shingles of a prefix are in one document only; what is left is small.
    several = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    shared = written(postings.join(several, "token"), "postings")

    # First product: per shingle and size band, everything against the node that has the fewest rarer shingles, which
    # is the least changed of a group of near copies.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / rule.percent))).cast("int")
    placed = shared.withColumn("band", band)
    leaders = placed.groupBy("token", "band").agg(F.min(F.struct("pos", F.xxhash64("node").alias("h"), "node", "n")).alias("lead"))
    star = (placed.join(leaders, ["token", "band"]).where(F.col("node") != F.col("lead.node"))
            .where(_reaches(F.col("n"), F.col("pos"), F.col("lead.n"), rule.percent))
            .where(_reaches(F.col("lead.n"), F.col("lead.pos"), F.col("n"), rule.percent))
            .select(F.col("lead.node").alias("block"), "node").distinct())
    star = written(star, "star")
    heads = star.select("block", F.col("block").alias("node")).distinct()
    first = written(_product(heads, star, _texts(given, reps, star), rule), "links")
    labels = components(first)

    # Second product: nodes against the blocks of other components that share a shingle and can still reach the bound.
    # Per shingle a component is one row: its least size, and the most that any member leaves for a partner's size.
    every = shared.join(labels, "node", "left").select("node", "n", "pos", "token", F.coalesce("component", "node").alias("label"))
    mixed = every.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    sizes = labels.groupBy(F.col("component").alias("label")).agg(F.count(F.lit(1)).alias("c"))
    open_ = written(every.join(mixed, "token").join(sizes, "label", "left").withColumn("c", F.coalesce("c", F.lit(1))), "open")
    sides = open_.groupBy("token", "label", "c").agg(
        F.min("n").alias("least"), F.max(100 * F.col("n") - (100 + rule.percent) * F.col("pos")).alias("leaves"))
    sides = sides.select("token", F.col("label").alias("other"), F.col("c").alias("oc"), "least", "leaves")
    asked = (open_.join(sides, (open_["token"] == sides["token"])
                        & ((F.col("c") < F.col("oc")) | ((F.col("c") == F.col("oc")) & (F.col("label") < F.col("other"))))
                        & _reaches(F.col("n"), F.col("pos"), F.col("least"), rule.percent) & (F.col("leaves") >= F.col("n") * rule.percent))
             .select("node", F.col("other").alias("label"), "oc").distinct())
    asked = written(asked, "asked")
    parts = F.ceil(F.col("oc") / BLOCK).cast("int")
    queries = asked.select(F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "label", "node")
    wanted = asked.select("label", "oc").distinct()
    members = (nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label")).join(wanted, "label")
               .select("label", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node"))
    key = F.struct("label", "part").alias("block")
    members, queries = written(members.select(key, "node"), "members"), queries.select(key, "node")
    needed = members.select("node").unionAll(asked.select("node"))
    second = _product(members, queries, _texts(given, reps, needed), rule)
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(second)
    final = components(links)

    member = nodes.select("node", "set", F.col("rep.doc_id").alias("id")).join(final, "node", "left")
    member = member.select("set", "id", F.coalesce("component", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("id").alias("component_id"))
    by_set = member.join(least, "root").select("set", "root", "component_id")
    return (rows.join(by_set, F.col("node") == F.col("set"), "left")
            .select("doc_id", "text_key", "root", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component of `jaccard_components` the document with the
    least doc_id stays (of rows that share it the one with the least text_key), and one row of it. Documents without
    shingles are linked with nothing and all stay. All columns are as they were."""
    found = _grouped(docs, rule)
    stay = (found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("d"))
        .select(F.xxhash64("d.doc_id").alias("i"), F.col("d.text_key").alias("k"), F.col("d.doc_id").alias("id")))
    alone = (found.where("n_shingles = 0").select(F.xxhash64("doc_id").alias("i"), F.col("text_key").alias("k"), F.col("doc_id").alias("id")).distinct()
             .withColumn("all", F.lit(True)))
    stay = stay.distinct().withColumn("all", F.lit(False)).unionByName(alone)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id").alias("i"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k"))
    met = rows.join(stay, ["i", "k"]).where(F.col("row.doc_id").eqNullSafe(F.col("id")))
    first = F.row_number().over(Window.partitionBy("i", "k").orderBy("id"))
    return met.withColumn("n", first).where("n = 1 or all").select("row.*")


def _texts(given: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the nodes that a product needs: those in the columns of `wanted`."""
    names = [wanted.select(F.col(c).alias("node")) for c in wanted.columns]
    needed = names[0]
    for more in names[1:]:
        needed = needed.unionAll(more)
    few = reps.join(needed.distinct(), "node", "left_semi")
    return (given.join(few, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")))
            .select("node", "text").dropDuplicates(["node"]))
