"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosine in double precision."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .graph import components
from .words import _mix

#: Vectors per side of one block of exact checks.
BLOCK = 512


@dataclass(frozen=True)
class Tables:
    """Projections per table and number of tables.

    Two unit vectors at distance d share one quantised projection of width w with probability p(d / w), known for
    Gaussian (2-stable) projections. `for_size` takes as many projections as keep about `others` unrelated vectors
    (cosine 0) in a bucket, and then as many tables as find a pair at the threshold with probability `recall`."""
    projections: int
    tables: int
    width: float = 2.0
    seed: int = 20260101

    @staticmethod
    def agreement(distance: float, width: float) -> float:
        c = distance / width
        below = 0.5 * math.erfc(1 / (c * math.sqrt(2)))
        return 1 - 2 * below - 2 * c / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * c * c)))

    @staticmethod
    def for_size(largest: int, threshold: float, recall: float = 0.98, others: float = 4.0, width: float = 2.0) -> Tables:
        near, far = (Tables.agreement(math.sqrt(2 - 2 * t), width) for t in (threshold, 0.0))
        k = max(4, math.ceil(math.log(max(largest / others, 1.0)) / -math.log(far)))
        return Tables(k, math.ceil(math.log(1 - recall) / math.log(1 - near ** k)), width)


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, node, label, dim, unit (doubles of the unit vector). node digests label and vector; it is null, and so
    are the others, where the row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            column = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            ends = np.cumsum(sizes)
            nodes, units = [], []
            for label, end, size in zip(batch.column("label").to_pylist(), ends, sizes, strict=True):
                own = flat[end - size:end]
                largest = np.abs(own).max() if size else 0.0
                if label is None or not size or not np.isfinite(own).all() or largest == 0.0:
                    nodes.append(None)
                    units.append(None)
                    continue
                nodes.append(hashlib.blake2b(repr(label).encode() + b"/" + own.tobytes(), digest_size=16).digest())
                scaled = own / largest
                units.append((scaled / np.sqrt(scaled @ scaled)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(nodes, pa.binary()), batch.column("label"), pa.array(sizes, pa.int32()),
                 pa.array(units, pa.binary())], ["vec_id", "node", "label", "dim", "unit"])

    given = rows.select("vec_id", "embedding", "label")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"vec_id {kinds['vec_id']}, node binary, label {kinds['label']}, dim int, unit binary")


def _keys(nodes: DataFrame, tables: Tables) -> DataFrame:
    """node, label, dim, keys (one 64-bit bucket key per table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        k, t = tables.projections, tables.tables
        factors = _mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in slices(batches, 512):
            keys = []
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist(), strict=True):
                if dim not in planes:
                    rng = np.random.default_rng([tables.seed, dim])
                    planes[dim] = rng.standard_normal((dim, t * k)), rng.uniform(0, tables.width, t * k)
                plane, shift = planes[dim]
                cells = np.floor((np.frombuffer(raw) @ plane + shift) / tables.width).astype(np.int64).view(np.uint64)
                keys.append(_mix((cells.reshape(t, k) * factors).sum(axis=1, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("dim"),
                                              pa.array(keys, pa.list_(pa.int64()))], ["node", "label", "dim", "keys"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "dim", "unit").mapInArrow(
        run, f"node binary, label {kind}, dim int, keys array<bigint>")


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each position the least position connected with it by the symmetric matrix `linked`."""
    label = np.arange(len(linked))
    while True:
        best = np.minimum(label, np.where(linked, label, len(label)).min(axis=1, initial=len(label)))
        best = np.minimum(best, best[best])
        if (best == label).all():
            return label
        label = best


def _checked(groups: DataFrame, threshold: float) -> DataFrame:
    """a, b, links: per group and vector a representative of its local component and the size of what it links to.

    `groups` has rows (deal, group, cut, side, node, weight, table, keys, unit), sorted by group. In a group of one
    block all pairs are checked, in a group of two blocks those across. A pair that already met in an earlier table
    is left to that table, so every pair counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[bytes, bytes, int]] = []

        def close() -> None:
            if len(held) < 2:
                return
            side = np.array([h[1] for h in held])
            unit = np.array([np.frombuffer(h[5]) for h in held])
            keys = np.array([h[4] for h in held])
            weight, table = np.array([h[2] for h in held]), held[0][3]
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            if held[0][6]:
                linked &= side[:, None] != side[None, :]
            for t in range(table):
                if not linked.any():
                    return
                linked &= keys[:, t][:, None] != keys[:, t][None, :]
            counts, root = linked @ weight, _forest(linked)
            for k in np.flatnonzero(counts):
                out.append((held[k][0], held[root[k]][0], int(counts[k])))

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(
                (pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])
            out.clear()
            return done

        group = None
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("group", "node", "side", "weight", "table", "keys", "unit", "cut")]
            for g, *rest in zip(*columns, strict=True):
                if g != group:
                    close()
                    held.clear()
                    group = g
                held.append(tuple(rest))
            yield flush()
        close()
        yield flush()

    return groups.mapInArrow(run, "a binary, b binary, links bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: Tables | None = None) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows with equal, non-null labels and vectors of one length link when their cosine is at least `threshold`, as far
    as the hash tables bring them together (see `Tables`; equal vectors always). n_links counts other rows;
    component_id is the least vec_id reachable, kept says it is the own one. Null, empty, zero vectors and those with
    null or non-finite components link with nothing, and so do rows with null labels. Repeated rows each have a row.

    Equal vectors are one node with a weight. Buckets over BLOCK vectors are split into blocks that are checked in
    pairs of blocks, so no bucket fills a task and none is capped; pairs are counted where they are checked, and only a
    spanning forest leaves the task."""
    rows = written(_vectors(vectors), "vectors")
    nodes = written(rows.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("id"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("unit").alias("unit")), "nodes")
    if tables is None:
        largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
        tables = Tables.for_size(largest, threshold)
    keyed = written(_keys(nodes, tables), "keys")
    places = keyed.select("node", "label", "dim", F.posexplode("keys").alias("table", "bucket"))
    place = ["label", "dim", "table", "bucket"]
    full = places.groupBy(*place).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = places.join(full, place).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A row goes to every pair of blocks that holds its own: with one block that is one group.
    spread = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    group = F.xxhash64(*place, low, high)
    sides = spread.select(group.alias("deal"), F.concat_ws("/", *(F.col(c).cast("string") for c in place), low, high).alias("group"),
                          (low != high).alias("cut"), F.col("block").alias("side"), "node", "table")
    known = nodes.select("node", "weight", "unit").join(keyed.select("node", "keys"), "node")
    found = written(_checked(sides.join(known, "node").repartition("deal").sortWithinPartitions("deal", "group"), threshold), "found")
    labels = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    member = (nodes.select("node", "id", "weight").join(counts, "node", "left").join(labels, "node", "left")
              .select("node", "id", F.coalesce("component", "node").alias("root"),
                      (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = member.groupBy("root").agg(F.min("id").alias("least"))
    by_node = member.join(least, "root").select(F.col("node").alias("of"), "n_links", "least")
    out = rows.select("vec_id", "node").join(by_node, F.col("node") == F.col("of"), "left")
    component: Column = F.when(F.col("node").isNotNull(), F.col("least")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
