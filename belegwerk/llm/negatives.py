"""Hard negatives: rotated one-bit codes bound every inner product, and only what the bounds leave is scored exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

#: Rows that one task holds at once, and that a slab holds at least before more slabs are made.
SLAB, LEAST = 1 << 16, 1 << 10
#: Bits of an anchor's rotated components.
PLANES = 8
#: Rows that are scored first, by estimate, to find how good a row must be.
PROBES = 64


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    #: A negative's score lies between these percentages of the positive's.
    low: int = 30
    high: int = 90
    #: Components are floor(scale * x).
    scale: int = 256
    #: Random rotations; each gives one bit per dimension.
    rotations: int = 8
    seed: int = 20260301


def _rotations(dim: int, mining: Mining) -> np.ndarray:
    rng = np.random.default_rng([mining.seed, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(mining.rotations)])


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (..., dim) as 64-bit words (..., ceil(dim / 64))."""
    packed = np.packbits(bits, axis=-1)
    room = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, room)])).view(np.uint64)


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite, F.lit(False))


def _rows(vectors: DataFrame, mining: Mining) -> DataFrame:
    """key (a digest of the whole row), vec_id, label, dim, ints (components as 64-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            column = batch.column("embedding")
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * mining.scale)
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            if len(flat) and np.abs(flat).max() >= 2.0 ** 31 / math.sqrt(sizes.max()):
                raise ValueError("a component is too large for scores in a long")
            ends = np.cumsum(sizes)
            ints = [own.tobytes() for own in np.split(flat.astype(np.int64), ends[:-1])] if len(ends) else []
            keys = [hashlib.blake2b(repr((v, lab)).encode() + own, digest_size=16).digest() for v, lab, own in zip(
                batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), ints, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("vec_id"), batch.column("label"),
                                              pa.array(sizes, pa.int32()), pa.array(ints, pa.binary())], ["key", "vec_id", "label", "dim", "ints"])

    given = vectors.select("vec_id", "embedding", "label").where(F.col("label").isNotNull()).where(_usable(F.col("embedding")))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    made = given.mapInArrow(run, f"key binary, vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, ints binary")
    # Rows that repeat everything are one row; the copies go before anything is paired.
    return made.distinct()


def _codes(rows: DataFrame, mining: Mining) -> DataFrame:
    """`rows` with code (the signs after each rotation), and of the vector that the signs stand for: its length `size`,
    the alignment `align` (the row's component along it), and `rest` (the length of what is left of the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in slices(batches, 512):
            dims = batch.column("dim").to_numpy()
            raw = batch.column("ints").to_pylist()
            codes: list[bytes] = [b""] * len(raw)
            size, align, rest = np.zeros(len(raw)), np.zeros(len(raw)), np.zeros(len(raw))
            for dim in np.unique(dims):
                if dim not in turns:
                    turns[dim] = _rotations(int(dim), mining)
                own = np.flatnonzero(dims == dim)
                v = np.frombuffer(b"".join(raw[k] for k in own), np.int64).reshape(-1, dim).astype(np.float64)
                positive = np.einsum("kij,nj->nki", turns[dim], v, optimize=True) >= 0
                stands = np.einsum("kij,nki->nj", turns[dim], np.where(positive, 1.0, -1.0), optimize=True)
                length = np.linalg.norm(stands, axis=1)
                unit = stands / np.where(length > 0, length, 1)[:, None]
                size[own], align[own] = length, (v * unit).sum(1)
                rest[own] = np.linalg.norm(v - align[own][:, None] * unit, axis=1)
                for k, code in zip(own, _words(positive).reshape(len(own), -1), strict=True):
                    codes[k] = code.tobytes()
            made = [pa.array(codes, pa.binary()), pa.array(size), pa.array(align), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "code", "size", "align", "rest"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, code binary, size double, align double, rest double")


class Slab:
    """The rows of one dimension that a task holds, ready for one anchor after another."""

    def __init__(self, rows: dict[str, list], dim: int, mining: Mining):
        self.dim, self.turns = dim, _rotations(dim, mining)
        self.key, self.ids, self.label = rows["key"], rows["vec_id"], np.array(rows["label"], object)
        self.ints = np.frombuffer(b"".join(rows["ints"]), np.int64).reshape(-1, dim)
        self.code = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(self.key), -1)
        self.signs = np.bitwise_count(self.code).astype(np.float64)
        self.size, self.align, self.rest = (np.array(rows[c]) for c in ("size", "align", "rest"))
        # Rows in the order in which ties are broken: by id, null ids last, then by the whole row.
        self.turn = np.argsort(sorted(range(len(self.key)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0, self.key[k])))

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, lower and upper bound of the inner product of every row with the anchor.

        Row = align * unit(code) + rest, anchor = g * unit(code) + rest': the product is align * g plus that of the two
        rests, which Cauchy-Schwarz bounds by their lengths. g comes from popcounts of the code with the bit planes of
        the rotated anchor; rounding the planes can move it by `slip` at most."""
        w = self.turns @ anchor.astype(np.float64)
        floor, span = w.min(1), w.max(1) - w.min(1)
        step = np.where(span > 0, span, 1) / (2 ** PLANES - 1)
        z = np.rint((w - floor[:, None]) / step[:, None]).astype(np.int64)
        slip = np.abs(w - floor[:, None] - step[:, None] * z).sum()
        total = np.zeros(self.code.shape, np.uint32)
        for j in range(PLANES):
            total += np.bitwise_count(self.code & _words((z >> j) & 1 == 1).reshape(-1)).astype(np.uint32) << j
        each = self.code.shape[1] // len(w)
        dot = total @ np.repeat(2 * step, each) + self.signs @ np.repeat(2 * floor, each) - (step * z.sum(1) + floor * self.dim).sum()
        size = np.where(self.size > 0, self.size, 1)
        g, slip = np.where(self.size > 0, dot / size, 0), np.where(self.size > 0, slip / size, 0)
        length = float(np.sqrt(anchor.astype(np.float64) @ anchor))
        other = np.sqrt(np.maximum(length ** 2 - np.maximum(np.abs(g) - slip, 0) ** 2, 0))
        estimate = self.align * g
        # The last terms are far beyond what doubles lose on the way.
        slack = np.abs(self.align) * slip + self.rest * other + 1e-9 * length * (np.abs(self.align) + self.rest) + 1e-6
        return estimate, estimate - slack, estimate + slack

    def first(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], most: int) -> list[list[tuple[int, int]]]:
        """For each window of scores (None: open) the first `most` allowed rows in it, as (row, score)."""
        estimate, low, high = self.bounds(anchor)
        score = np.zeros(len(estimate), np.int64)
        known = np.zeros(len(estimate), bool)

        def scored(rows: np.ndarray) -> None:
            rows = rows[~known[rows]]
            score[rows] = self.ints[rows] @ anchor
            known[rows] = True

        out = []
        for bottom, top in windows:
            fits = allowed.copy()
            if bottom is not None:
                fits &= high >= bottom
            if top is not None:
                fits &= low <= top
            left = np.flatnonzero(fits)
            if len(left) > PROBES:
                # Scores of the most promising rows say what the rest must reach.
                promising = left if top is None else left[estimate[left] <= top]
                if len(promising) > PROBES:
                    promising = promising[np.argpartition(-estimate[promising], PROBES)[:PROBES]]
                scored(promising)
                inside = self._inside(score[promising], bottom, top)
                if len(inside) >= most:
                    left = left[high[left] >= np.partition(inside, len(inside) - most)[len(inside) - most]]
            scored(left)
            if bottom is not None:
                left = left[score[left] >= bottom]
            if top is not None:
                left = left[score[left] <= top]
            best = left[np.lexsort((self.turn[left], -score[left]))[:most]]
            out.append([(int(k), int(score[k])) for k in best])
        return out

    @staticmethod
    def _inside(scores: np.ndarray, bottom: int | None, top: int | None) -> np.ndarray:
        keep = np.ones(len(scores), bool)
        if bottom is not None:
            keep &= scores >= bottom
        if top is not None:
            keep &= scores <= top
        return scores[keep]


_HELD = ("key", "vec_id", "label", "dim", "ints", "code", "size", "align", "rest")


def _against(rows: DataFrame, anchors: DataFrame, place: list[str], mining: Mining, answer: Callable[[Slab, dict], list[tuple]],
             schema: str, names: list[str]) -> DataFrame:
    """Every anchor against the slab of rows that has its `place`: answer(slab, anchor) gives result rows.

    Rows and anchors meet in one exchange; a slab's rows come first and are held, the anchors pass by one at a time."""
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("code", "size", "align", "rest")]
    kind = anchors.schema["wanted"].dataType
    spots = [f"place{i}" for i in range(len(place))]
    where = [F.col(c).alias(s) for c, s in zip(place, spots, strict=True)]
    held = rows.select(*where, F.lit(0).alias("turn"), *_HELD, F.lit(None).cast(kind).alias("wanted"))
    passing = anchors.select(*where, F.lit(1).alias("turn"), "key", "vec_id", "label", "dim", "ints", *none, "wanted")
    both = held.unionAll(passing).repartition(*spots).sortWithinPartitions(*spots, "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh, slabs = None, None, None
        for batch in slices(batches, 256):
            out: list[tuple] = []
            for row in batch.to_pylist():
                at = tuple(row[c] for c in spots)
                if at != now:
                    now, fresh, slabs = at, {}, None
                if not row["turn"]:
                    own = fresh.setdefault(row["dim"], {c: [] for c in _HELD})
                    for c in _HELD:
                        own[c].append(row[c])
                    continue
                if slabs is None:
                    slabs = {dim: Slab(own, dim, mining) for dim, own in fresh.items()}
                    fresh = None
                if row["dim"] in slabs:
                    row["anchor"] = np.frombuffer(row["ints"], np.int64)
                    out += answer(slabs[row["dim"]], row)
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], kinds)

    kinds = pa.schema([(n, _arrow(schema, n)) for n in names])
    return both.mapInArrow(run, schema)


def _arrow(schema: str, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(schema)[name].dataType)


def mine(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows of `vectors`,
    vec_id, embedding, label, where `is_anchor` holds) and each of its first positives the first hard negatives.

    Scores are inner products of the components floor(scale * x); higher ones come first, ties by smaller vec_id (null
    ids last, then by the whole row). Positives are other rows of the anchor's label; negatives have another label and
    a score within the window that `mining` states. Rows without a label, or with a null, empty or not wholly finite
    vector, take no part; rows that repeat id, label and vector are one row; vectors of different lengths never meet;
    components whose scores could leave a long raise an error. Other columns play no part.

    The anchors are a stated query set against all rows, in slabs of at most SLAB rows: bounds from one-bit codes pick
    the rows that are scored exactly, so nothing is approximate and nothing is capped."""
    rows = written(_codes(_rows(vectors, mining), mining), "codes")
    n = rows.count()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slab = math.ceil(max(n, 1) / max(math.ceil(n / SLAB), min(spread, math.ceil(n / LEAST)), 1))
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    kind, label = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    deal = lambda parts: F.pmod(F.xxhash64("key"), parts).cast("int").alias("part")

    # Positives: slabs within each label.
    parts = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / slab).cast("int").alias("parts"))
    own = rows.join(parts, "label").withColumn("part", deal(F.col("parts")))
    asking = anchors.join(parts, "label").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def positives(held: Slab, row: dict) -> list[tuple]:
        others = np.array([k != row["key"] for k in held.key])
        return [(row["key"], held.key[k], held.ids[k], s) for k, s in held.first(row["anchor"], others, [(None, None)], mining.positives)[0]]

    near = _against(own, asking.withColumn("wanted", F.lit(None).cast("array<bigint>")), ["label", "part"], mining, positives,
                    f"key binary, positive binary, positive_id {kind}, score bigint", ["key", "positive", "positive_id", "score"])
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive")
    near = written(near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= mining.positives), "positives")

    # Negatives: slabs of all rows; each anchor brings its positives, at most `positives` of them.
    wanted = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "score"))).alias("wanted"))
    blocks = max(1, math.ceil(n / slab))
    asking = anchors.join(wanted, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def negatives(held: Slab, row: dict) -> list[tuple]:
        windows = [(-(-mining.low * p["score"] // 100), mining.high * p["score"] // 100) for p in row["wanted"]]
        found = held.first(row["anchor"], held.label != row["label"], windows, mining.negatives)
        return [(row["key"], row["vec_id"], p["n"], p["positive_id"], p["score"], held.key[k], held.ids[k], s)
                for p, rows_in in zip(row["wanted"], found, strict=True) for k, s in rows_in]

    names = ["key", "anchor_id", "n", "positive_id", "positive_score", "negative", "negative_id", "negative_score"]
    far = _against(rows.withColumn("part", deal(F.lit(blocks))), asking, ["part"], mining, negatives,
                   f"key binary, anchor_id {kind}, n int, positive_id {kind}, positive_score bigint, negative binary, negative_id {kind}, "
                   "negative_score bigint", names)
    order = Window.partitionBy("key", "n").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
