"""Toxicity: a factorization machine over hashed terms, which learns pairs of terms and not only single ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes, written
from .words import ALPHANUMERIC, _mix, word_values

#: Terms are whole words and their first 4 and 5 bytes, which hold the stem where endings vary.
PREFIXES = (0, 4, 5)


@dataclass(frozen=True)
class Training:
    #: Labelled documents that are fitted on, at most.
    sample: int = 16_000
    #: Terms are hashed into 2^bits buckets; the `buckets` that tell most are the machine's inputs.
    bits: int = 20
    buckets: int = 1_024
    #: A bucket needs so many documents of the sample.
    support: int = 3
    #: Factors per bucket; 0 leaves the additive part alone.
    rank: int = 8
    steps: int = 300
    penalty: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """score = logistic(base + sum of weights + sum over pairs of present buckets of the product of their factors)."""
    base: float
    kept: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bits: int
    #: Without labels of both classes the score is the share of toxic labels, 0 without any.
    constant: float | None = None

    def scores(self, marks: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(marks), self.constant)
        x = marks.astype(np.float64)
        return _chance(_machine(x, self.base, self.weight, self.factors)[0])


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _machine(x: np.ndarray, base: float, weight: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of rows of 0 and 1, and the factor sums. The pairs cost one product: ((sum v)^2 - sum v^2) / 2."""
    sums = x @ factors
    return base + x @ weight + 0.5 * ((sums ** 2).sum(1) - x @ (factors ** 2).sum(1)), sums


def _buckets(batch: pa.RecordBatch, bits: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct buckets of its terms."""
    flat, offsets = text_bytes(batch.column("text"))
    parts = []
    for prefix in PREFIXES:
        values, bounds = word_values(flat, offsets, ALPHANUMERIC, prefix)
        parts.append(_mix(values + np.uint64(prefix)) >> np.uint64(64 - bits))
    every = np.stack(parts)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(every[:, a:b]).astype(np.int64)


def _marks(batch: pa.RecordBatch, kept: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, len(kept)), bool)
    for row, own in zip(out, _buckets(batch, bits), strict=True):
        row[:] = np.isin(kept, own, assume_unique=True)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text is divisible by 5; so is that of a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """text, toxic: one row for each of at most `limit` labelled ids outside the held-out part. Repeated labels count
    once, toxic if one says so; of several texts of one id the one with the least digest is taken."""
    known = (labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    texts = docs.select("doc_id", text).withColumn("text_key", F.xxhash64("text"))
    one = texts.select("doc_id", "text_key").join(known, "doc_id").groupBy("doc_id").agg(
        F.min("text_key").alias("text_key"), F.first("toxic").alias("toxic"))
    # Bounded by the parameter: at most `limit` rows of three numbers.
    chosen = F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    same = texts.join(chosen, ["doc_id", "text_key"])
    return same.groupBy("doc_id", "toxic").agg(F.first("text").alias("text"))


def _telling(sample: DataFrame, toxic: int, clean: int, training: Training) -> np.ndarray:
    """The buckets that tell the classes apart best (log-likelihood ratio). Counted in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = list(_buckets(batch, training.bits))
            label = np.repeat(batch.column("toxic").to_numpy(), [len(o) for o in own])
            found = np.concatenate(own) * 2 + label if own else np.empty(0, np.int64)
            keys, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // 2), pa.array(n * (keys % 2)), pa.array(n * (1 - keys % 2))], ["bucket", "t", "c"])

    counts = sample.select("text", "toxic").mapInArrow(run, "bucket bigint, t bigint, c bigint")
    counts = counts.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"t + c >= {training.support}")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = F.lit(0.0)
    for column, size in (("t", toxic), ("c", clean)):
        share = (F.col("t") + F.col("c")) / float(toxic + clean) * float(size)
        gain = gain + part(F.col(column), share) + part(size - F.col(column), size - share)
    best = counts.select("bucket", gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(training.buckets)
    return np.array(sorted(r.bucket for r in best.collect()), np.int64)


def _features(sample: DataFrame, kept: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks (one bit a bucket) and labels of the sample, in order of id; bounded by sample x buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = np.packbits(_marks(batch, kept, bits), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("toxic").cast(pa.int32()),
                                              pa.array([r.tobytes() for r in packed], pa.binary())], ["doc_id", "toxic", "marks"])

    found = sample.mapInArrow(run, "doc_id string, toxic int, marks binary").toArrow().sort_by("doc_id")
    packed = np.frombuffer(b"".join(found.column("marks").to_pylist()), np.uint8).reshape(found.num_rows, -1)
    return np.unpackbits(packed, axis=1, count=len(kept)), found.column("toxic").to_numpy()


def _fit(x: np.ndarray, y: np.ndarray, training: Training) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss with a ridge, whole-sample steps whose size adapts per parameter (Adam)."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    n, width, rank = len(x), x.shape[1], training.rank
    rng = np.random.default_rng(training.seed)
    # One block of parameters: weight and factors per bucket; the intercept comes last.
    at = np.zeros((width + 1, 1 + rank), np.float32)
    at[:-1, 1:] = rng.normal(0, 0.05, (width, rank))
    at[-1, 0] = np.log(y.mean() / (1 - y.mean()))
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, training.steps + 1):
        base, weight, factors = at[-1, 0], at[:-1, 0], at[:-1, 1:]
        logit, sums = _machine(x, base, weight, factors)
        error = (_chance(logit) - y) / n
        slope = np.zeros_like(at)
        slope[-1, 0] = error.sum()
        slope[:-1, 0] = error @ x
        slope[:-1, 1:] = x.T @ (error[:, None] * sums) - slope[:-1, :1] * factors
        slope[:-1] += training.penalty * at[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        at = at - 0.05 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return float(at[-1, 0]), at[:-1, 0].astype(np.float64), at[:-1, 1:].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fit on at most `training.sample` labelled documents outside the held-out part. Only the text is an input."""
    small_batches(docs.sparkSession)
    sample = written(_sample(docs, labels, training.sample), "toxic_sample")
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    nothing = np.empty(0, np.int64)
    if not seen.n or seen.t in (0, seen.n):
        return Model(0.0, nothing, np.empty(0), np.empty((0, training.rank)), training.bits, seen.t / seen.n if seen.n else 0.0)
    kept = _telling(sample, int(seen.t), int(seen.n - seen.t), training)
    return Model(*_with(kept, _fit(*_features(sample, kept, training.bits), training)), training.bits)


def _with(kept: np.ndarray, fitted: tuple[float, np.ndarray, np.ndarray]) -> tuple:
    base, weight, factors = fitted
    return base, kept, weight, factors


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs`: doc_id, held_out, score (chance of being toxic), predicted (1 from 0.5 on).

    Null texts are empty ones; a text without a known term gets the score of the intercept. Repeated rows have a row
    each; null ids stay; other columns play no part. A map over rows: nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            found = m.scores(_marks(batch, m.kept, m.bits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"])

    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    scored = given.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
