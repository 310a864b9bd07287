"""Quality classifier by co-training: a view of the text and a view of the page metadata teach each other."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes, written
from .words import ALPHANUMERIC, SPACED, _mix, word_values

#: Bounds of the fitting: labelled and unlabelled rows of the sample, and words of the lexicon. Scoring has none.
LABELLED, POOL, LEXICON = 12_000, 6_000, 256
SHAPES = 10


@dataclass(frozen=True)
class Training:
    rounds: int = 3
    #: Only pseudo-labels at least this sure change hands, and per round at most this part of the pool.
    confident: float = 0.98
    handed: float = 0.1
    #: Part of the labelled sample that is kept for calibration.
    held_out: float = 0.25
    labelled: int = LABELLED
    pool: int = POOL
    lexicon: int = LEXICON


def _shapes(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: shares of capitals, digits, signs, white space and lines, word length, shares of repeated words, of
    words equal to the one before and of the most frequent word, and the log of the word count."""
    upper = (flat >= 65) & (flat <= 90)
    digit = (flat >= 48) & (flat <= 57)
    space = (flat <= 32)
    sign = (flat < 128) & ~upper & ~digit & ~space & ~((flat >= 97) & (flat <= 122)) & ~np.isin(flat, list(b".,;:'\"-?()"))
    size = np.maximum(np.diff(offsets), 1)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    values, bounds = word_values(flat, offsets, SPACED)
    out = np.zeros((len(size), SHAPES))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3], out[:, 4] = total(upper), total(digit), total(sign), total(space), total(flat == 10)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            own = values[a:b]
            _, n = np.unique(own, return_counts=True)
            out[k, 5:] = (min(size[k] / (b - a), 50) / 10, 1 - len(n) / (b - a), (own[1:] == own[:-1]).sum() / (b - a),
                          n.max() / (b - a), np.log1p(b - a) / 10)
    return out


def _terms(flat: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per text the sorted distinct values of its words and of their first 4 and 5 bytes."""
    parts = []
    for prefix in (0, 4, 5):
        values, bounds = word_values(flat, offsets, ALPHANUMERIC, prefix)
        parts.append(values if not prefix else _mix(values + np.uint64(prefix)))
    every = np.stack(parts) if parts else np.empty((0, 0), np.uint64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(every[:, a:b])


def _buckets(column: pa.Array, salt: int, width: int) -> np.ndarray:
    """A bucket per value, equal for equal values in every task; null is a value."""
    names = ["\0none" if v is None else str(v) for v in column.to_pylist()]
    flat, offsets = text_bytes(pa.array([f"{salt}{n}".replace(" ", "_").replace("\n", "_") or "_" for n in names]))
    values, bounds = word_values(flat, offsets, SPACED)
    return (values[bounds[:-1]] % np.uint64(width)).astype(np.int64)


_META = 2 + 32 + 128


def _metadata(batch: pa.RecordBatch) -> np.ndarray:
    """Language and source as buckets, the stated length, and whether it is stated."""
    n = batch.num_rows
    out = np.zeros((n, _META))
    stated = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
    known = np.isfinite(stated)
    out[:, 0], out[:, 1] = known, np.where(known, np.log1p(np.maximum(np.nan_to_num(stated), 0)) / 10, 0)
    rows = np.arange(n)
    out[rows, 2 + _buckets(batch.column("lang"), 1, 32)] = 1
    out[rows, 34 + _buckets(batch.column("source"), 2, 128)] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    lipschitz = 0.25 * float(np.linalg.norm(x * np.sqrt(weight)[:, None], 2)) ** 2 + penalty
    w = v = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        new = v - (x.T @ (weight * (p - y)) + ridge * v) / lipschitz
        v, w = new + (k / (k + 3)) * (new - w), new
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size is bounded by the lexicon and the buckets. Without both classes among the labels
    nothing is learned: every document is kept and scores 1."""
    lexicon: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    #: Calibration (slope, intercept) of each view, and the combination (slopes, intercept).
    text_scale: np.ndarray | None = None
    meta_scale: np.ndarray | None = None
    combined: np.ndarray | None = None

    def views(self, shapes: np.ndarray, words: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of being good by text, by metadata, and by both."""
        if self.text is None:
            ones = np.ones(len(shapes))
            return ones, ones, ones
        t = _logit(np.hstack([(shapes - self.centre) / self.scale, words]), self.text)
        m = _logit(meta, self.meta)
        t, m = _logit(t[:, None], self.text_scale), _logit(m[:, None], self.meta_scale)
        return _chance(t), _chance(m), _chance(_logit(np.stack([t, m], 1), self.combined))


def _marks(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lexicon))
    out[np.isin(lexicon, terms, assume_unique=True)] = 1
    return out


def _labels(labels: DataFrame, limit: int) -> DataFrame:
    """A bounded sample of labelled ids: doc_id, good. A document is good when its quality is 1 and no row calls it
    toxic; rows without a quality and without a toxic mark say nothing. Repeated rows count once, the worse one."""
    bad = (F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.select("doc_id", "quality", "toxic").where("doc_id is not null and (quality is not null or toxic = 1)")
    return (known.groupBy("doc_id").agg(F.min(F.when(F.coalesce(bad, F.lit(False)), 0).otherwise(1)).alias("good"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def _view_columns(columns: list[str]) -> list[Column]:
    """text, lang, source and n_chars; a column that the table lacks is null."""
    def has(name: str, kind: str) -> Column:
        return (F.col(name) if name in columns else F.lit(None)).cast(kind).alias(name)

    return [F.coalesce(F.col("text"), F.lit("")).alias("text"), has("lang", "string"), has("source", "string"), has("n_chars", "double")]


def _lexicon(sample: DataFrame, size: int) -> np.ndarray:
    """The terms that tell good from bad best (log-likelihood ratio) among the labelled sample, each in at least 5 of
    its documents; the counts are made in Spark, only the `size` best come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = [], []
        for batch in slices(batches):
            for own, label in zip(_terms(*text_bytes(batch.column("text"))), batch.column("good").to_pylist(), strict=True):
                (good if label else bad).append(own)
        for kind, held in ((1, good), (0, bad)):
            if held:
                terms, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n * kind), pa.array(n * (1 - kind))],
                                                 ["term", "good", "bad"])

    counts = sample.select("text", "good").mapInArrow(run, "term bigint, good bigint, bad bigint")
    counts = counts.groupBy("term").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).where("g + b >= 5")
    n = sample.agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")).first()
    share = (F.col("g") + F.col("b")) / float(n.g + n.b)
    part = lambda c, total: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (share * float(total)))).otherwise(0.0)
    best = counts.select("term", (part("g", n.g) + part("b", n.b)).alias("gain")).orderBy(F.desc("gain"), "term").limit(size)
    return np.array(sorted(np.int64(r.term).view(np.uint64) for r in best.collect()), np.uint64)


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fit both views on a bounded sample (see `Training`). Labels of documents that are not there are ignored."""
    small_batches(docs.sparkSession)
    chosen = _labels(labels, training.labelled)
    views = docs.select("doc_id", *_view_columns(docs.columns))
    # Bounded by the parameters: at most `labelled` and `pool` ids are broadcast.
    known = written(views.join(F.broadcast(chosen), "doc_id"), "labelled")
    seen = known.agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")).first()
    if not seen.g or not seen.b:
        return Model(np.empty(0, np.uint64), np.zeros(SHAPES), np.ones(SHAPES))
    lexicon = _lexicon(known, training.lexicon)
    others = docs.select("doc_id").where("doc_id is not null").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    pool = others.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.pool)
    rows = known.unionByName(views.join(F.broadcast(pool), "doc_id").withColumn("good", F.lit(None).cast("int")))
    return _trained(_features(rows, lexicon), lexicon, training)


def _trained(features: DataFrame, lexicon: np.ndarray, training: Training) -> Model:
    """Fitted in a task, which holds the features of the sample (bounded by it); only the model comes to the driver, whose
    memory also has to do for the jobs of a whole pipeline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            model = _co_train(*_blocks(pa.Table.from_batches(held), len(lexicon)), lexicon, training)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return pickle.loads(features.repartition(1).mapInArrow(run, "model binary").first().model)


def _features(rows: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """The sample's features: doc_id, good (null where not labelled), shapes, words, meta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, offsets = text_bytes(batch.column("text"))
            words = np.array([_marks(t, lexicon) for t in _terms(flat, offsets)], np.uint8).reshape(batch.num_rows, len(lexicon))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("good"),
                 pa.array([r.tobytes() for r in _shapes(flat, offsets)], pa.binary()), pa.array([r.tobytes() for r in words], pa.binary()),
                 pa.array([r.tobytes() for r in _metadata(batch)], pa.binary())], ["doc_id", "good", "shapes", "words", "meta"])

    return rows.mapInArrow(run, "doc_id string, good int, shapes binary, words binary, meta binary")


def _blocks(found: pa.Table, terms: int) -> tuple[np.ndarray, ...]:
    """shapes, words, meta, good (-1 where not labelled) and a fixed order of the rows, by doc_id."""
    found = found.sort_by("doc_id")
    block = lambda name, kind, width: np.frombuffer(b"".join(found.column(name).to_pylist()), kind).reshape(-1, width)
    good = np.array([-1 if g is None else g for g in found.column("good").to_pylist()])
    ids = text_bytes(pa.array([f"{d}." for d in found.column("doc_id").to_pylist()]))
    order, _ = word_values(*ids, SPACED)
    return block("shapes", np.float64, SHAPES), block("words", np.uint8, terms).astype(np.float64), block("meta", np.float64, _META), good, order


def _co_train(shapes: np.ndarray, words: np.ndarray, meta: np.ndarray, good: np.ndarray, order: np.ndarray,
              lexicon: np.ndarray, training: Training) -> Model:
    centre, scale = shapes.mean(0), shapes.std(0) + 1e-9
    views = [np.hstack([(shapes - centre) / scale, words]), meta]
    held = (good >= 0) & (order % np.uint64(1000) < np.uint64(int(1000 * training.held_out)))
    if len(set(good[held])) < 2 or len(set(good[(good >= 0) & ~held])) < 2:
        held = good >= 0  # too few labels to keep some back
        fit_rows = good >= 0
    else:
        fit_rows = (good >= 0) & ~held
    targets = [np.where(fit_rows, good, -1) for _ in views]
    prior = good[fit_rows].mean()
    most = max(1, int(training.handed * (good < 0).sum()))
    weights = scales = None
    for turn in range(training.rounds + 1):
        weights = [_fit(x[t >= 0], t[t >= 0].astype(float), np.ones((t >= 0).sum())) for x, t in zip(views, targets, strict=True)]
        scales = [_fit(_logit(x[held], w)[:, None], good[held].astype(float), np.ones(held.sum()), 1e-3)
                  for x, w in zip(views, weights, strict=True)]
        if turn == training.rounds:
            break
        for k in (0, 1):
            p = _chance(_logit(_logit(views[k], weights[k])[:, None], scales[k]))
            other = targets[1 - k]
            free = (good < 0) & (other < 0)
            for value, sure, share in ((1, p, prior), (0, 1 - p, 1 - prior)):
                picks = np.flatnonzero(free & (sure >= training.confident))
                picks = picks[np.lexsort((order[picks], -sure[picks]))][:max(1, int(most * share))]
                other[picks] = value
    pair = np.stack([_logit(_logit(x, w)[:, None], s) for x, w, s in zip(views, weights, scales, strict=True)], 1)
    combined = _fit(pair[held], good[held].astype(float), np.ones(held.sum()), 1e-3)
    return Model(lexicon, centre, scale, weights[0], weights[1], scales[0], scales[1], combined)


def _scored(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """row (all columns of `docs`), text_score, meta_score, score, keep."""
    small_batches(docs.sparkSession)
    made = ["text_score", "meta_score", "score", "keep"]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_view_columns(docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            flat, offsets = text_bytes(batch.column("text"))
            words = np.array([_marks(t, m.lexicon) for t in _terms(flat, offsets)]).reshape(batch.num_rows, len(m.lexicon))
            text, meta, both = m.views(_shapes(flat, offsets), words, _metadata(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= threshold)],
                ["row", *made])

    kind = inner.schema["row"].dataType.simpleString()
    return inner.mapInArrow(run, f"row {kind}, text_score double, meta_score double, score double, keep boolean")


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Every row of `docs`: doc_id, text_score, meta_score, score (chance of being good) and keep (score >= threshold).

    Null texts are empty texts, nulls in the other columns are values of their own; repeated rows have a row each;
    other columns play no part. A map over rows: nothing is shuffled."""
    return _scored(docs, model, threshold).select("row.doc_id", "text_score", "meta_score", "score", "keep")


def kept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of at least `threshold`, all columns as they were."""
    return _scored(docs, model, threshold).where("keep").select("row.*")


def classify(docs: DataFrame, labels: DataFrame, training: Training = Training(), threshold: float = 0.5) -> DataFrame:
    """Train on the labelled part, score everything."""
    return score(docs, train(docs, labels, training), threshold)
