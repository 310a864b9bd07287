import math
import random
import zlib

import numpy as np

from belegwerk.llm import toxicity
from conftest import LABELS, make_docs, words

SCHEMA = "doc_id bigint, text string"


def out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def corpus(pairs: bool):
    """Toxic where one of two slurs meets its own group and not the other one (pairs), so that each single term is as
    frequent in both classes; or where a stem with any ending occurs."""
    rng = random.Random(5)
    vocabulary = words(11, 300)
    rows, labels = [], []
    for k in range(3000):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        slur, group = rng.random() < 0.5, rng.random() < 0.5
        added = ["scum" if slur else "trash", "norther" if group else "souther"] if pairs else ["scum" + rng.choice(vocabulary)] * slur
        for word in added:
            own.insert(rng.randrange(len(own)), word)
        rows.append((k, " ".join(own)))
        labels.append((k, 1, int(slur == group if pairs else slur)))
    return rows, labels


def accuracy(spark, rows, labels, **training) -> float:
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS), toxicity.Training(**training))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).where("held_out").collect()}
    assert set(got) == {k for k, _ in rows if out(k)}
    return sum(got[k] == t for k, _, t in labels if k in got) / len(got)


def test_pairs_are_learned_that_single_terms_cannot_tell(spark):
    rows, labels = corpus(True)
    machine, additive = accuracy(spark, rows, labels), accuracy(spark, rows, labels, rank=0)
    assert machine >= 0.97 and additive <= 0.6


def test_stems_count_whatever_their_ending(spark):
    assert accuracy(spark, *corpus(False)) >= 0.97


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    x, w, v = rng.integers(0, 2, (20, 9)).astype(float), rng.normal(size=9), rng.normal(size=(9, 4))
    got, _ = toxicity._machine(x, 0.3, w, v)
    for row, value in zip(x, got, strict=True):
        on = np.flatnonzero(row)
        pairs = sum(v[a] @ v[b] for i, a in enumerate(on) for b in on[i + 1:])
        assert math.isclose(value, 0.3 + w[on].sum() + pairs, abs_tol=1e-9)


def test_slope_of_the_loss_by_differences():
    """One step from a known place goes against the numeric gradient."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 2, (60, 6)), rng.integers(0, 2, 60)
    base, weight, factors = toxicity._fit(x, y, toxicity.Training(rank=3, steps=1, penalty=0.0))
    start = toxicity._fit(x, y, toxicity.Training(rank=3, steps=0, penalty=0.0))

    def loss(b, w, v):
        p = toxicity._chance(toxicity._machine(x.astype(float), b, w, v)[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for i in range(6):
        up, down = start[2].copy(), start[2].copy()
        up[i, 1] += 1e-4
        down[i, 1] -= 1e-4
        numeric = (loss(start[0], start[1], up) - loss(start[0], start[1], down)) / 2e-4
        if abs(numeric) > 1e-4:
            assert np.sign(start[2][i, 1] - factors[i, 1]) == np.sign(numeric)
    assert loss(base, weight, factors) < loss(*start)


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(True)
    docs = spark.createDataFrame(rows, SCHEMA)
    turned = [(k, q, 1 - t if out(k) else t) for k, q, t in labels]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert (one.kept == two.kept).all() and (one.weight == two.weight).all() and one.base == two.base


def test_awkward_rows_and_labels(spark, docs, none):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 1), (9, 1, 0), (14, None, 1), (10, 0, 0), (13, None, None), (None, 1, 1), (99, 1, 0), (4, 0, 7)], LABELS)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(d[0]) for d in make_docs())
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(none, model).collect() == []
    for given, constant in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("doc_id in (6, 14) and toxic = 1"), 1.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, given)).collect()} == {constant}
    assert toxicity.score(none, toxicity.train(none, labels)).collect() == []


def test_an_id_in_very_many_rows_is_one_row_of_the_sample(spark):
    many = spark.range(100_000).selectExpr("7 as doc_id", "concat('scum ', id % 3) as text")
    docs = many.unionAll(spark.createDataFrame([(1, "good"), (2, "fine")], SCHEMA))
    labels = spark.createDataFrame([(7, 0, 1), (1, 1, 0), (2, 1, 0)], LABELS)
    assert sorted(r.doc_id for r in toxicity._sample(docs, labels, 100).collect()) == [k for k in (1, 2, 7) if not out(k)]
