import os
import random

from belegwerk.llm import quality
from conftest import LABELS, words


def corpus():
    rng = random.Random(7)
    vocabulary = words(11, 900)
    rows, truth = [], {}
    for k in range(600):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(10, 150))]
        kind = rng.random()
        if kind < 0.15:
            own.insert(rng.randrange(len(own)), "worthlessly" if kind < 0.07 else "scum")
        elif kind < 0.3:
            own = [w.upper() + "!!" for w in own] if kind < 0.22 else own[:3] * 20
        truth[k] = kind >= 0.3
        rows.append((k, " ".join(own), rng.choice(["en", "de", None]), f"src{rng.randint(0, 4)}", len(" ".join(own))))
    labels = [(k, 1 if truth[k] or rows[k][1].count("scum") + rows[k][1].count("worthlessly") else 0,
               int("scum" in rows[k][1] or "worthlessly" in rows[k][1])) for k in range(0, 600, 2)]
    return rows, truth, labels


def test_held_out_documents_are_judged_right(spark):
    rows, truth, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    got = quality.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    unseen = [r for r in got if r.doc_id % 2]
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    assert sum(r.keep == truth[r.doc_id] for r in unseen) / len(unseen) >= 0.95
    again = quality.classify(docs.repartition(9), spark.createDataFrame(labels, LABELS)).collect()
    assert {r.doc_id: r.keep for r in again} == {r.doc_id: r.keep for r in got}


def test_awkward_rows_and_labels(spark, docs, none):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, None), (9, 1, 0), (14, 1, None), (10, 0, 0), (12, 0, None), (13, None, 1), (None, 1, 0), (99, 1, 0), (4, None, None)], LABELS)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    left = quality.kept(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.keep for r in rows)
    assert quality.score(none, model).collect() == []
    for nothing in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.keep and r.score == 1 for r in quality.classify(docs, nothing).collect())
    assert quality.classify(none, labels).collect() == []


def test_the_fit_runs_in_a_task_and_not_in_the_driver(spark, monkeypatch):
    rows, _, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    driver, fit = os.getpid(), quality._co_train

    def elsewhere(*args):
        assert os.getpid() != driver, "the features of the sample are in the driver"
        return fit(*args)

    monkeypatch.setattr(quality, "_co_train", elsewhere)
    model = quality.train(docs, spark.createDataFrame(labels, LABELS))
    assert model.text is not None and len(model.lexicon) <= quality.LEXICON
