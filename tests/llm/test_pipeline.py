import __spark_entry__ as entry
import corpus_pipeline as pipeline
import public_tokenizers
from belegwerk.llm import bpe, catalog, quality
from belegwerk.llm.common import table
from compare import connect, difference
from test_contamination import split
from test_jaccard import shingles
from test_secrets import base_spans

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_queries_with_a_twin(spark, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), catalog.SQL[name]) is None


def test_all_operators_are_registered_and_give_a_row_per_row(spark):
    named = entry.queries()
    for n in range(1, 11):
        assert [q for q in named if q.startswith(f"op{n}_")], n
    assert named["pipeline"] is pipeline.run and pipeline.ORACLE_SQL is None
    assert named["op8_embedding_dedup"](spark, FOLDER).count() == table(spark, FOLDER, "embeddings").count()


def test_stages_against_plain_python(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    out = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        out[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns
    scored = quality.classify(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    assert set(out["quality"]) == {r.doc_id for r in scored if r.keep}
    stay, sets = [], {}
    for i in sorted(out["quality"]):
        sets[i] = shingles(out["quality"][i].text, 5)
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if b < a else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    stay = sorted(i for i in sets if group[i] == i)
    assert sorted(out["near_duplicates"]) == stay
    items = [split(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    windows = {tuple(w[k:k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}

    def dirty(text):
        own = split(text)
        return any(tuple(own[p:p + n]) in windows for n in {len(w) for w in windows} for p in range(len(own) - n + 1))

    assert sorted(out["decontaminate"]) == [i for i in stay if not dirty(out["quality"][i].text)]
    assert set(out["secrets"]) == set(out["decontaminate"]) == set(out["tokens"])
    enc = bpe.encoding(public_tokenizers.path(pipeline.RANKS), public_tokenizers.PATTERN)
    for i, r in out["secrets"].items():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert base_spans(out["quality"][i].text) or r.text == out["quality"][i].text or "[secret]" in r.text
        assert out["tokens"][i].ids == enc.encode_ordinary(r.text) and out["tokens"][i].decodes
