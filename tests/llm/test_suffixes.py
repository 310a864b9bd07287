import random

import numpy as np

from belegwerk.llm import suffixes
from conftest import make_docs


def brute(rows: list[tuple], length: int) -> dict:
    """Per document (distinct id and text, in order) what stays and how many runs go."""
    seen, out = set(), {}
    for _, key, text in rows:
        raw = text.encode()
        edge = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                edge[p] += 1
                edge[p + length] -= 1
            else:
                seen.add(raw[p:p + length])
        gone = np.cumsum(edge)[:len(raw)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key] = (int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def compare(frame, length: int, **more) -> None:
    from belegwerk.llm.common import documents

    given = {(r.doc_id is not None, r.doc_id or 0, r.text_key, r.text) for r in documents(frame).collect()}
    want = brute([(i, (known, i, k), t) for known, i, k, t in sorted(given)], length)
    rows = suffixes.remove_repeats(frame, length, **more).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert (r.n_removed, len(r.runs), bytes(r.kept)) == want[(r.doc_id is not None, r.doc_id or 0, r.text_key)]


def test_awkward_rows(docs, none):
    compare(docs, 100)
    assert suffixes.remove_repeats(none).collect() == []


def test_many_buckets_and_one_frequent_line(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    line = some(40)
    texts = [some(rng.randint(0, 60)) + line[:rng.randint(60, len(line))] + some(rng.randint(0, 60)) for _ in range(300)]
    texts += [texts[5], texts[5] + "x", some(30) + "ab" * 400, "ab" * 300 + some(3), "z" * 3000, "z" * 50 + "y" + "z" * 200]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(7)
    compare(frame, 100, bucket_bytes=2000)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh ") for _ in range(900))
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000)) + part + "q" * 400 + part
    frame = spark.createDataFrame([(1, long), (0, part[200:700]), (2, None)], "doc_id bigint, text string")
    compare(frame, 100)
