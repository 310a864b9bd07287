import math

import numpy as np

from belegwerk.llm import lsh

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, n_links string"


def brute(rows, threshold=0.93):
    ok, unit = [], []
    for _, v, label, *_ in rows:
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        own = np.array(np.float32(v), float) if good else None
        ok.append(bool(good))
        unit.append(own / np.sqrt(own @ own) if good else None)
    links = [[b for b in range(len(rows)) if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2]
              and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold] for a in range(len(rows))]
    return links


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], SCHEMA).repartition(3)


def test_links_components_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for n in range(40):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in centre + 0.08 * rng.standard_normal(16)], n % 3) for k in range(1 + n % 4)]
    same = [1.0, 2.0, 3.0] + [0.0] * 13
    rows += [(500 + k, same, 1) for k in range(30)] + [(540, [2 * x for x in same], 1), (541, same, 2), (542, same, None), (543, None, 1),
             (544, [], 1), (545, [0.0] * 16, 1), (546, [None] + same[1:], 1), (547, [float("nan")] + same[1:], 1), (548, [float("inf")] + same[1:], 1),
             (549, same[:8], 1), (550, [-0.0] * 16, 1), (500, same, 1)]
    links = brute(rows)
    got = lsh.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for k, (i, *_ ) in enumerate(rows):
        want.setdefault(i, []).append(len(links[k]))
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r)
    assert {i: sorted(x.n_links for x in v) for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    assert {found[i][0].component_id for i in range(500, 530)} == {500} == {found[540][0].component_id}
    assert all(found[i][0].component_id == i and found[i][0].kept for i in (541, 542, 543, 544, 545, 546, 547, 548, 550))
    assert lsh.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_buckets_over_a_block_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(lsh, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(24)
    rows = [(k, [float(np.float32(x)) for x in centre + 0.1 * rng.standard_normal(24)], 1) for k in range(120)]
    links = brute(rows)
    got = lsh.near_duplicates(frame(spark, rows), tables=lsh.Tables(2, 12)).collect()
    missed = sum(len(links[r.vec_id]) - r.n_links for r in got)
    assert 0 <= missed <= 0.02 * sum(map(len, links))
    assert all(r.n_links <= len(links[r.vec_id]) for r in got)


def test_recall_at_the_threshold():
    tables = lsh.Tables.for_size(5000, 0.93)
    rng = np.random.default_rng(3)
    plane, shift = rng.standard_normal((64, tables.projections * tables.tables)), rng.uniform(0, tables.width, tables.projections * tables.tables)
    met = 0
    for _ in range(400):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b = 0.93 * a + math.sqrt(1 - 0.93 ** 2) * b / np.linalg.norm(b)
        cells = [np.floor((v @ plane + shift) / tables.width).reshape(tables.tables, -1) for v in (a, b)]
        met += (cells[0] == cells[1]).all(axis=1).any()
    assert met / 400 >= 0.93
