import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from belegwerk.llm import negatives
from belegwerk.llm.negatives import Mining, Slab, mine

SCHEMA = "vec_id bigint, embedding array<float>, label bigint, key string, n int, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, "y") for i, v, lab in rows], SCHEMA).repartition(3)


def brute(rows, m=Mining()):
    usable = {(i, tuple(np.floor(np.float32(v).astype(float) * m.scale).astype(int).tolist()), lab) for i, v, lab in rows
              if lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in usable:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(b, sum(x * y for x, y in zip(a[1], b[1], strict=True))) for b in usable if b != a and len(b[1]) == len(a[1])]
        first = lambda of, n: sorted(of, key=lambda b: (-b[1], b[0][0] is None, b[0][0] or 0))[:n]
        for p, ps in first([b for b in scored if b[0][2] == a[2]], m.positives):
            fit = [b for b in scored if b[0][2] != a[2] and m.low * ps <= 100 * b[1] <= m.high * ps]
            out += [(a[0], p[0], k, n[0], ps, s) for k, (n, s) in enumerate(first(fit, m.negatives), 1)]
    return sorted(out, key=repr)


def made(seed: int, n: int, dim: int, spread: float):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    rows = []
    for k in range(n):
        v = centres[rng.integers(8)] + spread * rng.standard_normal(dim)
        rows.append((k, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("dim", [5, 64, 70])
def test_the_same_rows_as_brute_force_in_many_slabs(spark, monkeypatch, dim):
    monkeypatch.setattr(negatives, "SLAB", 150)
    monkeypatch.setattr(negatives, "LEAST", 50)
    rows = made(dim, 700, dim, 0.3)
    got = sorted((tuple(r) for r in mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()), key=repr)
    assert got == brute(rows) and got


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = made(2, 260, 8, 0.2)
    v = rows[0][1]
    rows += [(300, v, 1), (301, v, 1), (302, v, 2), (303, v, 2), (304, v, None), (305, None, 1), (306, [], 1), (307, [None] + v[1:], 1),
             (308, [float("nan")] + v[1:], 1), (309, [float("-inf")] + v[1:], 2), (310, v[:5], 2), (311, [0.0] * 8, 2), (400, [0.0] * 8, 1),
             (500, [-x for x in v], 1), (None, [0.85 * x for x in v], 3), (None, v, 2), (600, v[:5], 1)]
    rows += [rows[0], rows[0], (302, v, 2)] + [(302, v, 2)] * 200
    got = sorted((tuple(r) for r in mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()), key=repr)
    assert got == brute(rows) and any(r[3] is None for r in got)


def test_empty_tables_and_other_windows(spark):
    assert mine(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    rows = made(4, 300, 16, 0.3)
    m = Mining(positives=2, negatives=3, low=0, high=100, scale=1000, rotations=2)
    got = sorted((tuple(r) for r in mine(frame(spark, rows), F.col("vec_id") % 100 == 0, m).collect()), key=repr)
    assert got == brute(rows, m)
    assert mine(frame(spark, rows), F.lit(None).cast("boolean")).collect() == []


def test_bounds_hold_and_leave_few_rows(spark):
    rows = made(9, 3000, 64, 0.6)
    m = Mining()
    codes = negatives._codes(negatives._rows(frame(spark, rows), m), m).toArrow().to_pydict()
    slab, shares = Slab(codes, 64, m), []
    for k in range(0, 3000, 150):
        estimate, low, high = slab.bounds(slab.ints[k])
        exact = slab.ints @ slab.ints[k]
        assert (low <= exact).all() and (exact <= high).all()
        assert np.corrcoef(estimate, exact)[0, 1] > 0.95
        shares.append((high >= np.sort(exact)[-10]).mean())
    assert np.mean(shares) < 0.3


def test_a_component_beyond_a_long_is_refused(spark):
    with pytest.raises(Exception, match="too large"):
        mine(frame(spark, [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1)]), F.col("vec_id") % 100 == 0)
