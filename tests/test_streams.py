"""Rate limits and chain alerts: brute force, batch job and replays in several orders give the same."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from belegwerk import model
from belegwerk.operators import audit, limits
from belegwerk.streaming import jobs

REQUEST = "key string, request_id long, at_ms long"


def brute(rows, limit, window):
    hits: dict = {}
    out = set()
    for key, number, at in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[2], r[1])):
        mine = hits.setdefault(key, [])
        live = [h for h in mine if h > at - window]
        if len(live) < limit:
            mine.append(at)
            out.add((key, number, at, True, 0))
        else:
            out.add((key, number, at, False, -((live[0] + window - at) // -1000)))
    return out


def requests(seed: int):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(0, 400_000)) for k in range(300)]
    # A third of all rows under one key: bursts with gaps, and one run without any gap.
    rows += [("hot", 1000 + k, (k // 40) * 50_000 + rng.randrange(0, 9_000)) for k in range(400)]
    return rows + [("dense", 2000 + k, k * 37) for k in range(800)]


def test_deciding_a_batch_equals_one_by_one():
    rng = random.Random(1)
    for limit in (1, 2, 5):
        at = sorted(rng.randrange(0, 60_000) for _ in range(400))
        whole = limits.decide(deque(), np.array(at), limit, 7_000)
        hits: deque = deque()
        parts = [limits.decide(hits, np.array(at[k:k + 13]), limit, 7_000) for k in range(0, 400, 13)]
        assert (whole[0] == np.concatenate([p[0] for p in parts])).all() and (whole[1] == np.concatenate([p[1] for p in parts])).all()
        assert {("k", i, t, bool(a), int(r)) for i, (t, a, r) in enumerate(zip(at, *whole, strict=True))} == brute([("k", i, t) for i, t in enumerate(at)], limit, 7_000)


@pytest.mark.parametrize("limit,window", [(2, 10_000), (5, 3_000)])
def test_pieces_decide_as_whole_keys_do(spark, limit, window):
    rows = requests(limit)
    df = spark.createDataFrame(rows, REQUEST).repartition(7)
    got = {tuple(r) for r in limits.rate_limit(df, limit, window).select("key", "request_id", "at_ms", "admitted", "retry_after_s").collect()}
    assert got == brute(rows, limit, window)
    cut = limits.pieces(df, window).groupBy("key").agg(F.countDistinct("piece").alias("n"))
    assert {r.key: r.n for r in cut.collect()}["hot"] == 10 and {r.key: r.n for r in cut.collect()}["dense"] == 1


def test_requests_without_a_time_or_rows(spark):
    got = limits.rate_limit(spark.createDataFrame([("a", 1, None), ("a", 2, 5)], REQUEST)).orderBy("request_id").collect()
    assert [(r.admitted, r.retry_after_s) for r in got] == [(False, None), (True, 0)]
    assert limits.rate_limit(spark.createDataFrame([], REQUEST)).collect() == []
    with pytest.raises(ValueError):
        limits.rate_limit(spark.createDataFrame([], REQUEST), limit=0)


@pytest.mark.parametrize("steps", [1, 5])
def test_rate_limit_replayed_in_steps(spark, steps):
    rows = requests(3)
    limiter = jobs.RateLimit(spark, 2, 10_000)
    df = spark.createDataFrame(rows, REQUEST).repartition(5)
    jobs.replay_in_order(df, "steps", "at_ms", lambda s: s.writeStream.foreachBatch(limiter), steps)
    assert {tuple(r) for r in limiter.decisions().collect()} == brute(rows, 2, 10_000)


def test_the_limiter_forgets_quiet_keys_and_repeats_a_trigger(spark):
    limiter = jobs.RateLimit(spark, 2, 1_000)
    first = spark.createDataFrame([("old", 1, 0), ("old", 2, 10), ("on", 3, 20)], REQUEST)
    limiter(first, 0)
    assert {r.key for r in limiter.live(0).collect()} == {"old", "on"}
    second = spark.createDataFrame([("on", 4, 1_010), ("on", 5, 1_015), ("on", 6, 900), ("new", 7, 5_000)], REQUEST)
    for _ in range(2):
        limiter(second, 1)
        got = {r.request_id: (r.admitted, r.retry_after_s) for r in limiter.decisions().collect()}
        # 6 comes late: it is decided at the time of 3, its key's newest before this trigger.
        assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 6: (True, 0), 4: (False, 1), 5: (False, 1), 7: (True, 0)}
        assert {r.key: (r.newest, r.hits) for r in limiter.live(1).collect()} == {"new": (5_000, [5_000])}


# --- chain alerts -----------------------------------------------------------------------------------


def chain_lines(spark, runs: int, length: int):
    """Lines that come in two minutes after one another, one run an hour after the other."""
    events = spark.range(runs * length).selectExpr(f"cast(id div {length} as string) as run_id", f"cast(id % {length} as int) as seq").selectExpr(
        "run_id", "seq", "concat('2026-01-01T00:', lpad(cast(seq as string), 2, '0'), ':00.000Z') as ts", "'VIEW' as type", "'{}' as actor",
        "cast(null as string) as input_hash", "cast(null as string) as output_hash", "'{}' as data")
    return audit.build_audit_chain(events).selectExpr(
        "run_id", "seq as line_no", "line", "timestamp_seconds(1700000000 + cast(run_id as int) * 3600 + seq * 120) as at")


def alerts(spark, lines, **kw):
    """What three replays and the batch job say."""
    jobs.use_rocksdb(spark)
    now = lines.agg(F.unix_millis(F.max("at"))).first()[0] - 60_000
    want = sorted(tuple(r) for r in audit.chain_alerts(lines, 600_001, now).select("run_id", "seq", "reason").collect())
    for steps in ((lines.repartition(1), 4), (lines.orderBy(F.rand(3)).repartition(6), 6), (lines.orderBy(F.desc("at")), 5)):
        found = []

        def keep(batch, _, found=found):
            found.extend(tuple(r) for r in batch.collect())

        check = jobs.stream_chain_check
        jobs.replay_in_order(steps[0], "lines", "at", lambda s: check(s, 600_001, "1 minute", **kw).writeStream.foreachBatch(keep), steps[1])
        assert sorted(found) == want
    return want


def test_lost_lines_alert_after_their_time(spark):
    lines = chain_lines(spark, 8, 12).where(
        "not (run_id = '1' and line_no = 4) and not (run_id = '2' and line_no = 0) and not (run_id = '3' and line_no in (3, 4, 8))"
        " and not (run_id = '4' and line_no = 11) and not (run_id = '7' and line_no = 10)")
    broken = lines.withColumn("line", F.when(F.expr("run_id = '5' and line_no = 6"), "{").when(
        F.expr("run_id = '3' and line_no = 6"), "{").otherwise(F.col("line")))
    got = alerts(spark, broken)
    # Run 4 lost its last line, which nobody can know; that of run 7 is too recent.
    assert got == [("1", 4, model.LOST_LINE), ("2", 0, model.LOST_LINE), ("3", 3, model.LOST_LINE), ("5", 6, "line is not valid JSON")]


def test_state_goes_when_a_run_is_done(spark):
    """Behind a broken or long quiet run nothing waits: the heads of old runs go with their lifetime."""
    jobs.use_rocksdb(spark)
    lines = chain_lines(spark, 6, 10).where("not (run_id = '0' and line_no = 3)")
    sizes = []

    def keep(batch, _):
        batch.count()

    path, checkpoint = jobs.fresh_dir(spark, "state"), jobs.fresh_dir(spark, "state-checkpoint")
    for run in range(6):
        lines.where(F.col("run_id") == str(run)).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.stream_chain_check(spark.readStream.schema(lines.schema).parquet(path), 600_001, "1 minute", lifetime_ms=3_600_000)
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(spark.read.format("statestore").option("stateVarName", "head").load(checkpoint).select("key").distinct().count())
    assert max(sizes) <= 3
