"""Rate limits: refused requests do not count, so every decision depends on the ones before it.

Two requests of a key that lie a whole window apart know nothing of each other: there a key is cut, and the pieces are
decided in parallel. A piece without such a gap streams through one task in order, holding only its admitted hits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: What is carried from one trigger to the next, per key: its newest request and the admitted hits of the window.
LIVE = "key string, newest bigint, hits array<bigint>"


def decide(hits: deque, at: np.ndarray, limit: int, window_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """(admitted, retry_after_s) of requests at rising times `at`; `hits` are the admitted ones before, and are updated.

    Once the window is full, everything up to the moment when its oldest hit leaves is refused in one step, so the work
    follows the number of admitted requests."""
    admitted, retry = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    i = 0
    while i < len(at):
        now = int(at[i])
        while hits and hits[0] <= now - window_ms:
            hits.popleft()
        if len(hits) < limit:
            admitted[i] = True
            hits.append(now)
            i += 1
            continue
        free = hits[0] + window_ms
        j = i + int(np.searchsorted(at[i:], free))
        retry[i:j] = -((free - at[i:j]) // -1000)
        i = j
    return admitted, retry


def pieces(requests: DataFrame, window_ms: int) -> DataFrame:
    """requests(key, at_ms, ..) + slot and piece: the first slot of the run of requests without a gap of a window.

    Inside a slot of one window's width no gap fits, so the cuts are found among slots: one short row per key and slot."""
    slotted = requests.withColumn("slot", F.floor(F.col("at_ms") / window_ms).cast("long"))
    slots = slotted.groupBy("key", "slot").agg(F.min("at_ms").alias("begin"), F.max("at_ms").alias("end"))
    order = Window.partitionBy("key").orderBy("slot")
    opens = F.coalesce(F.col("begin") - F.lag("end").over(order) >= window_ms, F.lit(True))
    cut = slots.withColumn("opens", opens).withColumn(
        "piece", F.last(F.when(F.col("opens"), F.col("slot")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.select(F.col("key").alias("__key"), F.col("slot").alias("__slot"), "piece")
    return slotted.join(cut, F.col("key").eqNullSafe(F.col("__key")) & (F.col("slot") == F.col("__slot"))).drop("__key", "__slot")


def rate_limit(requests: DataFrame, limit: int = 12, window_ms: int = HOUR_MS, live: DataFrame | None = None) -> DataFrame:
    """requests(key, request_id, at_ms) + admitted, retry_after_s: at most `limit` admitted ones in any window of a key.

    Requests are taken in order of time, then id. `live` (see LIVE) is what earlier requests have left behind; a request
    older than the newest one seen of its key is decided at that newest time, as on arrival. A request without a time is
    refused, with nothing to wait for. Null keys are one key."""
    if limit < 1:
        raise ValueError("a limit lets one request through at least")
    given = requests.select("key", F.col("request_id").cast("long").alias("request_id"), F.col("at_ms").cast("long").alias("at_ms"))
    timed = given.where("at_ms is not null").select("*", F.col("at_ms").alias("time"), F.lit(1).alias("step"))
    if live is not None:
        seen = live.select(F.col("key").alias("__key"), "newest")
        timed = (timed.join(seen, F.col("key").eqNullSafe(F.col("__key")), "left")
                 .withColumn("time", F.greatest("at_ms", F.coalesce("newest", "at_ms"))).drop("__key", "newest"))
        none = F.lit(None).cast("long")
        old = live.select("key", none.alias("request_id"), none.alias("at_ms"), F.explode("hits").alias("time"), F.lit(0).alias("step"))
        timed = timed.unionByName(old)
    cut = pieces(timed.select("key", "request_id", F.col("at_ms").alias("given_ms"), F.col("time").alias("at_ms"), "step"), window_ms)
    order = ["key", "piece", "at_ms", "step", "request_id"]
    cut = cut.select(*order, "given_ms").repartition("key", "piece").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hits = None, deque()
        for batch in batches:
            n = batch.num_rows
            key, piece = batch.column("key").to_pylist(), batch.column("piece").to_pylist()
            at, step = batch.column("at_ms").to_numpy(), batch.column("step").to_numpy()
            admitted, retry = np.zeros(n, bool), np.zeros(n, np.int64)
            changes = [k for k in range(n) if k == 0 or key[k] != key[k - 1] or piece[k] != piece[k - 1]]
            for a, b in zip(changes, [*changes[1:], n], strict=True):
                if now != (key[a], piece[a]):
                    now, hits = (key[a], piece[a]), deque()
                # What is carried lies before all that is decided now.
                fresh = a + int((step[a:b] == 0).sum())
                hits.extend(int(x) for x in at[a:fresh])
                admitted[fresh:b], retry[fresh:b] = decide(hits, at[fresh:b], limit, window_ms)
            keep = pa.array(step == 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("request_id"), batch.column("given_ms"), batch.column("at_ms"), pa.array(admitted), pa.array(retry)],
                ["key", "request_id", "at_ms", "decided_ms", "admitted", "retry_after_s"]).filter(keep)

    kind = given.schema["key"].dataType.simpleString()
    decided = cut.mapInArrow(run, f"key {kind}, request_id long, at_ms long, decided_ms long, admitted boolean, retry_after_s long")
    never = given.where("at_ms is null").select("key", "request_id", "at_ms", F.lit(None).cast("long").alias("decided_ms"),
                                               F.lit(False).alias("admitted"), F.lit(None).cast("long").alias("retry_after_s"))
    return decided.unionByName(never)


def still_live(decided: DataFrame, live: DataFrame | None, window_ms: int, forget_ms: int = 0) -> DataFrame:
    """What to carry on (see LIVE) after `decided`: hits that can still count. Keys whose newest request lies a window
    and `forget_ms` behind the newest of all are forgotten."""
    rows = decided.where("decided_ms is not null").select("key", F.col("decided_ms").alias("time"), F.col("admitted").alias("hit"))
    if live is not None:
        rows = rows.unionByName(live.select("key", F.col("newest").alias("time"), F.lit(False).alias("hit"))).unionByName(
            live.select("key", F.explode("hits").alias("time"), F.lit(True).alias("hit")))
    newest = rows.groupBy("key").agg(F.max("time").alias("newest"))
    last = newest.agg(F.max("newest")).first()[0]
    kept = newest.where(F.col("newest") > (last or 0) - window_ms - forget_ms).select(F.col("key").alias("__key"), "newest")
    # At most `limit` hits of a key lie in its last window.
    met = rows.join(kept, F.col("key").eqNullSafe(F.col("__key"))).drop("__key")
    return met.groupBy("key").agg(F.max("newest").alias("newest"), F.sort_array(F.collect_list(
        F.when(F.col("hit") & (F.col("time") > F.col("newest") - window_ms), F.col("time")))).alias("hits"))
