"""Positions and running sums that stay spread out when one key holds a large share of the rows.

The caller names a bucket: columns that rise with the order (a time slot, the first sort column).
Rows are ranked inside (key, bucket); a small table with one row per (key, bucket) carries the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bucketed(df: DataFrame, keys: list[str], buckets: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__b{i}" for i in range(len(buckets))]
    return df.withColumns(dict(zip(names, buckets))), names


def _with_offset(df: DataFrame, keys: list[str], names: list[str], amount: Column) -> DataFrame:
    """Adds __before: the sum of amount over all earlier buckets of the same key. A null key or bucket is a value."""
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*keys, *names).agg(amount.alias("__n"))
    offsets = sums.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, *names])], F.sum("__n").over(before).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*keys, *names])]
    return df.join(offsets, same).drop(*[f"__k{i}" for i in range(len(same))])


def index_rows(df: DataFrame, keys: list[str], order: list[Column], buckets: list[Column], out: str) -> DataFrame:
    """0-based position inside each key."""
    marked, names = _bucketed(df, keys, buckets)
    local = F.row_number().over(W.partitionBy(*keys, *names).orderBy(*order))
    ranked = _with_offset(marked, keys, names, F.count(F.lit(1)))
    return ranked.withColumn(out, (local - 1 + F.coalesce("__before", F.lit(0))).cast("int")).drop(*names, "__before")


def sum_before(df: DataFrame, keys: list[str], order: list[Column], buckets: list[Column], amount: str, out: str) -> DataFrame:
    """Sum of amount over the rows strictly before this one inside its key (0 for the first)."""
    marked, names = _bucketed(df, keys, buckets)
    earlier = W.partitionBy(*keys, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # Both parts in one type: adding two wide decimals as they come would cost digits after the point.
    kind = df.schema[amount].dataType
    wide = T.DecimalType(min(38, kind.precision + 10), kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()
    part = lambda c: F.coalesce(c, F.lit(0)).cast(wide)
    summed = _with_offset(marked, keys, names, F.sum(amount).cast(wide))
    total = part(F.sum(amount).over(earlier)) + part(F.col("__before"))
    return summed.withColumn(out, total).drop(*names, "__before")


def join_in_order(df: DataFrame, keys: list[str], order: str, text: str, separator: str, out: str, chunk: int = 256) -> DataFrame:
    """Concatenate text per key in the given integer order.

    Chunks are joined first and close to the data, so only finished pieces meet in the last step.
    """
    block = F.floor(F.col(order) / chunk)
    pieces = (
        df.groupBy(*keys, block.alias("__c"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("__p"))
        .select(*keys, "__c", F.array_join(F.transform("__p", lambda p: p["t"]), separator).alias("__t"))
    )
    return (
        pieces.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__c").alias("o"), F.col("__t").alias("t")))).alias("__p"))
        .select(*keys, F.array_join(F.transform("__p", lambda p: p["t"]), separator).alias(out))
    )
