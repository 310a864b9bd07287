"""What the model calls cost, per run and UTC day, and which calls a daily budget lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from .ordering import sum_before

COST = "decimal(18,8)"


def price_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls(.., model, prompt_tokens, completion_tokens) -> (priced with cost, calls without a pinned price).

    An unknown price is an error, never 0.
    """
    prices = calls.sparkSession.createDataFrame(list(model.MODEL_PRICES), "model string, input string, output string")
    joined = calls.join(F.broadcast(prices), "model", "left")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    part = lambda price, tokens: F.col(price).cast("decimal(9,4)") * F.col(tokens).cast("decimal(18,0)")
    cost = F.round((part("input", "prompt_tokens") + part("output", "completion_tokens")) / million, 8).cast(COST)
    priced = joined.where("input is not null").withColumn("cost", cost).drop("input", "output")
    refused = joined.where("input is null").drop("input", "output").withColumn("error", F.concat(F.lit('No pinned price for model "'), "model", F.lit('"')))
    return priced, refused


def utc_day(ts: Column) -> Column:
    """Day of a zone-free UTC timestamp."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd")


def daily_spend(calls: DataFrame) -> DataFrame:
    return calls.groupBy(utc_day(F.col("ts")).alias("day")).agg(F.sum("cost").cast(COST).alias("spent"))


def budget_status(spend: DataFrame, budget: str) -> DataFrame:
    limit = F.lit(budget).cast(COST)
    left = F.greatest(limit - F.col("spent"), F.lit(0).cast(COST))
    return spend.select("day", (F.col("spent") < limit).alias("live"), F.round(left, 4).cast("decimal(18,4)").alias("remaining"))


def run_cost(calls: DataFrame, key: str = "run_id") -> DataFrame:
    return calls.groupBy(key).agg(F.round(F.sum("cost"), 6).cast("decimal(18,6)").alias("cost"))


def budget_admission(calls: DataFrame, budget: str) -> DataFrame:
    """calls(call_id, ts, cost) + spent_before and admitted.

    A call is refused once the spend of its day reached the budget; the last admitted one may overshoot.
    Admitted calls are a prefix of the day, so the plain running sum decides. A busy day is cut into minutes.
    """
    dated = calls.withColumn("day", utc_day(F.col("ts")))
    minute = F.date_format(F.col("ts").cast("timestamp_ntz"), "HH:mm")
    summed = sum_before(dated, ["day"], [F.col("ts"), F.col("call_id")], [minute], "cost", "spent_before")
    return summed.withColumn("spent_before", F.col("spent_before").cast(COST)).withColumn(
        "admitted", F.col("spent_before") < F.lit(budget).cast(COST))
