"""Token counts from an exact length histogram and its suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths per block of the two-level sums: no window sees more rows than this, or than there are blocks.
BLOCK = 1024


def length_histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From rows with `length` (and the columns `by`): length, docs. Null lengths count as 0. The counts combine
    before the shuffle, so a length or group with a third of the rows costs one row per task."""
    return (lengths.select(*by, F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length"))
            .groupBy(*by, "length").agg(F.count(F.lit(1)).alias("docs")))


def context_answers(histogram: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """What every context limit needs, one row per occurring length taken as the limit (per group of `by`).

    docs, tokens: documents of exactly this length and their tokens. docs_over, tokens_over: suffix sums over longer
    ones. docs_total, tokens_total: over all. truncated_tokens: what is left when every document is cut to the limit.
    share_within: part of the documents that fit, so the q-quantile is the least length with share_within >= q. Limits
    between occurring lengths: `at_limits`.
    The sums run over blocks of lengths first, then inside a block. An empty histogram gives no rows."""
    blocks = F.floor(F.col("length") / block).cast("long")
    rows = histogram.select(*by, "length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), blocks.alias("block"))
    later = Window.partitionBy(*by).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    base = (rows.groupBy(*by, "block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
            .select(*by, "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_base") for c in "dt"),
                    F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total")))
    longer = Window.partitionBy(*by, "block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, [*by, "block"]) if not by else rows.alias("r").join(
        base.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "block")]
    ).select("r.*", "b.d_base", "b.t_base", "b.docs_total", "b.tokens_total")
    over = {c: F.col(f"{c[0]}_base") + F.coalesce(F.sum(c).over(longer), F.lit(0)) for c in ("docs", "tokens")}
    out = out.withColumn("docs_over", over["docs"]).withColumn("tokens_over", over["tokens"])
    return out.select(
        *by, "length", "docs", "tokens", "docs_over", "tokens_over", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("share_within"))


def at_limits(histogram: DataFrame, contexts: list[int]) -> DataFrame:
    """For every context limit asked for, also between occurring lengths: docs_over, tokens_over, truncated_tokens.
    One pass over the histogram; an empty one answers 0 everywhere."""
    n, docs = F.col("length"), F.col("docs")
    sums = [F.coalesce(F.sum(F.when(n > c, x)), F.lit(0)).alias(f"{name}{i}") for i, c in enumerate(contexts)
            for name, x in (("d", docs), ("t", docs * n))]
    sums += [F.coalesce(F.sum(F.least(n, F.lit(c)) * docs), F.lit(0)).alias(f"k{i}") for i, c in enumerate(contexts)]
    row = histogram.agg(*sums)
    return row.select(F.explode(F.array(*(F.struct(
        F.lit(c).cast("long").alias("context"), F.col(f"d{i}").alias("docs_over"), F.col(f"t{i}").alias("tokens_over"),
        F.col(f"k{i}").alias("truncated_tokens")) for i, c in enumerate(contexts)))).alias("r")).select("r.*")


def quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """For every share q: the least length that at least the part q of the documents does not exceed."""
    picks = [F.min(F.when(F.col("share_within") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    row = answers.agg(*picks)
    return row.select(F.explode(F.array(*(
        F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)))).alias("r")).select("r.*")
