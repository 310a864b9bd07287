"""URL filter: rules first, then gradient-boosted trees on lexical features of the url."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The column that says allow or block.
JUDGEMENT = "verdict"
#: Labelled urls that the trees are fitted on, at most.
LABELLED = 20_000


@dataclass(frozen=True)
class UrlRule:
    """host + path, and the ruling for urls on the host or a subdomain whose path starts with the path."""
    rule: str
    ruling: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host):]


def parsed(url: Column) -> tuple[Column, Column]:
    """host (after the first :// up to /, ? or #, A-Z lower-cased) and path (then up to ? or #). A null url and one
    without :// have both empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rows: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """`rows` (host, path) with rule and ruling: of the rules that fit the longest one, and of those of one length the
    first in `rules`; null where none fits. The rules are a short list, so they are part of the plan."""
    order = sorted(rules, key=lambda r: -len(r.rule))
    fits = [((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path) for r in order]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return rows.withColumn("rule", pick([r.rule for r in order])).withColumn("ruling", pick([r.ruling for r in order]))


FEATURES = ("f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_signs", "f_entropy", "f_params", "f_query", "f_secure",
            "f_suffix_rows", "f_suffix_length", "f_suffix_params", "f_host_log")


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter)))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c))) / size)
    parts = F.filter(parts, lambda p: p > 0)
    return F.coalesce(-F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p)), F.lit(0.0))


def lexical(rows: DataFrame) -> DataFrame:
    """`rows` (url, host, path, ruling) with the columns of FEATURES and `suffix`, the last label of the host.

    Statistics of suffix and host are over all rows and know nothing of rulings, or the trees would learn the rules'
    own suffixes: of a suffix the order of magnitude of its rows, their mean length and the share with parameters. They
    are joined back by key; a suffix with most of the rows is one short row of statistics, so the join may split it."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    out = (rows.withColumn("suffix", F.substring_index("host", ".", -1))
           .withColumn("f_length", F.length(url).cast("double")).withColumn("f_host", F.length("host").cast("double"))
           .withColumn("f_path", F.length("path").cast("double")).withColumn("f_depth", _count(F.col("path"), "/").cast("double"))
           .withColumn("f_labels", _count(F.col("host"), ".").cast("double"))
           .withColumn("f_digits", F.length(F.regexp_replace(url, "[^0-9]", "")) / size)
           .withColumn("f_signs", F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / size)
           .withColumn("f_entropy", _entropy(url)).withColumn("f_params", _count(query, "=").cast("double"))
           .withColumn("f_query", F.length(query).cast("double")).withColumn("f_secure", F.lower(url).startswith("https://").cast("double")))
    suffixes = out.groupBy("suffix").agg(
        F.round(F.log10(F.count(F.lit(1)).cast("double"))).alias("f_suffix_rows"), F.avg("f_length").alias("f_suffix_length"),
        F.avg((F.col("f_params") > 0).cast("double")).alias("f_suffix_params"))
    hosts = rows.groupBy("host").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("f_host_log"))
    return out.join(suffixes, "suffix").join(hosts, "host")


def judge(pages: DataFrame, rules: list[UrlRule], limit: int = LABELLED, trees: int = 10, depth: int = 4, seed: int = 7) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, blocked_score and the
    judgement (column JUDGEMENT: allow or block).

    It is the rule's where one fits, else that of gradient-boosted trees fitted on at most `limit` urls that
    the rules label (the first by a hash of url and id). blocked_score is their chance of block, also for ruled urls.
    Where all labels are alike there are no trees: that one holds, and allow without labels. Null
    and empty urls are judged like others; repeated rows have a row each; other columns are left out."""
    host, path = parsed(F.col("url"))
    rows = ruled(pages.select("page_id", "url").withColumn("host", host).withColumn("path", path), rules)
    seen = {r["ruling"]: r["count"] for r in rows.where("ruling is not null").groupBy("ruling").count().collect()}
    if len(seen) < 2:
        only = next(iter(seen), "allow")
        return rows.select("page_id", "host", "path", "rule", F.lit(float(only == "block")).alias("blocked_score"),
                           F.coalesce("ruling", F.lit(only)).alias(JUDGEMENT))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        lexical(rows))
    sample = vectors.where("ruling is not null").orderBy(F.xxhash64("url", "page_id")).limit(limit)
    sample = written(sample.select("features", (F.col("ruling") == "block").cast("double").alias("target")), "urls")
    trees_ = GBTClassifier(featuresCol="features", labelCol="target", maxIter=trees, maxDepth=depth, seed=seed).fit(sample)
    scored = trees_.transform(vectors).withColumn("blocked_score", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule", "blocked_score", F.coalesce(
        "ruling", F.when(F.col("blocked_score") >= 0.5, "block").otherwise("allow")).alias(JUDGEMENT))
