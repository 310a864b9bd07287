"""Query op13 and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .negatives import mine


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """A seventh of the rows first gets the next label, so that close rows of other labels exist."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    found = mine(rows, F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
with given as (select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
    from embeddings where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from given),
scored as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    list_dot_product(a.v, b.v)::bigint as score from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
positives as (select anchor_id, other_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over pair as integer) as rank, other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window pair as (partition by anchor_id, positive_id order by score desc, other_id)
qualify row_number() over pair <= 10"""
