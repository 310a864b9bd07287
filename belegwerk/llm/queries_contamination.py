"""Query op9 and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256_of_list, table
from .contamination import find_windows


def op9_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_windows(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        sha256_of_list(F.col("items")).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
windows as (select item_id, least(10, len(w)) as size, unnest(range(greatest(1, len(w) - 9))) as i, w from b where len(w) > 0),
keys as (select distinct item_id, size, array_to_string(w[i + 1:i + size], ' ') as k from windows),
sizes as (select distinct size from keys),
places as (select doc_id, size, p, array_to_string(w[p + 1:p + size], ' ') as k from (
    select doc_id, w, size, unnest(range(len(w) - size + 1)) as p from d, sizes where len(w) >= size)),
found as (select doc_id, p, size, item_id from places join keys using (size, k)),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from found) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
    from (select distinct doc_id, item_id::varchar as item from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""
