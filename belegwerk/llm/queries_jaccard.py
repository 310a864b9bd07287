"""Query op7 and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard import Rule, jaccard_components


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), Rule(words=4, percent=85)).drop("text_key")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SQL = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
g as (select distinct doc_id, array_to_string(w[i + 1:i + 4], ' ') as k
    from (select doc_id, w, unnest(range(greatest(1, len(w) - 3))) as i from d where len(w) > 0)),
s as (select doc_id, count(*) as n from g group by 1),
o as (select a.doc_id as x, b.doc_id as y, count(*) as shared from g a join g b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from o join s a on a.doc_id = x join s b on b.doc_id = y where 100 * shared >= 85 * (a.n + b.n - shared)),
t as (select x, y from e union all select y, x from e),
r as (select doc_id as x, doc_id as y from d union select r.x, t.y from r join t on r.y = t.x)
select d.doc_id, coalesce(s.n, 0) as n_shingles, m.c as component_id
from d left join s using (doc_id) join (select x, min(y) as c from r group by 1) m on m.x = d.doc_id"""
