"""Query op1 and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, LOGIN, OPAQUE, REACH, STRONG, joined, scan


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < STRONG)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(table(spark, folder, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql() -> str:
    scans = [(0, ASSIGN, f"case when length(regexp_extract(h, {_quoted(ASSIGN)}, 2)) >= 12 then 0 else 3 end",
              f"length(regexp_extract(h, {_quoted(ASSIGN)}, 2)) >= 6"),
             (1, ACCESS, "1", "true"), (2, HEX, "2", "true"),
             (3, OPAQUE, "4", "regexp_matches(h, '[A-Z]') and regexp_matches(h, '[a-z]') and regexp_matches(h, '[0-9]')"),
             (4, LOGIN, "5", "true"), (5, ENDPOINT, "6", "true")]
    raw = " union all ".join(
        f"select doc_id, {n} as n, i, h, length(g) as gap, {kind} as kind, {ok} as ok from (select doc_id, "
        f"unnest(range(len(hs))) as i, unnest(hs) as h, unnest(gs[:len(hs)]) as g from (select doc_id, "
        f"regexp_extract_all(text, {_quoted(p)}) as hs, string_split_regex(text, {_quoted(p)}) as gs from d))"
        for n, p, kind, ok in scans)
    near = lambda kinds: (
        f"coalesce(\"start\" - max(\"end\") filter (kind in {kinds}) over prior <= {REACH}, false) or "
        f"coalesce(min(\"start\") filter (kind in {kinds}) over later - \"end\" <= {REACH}, false)")
    order = 'partition by doc_id order by "start", "end", kind rows between'
    windows = f"window prior as ({order} unbounded preceding and 1 preceding), later as ({order} 1 following and unbounded following)"
    one = "kind || ':' || \"start\" || ':' || \"end\""
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
raw as ({raw}),
placed as (select doc_id, kind, ok, length(h) as len, sum(gap + length(h)) over (
    partition by doc_id, n order by i rows between unbounded preceding and current row) as "end" from raw),
parts as (select doc_id, kind, ("end" - len)::bigint as "start", "end"::bigint as "end" from placed where ok),
bare as (select * from (select *, coalesce(max("end") filter (kind < 3) over prior >= "end", false)
    or coalesce(min("start") filter (kind < 3) over later = "start", false) as covered from parts {windows})
    where kind < 3 or not covered),
judged as (select *, {near('(1, 5)')} as has_id, {near('(0, 3, 4)')} as has_secret from bare {windows}),
spans as (select doc_id, "start", "end", kind as rank,
    ['assign', 'access', 'hex', 'short', 'opaque', 'login', 'endpoint'][kind + 1] as kind from judged
    where kind < 3 or (kind in (3, 4) and has_id) or (kind = 5 and has_secret) or (kind = 6 and has_id and has_secret)),
lists as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg({one}, ',' order by "start", rank) filter (rank < 3) as base,
    string_agg({one}, ',' order by "start", rank) as spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join lists using (doc_id)"""


SQL = _sql()
