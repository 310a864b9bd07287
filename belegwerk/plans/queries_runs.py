"""Named queries: audit chains, costs, budgets and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.text import tagged_sha256
from ..operators import audit, costs, limits
from ..session import fresh_dir
from ..sources import audit_files, records
from .bindings import Tables
from .oracle_parts import part, usd, with_parts
from .registry import query


@query("audit_chain", with_parts("SELECT run_id, seq, prev_hash, hash FROM chain", "chain"))
def audit_chain(t: Tables) -> DataFrame:
    return audit.build_audit_chain(t.audit_events).select("run_id", "seq", "prev_hash", "hash")


def tampered_lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(runs, lines) after events were changed, deleted, unlinked or garbled in some runs."""
    r = F.col("run_id").cast("long")
    chain = audit.build_audit_chain(t.audit_events)
    hit = lambda n, at: (r % 7 == n) & (F.col("seq") == at)
    line = (
        F.when(hit(1, 2), F.replace("line", F.lit('"version":"0.1.0"'), F.lit('"version":"0.1.1"')))
        .when(hit(2, 3), F.lit("{not json"))
        .when(hit(3, 1), F.regexp_replace("line", '"prevHash":"sha256:[0-9a-f]{4}', '"prevHash":"sha256:zzzz'))
        .otherwise(F.col("line"))
    )
    kept = chain.withColumn("line", line).where(~hit(4, 1)).where(r % 7 != 5)
    texts = kept.select("run_id", (F.col("seq") - F.when((r % 7 == 4) & (F.col("seq") > 1), 1).otherwise(0)).alias("line_no"), "line")
    return t.audit_events.select("run_id").distinct(), texts


part("run_len", "SELECT run_id, count(*) AS n, CAST(run_id AS BIGINT) % 7 AS k FROM audit GROUP BY run_id", "audit")
part("run_decision", """
SELECT run_id, CASE k WHEN 5 THEN 0 WHEN 4 THEN CASE WHEN n > 1 THEN n - 1 ELSE n END ELSE n END AS events,
  CASE WHEN k = 1 AND n > 2 THEN 2 WHEN k = 2 AND n > 3 THEN 3 WHEN k = 3 AND n > 1 THEN 1 WHEN k = 4 AND n > 2 THEN 1 WHEN k = 5 THEN 0 END AS seq,
  CASE WHEN k = 1 AND n > 2 THEN 'event content does not match its hash' WHEN k = 2 AND n > 3 THEN 'line is not valid JSON'
    WHEN k = 3 AND n > 1 THEN 'prevHash does not match previous event' WHEN k = 4 AND n > 2 THEN 'sequence gap (found 2)' WHEN k = 5 THEN 'empty log' END AS reason
FROM run_len""", "run_len")


@query("audit_decisions", with_parts("SELECT run_id, reason IS NULL AS ok, events, seq, reason FROM run_decision", "run_decision"))
def audit_decisions(t: Tables) -> DataFrame:
    runs, texts = tampered_lines(t)
    parsed = audit.parse_audit_lines(texts)
    return audit.verify_audit_chain(parsed, runs)


@query("output_files", """
WITH last AS (SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) - 1 AS seq, user_id FROM events GROUP BY user_id)
SELECT run_id, 'invoice.xml' AS name, CAST(seq AS INTEGER) AS seq, 'file invoice.xml was modified' AS reason FROM last WHERE user_id % 3 = 1
UNION ALL SELECT run_id, 'extra.xml', CAST(seq AS INTEGER), 'file extra.xml not recorded' FROM last WHERE user_id % 2 = 0""")
def output_files(t: Tables) -> DataFrame:
    r = F.col("run_id").cast("long")
    content = F.concat(F.lit("<x>"), "run_id", F.lit("</x>"))
    data = F.concat(F.lit('{"files":{"invoice.xml":"'), tagged_sha256(content), F.lit('"}}'))
    parsed = audit.parse_audit_lines(audit.build_audit_chain(t.audit_events.withColumn("data", data)).select("run_id", F.col("seq").alias("line_no"), "line"))
    runs = t.audit_events.select("run_id").distinct()
    changed = F.when(r % 3 == 1, F.concat(content, F.lit(" "))).otherwise(content)
    files = runs.select("run_id", F.explode(F.array_compact(F.array(
        F.struct(F.lit("invoice.xml").alias("name"), tagged_sha256(changed).alias("sha256")),
        F.when(r % 2 == 0, F.struct(F.lit("extra.xml").alias("name"), tagged_sha256(content).alias("sha256")))))).alias("f")).select("run_id", "f.*")
    return audit.verify_output_files(parsed, files)


@query("audit_log_lines", with_parts("SELECT run_id, seq AS line_no, type FROM audit", "audit"))
def audit_log_lines(t: Tables) -> DataFrame:
    """The log of each run as one text with blank lines in between, split again."""
    from ..operators.ordering import join_in_order
    chain = audit.build_audit_chain(t.audit_events)
    texts = join_in_order(chain, ["run_id"], "seq", "line", "\n \n", "text")
    lines = records.log_lines(texts.withColumn("text", F.concat("text", F.lit("\n"))))
    return audit.parse_audit_lines(lines).select("run_id", "line_no", "type")


@query("audit_log_files", with_parts("SELECT run_id, seq AS line_no, type FROM audit", "audit"))
def audit_log_files(t: Tables) -> DataFrame:
    """The logs as files, one per run, written in order and read again by byte ranges."""
    folder = fresh_dir(t.spark, "audit-log")
    audit_files.write_audit_log(audit.build_audit_chain(t.audit_events), folder)
    return audit.parse_audit_lines(audit_files.read_audit_log(t.spark, folder)[1]).select("run_id", "line_no", "type")


@query("last_states", with_parts("SELECT run_id, arg_max(type, seq) AS type, max(seq) AS seq FROM audit GROUP BY run_id", "audit"))
def last_states(t: Tables) -> DataFrame:
    return audit.last_state(t.audit_events)


@query("step_durations", with_parts("""
SELECT run_id, seq, type, lead(ms) OVER (PARTITION BY run_id ORDER BY seq) - ms AS ms FROM (SELECT *, epoch_ms(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS ms FROM audit)""", "audit"))
def step_durations(t: Tables) -> DataFrame:
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(replace(replace(ts, 'T', ' '), 'Z', '') as timestamp_ntz))")
    return audit.step_durations(t.audit_events.withColumn("at_ms", at))


#: The audit events once more, of every type in turn, with the data that such events carry.
_TYPES = [s[0] for s in model.STATIONS]
_LABELS = ", ".join(f"('{t}', '{label}', '{initials}')" for t, label, initials, _ in model.STATIONS)
part("told", f"""
SELECT run_id, seq, [{", ".join(f"'{t}'" for t in _TYPES)}][event_id % {len(_TYPES)} + 1] AS type, (event_id // {len(_TYPES)}) % 2 = 0 AS even,
  CAST(json_extract_string(data, '$.k') AS BIGINT) AS k FROM audit""", "audit")


def _told(t: Tables) -> DataFrame:
    k, even = F.get_json_object("data", "$.k").cast("long"), F.expr(f"(event_id div {len(_TYPES)}) % 2 = 0")
    many = lambda n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"path":"x"}'), n.cast("int")), ","), F.lit("]"))
    said = lambda **fields: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), v if isinstance(v, Column) else F.lit(v)) for f, v in fields.items()]), F.lit("}"))
    text = lambda n: n.cast("string")
    data = {
        "INGEST": said(pages=text(k % 5)), "EXTRACT": F.when(even, F.lit('{"reused":true}')).otherwise(said(promptTokens=text(k), completionTokens=text(k % 7), costUsd='"0.00012"')),
        "EVIDENCE_CHECK": said(accepted=text(k), rejected=many(k % 4)), "DERIVE": said(lines=text(k), vatGroups=text(k % 3)),
        "CONSISTENCY_CHECK": said(totalWarnings=text(k % 2), lineMismatches=text(k % 3)),
        "VALIDATE": F.when(even, said(valid="true", errorCount="0", reportHash='"sha256:abcdef0123456789"')).otherwise(said(valid="false", errorCount=text(k % 6))),
        "REPAIR_PLAN": said(promptTokens=text(k), completionTokens="1", costUsd='"0.5"'), "PATCH_GUARD": said(accepted=many(k % 3), rejected=many(k % 4)),
        "NEEDS_INPUT": said(missing=many(k % 3)), "REJECTED": F.lit('{"rules":["BR-E-10","BR-O-10"]}'), "USER_INPUT": F.lit('{"fields":["BT-1","BT-2"]}')}
    kind = F.get(F.array(*[F.lit(x) for x in _TYPES]), (F.col("event_id") % len(_TYPES)).cast("int"))
    told = t.audit_events.withColumn("type", kind)
    return told.withColumns({
        "data": F.coalesce(*[F.when(F.col("type") == x, v) for x, v in data.items()], F.lit("{}")),
        "input_hash": F.when(F.col("type") == "INGEST", tagged_sha256(F.col("run_id"))), "output_hash": F.when(F.col("type") == "BUILD_CII", tagged_sha256(F.col("run_id")))})


@query("event_counts", with_parts("""
SELECT run_id, arg_max(k, seq) FILTER (type = 'EVIDENCE_CHECK') AS accepted, arg_max(k % 4, seq) FILTER (type = 'EVIDENCE_CHECK') AS rejected,
  arg_max(k, seq) FILTER (type = 'DERIVE') AS lines, arg_max(k % 3, seq) FILTER (type = 'DERIVE') AS vat_groups,
  arg_max(k % 2, seq) FILTER (type = 'CONSISTENCY_CHECK') AS total_warnings, arg_max(k % 3, seq) FILTER (type = 'CONSISTENCY_CHECK') AS line_mismatches,
  arg_max(CASE WHEN even THEN 0 ELSE k % 6 END, seq) FILTER (type = 'VALIDATE') AS error_count
FROM told GROUP BY run_id""", "told"))
def event_counts(t: Tables) -> DataFrame:
    return audit.event_counts(_told(t))


@query("station_notes", with_parts(f"""
SELECT run_id, seq, type, label, initials, CASE type WHEN 'INGEST' THEN (k % 5) || ' page' || CASE WHEN k % 5 = 1 THEN '' ELSE 's' END || ' · ' || substr(sha256(run_id), 1, 10)
    WHEN 'EXTRACT' THEN CASE WHEN even THEN 'previous reading reused' ELSE k || ' → ' || (k % 7) || ' tokens · $0.00012' END
    WHEN 'EVIDENCE_CHECK' THEN k || ' quoted · ' || (k % 4) || ' refused'
    WHEN 'DERIVE' THEN k || ' line' || CASE WHEN k = 1 THEN '' ELSE 's' END || ' · ' || (k % 3) || ' VAT group' || CASE WHEN k % 3 = 1 THEN '' ELSE 's' END
    WHEN 'CONSISTENCY_CHECK' THEN CASE WHEN k % 3 > 0 THEN (k % 3) || ' line' || CASE WHEN k % 3 = 1 THEN '' ELSE 's' END || ' contradict the page'
      WHEN k % 2 > 0 THEN 'printed total differs' ELSE 'all lines match the page' END
    WHEN 'BUILD_CII' THEN substr(sha256(run_id), 1, 10)
    WHEN 'VALIDATE' THEN CASE WHEN even THEN 'accepted · report abcdef0123' ELSE (k % 6) || ' rule violation' || CASE WHEN k % 6 = 1 THEN '' ELSE 's' END END
    WHEN 'REPAIR_PLAN' THEN k || ' → 1 tokens · $0.50000' WHEN 'PATCH_GUARD' THEN (k % 3) || ' accepted · ' || (k % 4) || ' voided'
    WHEN 'NEEDS_INPUT' THEN CASE WHEN k % 3 > 0 THEN (k % 3) || ' fact' || CASE WHEN k % 3 = 1 THEN '' ELSE 's' END || ' not on the document' ELSE 'could not be resolved from the document' END
    WHEN 'REJECTED' THEN 'BR-E-10, BR-O-10 cannot be met from the document' WHEN 'USER_INPUT' THEN 'BT-1, BT-2' WHEN 'OUTPUT' THEN 'audit chain closed' END AS note
FROM told JOIN (VALUES {_LABELS}) s(type, label, initials) USING (type)""", "told"))
def station_notes(t: Tables) -> DataFrame:
    return audit.station_notes(_told(t))


# --- costs ----------------------------------------------------------------------------------------


@query("priced_calls", with_parts(f"SELECT call_id, model, {usd('units')} AS cost FROM priced", "priced"))
def priced_calls(t: Tables) -> DataFrame:
    return costs.price_calls(t.model_calls)[0].select("call_id", "model", "cost")


@query("unpriced_calls", with_parts("""SELECT call_id, 'No pinned price for model "unknown/model"' AS error FROM call WHERE model = 'unknown/model'""", "call"))
def unpriced_calls(t: Tables) -> DataFrame:
    return costs.price_calls(t.model_calls)[1].select("call_id", "error")


@query("daily_spend", with_parts(f"SELECT day, {usd('sum(units)')} AS spent FROM priced GROUP BY day", "priced"))
def daily_spend(t: Tables) -> DataFrame:
    return costs.daily_spend(costs.price_calls(t.model_calls)[0])


BUDGET = "0.25"


@query("budget_status", with_parts("""
SELECT day, u < 25000000 AS live, CAST(CAST((greatest(25000000 - u, 0) + 5000) // 10000 AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS remaining
FROM (SELECT day, CAST(sum(units) AS BIGINT) AS u FROM priced GROUP BY day)""", "priced"))
def budget_status(t: Tables) -> DataFrame:
    return costs.budget_status(daily_spend(t), BUDGET)


@query("run_costs", with_parts("""
SELECT run_id, CAST(CAST((sum(units) + 50) // 100 AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6)) AS cost FROM priced GROUP BY run_id""", "priced"))
def run_costs(t: Tables) -> DataFrame:
    return costs.run_cost(costs.price_calls(t.model_calls)[0])


@query("budget_admission", with_parts(f"""
SELECT call_id, day, {usd('b')} AS spent_before, b < 25000000 AS admitted FROM (SELECT *, CAST(coalesce(sum(units) OVER (PARTITION BY day ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM priced)""", "priced"))
def budget_admission(t: Tables) -> DataFrame:
    calls = costs.price_calls(t.model_calls)[0]
    return costs.budget_admission(calls, BUDGET).select("call_id", "day", "spent_before", "admitted")


part("req", "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events")
part("lim", """
SELECT key, request_id, at_ms, n, true AS admitted, CAST(0 AS BIGINT) AS retry_after_s, [at_ms] AS hits FROM req WHERE n = 1
UNION ALL
SELECT key, request_id, at_ms, n, len(live) < 2, CASE WHEN len(live) < 2 THEN CAST(0 AS BIGINT) ELSE CAST((live[1] + 43200000 - at_ms + 999) // 1000 AS BIGINT) END,
  CASE WHEN len(live) < 2 THEN list_append(live, at_ms) ELSE live END
FROM (SELECT r.*, list_filter(l.hits, lambda h: h > r.at_ms - 43200000) AS live FROM lim l JOIN req r ON r.key = l.key AND r.n = l.n + 1)""", "req")
LIMIT_SQL = with_parts("SELECT key, request_id, at_ms, admitted, retry_after_s FROM lim", "lim")


@query("rate_limit", LIMIT_SQL)
def rate_limit(t: Tables) -> DataFrame:
    """At most two admitted requests per user in any twelve hours."""
    decided = limits.rate_limit(t.requests, limit=2, window_ms=43_200_000)
    return decided.select("key", "request_id", "at_ms", "admitted", "retry_after_s")
