"""Named queries: corpus building, extraction, patches, the repair loop and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codelists import CodeLists
from ..operators import amounts, audit, corpus, evidence, patches, rules
from ..session import materialise, materialise_by
from ..sources import extractions
from ..streaming import jobs
from . import queries_model, queries_runs, queries_score, repair
from .bindings import Tables
from .oracle_parts import money, part, usd, with_parts
from .registry import query

LISTS = CodeLists()
SALT = "holdout-v1"


@query("holdout_ids", f"SELECT doc_id, sha256('{SALT}:' || doc_id) AS rank_hash FROM documents ORDER BY rank_hash LIMIT 4")
def holdout_ids(t: Tables) -> DataFrame:
    return corpus.holdout_split(t.table("documents"), SALT, 4)


def _manifest(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.table("documents").select(
        d.alias("id"), F.sha2("text", 256).alias("sha256"), F.when(d % 3 == 0, "clean").when(d % 3 == 1, "noisy").otherwise("mutated").alias("set"), (d % 5 == 0).alias("holdout"))


@query("changed_entries", "SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 10 = 7")
def changed_entries(t: Tables) -> DataFrame:
    now = _manifest(t)
    before = now.where("id % 10 <> 3").withColumn("sha256", F.when(F.col("id") % 10 == 7, "old").otherwise(F.col("sha256")))
    return corpus.diff_manifest(before, now)


_SETS = "CASE doc_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'noisy' ELSE 'mutated' END"


@query("corpus_counts", f"SELECT {_SETS} AS \"set\", doc_id % 5 = 0 AS holdout, count(*) AS n FROM documents GROUP BY ALL")
def corpus_counts(t: Tables) -> DataFrame:
    return corpus.corpus_counts(_manifest(t))


@query("selected_entries", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 1 AND doc_id % 5 <> 0 ORDER BY doc_id")
def selected_entries(t: Tables) -> DataFrame:
    return corpus.sort_manifest(corpus.select_entries(_manifest(t), "noisy")).select("id")


@query("in_scope", with_parts("SELECT doc_id FROM inv WHERE currency = 'EUR' AND doc_id % 4 <> 1 AND doc_id % 7 <> 1 AND doc_id % 9 <> 1", "inv"))
def in_scope(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    zero_unless = lambda n: F.when(d % n == 1, "1.00").otherwise("0.00")
    facts = t.invoices.select(
        "doc_id", "type_code", "currency", zero_unless(4).alias("allowances"), F.lit(None).cast("string").alias("charges"), zero_unless(7).alias("prepaid"),
        F.lit("0").alias("rounding"), F.when(d % 9 == 1, "48").otherwise(F.col("payment.means_code")).alias("means_code"))
    return corpus.select_in_scope(facts).select("doc_id")


POOLS = corpus.Pools()


def _picked(pool: tuple[str, ...], key: str, salt: int) -> str:
    return f"[{', '.join(repr(v) for v in pool)}][({key} * 7 + {salt * 13}) % {len(pool)} + 1]"


@query("dressed_invoices", f"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'RE-' || year(o_orderdate) || '-' || (1000 + o_orderkey) ELSE 'R-1' END AS number,
  {_picked(POOLS.sellers, "o_orderkey", 0)} AS seller_name, {_picked(POOLS.cities, "o_orderkey", 4)} AS seller_city,
  '+49 30 ' || (4400 + o_orderkey % 90) || (100 + o_orderkey) || '-0' AS phone, {_picked(POOLS.buyers, "o_orderkey", 6)} AS buyer_name,
  'bis ' || {_picked(POOLS.items, "o_orderkey", 2)} AS terms FROM orders""")
def dressed_invoices(t: Tables) -> DataFrame:
    o = F.col("doc_id")
    bare = t.invoices.join(t.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "doc_id").withColumns({
        "seed": o, "issue_date": F.col("day"), "number": F.when(o % 3 == 0, "Rechnungsnummer").otherwise("R-1"), "payment_terms": F.lit("bis …"),
        "seller": F.col("seller").withField("name", F.lit("[Seller name]")).withField("address.city", F.lit("[…]")).withField("contact.phone", F.lit("[phone]")),
        "buyer": F.col("buyer").withField("name", F.lit("nicht vorhanden"))})
    done, _ = corpus.dress_invoices(bare, t.lines, POOLS)
    return done.select("doc_id", "number", F.col("seller.name").alias("seller_name"), F.col("seller.address.city").alias("seller_city"),
                       F.col("seller.contact.phone").alias("phone"), F.col("buyer.name").alias("buyer_name"), F.col("payment_terms").alias("terms"))


@query("dressed_lines", with_parts(f"""SELECT doc_id, line_index, CASE WHEN doc_id % 2 = 0 THEN CAST(line_index + 1 AS VARCHAR) ELSE 'P' || line_index END AS id,
  'Zeitschrift ' || {_picked(POOLS.items, "doc_id", 1)} AS name FROM line""", "line"))
def dressed_lines(t: Tables) -> DataFrame:
    index = F.col("line_index").cast("string")
    lines = t.lines.withColumns({"id": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("12345"), index)).otherwise(F.concat(F.lit("P"), index)), "name": F.lit("Zeitschrift [...]")})
    return corpus.dress_invoices(t.invoices.withColumn("seed", F.col("doc_id")), lines, POOLS)[1].select("doc_id", "line_index", "id", "name")


# --- defects ------------------------------------------------------------------------------------------

_MUT = ", ".join(f"({i}, '{m[0]}', '{m[5]}')" for i, m in enumerate(corpus.MUTATIONS))
part("pool", f"""
SELECT i.doc_id, i.iban IS NOT NULL AS paid, coalesce(std, true) AS std, x.doc_id IS NOT NULL AS exempted FROM inv i
LEFT JOIN (SELECT doc_id, bool_and(vat_category = 'S') AS std FROM line GROUP BY doc_id) s ON s.doc_id = i.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM ex) x ON x.doc_id = i.doc_id
WHERE i.doc_id NOT IN (SELECT o_orderkey FROM orders ORDER BY sha256('{SALT}:' || o_orderkey) LIMIT 4)""", "inv", "line", "ex")
part("cand", f"""
SELECT k, mutation_id, doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n
FROM pool JOIN (VALUES {_MUT}) m(k, mutation_id, applies) ON applies = 'any' OR (applies = 'paid' AND paid) OR (applies = 'all-standard' AND std) OR (applies = 'all-standard-no-exemption' AND std AND NOT exempted)""", "pool")
part("base", "SELECT mutation_id, k, j, doc_id FROM cand, (VALUES (0), (1)) v(j) WHERE pos = (k * 3 + j) % n", "cand")


def bases(t: Tables) -> DataFrame:
    return corpus.mutation_bases(t.invoices, t.lines, t.exemptions, corpus.holdout_split(t.invoices, SALT, 4))


@query("mutation_bases", with_parts("SELECT mutation_id, CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, doc_id FROM base", "base"))
def mutation_bases(t: Tables) -> DataFrame:
    return bases(t)


_INV = "buyer_reference, currency, seller_vat, seller_tax, seller_id, seller_reg, contact_phone, contact_email, seller_ea, seller_city, buyer_ea, buyer_city, iban"


def _all_mutations(t: Tables, df: DataFrame) -> DataFrame:
    names = F.explode(F.array(*[F.lit(m[0]) for m in corpus.MUTATIONS]))
    return df.withColumn("mutation_id", names)


@query("mutated_invoices", with_parts(f"""
SELECT doc_id, mutation_id, CASE WHEN mutation_id = 'missing-buyer-reference' THEN '' ELSE buyer_reference END AS buyer_reference, CASE WHEN mutation_id = 'invalid-currency-symbol' THEN '€' ELSE currency END AS currency,
  CASE WHEN mutation_id <> 'missing-seller-tax-ids' THEN seller_vat END AS seller_vat, CASE WHEN mutation_id <> 'missing-seller-tax-ids' THEN seller_id END AS seller_id,
  CASE WHEN mutation_id = 'missing-seller-phone' THEN '' ELSE contact_phone END AS contact_phone, CASE WHEN mutation_id = 'missing-seller-email' THEN '' ELSE contact_email END AS contact_email,
  CASE WHEN mutation_id = 'missing-seller-electronic-address' THEN '' ELSE seller_ea END AS seller_ea, CASE WHEN mutation_id = 'missing-seller-city' THEN '' ELSE seller_city END AS seller_city,
  CASE WHEN mutation_id = 'missing-buyer-electronic-address' THEN '' ELSE buyer_ea END AS buyer_ea, CASE WHEN mutation_id = 'missing-buyer-city' THEN '' ELSE buyer_city END AS buyer_city,
  CASE WHEN mutation_id <> 'missing-iban' THEN iban END AS iban FROM inv, (VALUES {_MUT}) m(k, mutation_id, applies) WHERE buyer_ea IS NOT NULL AND seller_ea IS NOT NULL""", "inv"))
def mutated_invoices(t: Tables) -> DataFrame:
    """Every defect on every invoice that has both electronic addresses."""
    whole = t.invoices.where("buyer.electronic_address.value is not null and seller.electronic_address.value is not null")
    m = corpus.mutate_invoices(_all_mutations(t, whole))
    return m.select(
        "doc_id", "mutation_id", "buyer_reference", "currency", F.col("seller.vat_id").alias("seller_vat"), F.col("seller.id").alias("seller_id"),
        F.col("seller.contact.phone").alias("contact_phone"), F.col("seller.contact.email").alias("contact_email"), F.col("seller.electronic_address.value").alias("seller_ea"),
        F.col("seller.address.city").alias("seller_city"), F.col("buyer.electronic_address.value").alias("buyer_ea"), F.col("buyer.address.city").alias("buyer_city"), F.col("payment.iban").alias("iban"))


@query("mutated_corpus", with_parts(f"""
SELECT l.doc_id, b.mutation_id, l.line_index, CASE WHEN b.mutation_id = 'exempt-without-reason' THEN 'E' ELSE vat_category END AS vat_category,
  CASE WHEN b.mutation_id = 'exempt-without-reason' THEN '0' ELSE vat_rate END AS vat_rate,
  CASE WHEN b.mutation_id = 'unit-as-german-word' THEN CASE WHEN line_index % 2 = 0 THEN 'Stück' ELSE 'Stunde' END ELSE unit_code END AS unit_code,
  {money("tax_cents + CASE WHEN b.mutation_id = 'vat-amount-off' THEN 10 ELSE 0 END")} AS tax_total, {money("grand_cents + CASE WHEN b.mutation_id = 'grand-total-off' THEN 100 ELSE 0 END")} AS grand_total
FROM line l JOIN base b ON b.doc_id = l.doc_id JOIN tot ON tot.doc_id = l.doc_id""", "line", "base", "tot"))
def mutated_corpus(t: Tables) -> DataFrame:
    """Lines and printed amounts of the chosen base documents."""
    _, lines, printed = corpus.mutate_corpus(t.invoices, t.lines, t.totals, bases(t))
    return lines.join(printed, ["doc_id", "mutation_id"]).select("doc_id", "mutation_id", "line_index", "vat_category", "vat_rate", "unit_code", "tax_total", "grand_total")


@query("corpus_union", with_parts(f"""
SELECT "set" || '/' || doc_id || '-' || variant AS id, "set", variant AS name, doc_id AS source_id, number, buyer_reference, currency, seller_city, contact_phone, iban, {money("tax_cents")} AS tax_total, {money("grand_cents")} AS grand_total
FROM good CROSS JOIN (VALUES {", ".join(f"('{v[0]}', '{v[1]}')" for v in corpus.VARIANTS)}) v("set", variant) LEFT JOIN tot USING (doc_id)
UNION ALL
SELECT 'mutated/' || doc_id || '-' || mutation_id, 'mutated', mutation_id, doc_id, number, CASE WHEN mutation_id = 'missing-buyer-reference' THEN '' ELSE buyer_reference END,
  CASE WHEN mutation_id = 'invalid-currency-symbol' THEN '€' ELSE currency END, CASE WHEN mutation_id = 'missing-seller-city' THEN '' ELSE seller_city END,
  CASE WHEN mutation_id = 'missing-seller-phone' THEN '' ELSE contact_phone END, CASE WHEN mutation_id <> 'missing-iban' THEN iban END,
  {money("tax_cents + CASE WHEN mutation_id = 'vat-amount-off' THEN 10 ELSE 0 END")}, {money("grand_cents + CASE WHEN mutation_id = 'grand-total-off' THEN 100 ELSE 0 END")}
FROM inv JOIN base USING (doc_id) LEFT JOIN tot USING (doc_id)""", "good", "inv", "base", "tot"))
def corpus_union(t: Tables) -> DataFrame:
    """Clean, noisy and mutated documents as one corpus with its truth, stored and read again."""
    mutated, _, printed = corpus.mutate_corpus(t.invoices, t.lines, t.totals, bases(t))
    stored = materialise(corpus.corpus_union(queries_score.good_invoices(t), t.totals, mutated, printed), "corpus")
    return stored.select("id", "set", "name", "source_id", "number", "buyer_reference", "currency", F.col("seller.address.city").alias("seller_city"),
                         F.col("seller.contact.phone").alias("contact_phone"), F.col("payment.iban").alias("iban"), "tax_total", "grand_total")


@query("checked_mutations", """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN o_orderkey % 5 = 1 THEN 'BR-CL-23' ELSE 'BR-DE-1' END AS detected_by, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS hit, o_orderkey % 2 = 0 AS valid,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 3 <> 0 AND (o_orderkey % 2 = 0) = (o_orderkey % 5 = 1) END AS ok FROM orders""")
def checked_mutations(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    rule = F.when(o % 5 == 0, "none").when(o % 5 == 1, "BR-CL-23").otherwise("BR-DE-1")
    cases = t.table("orders").select(o.alias("case_id"), rule.alias("detected_by"), (o % 5 == 1).alias("accepted_anyway"))
    found = t.table("orders").where(o % 5 != 0).select(o.alias("case_id"), F.when(o % 3 != 0, rule).otherwise("BR-02").alias("rule_id"))
    return corpus.check_mutations(cases, found, t.table("orders").select(o.alias("case_id"), (o % 2 == 0).alias("valid")))


@query("negative_cases", with_parts("""
SELECT doc_id || '|0' AS doc_id, 'BR-CL-04' AS rule_id FROM good UNION ALL SELECT doc_id || '|1', 'BR-CO-15' FROM good WHERE doc_id IN (SELECT doc_id FROM line)
UNION ALL SELECT doc_id || '|2', 'BR-DE-15' FROM good UNION ALL SELECT DISTINCT doc_id || '|3', 'BR-CL-18' FROM line WHERE vat_category = 'S' AND doc_id IN (SELECT doc_id FROM good)""", "good", "line"))
def negative_cases(t: Tables) -> DataFrame:
    """The rule each defect of a good invoice breaks, found with a location."""
    good = queries_score.good_invoices(t)
    only = lambda df: df.join(good.select("doc_id"), "doc_id", "left_semi")
    bad_inv, bad_lines, bad_totals = corpus.negative_cases(good, only(t.lines), only(t.totals))
    each = corpus.each_case
    found = rules.check_rules(bad_inv, None, amounts.derive_line_net(bad_lines), bad_totals, each(only(t.breakdown)), each(only(t.exemptions)), LISTS)
    expected = F.create_map(*[F.lit(x) for i, (_, r) in enumerate(corpus.NEGATIVE_CASES) for x in (str(i), r)])
    hits = found.where((F.col("rule_id") == expected[F.substring_index("doc_id", "|", -1)]) & (F.col("location") != ""))
    return hits.select("doc_id", "rule_id").distinct()


@query("text_page_variants", with_parts(f"""
SELECT "set" || '/' || doc_id || '-' || variant AS doc_id, page, lines, has_title FROM (
SELECT doc_id, v.*, unnest(CASE WHEN split THEN [1, 2] ELSE [1] END) AS page FROM good, (VALUES ('clean','classic',false,'Rechnungsnummer'),('clean','modern',false,'Rechnungsnummer'),('clean','compact',false,'Rechnungsnummer'),('noisy','noisy-a',false,'Rechnung Nr.'),('noisy','noisy-b',true,'Rechnungsnummer')) v("set", variant, split, title)
WHERE doc_id IN (SELECT doc_id FROM line)) JOIN (SELECT doc_id, page2 AS page, split2 AS split, n AS lines, page2 = 1 AS has_title FROM (
  SELECT h.doc_id, head AS n, 1 AS page2, true AS split2 FROM heads h UNION ALL SELECT doc_id, body, 2, true FROM heads UNION ALL SELECT doc_id, head + body, 1, false FROM heads)) USING (doc_id, page, split)""", "good", "line", "grp", "ex"
).replace('\nSELECT "set" ||', """,
heads AS (SELECT g.doc_id, CAST(3 + CASE WHEN seller_line2 IS NULL THEN 0 ELSE 1 END + 4 + 1 + CASE WHEN seller_vat IS NULL THEN 0 ELSE 1 END + CASE WHEN seller_tax IS NULL THEN 0 ELSE 1 END + CASE WHEN seller_reg IS NULL THEN 0 ELSE 1 END + CASE WHEN seller_id IS NULL THEN 0 ELSE 1 END
  + 5 + 4 + CASE WHEN due_date IS NULL THEN 0 ELSE 1 END + CASE WHEN order_reference IS NULL THEN 0 ELSE 1 END AS BIGINT) AS head,
  (SELECT count(*) FROM line l WHERE l.doc_id = g.doc_id) + (SELECT count(*) FROM grp r WHERE r.doc_id = g.doc_id) + 3 + CASE WHEN iban IS NULL THEN 0 ELSE 1 END + CASE WHEN account_name IS NULL THEN 0 ELSE 1 END + 1
  + (SELECT count(*) FROM ex x WHERE x.doc_id = g.doc_id) AS body FROM good g)
SELECT "set" ||"""))
def text_page_variants(t: Tables) -> DataFrame:
    """Clean and noisy text pages of every good invoice: how many lines each page has."""
    # All is stored by document before it is spread, so that no printed text is shuffled.
    stored = lambda df, name: materialise_by(df, name, "doc_id", placed=True)
    lined = stored(queries_score.good_of(t.keyed_invoices).join(t.doc_lines.select("doc_id").distinct(), "doc_id", "left_semi"), "lined")
    only = lambda df: df.join(lined.select("doc_id"), "doc_id", "left_semi")
    nets = stored(only(t.doc_nets), "nets")
    breakdown = amounts.vat_breakdown(nets)
    pages = corpus.noise_variants(lined, nets, breakdown, amounts.invoice_totals(breakdown), only(t.doc_exemptions))
    return pages.select("doc_id", "page", F.size(F.split("text", "\n")).cast("long").alias("lines"),
                        F.col("text").rlike("(?m)^(Rechnungsnummer|Rechnung Nr\\.): ").alias("has_title"))


# --- extraction ---------------------------------------------------------------------------------------


def _attempts(t: Tables) -> DataFrame:
    """Two recorded attempts per order; some unusable, a few both."""
    o = F.col("o_orderkey")
    good = F.concat(F.lit('{"header":{"invoiceNumber":{"value":"R-'), o.cast("string"), F.lit('","quote":"Nr. R-'), o.cast("string"), F.lit('","page":1}},"lines":[{"rowQuote":"row","page":1,"quantity":"2"}]}'))
    bad = F.when(o % 2 == 0, "{broken").otherwise('{"header":null,"lines":"none"}')
    first = t.table("orders").select(o.alias("doc_id"), F.lit(0).alias("attempt"), F.when(o % 4 == 0, bad).otherwise(good).alias("content"))
    second = t.table("orders").where(o % 4 == 0).select(o.alias("doc_id"), F.lit(1).alias("attempt"), F.when(o % 8 == 0, bad).otherwise(good).alias("content"))
    return first.unionByName(second)


@query("extraction_attempts", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS attempt FROM orders WHERE o_orderkey % 8 <> 0")
def extraction_attempts(t: Tables) -> DataFrame:
    ok, bad = extractions.parse_extractions(_attempts(t))
    return extractions.pick_first_valid_attempt(ok, bad)[0].select("doc_id", "attempt")


@query("extraction_failures", "SELECT o_orderkey AS doc_id, CAST(2 AS BIGINT) AS attempts, 'extraction returned invalid JSON twice' AS error FROM orders WHERE o_orderkey % 8 = 0")
def extraction_failures(t: Tables) -> DataFrame:
    ok, bad = extractions.parse_extractions(_attempts(t))
    return extractions.pick_first_valid_attempt(ok, bad)[1]


@query("extracted_facts", """
SELECT o_orderkey AS doc_id, 'number' AS path, 'R-' || o_orderkey AS value, 'Nr. R-' || o_orderkey AS quote, 1 AS page FROM orders WHERE o_orderkey % 8 <> 0
UNION ALL SELECT o_orderkey, 'lines.0.quantity', '2', 'row', 1 FROM orders WHERE o_orderkey % 8 <> 0""")
def extracted_facts(t: Tables) -> DataFrame:
    ok, bad = extractions.parse_extractions(_attempts(t))
    return extractions.facts_of(extractions.pick_first_valid_attempt(ok, bad)[0])


# --- streams ------------------------------------------------------------------------------------------


@query("stream_run_state", with_parts("""SELECT run_id, arg_max(type, seq) AS type, max(seq) AS seq,
  CASE arg_max(type, seq) WHEN 'OUTPUT' THEN 'OUTPUT' WHEN 'REJECTED' THEN 'FAILED' END AS state FROM audit GROUP BY run_id""", "audit"))
def stream_run_state(t: Tables) -> DataFrame:
    events = jobs.stream_table(t.audit_events.select("run_id", "seq", "type"), "run-events")
    return jobs.latest(jobs.run_to_table(jobs.stream_run_state(events), "run-state", "update"), "run_id")


#: Replays: lines come in as their events happen; a hole is reported after this time.
PATIENCE_MS, DISORDER = 3_600_001, "2 minutes"


def _arriving(t: Tables, lines: DataFrame) -> DataFrame:
    """Lines with the time at which they came in: that of the event in their place."""
    at = F.col("ts").cast("timestamp").alias("at")
    return lines.join(t.audit_events.select("run_id", F.col("seq").alias("line_no"), at), ["run_id", "line_no"])


@query("stream_chain_alerts", with_parts("SELECT run_id, CAST(seq AS INTEGER) AS seq, reason FROM run_decision WHERE seq IS NOT NULL AND reason <> 'empty log'", "run_decision"))
def stream_chain_alerts(t: Tables) -> DataFrame:
    jobs.use_rocksdb(t.spark)
    lines = _arriving(t, queries_runs.tampered_lines(t)[1])
    check = lambda stream: jobs.stream_chain_check(stream, PATIENCE_MS, DISORDER)
    return jobs.replay_to_table(lines, "audit-lines", "at", check, jobs.ALERT_TYPE)


LOST_SQL = with_parts("""
SELECT run_id, CAST(CASE WHEN d.seq < 2 OR NOT gone THEN d.seq ELSE 2 END AS INTEGER) AS seq,
  CASE WHEN d.seq < 2 OR NOT gone THEN d.reason ELSE 'line did not arrive' END AS reason
FROM run_decision d JOIN (
  SELECT run_id, CAST(run_id AS BIGINT) % 5 = 2 AND max(seq) FILTER (CAST(run_id AS BIGINT) % 7 <> 4 OR seq < (SELECT max(n) - 1 FROM run_len l WHERE l.run_id = a.run_id)) > 2 AS gone,
    min(epoch_ms(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP))) FILTER (seq > 2) AS since FROM audit a GROUP BY run_id) USING (run_id)
CROSS JOIN (SELECT max(epoch_ms(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP))) - 120000 AS now FROM audit)
WHERE reason IS DISTINCT FROM 'empty log' AND (CASE WHEN gone AND NOT coalesce(d.seq < 2, false) THEN since + 3600001 <= now ELSE d.reason IS NOT NULL END)""", "run_decision", "audit")


def _with_holes(t: Tables) -> DataFrame:
    """The tampered lines, of which every fifth run has lost line 2 as well."""
    return _arriving(t, queries_runs.tampered_lines(t)[1]).where(~((F.col("run_id").cast("long") % 5 == 2) & (F.col("line_no") == 2)))


@query("lost_line_alerts", LOST_SQL)
def lost_line_alerts(t: Tables) -> DataFrame:
    """Breaks and lost lines as they stand when the last event has come in and the disorder has passed."""
    last = t.audit_events.agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("ms")).first().ms or 0
    return audit.chain_alerts(_with_holes(t), PATIENCE_MS, last - 120_000)


@query("stream_lost_lines", LOST_SQL)
def stream_lost_lines(t: Tables) -> DataFrame:
    """The same as lines come in: a timer reports the line that stays missing."""
    jobs.use_rocksdb(t.spark)
    check = lambda stream: jobs.stream_chain_check(stream, PATIENCE_MS, DISORDER)
    return jobs.replay_to_table(_with_holes(t), "holed-lines", "at", check, jobs.ALERT_TYPE)


@query("stream_rate_limit", queries_runs.LIMIT_SQL)
def stream_rate_limit(t: Tables) -> DataFrame:
    """Requests in order of time over several triggers: the hits of the window are carried from one to the next."""
    limiter = jobs.RateLimit(t.spark, limit=2, window_ms=43_200_000)
    jobs.replay_in_order(t.requests, "requests", "at_ms", lambda stream: stream.writeStream.foreachBatch(limiter))
    return limiter.decisions()


@query("stream_daily_spend", with_parts(f"SELECT day, {usd('sum(units)')} AS spent FROM priced GROUP BY day", "priced"))
def stream_daily_spend(t: Tables) -> DataFrame:
    calls = t.model_calls.withColumn("ts", F.expr("timestamp_millis(timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts))")).drop("run_id")
    stream = jobs.stream_table(calls, "calls", files=6, per_trigger=1)
    return jobs.latest(jobs.run_to_table(jobs.stream_daily_spend(stream), "spend", "update"), "day")


@query("stream_questions", """
SELECT o_orderkey AS doc_id, rule_id, 'm' AS message, path FROM orders JOIN (VALUES (0, 'BR-DE-1', 'payment.iban'), (1, 'BR-02', NULL), (2, 'BR-62', 'seller.electronicAddress.value')) f(i, rule_id, path) ON o_orderkey % 3 = i WHERE o_orderkey % 4 <> 0""")
def stream_questions(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    found = t.table("orders").select(
        o.alias("doc_id"), F.lit(0).alias("seq"), F.when(o % 3 == 0, "BR-DE-1").when(o % 3 == 1, "BR-02").otherwise("BR-62").alias("rule_id"),
        F.when(o % 4 == 0, "warning").otherwise("error").alias("severity"), F.lit("m").alias("message"))
    asked = jobs.stream_findings_to_questions(jobs.stream_table(found, "findings"))
    return jobs.run_to_table(asked, "questions").select("doc_id", "rule_id", "message", "path")
