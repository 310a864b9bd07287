"""Named queries: completeness, rules, findings, issues and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..codelists import CodeLists
from ..operators import amounts, findings, model_check, rules
from ..session import materialise
from . import repair
from .bindings import Tables
from .oracle_parts import HEADER, LINE, money, part, with_parts
from .registry import query

_BT = {p: bt for p, bt, _ in HEADER}
_GONE = lambda c: f"({c} IS NULL OR {c} = '')"
_REQUIRED = [
    ("number", _GONE("number")), ("issueDate", "issue_date IS NULL"), ("currency", "currency IS DISTINCT FROM 'EUR'"), ("buyerReference", _GONE("buyer_reference")),
    ("seller.name", _GONE("seller_name")), ("seller.electronicAddress", "seller_ea IS NULL AND seller_scheme IS NULL"),
    ("seller.electronicAddress.scheme", f"NOT (seller_ea IS NULL AND seller_scheme IS NULL) AND {_GONE('seller_scheme')}"),
    ("seller.electronicAddress.value", f"NOT (seller_ea IS NULL AND seller_scheme IS NULL) AND {_GONE('seller_ea')}"),
    ("seller.address.city", _GONE("seller_city")), ("seller.address.postcode", _GONE("seller_postcode")),
    ("seller.contact.name", _GONE("contact_name")), ("seller.contact.phone", _GONE("contact_phone")), ("seller.contact.email", _GONE("contact_email")),
    ("buyer.electronicAddress", "buyer_ea IS NULL"), ("buyer.address.city", _GONE("buyer_city"))]
part("refused", "SELECT o_orderkey AS doc_id, 'buyerReference' AS path, 'a party name is not a buyer reference' AS reason FROM orders WHERE o_orderkey % 14 = 0")
part("missing", "SELECT m.doc_id, m.path, bt, coalesce(r.reason, 'not found on the document') AS reason FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{p}' AS path, '{_BT.get(p, p)}' AS bt FROM inv WHERE {c}" for p, c in _REQUIRED)
    + " UNION ALL SELECT doc_id, 'lines', 'lines' FROM inv WHERE doc_id NOT IN (SELECT doc_id FROM line)) m LEFT JOIN refused r ON r.doc_id = m.doc_id AND r.path = m.path", "inv", "line", "refused")


def _refused(t: Tables) -> DataFrame:
    return t.table("orders").where("o_orderkey % 14 = 0").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("buyerReference").alias("path"), F.lit("x").alias("value"), F.lit("a party name is not a buyer reference").alias("reason"))


def stored_missing(t: Tables) -> DataFrame:
    """The missing facts as a written table, for queries that read them several times."""
    if not hasattr(t, "_missing"):
        t._missing = materialise(missing(t), "missing")
    return t._missing


def missing(t: Tables) -> DataFrame:
    return model_check.check_required(t.invoices, t.lines, t.exemptions, _refused(t))


@query("missing_facts", with_parts("SELECT doc_id, path, bt, reason FROM missing", "missing"))
def missing_facts(t: Tables) -> DataFrame:
    return missing(t)


@query("missing_line_facts", with_parts("""
SELECT doc_id, 'lines.' || line_index || '.' || f AS path, bt || ' (line ' || (line_index + 1) || ')' AS bt, 'not found on the document' AS reason
FROM line, (VALUES ('quantity', 'BT-129', 0), ('vatCategory', 'BT-151', 1), ('vatRate', 'BT-152', 2)) v(f, bt, k) WHERE line_index % 4 = k AND (k < 2 OR vat_rate IS NOT NULL)""", "line"))
def missing_line_facts(t: Tables) -> DataFrame:
    """Lines with a malformed quantity, an unknown category or a malformed rate."""
    k = F.col("line_index") % 4
    lines = t.lines.withColumns({
        "quantity": F.when(k == 0, F.lit("1,5")).otherwise(F.col("quantity")), "vat_category": F.when(k == 1, F.lit("B")).otherwise(F.col("vat_category")),
        "vat_rate": F.when((k == 2) & F.col("vat_rate").isNotNull(), F.lit("x")).otherwise(F.col("vat_rate"))})
    found = model_check.check_required(t.invoices, lines, t.exemptions, _refused(t))
    return found.where("path like 'lines.%'")


_LEAF_EXTRA = (("typeCode", "type_code"), ("seller.electronicAddress.scheme", "seller_scheme"), ("buyer.electronicAddress.scheme", "buyer_scheme"), ("payment.meansCode", "means_code"))


@query("fields_without_provenance", with_parts("SELECT doc_id, path FROM (" + " UNION ALL ".join(
    [f"SELECT doc_id, '{p}' AS path, {c} AS value FROM inv" for p, _, c in HEADER] + [f"SELECT doc_id, '{p}', {c} FROM inv" for p, c in _LEAF_EXTRA]
    + [f"SELECT doc_id, 'lines.' || line_index || '.{p}', {c} FROM line" for p, _, c in LINE]
    + [f"SELECT doc_id, 'vatExemptions.' || ex_index || '.{p}', {c} FROM ex" for p, c in (("category", "category"), ("reason", "reason"), ("reasonCode", "reason_code"))])
    + ") WHERE value IS NOT NULL AND (length(path) + doc_id) % 3 = 0", "inv", "line", "ex"))
def fields_without_provenance(t: Tables) -> DataFrame:
    leaves = model_check.leaf_paths(t.invoices, t.lines, t.exemptions)
    backed = leaves.where((F.length("path") + F.col("doc_id")) % 3 != 0).select("doc_id", "path")
    return model_check.fields_without_provenance(leaves, backed)


# --- rules ------------------------------------------------------------------------------------------

LISTS = CodeLists()
_NO_CONTACT = f"({_GONE('contact_name')} AND {_GONE('contact_phone')} AND {_GONE('contact_email')})"
_HEADER_RULES = [
    ("BR-02", "error", "/number", _GONE("number")), ("BR-03", "error", "/issueDate", _GONE("issue_date")), ("BR-06", "error", "/seller/name", _GONE("seller_name")),
    ("BR-07", "error", "/buyer/name", _GONE("buyer_name")), ("BR-62", "error", "/seller/electronicAddress", f"{_GONE('seller_ea')} OR {_GONE('seller_scheme')}"),
    ("BR-63", "error", "/buyer/electronicAddress", f"{_GONE('buyer_ea')} OR {_GONE('buyer_scheme')}"),
    ("BR-CO-26", "error", "/seller", f"{_GONE('seller_id')} AND {_GONE('seller_reg')} AND {_GONE('seller_vat')}"), ("BR-DE-1", "error", "/payment", _GONE("iban")),
    ("BR-DE-2", "error", "/seller/contact", _NO_CONTACT), ("BR-DE-3", "error", "/seller/address/city", _GONE("seller_city")),
    ("BR-DE-4", "error", "/seller/address/postcode", _GONE("seller_postcode")), ("BR-DE-5", "error", "/seller/contact/name", f"NOT {_NO_CONTACT} AND {_GONE('contact_name')}"),
    ("BR-DE-6", "error", "/seller/contact/phone", f"NOT {_NO_CONTACT} AND {_GONE('contact_phone')}"), ("BR-DE-7", "error", "/seller/contact/email", f"NOT {_NO_CONTACT} AND {_GONE('contact_email')}"),
    ("BR-DE-8", "error", "/buyer/address/city", _GONE("buyer_city")), ("BR-DE-9", "error", "/buyer/address/postcode", _GONE("buyer_postcode")),
    ("BR-DE-15", "error", "/buyerReference", _GONE("buyer_reference")), ("BR-DE-TMP-32", "warning", "/", "true"),
    ("BR-CL-04", "error", "/currency", "currency = '€'"), ("BR-CL-14", "error", "/seller/address/countryCode", "seller_country = 'ZZ'")]
part("header_finding", " UNION ALL ".join(
    f"SELECT doc_id, '{r}' AS rule_id, '{s}' AS severity, '{l}' AS location FROM inv WHERE {c}" for r, s, l, c in _HEADER_RULES), "inv")


def _stated(t: Tables) -> DataFrame:
    d, terms = F.col("doc_id"), F.col("payment_terms")
    return t.invoices.withColumns({
        "guideline": F.when(d % 37 == 0, "urn:cen.eu:en16931:2017").otherwise(model.GUIDELINE_ID),
        "payment_terms_raw": F.when(d % 10 == 0, terms).otherwise(F.concat(terms, F.lit("\n")))})


@query("header_rules", with_parts("""SELECT * FROM header_finding
UNION ALL SELECT doc_id, 'BR-DE-18', 'error', '/paymentTerms' FROM inv WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, 'BR-DE-21', 'error', '/' FROM inv WHERE doc_id % 37 = 0""", "header_finding", "inv"))
def header_rules(t: Tables) -> DataFrame:
    """Headers as XML documents state them: some name another guideline, and the payment terms lack a last newline."""
    return rules.header_findings(_stated(t), LISTS)


part("line_finding", """
SELECT doc_id, 'BR-16' AS rule_id, 'error' AS severity, '/lines' AS location FROM inv WHERE doc_id NOT IN (SELECT doc_id FROM line)
UNION ALL SELECT doc_id, 'BR-CL-23', 'error', '/lines/' || line_index FROM line WHERE unit_code = 'Stück'
UNION ALL SELECT doc_id, 'BR-S-02', 'error', '/lines' FROM inv WHERE seller_vat IS NULL AND seller_tax IS NULL AND doc_id IN (SELECT doc_id FROM line WHERE vat_category = 'S')""", "inv", "line")


@query("line_rules", with_parts("""
SELECT * FROM line_finding WHERE rule_id <> 'BR-S-02'
UNION ALL SELECT doc_id, 'BR-S-02', 'error', '/lines' FROM inv WHERE seller_vat IS NULL AND seller_tax IS NULL AND doc_id IN (SELECT doc_id FROM line WHERE vat_category = 'S' AND line_index <> 2)
UNION ALL SELECT doc_id, 'BR-CL-18', 'error', '/lines/' || line_index FROM line WHERE line_index = 2
UNION ALL SELECT doc_id, 'BR-O-05', 'error', '/lines/' || line_index FROM line WHERE line_index <> 2 AND vat_category = 'O' AND doc_id % 2 = 0""", "line_finding", "inv", "line"))
def line_rules(t: Tables) -> DataFrame:
    third = F.col("line_index") == 2
    lines = t.lines.withColumns({
        "vat_category": F.when(third, F.lit("Q")).otherwise(F.col("vat_category")),
        "vat_rate": F.when((F.col("vat_category") == "O") & (F.col("doc_id") % 2 == 0), F.lit("0")).otherwise(F.col("vat_rate"))})
    return rules.line_findings(t.invoices, lines, LISTS)


@query("amount_rules", with_parts("""
SELECT doc_id, 'BR-CO-10' AS rule_id, 'error' AS severity, '/lineTotal' AS location FROM tot WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'BR-CO-13', 'error', '/taxBasisTotal' FROM tot WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'BR-CO-14', 'error', '/taxTotal' FROM tot WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'BR-CO-15', 'error', '/grandTotal' FROM tot WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0)
UNION ALL SELECT doc_id, 'BR-S-08', 'error', '/vat/S/' || rate || '.000000' FROM grp WHERE vat_category = 'S' AND doc_id % 13 = 0
UNION ALL SELECT doc_id, 'BR-S-09', 'error', '/vat/S/' || rate || '.000000' FROM grp WHERE vat_category = 'S' AND doc_id % 13 = 0
  AND tax_cents <> (2 * (taxable_cents + 10000) * rate + 100) // 200""", "tot", "grp"))
def amount_rules(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    add = lambda c, n, by: (F.col(c) + F.when(d % n == 0, F.lit(by)).otherwise("0").cast("decimal(18,2)")).cast("decimal(18,2)")
    stated = t.totals.withColumns({"line_total": add("line_total", 5, "1.00"), "tax_total": add("tax_total", 7, "1.00"), "grand_total": add("grand_total", 11, "1.00")})
    groups = t.breakdown.withColumn("taxable_amount", add("taxable_amount", 13, "100.00"))
    return rules.amount_findings(stated, groups, t.nets)


part("ex_finding", """
SELECT doc_id, 'BR-E-10' AS rule_id, 'error' AS severity, '/vatExemptions' AS location FROM (SELECT DISTINCT doc_id FROM grp WHERE vat_category = 'E') WHERE doc_id NOT IN (SELECT doc_id FROM ex WHERE category = 'E')
UNION ALL SELECT doc_id, 'BR-O-10', 'error', '/vatExemptions' FROM (SELECT DISTINCT doc_id FROM grp WHERE vat_category = 'O') WHERE doc_id NOT IN (SELECT doc_id FROM ex WHERE category = 'O')""", "grp", "ex")


@query("exemption_rules", with_parts("""SELECT * FROM ex_finding
UNION ALL SELECT DISTINCT doc_id, 'BR-DE-14', 'error', '/vatExemptions' FROM grp WHERE doc_id % 41 = 0""", "ex_finding", "grp"))
def exemption_rules(t: Tables) -> DataFrame:
    """Groups as a document states them: some come without a rate."""
    stated = t.breakdown.withColumn("rate", F.when(F.col("doc_id") % 41 != 0, F.col("rate")))
    return rules.exemption_findings(stated, t.exemptions)


part("finding", "SELECT * FROM header_finding UNION ALL SELECT * FROM line_finding UNION ALL SELECT * FROM ex_finding", "header_finding", "line_finding", "ex_finding")


def all_findings(t: Tables) -> DataFrame:
    nets = amounts.derive_line_net(t.lines)
    breakdown = materialise(amounts.vat_breakdown(nets), "breakdown")
    return rules.check_rules(t.invoices, None, nets, amounts.invoice_totals(breakdown), breakdown, t.exemptions, LISTS)


@query("rule_findings", with_parts("SELECT * FROM finding", "finding"))
def rule_findings(t: Tables) -> DataFrame:
    return all_findings(t)


@query("explained_findings", with_parts("""
SELECT rule_id, doc_id, severity, location, rule_id NOT IN ('BR-CL-14', 'BR-DE-18', 'BR-E-10', 'BR-O-10') AS explained FROM finding WHERE severity = 'error'""", "finding"))
def explained_findings(t: Tables) -> DataFrame:
    return findings.explain_findings(all_findings(t)).select("rule_id", "doc_id", "severity", "location", F.col("en").isNotNull().alias("explained"))


def _run_findings(t: Tables) -> DataFrame:
    """Findings of runs: a few rule ids per customer, in order of the order key."""
    o = F.col("o_orderkey")
    return t.table("orders").select(
        F.col("o_custkey").alias("run_id"), o.alias("seq"), F.concat(F.lit("XR-"), (o % 7).cast("string")).alias("rule_id"),
        F.when(o % 5 == 0, "warning").otherwise("error").alias("severity"), F.concat(F.lit("message "), o.cast("string")).alias("message"))


part("unknown", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS position FROM (
  SELECT o_custkey AS run_id, 'XR-' || (o_orderkey % 7) AS rule_id, min(o_orderkey) AS seq, 'message ' || min(o_orderkey) AS message FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL)) WHERE position <= 3""")


@query("unknown_rules", with_parts("SELECT run_id, rule_id, seq, message, position FROM unknown", "unknown"))
def unknown_rules(t: Tables) -> DataFrame:
    return findings.unknown_rules(_run_findings(t))


@query("rules_to_explain", with_parts("SELECT rule_id, arg_min(message, (seq, run_id)) AS message, min(seq) AS seen_at, arg_min(run_id, (seq, run_id)) AS run_id FROM unknown WHERE rule_id NOT IN ('XR-1', 'XR-4') GROUP BY rule_id", "unknown"))
def rules_to_explain(t: Tables) -> DataFrame:
    known = t.table("orders").select(F.concat(F.lit("XR-"), (F.col("o_orderkey") % 7).cast("string")).alias("rule_id"), (F.col("o_orderkey") % 7).isin(1, 4).alias("ok")).distinct()
    return findings.rules_to_explain(findings.unknown_rules(_run_findings(t)).withColumnRenamed("seq", "seen_at"), known)


_FIELDS_SQL = ", ".join(f"('{r}', '{p}', '{model.PATH_BT[p]}')" for r, p in model.RULE_FIELDS)
part("question", f"""
SELECT doc_id, path, bt, 'required by ' || arg_min(rule_id, rule_id) || ' but not on the document' AS reason
FROM finding JOIN (VALUES {_FIELDS_SQL}) f(rule_id, path, bt) USING (rule_id) WHERE severity = 'error'
AND NOT EXISTS (SELECT 1 FROM missing m WHERE m.doc_id = finding.doc_id AND m.path = f.path) GROUP BY doc_id, path, bt""", "finding", "missing")


def _rule_issues(t: Tables) -> DataFrame:
    """Error findings as issues, in order of the rule id."""
    found = all_findings(t).where("severity = 'error'")
    return found.select("doc_id", F.concat("rule_id", F.lit("|"), "location").alias("seq"), F.col("rule_id").alias("id"), F.col("rule_id").alias("message"), "location")


@query("questions_from_rules", with_parts("SELECT * FROM question", "question"))
def questions_from_rules(t: Tables) -> DataFrame:
    return findings.questions_from_rules(_rule_issues(t), missing(t))


def _mismatches(t: Tables) -> DataFrame:
    """Every page shows its line amounts; on every sixth they are a cent off."""
    off = F.when(F.col("doc_id") % 6 == 3, F.lit("0.01")).otherwise("0.00").cast("decimal(18,2)")
    printed = t.placed_nets.select("doc_id", "line_index", (F.col("net_amount") + off).cast("decimal(18,2)").alias("amount"))
    return amounts.check_lines(printed, t.placed_nets)


part("issue", f"""
SELECT doc_id, 'MISSING' AS id, bt || ' is required but ' || reason AS message, '/' || replace(path, '.', '/') AS location FROM missing
UNION ALL SELECT doc_id, 'LINE-MISMATCH', 'line ' || (line_index + 1) || ': quantity × price / base quantity = ' || {money('net_cents')} || ', but the printed line amount is '
  || {money('net_cents + 1')} || '. Check quantity, unit price and base quantity of this line.', '/lines/' || line_index
FROM line WHERE doc_id % 6 = 3 AND doc_id NOT IN (SELECT doc_id FROM missing)
UNION ALL SELECT doc_id, rule_id, rule_id, location FROM finding WHERE severity = 'error' AND rule_id <> 'BR-CL-23' AND doc_id NOT IN (SELECT doc_id FROM missing) AND NOT (doc_id % 6 = 3 AND doc_id IN (SELECT doc_id FROM line))""", "missing", "finding", "line")


def _issues(t: Tables) -> DataFrame:
    found = all_findings(t).select("doc_id", F.abs(F.xxhash64("rule_id", "location")).alias("seq"), "rule_id", "severity", F.col("rule_id").alias("message"), "location")
    return repair.build_issues(stored_missing(t), _mismatches(t), found)


@query("issues", with_parts("SELECT doc_id, id, message, location FROM issue", "issue"))
def issues(t: Tables) -> DataFrame:
    return _issues(t).drop("seq")


part("state", f"""
SELECT d.doc_id, CASE WHEN n_issue IS NULL THEN 'OUTPUT' WHEN coalesce(n_q, 0) = 0 AND n_rule > 0 THEN 'FAILED' ELSE 'NEEDS_INPUT' END AS state,
  CAST(CASE WHEN n_issue IS NULL THEN 0 ELSE coalesce(n_q, 0) END AS BIGINT) AS n_questions
FROM (SELECT o_orderkey AS doc_id FROM orders) d
LEFT JOIN (SELECT doc_id, count(*) AS n_issue, count(*) FILTER (id NOT IN ('MISSING', 'LINE-MISMATCH')) AS n_rule FROM issue GROUP BY doc_id) i ON i.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_q FROM (SELECT doc_id, path FROM missing UNION
  SELECT doc_id, path FROM issue JOIN (VALUES {_FIELDS_SQL}) f(rule_id, path, bt) ON issue.id = f.rule_id) GROUP BY doc_id) q ON q.doc_id = d.doc_id""", "issue", "missing")


@query("outcomes", with_parts("SELECT * FROM state", "state"))
def outcomes(t: Tables) -> DataFrame:
    found = _issues(t)
    errors = found.select("doc_id").distinct().withColumn("bad", F.lit(True))
    decision = t.invoices.select("doc_id").join(errors, "doc_id", "left").select("doc_id", F.col("bad").isNull().alias("valid"), F.lit("stored").alias("report_hash"))
    return repair.classify_outcome(t.invoices, decision, found, stored_missing(t))[0].select("doc_id", "state", "n_questions")
