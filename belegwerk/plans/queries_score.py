"""Named queries: invoice XML, scoring and the evaluation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.text import tagged_sha256
from ..operators import amounts, scoring
from ..session import materialise, materialise_by
from ..sources import invoice_xml, records, validator_reports
from . import evaluate, views
from .bindings import Tables
from .oracle_parts import HEADER, flat_sql, part, with_parts
from .registry import query


def good_invoices(t: Tables) -> DataFrame:
    """Invoices that carry everything the XML needs."""
    return good_of(t.invoices)


def good_of(invoices: DataFrame) -> DataFrame:
    return invoices.where(
        "number is not null and issue_date is not null and currency is not null and buyer_reference is not null and seller.name <> '' "
        "and seller.electronic_address.value is not null and seller.electronic_address.scheme <> '' and buyer.electronic_address.value is not null "
        "and seller.address.city is not null and seller.address.postcode is not null and buyer.address.city is not null "
        "and seller.contact.name is not null and seller.contact.phone is not null and seller.contact.email is not null")


part("good", """
SELECT * FROM inv WHERE number IS NOT NULL AND issue_date IS NOT NULL AND currency IS NOT NULL AND buyer_reference IS NOT NULL AND seller_name <> ''
AND seller_ea IS NOT NULL AND seller_scheme <> '' AND buyer_ea IS NOT NULL AND seller_city IS NOT NULL AND seller_postcode IS NOT NULL AND buyer_city IS NOT NULL
AND contact_name IS NOT NULL AND contact_phone IS NOT NULL AND contact_email IS NOT NULL""", "inv")

_E = lambda c: f"replace(replace({c}, '&', '&amp;'), '<', '&lt;')"


def _x(depth: int, name: str, value: str, attrs: str = "") -> str:
    """SQL text of one leaf; NULL and '' give ''."""
    pad = "  " * depth
    return f"CASE WHEN coalesce({value}, '') = '' THEN '' ELSE '{pad}<{name}' || {attrs or repr('')} || '>' || {_E(value)} || '</{name}>' || chr(10) END"


def _n(depth: int, name: str, *inside: str) -> str:
    pad = "  " * depth
    return f"'{pad}<{name}>' || chr(10) || " + " || ".join(inside) + f" || '{pad}</{name}>' || chr(10)"


def _cents(c: str) -> str:
    return f"CAST(CAST(CAST({c} AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS VARCHAR)"


_unit = "' unitCode=\"' || unit_code || '\"'"
part("line_xml", "SELECT doc_id, string_agg(" + _n(
    2, "ram:IncludedSupplyChainTradeLineItem",
    _n(3, "ram:AssociatedDocumentLineDocument", _x(4, "ram:LineID", "id")), _n(3, "ram:SpecifiedTradeProduct", _x(4, "ram:Name", "name")),
    _n(3, "ram:SpecifiedLineTradeAgreement", _n(4, "ram:NetPriceProductTradePrice", _x(5, "ram:ChargeAmount", "net_price"), _x(5, "ram:BasisQuantity", "price_base_quantity", _unit))),
    _n(3, "ram:SpecifiedLineTradeDelivery", _x(4, "ram:BilledQuantity", "quantity", _unit)),
    _n(3, "ram:SpecifiedLineTradeSettlement",
       _n(4, "ram:ApplicableTradeTax", _x(5, "ram:TypeCode", "'VAT'"), _x(5, "ram:CategoryCode", "vat_category"), _x(5, "ram:RateApplicablePercent", "vat_rate")),
       _n(4, "ram:SpecifiedTradeSettlementLineMonetarySummation", _x(5, "ram:LineTotalAmount", _cents("net_cents"))))) + ", '' ORDER BY line_index) AS lines_xml FROM line GROUP BY doc_id", "line")
part("tax_xml", "SELECT doc_id, string_agg(" + _n(
    3, "ram:ApplicableTradeTax", _x(4, "ram:CalculatedAmount", _cents("tax_cents")), _x(4, "ram:TypeCode", "'VAT'"), _x(4, "ram:ExemptionReason", "reason"),
    _x(4, "ram:BasisAmount", _cents("taxable_cents")), _x(4, "ram:CategoryCode", "vat_category"), _x(4, "ram:ExemptionReasonCode", "reason_code"),
    _x(4, "ram:RateApplicablePercent", "CAST(coalesce(rate, 0) AS VARCHAR)")) + """, '' ORDER BY first_line) AS taxes_xml
FROM grp LEFT JOIN (SELECT doc_id, category AS vat_category, reason, reason_code FROM ex) e USING (doc_id, vat_category) GROUP BY doc_id""", "grp", "ex")


def _party_address(p: str) -> str:
    return _n(4, "ram:PostalTradeAddress", _x(5, "ram:PostcodeCode", f"{p}_postcode"), _x(5, "ram:LineOne", f"{p}_line1"), _x(5, "ram:LineTwo", f"{p}_line2"),
              _x(5, "ram:CityName", f"{p}_city"), _x(5, "ram:CountryID", f"{p}_country"))


_if = lambda cond, node: f"CASE WHEN {cond} THEN {node} ELSE '' END"
_ea = lambda p: _n(4, "ram:URIUniversalCommunication", _x(5, "ram:URIID", f"{p}_ea", f"' schemeID=\"' || {p}_scheme || '\"'"))
_DOC = (
    "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<rsm:CrossIndustryInvoice xmlns:rsm=\"urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100\""
    " xmlns:ram=\"urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100\" xmlns:qdt=\"urn:un:unece:uncefact:data:standard:QualifiedDataType:100\""
    " xmlns:udt=\"urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100\">' || chr(10) || "
    + _n(1, "rsm:ExchangedDocumentContext",
         _n(2, "ram:BusinessProcessSpecifiedDocumentContextParameter", _x(3, "ram:ID", "'urn:fdc:peppol.eu:2017:poacc:billing:01:1.0'")),
         _n(2, "ram:GuidelineSpecifiedDocumentContextParameter", _x(3, "ram:ID", "'urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0'"))) + " || "
    + _n(1, "rsm:ExchangedDocument", _x(2, "ram:ID", "number"), _x(2, "ram:TypeCode", "type_code"),
         _n(2, "ram:IssueDateTime", _x(3, "udt:DateTimeString", "replace(issue_date, '-', '')", "' format=\"102\"'"))) + " || "
    + _n(1, "rsm:SupplyChainTradeTransaction", "coalesce(lines_xml, '')",
         _n(2, "ram:ApplicableHeaderTradeAgreement", _x(3, "ram:BuyerReference", "buyer_reference"),
            _n(3, "ram:SellerTradeParty", _x(4, "ram:ID", "seller_id"), _x(4, "ram:Name", "seller_name"),
               _if("seller_reg IS NOT NULL", _n(4, "ram:SpecifiedLegalOrganization", _x(5, "ram:ID", "seller_reg"))),
               _n(4, "ram:DefinedTradeContact", _x(5, "ram:PersonName", "contact_name"), _n(5, "ram:TelephoneUniversalCommunication", _x(6, "ram:CompleteNumber", "contact_phone")),
                  _n(5, "ram:EmailURIUniversalCommunication", _x(6, "ram:URIID", "contact_email"))),
               _party_address("seller"), _ea("seller"),
               _if("seller_tax IS NOT NULL", _n(4, "ram:SpecifiedTaxRegistration", _x(5, "ram:ID", "seller_tax", "' schemeID=\"FC\"'"))),
               _if("seller_vat IS NOT NULL", _n(4, "ram:SpecifiedTaxRegistration", _x(5, "ram:ID", "seller_vat", "' schemeID=\"VA\"'")))),
            _n(3, "ram:BuyerTradeParty", _x(4, "ram:Name", "buyer_name"), _party_address("buyer"), _ea("buyer")),
            _if("order_reference IS NOT NULL", _n(3, "ram:BuyerOrderReferencedDocument", _x(4, "ram:IssuerAssignedID", "order_reference")))),
         "'    <ram:ApplicableHeaderTradeDelivery/>' || chr(10)",
         _n(2, "ram:ApplicableHeaderTradeSettlement", _x(3, "ram:InvoiceCurrencyCode", "currency"),
            _if("iban IS NOT NULL", _n(3, "ram:SpecifiedTradeSettlementPaymentMeans", _x(4, "ram:TypeCode", "means_code"),
                                       _n(4, "ram:PayeePartyCreditorFinancialAccount", _x(5, "ram:IBANID", "iban"), _x(5, "ram:AccountName", "account_name")))),
            "coalesce(taxes_xml, '')",
            _n(3, "ram:SpecifiedTradePaymentTerms", _x(4, "ram:Description", "payment_terms || CASE WHEN doc_id % 5 = 0 THEN chr(10) ELSE '' END"),
               _if("due_date IS NOT NULL", _n(4, "ram:DueDateDateTime", _x(5, "udt:DateTimeString", "replace(due_date, '-', '')", "' format=\"102\"'")))),
            _n(3, "ram:SpecifiedTradeSettlementHeaderMonetarySummation", _x(4, "ram:LineTotalAmount", _cents("line_cents")), _x(4, "ram:TaxBasisTotalAmount", _cents("line_cents")),
               _x(4, "ram:TaxTotalAmount", _cents("tax_cents"), "' currencyID=\"' || currency || '\"'"), _x(4, "ram:GrandTotalAmount", _cents("grand_cents")),
               _x(4, "ram:DuePayableAmount", _cents("grand_cents")))))
    + " || '</rsm:CrossIndustryInvoice>' || chr(10)")
part("doc_xml", f"SELECT doc_id, {_DOC} AS xml FROM good LEFT JOIN line_xml USING (doc_id) LEFT JOIN tax_xml USING (doc_id) LEFT JOIN tot USING (doc_id)", "good", "line_xml", "tax_xml", "tot")


def written(t: Tables) -> DataFrame:
    """Lines are placed and computed once and stored by document, where their texts, groups and totals are made without
    another shuffle."""
    nets = materialise_by(t.placed_nets, "nets", "doc_id")
    breakdown = amounts.vat_breakdown(nets)
    return invoice_xml.write_invoice_xml(good_of(t.keyed_invoices), nets, breakdown, amounts.invoice_totals(breakdown), t.exemptions)


@query("invoice_xml", with_parts("SELECT doc_id, sha256(xml) AS sha256, CAST(length(xml) AS BIGINT) AS n FROM doc_xml", "doc_xml"))
def invoice_xml_hashes(t: Tables) -> DataFrame:
    return written(t).select("doc_id", "sha256", F.length("xml").cast("long").alias("n"))


part("line_read", "SELECT * FROM line WHERE doc_id IN (SELECT doc_id FROM good)", "line", "good")
part("ex_read", "SELECT * FROM ex WHERE doc_id IN (SELECT doc_id FROM good)", "ex", "good")


@query("invoice_xml_read", with_parts("SELECT doc_id, key, term, value FROM (" + flat_sql("good", "line_read", "ex_read") + ")", "good", "line_read", "ex_read"))
def invoice_xml_read(t: Tables) -> DataFrame:
    """Every fact read back from the written XML."""
    back = invoice_xml.parse_invoice_xml(written(t).select("doc_id", "xml"))
    return scoring.flatten_facts(back["invoices"], back["lines"], back["exemptions"])


@query("invoice_xml_refused", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN 'not readable XML' ELSE 'missing BT-1' END AS reason FROM orders WHERE o_orderkey % 10 < 2")
def invoice_xml_refused(t: Tables) -> DataFrame:
    """Every order as a small document: some are cut off, some have no number, the others are not refused."""
    o = F.col("o_orderkey")
    number = F.when(o % 10 == 1, "").otherwise(F.concat(F.lit("<a:ID>R-"), o.cast("string"), F.lit("</a:ID>")))
    whole = F.concat(F.lit("<a:X xmlns:a='u'><a:ExchangedDocument>"), number, F.lit("<a:TypeCode>380</a:TypeCode></a:ExchangedDocument></a:X>"))
    xml = F.when(o % 10 == 0, F.substring(whole, F.lit(1), (F.length(whole) - 1 - o % 50).cast("int"))).otherwise(whole)
    return invoice_xml.parse_invoice_xml(t.table("orders").select(o.alias("doc_id"), xml.alias("xml")))["bad"]


@query("xml_round_trip", with_parts(
    "SELECT doc_id, count(*) AS facts, CAST(0 AS BIGINT) AS differences FROM (" + flat_sql("good", "line_read", "ex_read") + ") GROUP BY doc_id", "good", "line_read", "ex_read"))
def xml_round_trip(t: Tables) -> DataFrame:
    # Written and compared from what is stored by document: lines are placed and computed once, groups and totals made where
    # they lie.
    stored = lambda df, name: materialise_by(df, name, "doc_id", placed=True)
    good = stored(good_of(t.keyed_invoices), "good")
    only = lambda df: df.join(good.select("doc_id"), "doc_id", "left_semi")
    nets = stored(only(t.doc_nets), "nets")
    breakdown = amounts.vat_breakdown(nets)
    return views.roundtrip_check(good, nets, breakdown, amounts.invoice_totals(breakdown), only(t.doc_exemptions))


# --- validator reports -----------------------------------------------------------------------------

_REPORT = ("'<rep:report xmlns:rep=\"http://example/report\"><rep:scenarioMatched><rep:validationStepResult id=\"s\"><rep:message code=\"BR-DE-15\" level=\"' || lvl || '\" xpathLocation=\"/x[' || doc_id || ']\"> text '"
           " || doc_id || ' </rep:message><rep:message code=\"BR-02\" level=\"warning\" xpathLocation=\"/y\">second</rep:message></rep:validationStepResult></rep:scenarioMatched><rep:assessment><rep:' || decision || '><a/></rep:' || decision || '></rep:assessment></rep:report>'")
part("report", f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {_REPORT} END AS report, lvl, decision FROM (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'warning' END AS lvl, CASE WHEN o_orderkey % 3 = 0 THEN 'accept' ELSE 'reject' END AS decision FROM orders)")


def _reports(t: Tables) -> DataFrame:
    d = F.col("o_orderkey")
    decision = F.when(d % 3 == 0, "accept").otherwise("reject")
    lit = F.lit
    text = F.concat(
        lit('<rep:report xmlns:rep="http://example/report"><rep:scenarioMatched><rep:validationStepResult id="s"><rep:message code="BR-DE-15" level="'), F.when(d % 2 == 0, "error").otherwise("warning"),
        lit('" xpathLocation="/x['), d.cast("string"), lit(']"> text '), d.cast("string"),
        lit(' </rep:message><rep:message code="BR-02" level="warning" xpathLocation="/y">second</rep:message></rep:validationStepResult></rep:scenarioMatched><rep:assessment><rep:'),
        decision, lit("><a/></rep:"), decision, lit("></rep:assessment></rep:report>"))
    return t.table("orders").select(d.alias("doc_id"), F.when(d % 10 != 0, text).alias("report"), F.when(d % 10 == 0, F.array(lit("boom"))).alias("processing_errors"))


@query("validator_decisions", with_parts("SELECT doc_id, report IS NOT NULL AND decision = 'accept' AS valid, sha256(report) AS report_hash FROM report", "report"))
def validator_decisions(t: Tables) -> DataFrame:
    return validator_reports.parse_validator_reports(_reports(t))[0]


@query("validator_findings", with_parts("""
SELECT doc_id, 0 AS seq, 'BR-DE-15' AS rule_id, lvl AS severity, 'text ' || doc_id AS message, '/x[' || doc_id || ']' AS location FROM report WHERE report IS NOT NULL
UNION ALL SELECT doc_id, 1, 'BR-02', 'warning', 'second', '/y' FROM report WHERE report IS NOT NULL
UNION ALL SELECT doc_id, 0, 'PROCESSING', 'error', 'boom', '' FROM report WHERE report IS NULL""", "report"))
def validator_findings(t: Tables) -> DataFrame:
    return validator_reports.parse_validator_reports(_reports(t))[1]


# --- scoring ----------------------------------------------------------------------------------------


@query("flattened_facts", with_parts("SELECT doc_id, key, term, value FROM truth", "truth"))
def flattened_facts(t: Tables) -> DataFrame:
    return scoring.flatten_facts(t.invoices, t.lines, t.exemptions)


def compared(t: Tables) -> DataFrame:
    return scoring.compare_tables((t.keyed_invoices, t.keyed_lines, t.exemptions), (t.got_invoices, t.got_lines, t.exemptions))


@query("compared_facts", with_parts("SELECT doc_id, key, term, status, want, got FROM compared", "compared"))
def compared_facts(t: Tables) -> DataFrame:
    return compared(t)


@query("invented_facts", with_parts("SELECT doc_id, key, term, got AS value FROM compared WHERE status = 'invented'", "compared"))
def invented_facts(t: Tables) -> DataFrame:
    return scoring.invented_in_tables((t.keyed_invoices, t.keyed_lines, t.exemptions), (t.got_invoices, t.got_lines, t.exemptions))


@query("term_accuracy", with_parts("""SELECT term, count(*) AS total, count(*) FILTER (status = 'correct') AS correct FROM compared WHERE status <> 'invented' GROUP BY term
ORDER BY CAST(substr(term, 4) AS INTEGER)""", "compared"))
def term_accuracy(t: Tables) -> DataFrame:
    return scoring.sort_terms(scoring.term_accuracy(compared(t)))


part("eval_run", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OUTPUT' WHEN 1 THEN 'OUTPUT' WHEN 2 THEN 'NEEDS_INPUT' ELSE 'FAILED' END AS state,
  CASE doc_id % 3 WHEN 0 THEN 'OUTPUT' WHEN 1 THEN 'NEEDS_INPUT' ELSE 'FAILED' END AS expected, doc_id % 12 = 3 AS failed, doc_id % 5 <> 0 AS valid,
  CAST(doc_id % 4 AS INTEGER) AS iterations, CAST(CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lost, 100 + doc_id * 7 % 900 AS micro, 1000 + doc_id * 37 % 5000 AS ms, doc_id % 8 <> 0 AS same FROM inv""", "inv")
part("scored", """
SELECT r.doc_id, state, expected, state = expected AND NOT failed AS as_expected, valid, iterations, lost AS fields_without_provenance,
  CAST(CAST(micro AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6)) AS cost, ms, count(*) FILTER (status <> 'invented') AS fields_total,
  count(*) FILTER (status = 'correct') AS fields_correct, count(*) FILTER (status = 'invented') AS fields_invented, state = 'OUTPUT' AND same AS totals_correct,
  coalesce(list_sort(list(key || '=' || got) FILTER (status = 'invented')), []) AS invented_keys,
  coalesce(list_sort(list(key || ': ' || got || ' (truth ' || want || ')') FILTER (status = 'wrong')), []) AS wrong_keys
FROM eval_run r JOIN compared c ON c.doc_id = r.doc_id GROUP BY ALL""", "eval_run", "compared")


def _runs(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    grand = F.lit("10.00")
    return t.keyed_invoices.select(
        "doc_id", F.when(d % 4 < 2, "OUTPUT").when(d % 4 == 2, "NEEDS_INPUT").otherwise("FAILED").alias("state"),
        scoring.expected_state(F.when(d % 3 == 1, "needs-input").when(d % 3 == 2, "rejected")).alias("expected"),
        F.when(d % 12 == 3, "crash").alias("error"), (d % 5 != 0).alias("valid"), (d % 4).cast("int").alias("iterations"),
        F.when(d % 50 == 0, 1).otherwise(0).cast("long").alias("fields_without_provenance"),
        ((100 + d * 7 % 900).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)").alias("cost"), (1000 + d * 37 % 5000).alias("ms"),
        grand.alias("truth_grand"), F.when(d % 8 != 0, grand).otherwise("9.99").alias("got_grand"), grand.alias("truth_due"), grand.alias("got_due"))


def scored(t: Tables) -> DataFrame:
    # Stored, since the counts and the lists are two passes over it.
    return scoring.score_documents(materialise(scoring.for_counting(compared(t)), "compared"), _runs(t))


@query("document_scores", with_parts("SELECT * FROM scored", "scored"))
def document_scores(t: Tables) -> DataFrame:
    return scored(t)


@query("evaluation_summary", with_parts("""
SELECT count(*) AS documents, count(*) FILTER (state = 'OUTPUT' AND valid) AS valid_outputs,
  count(*) FILTER (state = 'OUTPUT' AND valid AND totals_correct AND fields_without_provenance = 0) AS gate_pass, count(*) FILTER (as_expected) AS as_expected,
  CAST(sum(fields_correct) AS BIGINT) AS fields_correct, CAST(sum(fields_total) AS BIGINT) AS fields_total, CAST(sum(fields_invented) AS BIGINT) AS fields_invented,
  CAST(sum(fields_without_provenance) AS BIGINT) AS fields_without_provenance, CAST(sum(iterations) AS BIGINT) AS iterations,
  CAST(round(sum(cost), 4) AS DECIMAL(18,4)) AS total_cost, percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS median_ms FROM scored""", "scored"))
def evaluation_summary(t: Tables) -> DataFrame:
    return scoring.summarize_eval(scored(t))


# --- readers side by side -----------------------------------------------------------------------------


def corpus_of(t: Tables) -> evaluate.Corpus:
    d, total = F.col("doc_id"), F.lit("10.00")
    expected = t.keyed_invoices.select(
        "doc_id", scoring.expected_state(F.when(d % 3 == 1, "needs-input").when(d % 3 == 2, "rejected")).alias("expected"),
        total.alias("truth_grand"), total.alias("truth_due"))
    return evaluate.Corpus((t.keyed_invoices, t.keyed_lines, t.exemptions), expected)


def careless(t: Tables) -> evaluate.Pipeline:
    """A reader that loses, changes and invents fields."""
    def read(corpus: evaluate.Corpus) -> evaluate.Reading:
        return evaluate.Reading((t.got_invoices, t.got_lines, t.exemptions), _runs(t).drop("expected", "truth_grand", "truth_due"))

    return read


def exact(corpus: evaluate.Corpus) -> evaluate.Reading:
    """A reader that knows everything and never asks."""
    runs = corpus.expected.select(
        "doc_id", F.lit("OUTPUT").alias("state"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("valid"), F.lit(0).alias("iterations"),
        F.lit(0).cast("long").alias("fields_without_provenance"), F.lit("0").cast("decimal(18,6)").alias("cost"),
        (F.lit(1000) + F.col("doc_id") % 7).cast("long").alias("ms"), F.col("truth_grand").alias("got_grand"), F.col("truth_due").alias("got_due"))
    return evaluate.Reading(corpus.truth, runs)


def evaluated(t: Tables) -> dict[str, DataFrame]:
    return evaluate.evaluate(corpus_of(t), {"careless": careless(t), "exact": exact})


part("side", """
SELECT 'careless' AS pipeline, doc_id, state, expected, as_expected, valid, iterations, fields_without_provenance, cost, ms, fields_total, fields_correct, fields_invented, totals_correct FROM scored
UNION ALL SELECT 'exact', r.doc_id, 'OUTPUT', expected, expected = 'OUTPUT', true, 0, 0, CAST(0 AS DECIMAL(18,6)), 1000 + r.doc_id % 7, n, n, 0, true
FROM eval_run r JOIN (SELECT doc_id, count(*) AS n FROM truth GROUP BY doc_id) USING (doc_id)""", "scored", "eval_run", "truth")
part("side_summary", """
SELECT pipeline, count(*) AS documents, count(*) FILTER (state = 'OUTPUT' AND valid) AS valid_outputs,
  count(*) FILTER (state = 'OUTPUT' AND valid AND totals_correct AND fields_without_provenance = 0) AS gate_pass, count(*) FILTER (as_expected) AS as_expected,
  CAST(sum(fields_correct) AS BIGINT) AS fields_correct, CAST(sum(fields_total) AS BIGINT) AS fields_total, CAST(sum(fields_invented) AS BIGINT) AS fields_invented,
  CAST(sum(fields_without_provenance) AS BIGINT) AS fields_without_provenance, CAST(sum(iterations) AS BIGINT) AS iterations,
  CAST(round(sum(cost), 4) AS DECIMAL(18,4)) AS total_cost, percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS median_ms FROM side GROUP BY pipeline""", "side")
part("side_term", """
SELECT 'careless' AS pipeline, term, count(*) AS total, count(*) FILTER (status = 'correct') AS correct FROM compared WHERE status <> 'invented' GROUP BY term
UNION ALL SELECT 'exact', term, count(*), count(*) FROM truth GROUP BY term""", "compared", "truth")


@query("pipelines_side_by_side", with_parts("SELECT * FROM side_summary", "side_summary"))
def pipelines_side_by_side(t: Tables) -> DataFrame:
    """One summary per reader over the whole corpus."""
    return evaluated(t)["summary"]


_SUMMARY_JSON = ", ".join(f"'{evaluate._camel(c)}': {'CAST(total_cost AS VARCHAR)' if c == 'total_cost' else c}" for c in evaluate.SUMMARY)


@query("evaluation_report", with_parts(f"""
SELECT pipeline, 0 AS section, '' AS key, '{{"summary":' || CAST(to_json({{{_SUMMARY_JSON}}}) AS VARCHAR) || ',"terms":[' AS line FROM side_summary
UNION ALL SELECT pipeline, 1, key, CASE WHEN row_number() OVER (PARTITION BY pipeline ORDER BY key) = 1 THEN '' ELSE ',' END || json FROM (
  SELECT pipeline, lpad(regexp_extract(term, '[0-9]+'), 6, '0') || ' ' || term AS key, CAST(to_json({{'term': term, 'correct': correct, 'total': total}}) AS VARCHAR) AS json FROM side_term)
UNION ALL SELECT pipeline, 2, '', '],"rows":[' FROM side_summary
UNION ALL SELECT pipeline, 3, key, CASE WHEN row_number() OVER (PARTITION BY pipeline ORDER BY key) = 1 THEN '' ELSE ',' END || json FROM (
  SELECT pipeline, CAST(doc_id AS VARCHAR) AS key, CAST(to_json({{'id': doc_id, 'state': state, 'expected': expected, 'asExpected': as_expected, 'valid': valid,
    'fieldsTotal': fields_total, 'fieldsCorrect': fields_correct, 'fieldsInvented': fields_invented}}) AS VARCHAR) AS json FROM side)
UNION ALL SELECT pipeline, 4, '', ']}}' FROM side_summary""", "side", "side_summary", "side_term"))
def evaluation_report(t: Tables) -> DataFrame:
    """The report of every reader, line by line as it is written."""
    return evaluate.report_lines(evaluated(t))


@query("not_as_expected", with_parts("SELECT doc_id, state, expected FROM scored WHERE NOT as_expected", "scored"))
def not_as_expected(t: Tables) -> DataFrame:
    return records.not_as_expected(scored(t))


@query("pass_costs", "SELECT user_id // 2 AS case_id, CAST(CAST(sum(event_id % 100) AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6)) AS cost, CAST(sum(event_id % 4) AS BIGINT) AS iterations FROM events GROUP BY 1")
def pass_costs(t: Tables) -> DataFrame:
    e = F.col("event_id")
    passes = t.table("events").select(
        F.expr("user_id div 2").alias("case_id"), ((e % 100).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).alias("cost"), (e % 4).alias("iterations"))
    return scoring.pass_costs(passes)


@query("run_event_rows", """
SELECT CAST(user_id AS VARCHAR) AS case_id, CASE WHEN k = 0 THEN 1 ELSE 2 END AS pass, CAST(row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) - 1 AS INTEGER) AS seq, event_id AS at_ms, event_type AS type
FROM (SELECT *, event_id % 2 AS k FROM events)""")
def run_event_rows(t: Tables) -> DataFrame:
    """Recorded runs, first and follow-up pass, one row per event."""
    step = F.struct(F.col("event_id").alias("at"), F.concat(F.lit('{"type":"'), "event_type", F.lit('"}')).alias("event"))
    even = F.col("event_id") % 2 == 0
    recordings = t.table("events").groupBy(F.col("user_id").cast("string").alias("case_id")).agg(
        F.array_sort(F.collect_list(F.when(even, step))).alias("run"), F.array_sort(F.collect_list(F.when(~even, step))).alias("followUp"))
    return records.parse_run_events(recordings).drop("event")


_SHOWN = [(p, c) for _, p, _, _ in model.VIEW_FIELDS for path, _, c in HEADER if path == p]


@query("result_view", with_parts("""
SELECT doc_id, path, value, CASE WHEN value IS NULL THEN '—' WHEN doc_id % 3 = 0 THEN 'p.1' WHEN doc_id % 3 = 1 THEN 'you' ELSE 'calc' END AS mark, path = 'buyerReference' AND doc_id % 7 = 0 AS missing
FROM (""" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS path, nullif({c}, '') AS value FROM inv" for p, c in _SHOWN) + """)
WHERE value IS NOT NULL OR (path = 'buyerReference' AND doc_id % 7 = 0)""", "inv"))
def result_view(t: Tables) -> DataFrame:
    """Every shown field of every invoice, from all facts of its model."""
    from ..operators.model_check import leaf_paths
    d = F.col("doc_id")
    leaves = leaf_paths(t.invoices, t.lines, t.exemptions)
    facts = leaves.withColumns({"kind": F.when(d % 3 == 0, "evidence").when(d % 3 == 1, "user").otherwise("derived"), "page": F.lit(1)})
    missing = t.invoices.where(d % 7 == 0).select("doc_id", F.lit("buyerReference").alias("path"))
    return views.result_view(facts, missing, t.invoices).select("doc_id", "path", "value", "mark", "missing")
