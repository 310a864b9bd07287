"""Named queries: assembly of whole extractions, the patch guard, and the repair loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codelists import CodeLists
from ..functions import printing as P
from ..operators import amounts, corpus, evidence, model_check, patches
from ..session import discard, materialise, materialise_by
from . import queries_score, repair
from .assemble import assemble_read, printed_totals, read_texts
from .bindings import Tables
from .oracle_parts import HEADER, LINE, part, with_parts
from .queries_text import address_pages
from .registry import query

LISTS = CodeLists()


# --- assembly -----------------------------------------------------------------------------------------


def reading(t: Tables) -> dict[str, DataFrame]:
    """Good invoices printed as pages, and what a careful reader quotes from them."""
    style = {"number_format": F.lit("de"), "date_format": F.lit("de"), "label_variant": F.lit(0), "shuffled": F.lit(False), "split": F.lit(False)}
    # Stored by document, so that no file holds most of the headers.
    stored = lambda df, name: materialise_by(df, name, "doc_id", placed=True)
    styled = lambda df: df.withColumns({k: style[k] for k in ("number_format", "label_variant")})
    good = stored(queries_score.good_of(t.keyed_invoices).join(t.doc_lines.select("doc_id").distinct(), "doc_id", "left_semi").withColumns(style), "good")
    only = lambda df: styled(df.join(good.select("doc_id"), "doc_id", "left_semi"))
    # A line's amount and its text are computed once; groups and totals come from the stored amounts.
    nets = stored(only(t.doc_nets).withColumn("quote", corpus.line_text()), "printed-lines")
    rows = nets.select("doc_id", F.lit(3).alias("block"), F.col("line_index").alias("seq"), F.col("quote").alias("text"))
    breakdown, exemptions = amounts.vat_breakdown(nets), only(t.doc_exemptions)
    blocks = [corpus.format_facts(good), rows, corpus.format_vat(styled(breakdown)), corpus.format_totals(styled(amounts.invoice_totals(breakdown))),
              corpus.format_exemptions(exemptions)]
    pages = stored(corpus.text_pages(blocks, good), "printed-pages")
    leaves = model_check.leaf_paths(good, nets.limit(0), exemptions.limit(0)).where(
        "path <> 'typeCode' and path not like '%.scheme' and path <> 'payment.meansCode'")
    printed = F.when(F.col("path").isin("issueDate", "dueDate"), P.print_date(F.col("value"), F.lit("de"))).otherwise(F.col("value"))
    quote = F.when(F.col("path") == "payment.accountName", F.concat(F.lit("Kontoinhaber: "), "value")).otherwise(printed)
    header = leaves.select("doc_id", "path", printed.alias("value"), quote.alias("quote"), F.lit(1).alias("page"))
    de = F.lit("de")
    amount = lambda c: P.print_amount(F.col(c).cast("string"), de)
    cells = {
        "id": F.col("id"), "name": F.col("name"), "quantity": P.print_decimal(F.col("quantity"), de), "unitCode": P.print_unit(F.col("unit_code")),
        "netPrice": amount("net_price"), "priceBaseQuantity": P.print_decimal(F.col("price_base_quantity"), de),
        "vatCategory": F.concat(F.lit("("), "vat_category", F.lit(")")), "vatRate": P.print_rate(F.col("vat_rate"), de)}
    index = F.col("line_index").cast("string")
    fields = [F.struct(F.concat(F.lit("lines."), index, F.lit(f".{k}")).alias("path"), v.alias("value")) for k, v in cells.items()]
    fields.append(F.struct(F.concat(F.lit("documentTotals.lines."), index).alias("path"), amount("net_amount").alias("value")))
    lines = nets.select("doc_id", F.explode(F.array(*fields)).alias("f"), "quote").select("doc_id", "f.*", "quote", F.lit(1).alias("page")).where("value is not null")
    ex_path = lambda f: F.concat(F.lit("vatExemptions."), F.col("ex_index").cast("string"), F.lit(f".{f}"))
    label = F.concat(F.lit("Grund der Steuerbefreiung ("), "category", F.lit(")"))
    exempted = exemptions.select("doc_id", F.explode(F.array(
        F.struct(ex_path("category").alias("path"), F.concat(F.lit("("), "category", F.lit(")")).alias("value"), label.alias("quote")),
        F.struct(ex_path("reason").alias("path"), F.col("reason").alias("value"), F.col("reason").alias("quote")),
        F.struct(ex_path("reasonCode").alias("path"), F.concat(F.lit("("), "reason_code", F.lit(")")).alias("value"), F.concat(F.lit("("), "reason_code", F.lit(")")).alias("quote")))).alias("f")).select(
        "doc_id", "f.*", F.lit(1).alias("page")).where("value is not null")
    facts = header.unionByName(lines).unionByName(exempted)
    return {"facts": stored(facts, "reading"), "pages": pages, "line_ids": nets.select("doc_id", "line_index")}


def assembled(t: Tables) -> dict[str, DataFrame]:
    if not hasattr(t, "_assembled"):
        r = reading(t)
        facts, pages = read_texts(r["facts"], r["pages"])
        discard(r["facts"], r["pages"])
        t._assembled = assemble_read(facts, pages, r["line_ids"], LISTS)
    return t._assembled


part("whole", "SELECT * REPLACE (CASE WHEN currency = '€' THEN 'EUR' ELSE currency END AS currency) FROM good WHERE doc_id IN (SELECT doc_id FROM line)", "good", "line")
part("whole_line", "SELECT * REPLACE (CASE WHEN unit_code = 'Stück' THEN 'H87' ELSE unit_code END AS unit_code) FROM line WHERE doc_id IN (SELECT doc_id FROM whole)", "whole")
part("whole_ex", """
SELECT e.* FROM ex e WHERE doc_id IN (SELECT doc_id FROM whole) AND (reason IS NOT NULL OR reason_code IS NOT NULL)
UNION ALL SELECT w.doc_id, coalesce((SELECT max(ex_index) + 1 FROM ex x WHERE x.doc_id = w.doc_id), 0), 'O', NULL, 'VATEX-EU-O' FROM (SELECT DISTINCT doc_id FROM whole_line WHERE vat_category = 'O') w
WHERE doc_id NOT IN (SELECT doc_id FROM ex WHERE category = 'O')""", "whole_line", "ex")


@query("assembled_facts", with_parts("SELECT doc_id, path, value FROM (" + " UNION ALL ".join(
    [f"SELECT doc_id, '{p}' AS path, {c} AS value FROM whole" for p, _, c in HEADER if p != "seller.address.countryCode"]
    + ["SELECT doc_id, 'seller.address.countryCode', CASE WHEN seller_country <> 'ZZ' THEN seller_country END FROM whole",
       "SELECT doc_id, 'typeCode', '380' FROM whole", "SELECT doc_id, 'payment.meansCode', means_code FROM whole",
       "SELECT doc_id, 'seller.electronicAddress.scheme', 'EM' FROM whole", "SELECT doc_id, 'buyer.electronicAddress.scheme', buyer_scheme FROM whole"]
    + [f"SELECT doc_id, 'lines.' || line_index || '.{p}', {c} FROM whole_line" for p, _, c in LINE]
    + [f"SELECT doc_id, 'vatExemptions.' || ex_index || '.{p}', {c} FROM whole_ex" for p, c in (("category", "category"), ("reason", "reason"), ("reasonCode", "reason_code"))])
    + ") WHERE value IS NOT NULL", "whole", "whole_line", "whole_ex"))
def assembled_facts(t: Tables) -> DataFrame:
    """Print, read, check and normalise: the model comes back, with the units as codes."""
    return assembled(t)["accepted"].select("doc_id", "path", "value")


@query("assembled_rejections", with_parts("""SELECT doc_id, 'seller.address.countryCode' AS path, 'ZZ' AS value, 'unknown country "ZZ"' AS reason FROM whole WHERE seller_country = 'ZZ'""", "whole"))
def assembled_rejections(t: Tables) -> DataFrame:
    return assembled(t)["rejected"]


@query("assembled_missing", with_parts("""SELECT doc_id, 'seller.address.countryCode' AS path, 'BT-40' AS bt, 'unknown country "ZZ"' AS reason FROM whole WHERE seller_country = 'ZZ'
UNION ALL SELECT doc_id, 'currency', 'BT-5', 'not found on the document' FROM whole WHERE currency = 'USD'""", "whole"))
def assembled_missing(t: Tables) -> DataFrame:
    return materialise(assembled(t)["missing"], "missing")


@query("assembled_line_amounts", with_parts("SELECT doc_id, line_index, CAST(CAST(CAST(net_cents AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM whole_line", "whole_line"))
def assembled_line_amounts(t: Tables) -> DataFrame:
    return printed_totals(assembled(t)["printed"])[1]


# --- patch guard ----------------------------------------------------------------------------------------

_PATCHES: list[tuple[str, str, str, str, str | None, str | None]] = [
    ("add", "/seller/contact/phone", "+49 621 9050-3", "Tel. +49 621 9050-3", "+49 621 9050-3", None),
    ("add", "/lines/0/unitCode", "Stück", "Einheit Stück Preis 12,50", "H87", None),
    ("replace", "/lines/0/netPrice", "12,50", "Einheit Stück Preis 12,50", "12.50", None),
    ("replace", "/lines/0/netAmount", "12,50", "Einheit Stück Preis 12,50", None, "derived or fixed field"),
    ("add", "/seller/preferredCarrier", "x", "x", None, "unknown field"),
    ("add", "/orderReference", "PO", " ", None, "no provenance (missing quote)"),
    ("add", "/orderReference", "PO", "Erfunden PO", None, "evidence: quote-not-on-page"),
    ("add", "/buyerReference", "{bn}", "{bn}", None, "a party name is not a buyer reference"),
    ("add", "/payment/iban", "DE00", "Datum 04.04.2016", None, "evidence: value-not-in-quote"),
    ("replace", "/seller/address/line1", "{bs}", "{bs}", None, "printed once and already used for the buyer"),
    ("remove", "/number", "1", "1", None, "operation remove not allowed"),
    ("add", "/seller/electronicAddress/value", "post@kunde.example", "post@kunde.example", None, "printed inside the buyer's address block"),
    ("add", "/seller/contact/email", "s@firma.example", "Mail s@firma.example", None, "same evidence already used for orderReference"),
    ("replace", "/issueDate", "gestern", "seit gestern", None, 'normalization: unrecognized date "gestern"'),
    ("replace", "/seller/address/city", "Musterdorf", "Musterdorf", None, "city is not printed next to the postcode"),
    ("add", "/seller/vatId", "seit", "seit gestern", None, "shape: not a VAT identifier"),
]


def _patch_sql() -> str:
    q = lambda s: "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {q(p)}, {q(n)}, {q(r)})" for i, (_, p, _, _, n, r) in enumerate(_PATCHES))
    return f"SELECT o_orderkey AS doc_id, pointer, normalized, reason FROM orders JOIN (VALUES {rows}) p(i, pointer, normalized, reason) ON o_orderkey % {len(_PATCHES)} = i"


@query("guarded_patches", _patch_sql())
def guarded_patches(t: Tables) -> DataFrame:
    """Every document gets one proposed correction; each guard has its case."""
    facts, pages = address_pages(t)
    more = "\npost@kunde.example\n\n\n\n\n\nTel. +49 621 9050-3\nEinheit Stück Preis 12,50\nMail s@firma.example\nseit gestern\nMusterdorf"
    pages = materialise(pages.withColumn("text", F.concat("text", F.lit(more))), "guard-pages")
    held = facts.where("path not in ('seller.address.city', 'buyer.address.city')").withColumn("kind", F.lit("evidence"))
    also = held.where("path = 'seller.name'").withColumns({"path": F.lit("orderReference"), "value": F.lit("s@firma.example"), "quote": F.lit("Mail s@firma.example")})
    held = materialise(held.unionByName(also), "held")
    names = held.where("path in ('buyer.name', 'buyer.address.line1')").groupBy("doc_id").agg(
        F.max(F.when(F.col("path") == "buyer.name", F.col("value"))).alias("bn"), F.max(F.when(F.col("path") == "buyer.address.line1", F.col("value"))).alias("bs"))
    pool = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(p).alias("path"), F.lit(v).alias("value"), F.lit(qt).alias("quote")) for op, p, v, qt, _, _ in _PATCHES])
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{bn}"), F.col("bn")), F.lit("{bs}"), F.col("bs"))
    plan = names.withColumn("p", F.get(pool, (F.col("doc_id") % len(_PATCHES)).cast("int"))).select("doc_id", "bn", "bs", "p.*").select(
        "doc_id", F.lit(0).alias("seq"), "op", "path", fill("value").alias("value"), fill("quote").alias("quote"), F.lit(1).alias("page"))
    formats = names.select("doc_id", F.lit("de").alias("number_format"))
    guarded = patches.guard_patches(plan, pages, evidence.canonical_pages(pages), evidence.document_text(pages), formats, held, LISTS)
    return guarded.select("doc_id", "pointer", "normalized", "reason")


@query("patched_facts", """
SELECT o_orderkey AS doc_id, 'number' AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'new2' ELSE 'old' END AS value, 'evidence' AS kind FROM orders
UNION ALL SELECT o_orderkey, 'currency', 'EUR', 'derived' FROM orders UNION ALL SELECT o_orderkey, 'dueDate', '2026-01-01', 'evidence' FROM orders WHERE o_orderkey % 3 = 0""")
def patched_facts(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    fact = lambda p, v, k: F.struct(F.lit(p).alias("path"), F.lit(v).alias("value"), F.lit(k).alias("kind"))
    facts = t.table("orders").select(o.alias("doc_id"), F.explode(F.array(fact("number", "old", "evidence"), fact("currency", "EUR", "derived"))).alias("f")).select("doc_id", "f.*")
    patch = lambda s, p, v: F.struct(F.lit(s).alias("seq"), F.lit(p).alias("path"), F.lit(v).alias("normalized"))
    accepted = t.table("orders").select(o.alias("doc_id"), F.explode(F.array_compact(F.array(
        F.when(o % 2 == 0, patch(0, "number", "new1")), F.when(o % 2 == 0, patch(1, "number", "new2")), F.when(o % 3 == 0, patch(2, "dueDate", "2026-01-01"))))).alias("f")).select(
        "doc_id", "f.*", F.lit("q").alias("quote"), F.lit(1).alias("page"))
    return patches.apply_patches(facts, accepted).select("doc_id", "path", "value", "kind")


# --- repair loop ----------------------------------------------------------------------------------------

part("open", """
SELECT *, doc_id % 7 = 0 AS mr, doc_id % 5 = 0 AS mm FROM inv WHERE number IS NOT NULL AND issue_date IS NOT NULL AND currency = 'EUR' AND seller_name <> ''
AND seller_ea IS NOT NULL AND seller_scheme <> '' AND buyer_ea IS NOT NULL AND seller_city IS NOT NULL AND seller_postcode IS NOT NULL AND buyer_city IS NOT NULL
AND contact_name IS NOT NULL AND contact_phone IS NOT NULL AND contact_email IS NOT NULL AND doc_id IN (SELECT doc_id FROM line)""", "inv", "line")


def repair_input(t: Tables) -> dict:
    """Whole models, some without a buyer reference, some with a line that contradicts the page; recorded plans and decisions."""
    d = F.col("doc_id")
    docs = t.keyed_invoices.where(
        "number is not null and issue_date is not null and currency = 'EUR' and seller.name <> '' and seller.electronic_address.value is not null "
        "and seller.electronic_address.scheme <> '' and buyer.electronic_address.value is not null and seller.address.city is not null and seller.address.postcode is not null "
        "and buyer.address.city is not null and seller.contact.name is not null and seller.contact.phone is not null and seller.contact.email is not null"
    ).join(t.doc_lines.select("doc_id").distinct(), "doc_id", "left_semi")
    # All tables lie by document, where the rounds join them without a shuffle.
    stored = lambda df, name: materialise_by(df, name, "doc_id", placed=True)
    docs = stored(docs, "repair-docs")
    ids = docs.select("doc_id")
    only = lambda df: df.join(ids, "doc_id", "left_semi")
    leaves = model_check.leaf_paths(docs, only(t.doc_lines), only(t.doc_exemptions))
    none = F.lit(None).cast("string")
    facts = leaves.select("doc_id", "path", "value", F.lit("derived").alias("kind"), none.alias("quote"), F.lit(None).cast("int").alias("page"))
    off = F.when((d % 5 == 0) & (F.col("line_index") == 0), F.lit("0.01")).otherwise("0.00").cast("decimal(18,2)")
    amounts_printed = only(t.doc_nets).select("doc_id", "line_index", (F.col("net_amount") + off).alias("amount"))
    plans = ids.where(d % 7 == 0).select(
        "doc_id", F.lit(1).alias("round"), F.lit(0).alias("seq"), F.lit("add").alias("op"), F.lit("/buyerReference").alias("path"), F.lit("04011000-9").alias("value"),
        F.when(d % 14 == 0, "Leitweg 04011000-9").otherwise("nicht gedruckt 04011000-9").alias("quote"), F.lit(1).alias("page"))
    pages = ids.select("doc_id", F.lit(1).alias("page"), F.lit("Rechnung\nLeitweg 04011000-9").alias("text"))
    every_round = ids.withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    broken = d % 11 == 0
    decisions = every_round.select("doc_id", "round", (~broken).alias("valid"), F.lit("h").alias("report_hash"))
    found = every_round.where(broken).select(
        "doc_id", "round", F.lit(0).alias("seq"), F.lit("BR-E-10").alias("rule_id"), F.lit("error").alias("severity"), F.lit("no reason").alias("message"), F.lit("/x").alias("location"))
    return {
        "docs": ids, "facts": stored(facts, "repair-facts"), "line_ids": only(t.doc_lines).select("doc_id", "line_index"),
        "rejected": ids.limit(0).select("doc_id", none.alias("path"), none.alias("value"), none.alias("reason")), "printed_lines": stored(amounts_printed, "repair-lines"),
        "plans": plans, "pages": pages, "formats": ids.select("doc_id", F.lit("de").alias("number_format")), "validate": repair.stored_decisions(decisions, found)}


_STATE = """
SELECT doc_id, CASE WHEN mr AND doc_id % 14 <> 0 THEN 'NEEDS_INPUT' WHEN mm THEN 'NEEDS_INPUT' WHEN doc_id % 11 = 0 THEN 'FAILED' ELSE 'OUTPUT' END AS state,
  CAST(CASE WHEN mr AND doc_id % 14 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_questions, CASE WHEN mr OR mm OR doc_id % 11 = 0 THEN 1 ELSE 0 END AS iterations FROM open"""


@query("repair_outcomes", with_parts(_STATE, "open"))
def repair_outcomes(t: Tables) -> DataFrame:
    return repair.repair_replay(lists=LISTS, **repair_input(t))["outcome"].select("doc_id", "state", "n_questions", "iterations")


@query("resumed_outcomes", with_parts("""
SELECT doc_id, CASE WHEN mm THEN 'NEEDS_INPUT' WHEN doc_id % 11 = 0 THEN 'FAILED' ELSE 'OUTPUT' END AS state, CAST(0 AS BIGINT) AS n_questions, CASE WHEN mm OR doc_id % 11 = 0 THEN 1 ELSE 0 END AS iterations FROM open""", "open"))
def resumed_outcomes(t: Tables) -> DataFrame:
    """The same documents after the user answered the open question."""
    given = repair_input(t)
    inputs = given["docs"].where("doc_id % 7 = 0").select(
        "doc_id", F.lit("buyerReference").alias("path"), F.lit("04011000-9").alias("value"), F.lit("2026-01-01T00:00:00.000Z").alias("entered_at"))
    docs, facts = given.pop("docs"), given.pop("facts")
    return repair.resume_runs(docs, facts, inputs, lists=LISTS, **given)["outcome"].select("doc_id", "state", "n_questions", "iterations")


# --- several rounds -------------------------------------------------------------------------------------

#: What is printed for each field that a reader has lost: pointer, value, line of the page.
_LOST = (("/buyerReference", "04011000-9", "Leitweg 04011000-9"), ("/seller/contact/phone", "+49 30 5550", "Telefon +49 30 5550"),
         ("/seller/contact/email", "neu@beleg.example", "E-Mail neu@beleg.example"))
_OTHER = ("/orderReference", "PO-NEU", "Bestellung PO-NEU")
#: Per kind of document its plans: (round, which lost field, or None for a correction that heals nothing, whether the quote is printed).
_PLANS: dict[int, tuple[tuple[int, int | None, bool], ...]] = {
    1: ((1, 0, True), (1, 1, True), (1, 2, True)), 2: ((1, 0, True), (2, 1, True), (2, 2, True)), 3: ((1, 0, True), (2, 1, True), (3, 2, True)),
    4: ((1, 0, True), (2, None, True), (3, 1, True)), 5: ((1, 0, True), (2, 1, False), (3, 1, True)), 6: ((1, 0, True), (2, 1, True), (3, 2, False))}


def repaired_in_rounds(t: Tables) -> dict[str, DataFrame]:
    """Models of which a reader has lost three fields, and plans that bring them back at once, one by one, or not at all."""
    if hasattr(t, "_rounds"):
        return t._rounds
    given = repair_input(t)
    kind = (F.floor(F.col("doc_id") / 7) % 7).cast("int")
    lost = [pointer[1:].replace("/", ".") for pointer, _, _ in _LOST]
    given["facts"] = given["facts"].where((kind == 0) | ~F.col("path").isin(*lost))
    given["printed_lines"] = t.doc_nets.join(given["docs"], "doc_id", "left_semi").select("doc_id", "line_index", F.col("net_amount").alias("amount"))
    given["pages"] = given["docs"].select("doc_id", F.lit(1).alias("page"), F.lit("\n".join(["Rechnung", *(x[2] for x in _LOST), _OTHER[2]])).alias("text"))

    def patch(seq: int, turn: int, which: int | None, printed: bool):
        pointer, value, quote = _OTHER if which is None else _LOST[which]
        return F.struct(F.lit(turn).alias("round"), F.lit(seq).alias("seq"), F.lit("replace" if which is None else "add").alias("op"),
                        F.lit(pointer).alias("path"), F.lit(value).alias("value"), F.lit(quote if printed else f"nicht gedruckt: {value}").alias("quote"))

    plans = F.coalesce(*[F.when(kind == k, F.array(*[patch(i, *p) for i, p in enumerate(plan)])) for k, plan in _PLANS.items()])
    given["plans"] = given["docs"].select("doc_id", F.explode(plans).alias("p")).select("doc_id", "p.*", F.lit(1).alias("page"))
    t._rounds = repair.repair_replay(lists=LISTS, **given)
    return t._rounds


part("rounds", """
SELECT doc_id, (doc_id // 7) % 7 AS kind, doc_id % 7 = 0 AS mr, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS broken FROM open""", "open")


@query("repair_rounds", with_parts("""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS round, CAST(n[i] AS BIGINT) AS n_issues,
  CASE WHEN i - 1 < CASE WHEN kind IN (4, 5) THEN 2 WHEN kind = 6 THEN 3 WHEN kind IN (1, 2, 3) THEN kind ELSE 0 END THEN kind_fixed[i] END AS accepted,
  CASE WHEN kind = 5 AND i = 2 THEN 'evidence: quote-not-on-page' WHEN kind = 6 AND i = 3 THEN 'evidence: quote-not-on-page' END AS refused,
  CASE WHEN kind IN (4, 5, 6) OR (kind = 0 AND mr) THEN 'NEEDS_INPUT' WHEN broken = 1 THEN 'FAILED' ELSE 'OUTPUT' END AS state,
  CAST(CASE WHEN kind IN (4, 5) THEN 2 WHEN kind = 6 OR (kind = 0 AND mr) THEN 1 ELSE 0 END AS BIGINT) AS n_questions,
  CAST(CASE kind WHEN 0 THEN CASE WHEN mr THEN 1 ELSE broken END WHEN 1 THEN 1 + broken WHEN 2 THEN 2 + broken WHEN 3 THEN 3 WHEN 6 THEN 3 ELSE 2 END AS INTEGER) AS iterations
FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM (
  SELECT *, CASE kind WHEN 0 THEN [CASE WHEN mr THEN 1 ELSE broken END] WHEN 1 THEN [3, broken] WHEN 2 THEN [3, 2, broken] WHEN 3 THEN [3, 2, 1, broken]
    WHEN 4 THEN [3, 2, 2] WHEN 5 THEN [3, 2] ELSE [3, 2, 1] END AS n,
    CASE kind WHEN 1 THEN ['/buyerReference,/seller/contact/email,/seller/contact/phone'] WHEN 2 THEN ['/buyerReference', '/seller/contact/email,/seller/contact/phone']
      WHEN 3 THEN ['/buyerReference', '/seller/contact/phone', '/seller/contact/email'] WHEN 4 THEN ['/buyerReference', '/orderReference']
      WHEN 5 THEN ['/buyerReference', NULL] WHEN 6 THEN ['/buyerReference', '/seller/contact/phone', NULL] ELSE [NULL] END AS kind_fixed FROM rounds))""", "rounds"))
def repair_rounds(t: Tables) -> DataFrame:
    """Documents stop in round 1, 2 and 3, because all is well, because nothing falls, or because nothing was accepted:
    how many issues each has at the start of each of its rounds, what the guard said, and how it ends."""
    result = repaired_in_rounds(t)
    said = result["patches"].groupBy("doc_id", (F.col("round") - 1).alias("round")).agg(
        F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.col("pointer")))), ","), F.lit("")).alias("accepted"),
        F.max("reason").alias("refused"))
    outcome = result["outcome"].select("doc_id", "state", "n_questions", "iterations")
    return result["standing"].join(said, ["doc_id", "round"], "left").join(outcome, "doc_id").select(
        "doc_id", "round", "n_issues", "accepted", "refused", "state", "n_questions", "iterations")
