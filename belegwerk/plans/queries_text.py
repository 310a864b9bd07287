"""Named queries: text, evidence, normalisation and plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codelists import CodeLists
from ..functions import normalize as N
from ..functions import shapes
from ..functions.printing import MONTH_NAMES, print_date
from ..functions.text import canonical
from ..operators import claims, evidence, normalization
from ..session import materialise
from ..sources import extractions
from .bindings import Tables
from .oracle_parts import part, with_parts
from .registry import query


@query("canonical_text", with_parts("SELECT doc_id, page, sha256(text_c) AS text_hash, length(text_c) AS n FROM page_c", "page_c"))
def canonical_text(t: Tables) -> DataFrame:
    pages = evidence.canonical_pages(t.pages)
    return pages.select("doc_id", "page", F.sha2("text_c", 256).alias("text_hash"), F.length("text_c").cast("long").alias("n"))


_LOOSE = "(contains({h}, {n}) OR contains(replace({h}, ' ', ''), replace({n}, ' ', '')))"
part("evidenced", f"""
SELECT q.*, CASE WHEN quote_c = '' THEN 'empty-quote' WHEN text_c IS NULL THEN 'page-out-of-range'
  WHEN NOT {_LOOSE.format(h='text_c', n='quote_c')} THEN 'quote-not-on-page'
  WHEN value_c <> '' AND NOT {_LOOSE.format(h='quote_c', n='value_c')} THEN 'value-not-in-quote' END AS reason
FROM quote_c q LEFT JOIN page_c p USING (doc_id, page) WHERE trim(value, ' ' || chr(10)) <> ''""", "quote_c", "page_c")


@query("evidence_accepted", with_parts("SELECT doc_id, path, value, quote, page FROM evidenced WHERE reason IS NULL", "evidenced"))
def evidence_accepted(t: Tables) -> DataFrame:
    return evidence.check_evidence(t.quotes, t.pages, many_quotes=True)[0].select("doc_id", "path", "value", "quote", "page")


@query("evidence_rejected", with_parts("SELECT doc_id, path, value, reason FROM evidenced WHERE reason IS NOT NULL", "evidenced"))
def evidence_rejected(t: Tables) -> DataFrame:
    return evidence.check_evidence(t.quotes, t.pages, many_quotes=True)[1]


@query("quote_occurrences", with_parts("""
SELECT d.doc_id, quote, coalesce(n, 0) AS n
FROM (SELECT *, lower(trim(replace(quote, chr(10), ' '))) AS q FROM (
  SELECT doc_id, substring(text, 11 + 300 * unnest(range(1 + greatest(length(text) - 11, 0) // 300)), 3) AS quote FROM documents)) d
LEFT JOIN (SELECT doc_id, substr(text_c, i, size) AS q, count(*) AS n FROM (
    SELECT doc_id, text_c, size, unnest(range(1, length(text_c) - size + 2)) AS i FROM text_c, (VALUES (1), (2), (3)) s(size)) GROUP BY ALL) g
  ON g.doc_id = d.doc_id AND g.q = d.q""", "text_c"))
def quote_occurrences(t: Tables) -> DataFrame:
    """Three characters from every three hundred of the text: how often does the document hold them?"""
    last = F.floor(F.greatest(F.length("text") - 11, F.lit(0)) / 300).cast("int")
    # The pieces are cut before they become rows, so that no row carries its document's text.
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", F.lit(11) + F.lit(300) * i, F.lit(3)))
    quotes = t.table("documents").select("doc_id", F.explode(pieces).alias("quote"))
    return evidence.find_occurrences(quotes, evidence.document_text(t.pages))


@query("number_format", with_parts(r"""
SELECT doc_id, CASE WHEN sum(len(regexp_extract_all(text, '[0-9],[0-9]{2}(?:[^0-9]|$)'))) >= sum(len(regexp_extract_all(text, '[0-9]\.[0-9]{2}(?:[^0-9]|$)')))
  THEN 'de' ELSE 'plain' END AS number_format FROM page GROUP BY doc_id""", "page"))
def number_format(t: Tables) -> DataFrame:
    return evidence.detect_number_format(t.pages)


@query("currency_on_page", with_parts(r"""
SELECT doc_id, bool_or(contains(text, '€') OR regexp_matches(text, '(^|[^A-Za-z0-9_])EUR([^A-Za-z0-9_]|$)')) AS eur_seen FROM page GROUP BY doc_id""", "page"))
def currency_on_page(t: Tables) -> DataFrame:
    return evidence.currency_on_page(t.pages)


@query("city_follows_postcode", with_parts("""
SELECT doc_id, city, postcode, contains(text_c, lower(postcode || ' ' || city)) AS follows
FROM (SELECT doc_id, text_c, words[i + 1] AS postcode, coalesce(words[CASE WHEN (doc_id + i) % 2 = 0 THEN i + 2 ELSE i + 3 END], '') AS city
  FROM (SELECT doc_id, text_c, words, unnest(range(1, len(words), 20)) AS i FROM (SELECT doc_id, text_c, string_split(text_c, ' ') AS words FROM text_c)))
WHERE city <> '' AND postcode <> ''""", "text_c"))
def city_follows_postcode(t: Tables) -> DataFrame:
    """Every twentieth word of a text as a postcode, with the word behind it or the one after that as the city."""
    # Stored, because it is read three times and the filters would be pushed below the canonical form and repeat it.
    texts = materialise(evidence.document_text(t.pages), "texts")
    words = texts.select("doc_id", F.split("text_c", " ").alias("w")).where(F.size("w") > 1)
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    # Taken out before they become rows, so that no row carries its document's words.
    place = lambda i: F.struct(word(i + F.when((F.col("doc_id") + i) % 2 == 0, 1).otherwise(2)).alias("city"), word(i).alias("postcode"))
    places = F.transform(F.sequence(F.lit(1), F.size("w") - 1, F.lit(20)), place)
    cities = words.select("doc_id", F.explode(places).alias("p")).select("doc_id", "p.city", "p.postcode")
    return evidence.cities_after_postcodes(cities.where("city <> '' and postcode <> ''"), texts)


# --- shared address lines -----------------------------------------------------------------------

# One small page per order: both blocks in a row, with the buyer's lines repeated for some.
part("addr", """
SELECT o_orderkey AS doc_id, s_name AS sn, 'Hafenweg ' || (s_suppkey % 50) AS ss, c_name AS bn, 'Am Markt ' || (o_custkey % 90) AS bs,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Birkenau' ELSE 'Birkenfeld' END AS city,
  CASE WHEN o_orderkey % 4 = 0 THEN '12345' ELSE '54321' END AS postcode
FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = o_custkey // 15""")
part("addr_line", """
SELECT doc_id, no, lower(txt) AS txt FROM (SELECT doc_id, unnest(range(8)) AS no, unnest([sn, ss, CASE WHEN doc_id % 5 = 0 THEN '12345 Birkenau' ELSE 'Rechnung' END,
  'Datum 04.04.2016', bn, bs, '12345 Birkenau', '54321 Birkenfeld']) AS txt FROM addr)""", "addr")
part("addr_claim", """
SELECT doc_id, 'street' AS key, CASE WHEN doc_id % 6 = 0 THEN bs ELSE ss END AS sv, bs AS bv, CASE WHEN doc_id % 6 = 0 THEN bs ELSE ss END AS sq, bs AS bq FROM addr
UNION ALL SELECT doc_id, 'city', city, CASE WHEN doc_id % 7 <> 0 THEN 'Birkenau' END, postcode || ' ' || city, CASE WHEN doc_id % 7 <> 0 THEN '12345 Birkenau' END FROM addr
UNION ALL SELECT doc_id, 'postcode', postcode, '12345', postcode || ' ' || city, '12345 Birkenau' FROM addr""", "addr")
part("addr_judged", """
SELECT c.*, lower(sv) AS svc, lower(bv) AS bvc, lower(sq) AS sqc, lower(bq) AS bqc, string_agg(l.txt, ' ' ORDER BY l.no) AS text_c
FROM addr_claim c JOIN addr_line l USING (doc_id) GROUP BY ALL""", "addr_claim", "addr_line")
part("addr_head", """
SELECT *, CASE WHEN bv IS NULL THEN CASE WHEN len(string_split(text_c, svc)) = 2 THEN svc END
  WHEN sqc = bqc AND len(string_split(text_c, sqc)) = 2 THEN sqc WHEN svc = bvc AND len(string_split(text_c, svc)) = 2 THEN svc END AS head
FROM addr_judged""", "addr_judged")
part("addr_dist", """
SELECT h.doc_id, h.key, h.bv,
  min(CASE WHEN contains(a.txt, lower(sn)) OR (h.key <> 'street' AND contains(a.txt, lower(svs.sv))) THEN abs(a.no - h.at) END) AS ds,
  min(CASE WHEN contains(a.txt, lower(bn)) OR (h.key <> 'street' AND contains(a.txt, lower(bs))) THEN abs(a.no - h.at) END) AS db
FROM (SELECT g.doc_id, g.key, g.bv, min(l.no) AS at FROM addr_head g JOIN addr_line l ON l.doc_id = g.doc_id AND contains(l.txt, g.head) WHERE g.head IS NOT NULL GROUP BY ALL) h
JOIN addr USING (doc_id) JOIN addr_claim svs ON svs.doc_id = h.doc_id AND svs.key = 'street' JOIN addr_line a ON a.doc_id = h.doc_id GROUP BY ALL""", "addr_head", "addr")


def address_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(facts, pages) of the address example."""
    o = F.col("o_orderkey")
    addr = (
        t.table("orders").withColumn("s_suppkey", F.expr("o_custkey div 15"))
        .join(t.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("bn")), "o_custkey")
        .join(t.table("supplier").select("s_suppkey", F.col("s_name").alias("sn")), "s_suppkey")
        .select(
            o.alias("doc_id"), "sn", "bn", F.concat(F.lit("Hafenweg "), (F.col("s_suppkey") % 50).cast("string")).alias("ss"),
            F.concat(F.lit("Am Markt "), (F.col("o_custkey") % 90).cast("string")).alias("bs"),
            F.when(o % 4 == 0, "Birkenau").otherwise("Birkenfeld").alias("city"), F.when(o % 4 == 0, "12345").otherwise("54321").alias("postcode"))
    )
    d = F.col("doc_id")
    pages = addr.select("doc_id", F.lit(1).alias("page"), F.concat_ws(
        "\n", "sn", "ss", F.when(d % 5 == 0, "12345 Birkenau").otherwise("Rechnung"), F.lit("Datum 04.04.2016"), "bn", "bs",
        F.lit("12345 Birkenau"), F.lit("54321 Birkenfeld")).alias("text"))
    street = F.when(d % 6 == 0, F.col("bs")).otherwise(F.col("ss"))
    place = F.concat("postcode", F.lit(" "), "city")
    fact = lambda path, value, quote: F.struct(F.lit(path).alias("path"), value.alias("value"), quote.alias("quote"))
    b_place = F.lit("12345 Birkenau")
    rows = F.array(
        fact("seller.name", F.col("sn"), F.col("sn")), fact("buyer.name", F.col("bn"), F.col("bn")),
        fact("seller.address.line1", street, street), fact("buyer.address.line1", F.col("bs"), F.col("bs")),
        fact("seller.address.city", F.col("city"), place), fact("seller.address.postcode", F.col("postcode"), place),
        F.when(d % 7 != 0, fact("buyer.address.city", F.lit("Birkenau"), b_place)), fact("buyer.address.postcode", F.lit("12345"), b_place))
    facts = addr.select("doc_id", F.explode(F.array_compact(rows)).alias("f")).select("doc_id", "f.*", F.lit(1).alias("page"))
    return facts, pages


@query("shared_address_losers", with_parts("""
SELECT doc_id, 'seller' AS party, key FROM addr_dist WHERE (bv IS NOT NULL AND coalesce(ds, 1e9) >= coalesce(db, 1e9)) OR (bv IS NULL AND coalesce(db, 1e9) < coalesce(ds, 1e9))
UNION ALL SELECT doc_id, 'buyer', key FROM addr_dist WHERE bv IS NOT NULL AND coalesce(db, 1e9) >= coalesce(ds, 1e9)""", "addr_dist"))
def shared_address_losers(t: Tables) -> DataFrame:
    facts, pages = address_pages(t)
    return evidence.resolve_shared_address(facts, pages)


# --- claims --------------------------------------------------------------------------------------


@query("evidence_claims_rejected", """
WITH f AS (
  SELECT o_orderkey AS doc_id, p.path, p.kind, p.ord, CASE WHEN p.ord = 0 THEN c_name WHEN p.ord = 1 AND o_orderkey % 3 = 0 THEN c_name
    WHEN p.ord = 5 AND o_orderkey % 2 = 0 THEN upper(c_name) WHEN p.ord = 23 AND o_orderkey % 5 = 0 THEN c_name ELSE c_name || p.ord END AS value
  FROM orders JOIN customer ON c_custkey = o_custkey,
  (VALUES ('seller.name', 'party-name', 0), ('buyer.name', 'party-name', 1), ('buyerReference', 'buyerReference', 5), ('payment.accountName', 'account-name', 23)) p(path, kind, ord)),
o AS (SELECT *, first_value(path) OVER w AS owner, first_value(kind) OVER w AS owner_kind FROM f WINDOW w AS (PARTITION BY doc_id, lower(value) ORDER BY ord))
SELECT doc_id, path, value, 'same evidence already used for ' || CASE owner WHEN 'seller.name' THEN 'BT-27' WHEN 'buyer.name' THEN 'BT-44' WHEN 'buyerReference' THEN 'BT-10' ELSE 'BT-85' END AS reason
FROM o WHERE owner_kind <> kind""")
def evidence_claims_rejected(t: Tables) -> DataFrame:
    o, name = F.col("o_orderkey"), F.col("c_name")
    value = lambda i, cond: F.when(cond, F.upper(name) if i == 5 else name).otherwise(F.concat(name, F.lit(str(i))))
    fact = lambda path, v: F.struct(F.lit(path).alias("path"), v.alias("value"), v.alias("quote"))
    rows = F.array(
        fact("seller.name", name), fact("buyer.name", value(1, o % 3 == 0)), fact("buyerReference", value(5, o % 2 == 0)),
        fact("payment.accountName", value(23, o % 5 == 0)))
    facts = t.table("orders").join(t.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        o.alias("doc_id"), F.explode(rows).alias("f")).select("doc_id", "f.*")
    return claims.claim_evidence(facts)[1]


@query("name_repeats", """
SELECT o_orderkey AS doc_id, 'buyerReference' AS path, ref AS value, 'a party name is not a buyer reference' AS reason
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) WHEN o_orderkey % 3 = 1 THEN s_name || ' ' ELSE 'ref' END AS ref FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = o_custkey // 15)
WHERE ref <> 'ref'
UNION ALL SELECT o_orderkey, 'seller.id', s_name, 'repeats the seller name' FROM orders JOIN supplier ON s_suppkey = o_custkey // 15 WHERE o_orderkey % 4 = 0""")
def name_repeats(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    joined = t.table("orders").withColumn("s_suppkey", F.expr("o_custkey div 15")).join(
        t.table("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t.table("supplier"), "s_suppkey")
    ref = F.when(o % 3 == 0, F.upper("c_name")).when(o % 3 == 1, F.concat("s_name", F.lit(" "))).otherwise("ref")
    pair = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    facts = joined.select(o.alias("doc_id"), F.explode(F.array(
        pair("seller.name", F.col("s_name")), pair("buyerReference", ref), pair("seller.id", F.when(o % 4 == 0, F.col("s_name")).otherwise("L-1")))).alias("f")).select("doc_id", "f.*")
    return claims.name_repeats(facts, joined.select(o.alias("doc_id"), F.col("c_name").alias("buyer_name")))


# --- normalisation -------------------------------------------------------------------------------

LISTS = CodeLists()


def _cases(t: Tables, values: list[str | None], out) -> DataFrame:
    """Every order carries one of the printed values."""
    pool = F.array(*[F.lit(v) for v in values])
    base = t.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.get(pool, (F.col("o_orderkey") % len(values)).cast("int")).alias("raw"))
    return base.withColumn("n", out(F.col("raw"))).select("doc_id", "raw", F.col("n.value").alias("value"), F.col("n.reason").alias("reason"))


def _cases_sql(rows: list[tuple[str | None, str | None, str | None]]) -> str:
    lit = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"
    body = ", ".join(f"({i}, {lit(a)}, {lit(b)}, {lit(c)})" for i, (a, b, c) in enumerate(rows))
    return f"SELECT o_orderkey AS doc_id, raw, value, reason FROM orders JOIN (VALUES {body}) v(i, raw, value, reason) ON o_orderkey % {len(rows)} = i"


UNIT_CASES = [
    ("H87", "H87", None), ("XPP", "XPP", None), ("hur", "HUR", None), ("Stk. (XPP)", "XPP", None), ("Stück", "H87", None), ("Stk.", "H87", None),
    ("Stunde", "HUR", None), ("Pauschale", "LS", None), ("Fass voll", None, 'unknown unit "Fass voll"'), ("Stk", "STK", None), (" lump  sum. ", "LS", None),
    ("(QQQ)", None, 'unknown unit "(QQQ)"')]
COUNTRY_CASES = [("Deutschland", "DE", None), ("de", "DE", None), (" AT ", "AT", None), ("Österreich", "AT", None), ("Atlantis", None, 'unknown country "Atlantis"'), ("XI", "XI", None), ("XX", None, 'unknown country "XX"')]
VAT_CASES = [
    ("S", "S", None), ("ae", "AE", None), ("B", "B", None), ("Steuerschuldnerschaft des Leistungsempfängers", "AE", None), ("NICHT STEUERBAR", "O", None),
    ("außerhalb des Anwendungsbereichs", "O", None), ("steuerfrei nach § 4 UStG", "E", None), ("Ausfuhr, steuerfrei", "G", None), ("innergemeinschaftliche Lieferung", "K", None),
    ("Nullsatz", "Z", None), ("19 %", None, 'unknown VAT category "19 %"')]
EADDRESS_CASES = [
    ("seller@email.de (Schema: EM)", "seller@email.de", None), ("04011000-12345-03 (Schema: 0204)", "04011000-12345-03", None), ("(Schema: EM)", None, "empty electronic address"),
    ("Mail: <a.b@c.example>, Tel.", "a.b@c.example", None), ("  bare  ", "bare", None)]
CURRENCY_CASES = [("eur", "EUR", None), ("€", "EUR", None), (" Euro ", "EUR", None), ("USD", "USD", None), ("usd", None, 'unknown currency "usd"')]
DATE_CASES = [
    ("04.04.2016", "2016-04-04", None), ("4.4.2016", "2016-04-04", None), ("2016-04-04", "2016-04-04", None), ("4. April 2016", "2016-04-04", None), ("1. MÄRZ 2026", "2026-03-01", None),
    ("31.02.2026", None, "invalid date 2026-02-31"), ("29.02.2024", "2024-02-29", None), ("29.02.2100", None, "invalid date 2100-02-29"), ("2016-13-01", None, "invalid date 2016-13-01"), ("gestern", None, 'unrecognized date "gestern"')]
IBAN_CASES = [("de79 0000 0000 1234 5678 90", "DE79000000001234567890", None), ("DE7", None, "not an IBAN"), ("1234567890123456", None, "not an IBAN")]
CODE_CASES = [("(VATEX-EU-O)", "VATEX-EU-O", None), ("vatex-eu-132", "vatex-eu-132", None), ("O", None, "not a VATEX exemption code")]


def _register_cases(name: str, cases: list[tuple[str, str | None, str | None]], rule) -> None:
    query(name, _cases_sql(cases))(lambda t, c=cases, r=rule: _cases(t, [x[0] for x in c], r))


_register_cases("normalize_unit", UNIT_CASES, lambda c: N.unit(c, LISTS))
_register_cases("normalize_country", COUNTRY_CASES, lambda c: N.country(c, LISTS))
_register_cases("normalize_vat_category", VAT_CASES, lambda c: N.vat_category(c, None, LISTS))
_register_cases("normalize_electronic_address", EADDRESS_CASES, N.electronic_address)
_register_cases("normalize_currency", CURRENCY_CASES, N.currency)
_register_cases("normalize_date", DATE_CASES, N.date)
_register_cases("normalize_iban", IBAN_CASES, N.iban)
_register_cases("normalize_exemption_code", CODE_CASES, N.exemption_code)


_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + "]"


@query("normalize_printed_dates", f"""
SELECT doc_id, raw, CASE WHEN k < 3 OR (k = 3 AND month(day) IN (1, 3, 5, 7, 8, 10, 12)) THEN CASE k WHEN 3 THEN strftime(day, '%Y-%m-31') ELSE strftime(day, '%Y-%m-%d') END END AS value,
  CASE WHEN k = 4 THEN 'unrecognized date "' || raw || '"' WHEN k = 3 AND month(day) NOT IN (1, 3, 5, 7, 8, 10, 12) THEN 'invalid date ' || strftime(day, '%Y-%m-31') END AS reason
FROM (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS k, o_orderdate AS day, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN day(o_orderdate) || '. ' || {_MONTH_LIST}[month(o_orderdate)] || ' ' || year(o_orderdate) WHEN 3 THEN '31.' || strftime(o_orderdate, '%m.%Y') ELSE o_orderpriority END AS raw FROM orders)""")
def normalize_printed_dates(t: Tables) -> DataFrame:
    """Order dates as pages print them: in three forms, with the 31st of every month, and texts that are no dates."""
    o, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (F.when(o % 5 == 0, print_date(day, F.lit("de"))).when(o % 5 == 1, print_date(day, F.lit("iso"))).when(o % 5 == 2, print_date(day, F.lit("long")))
           .when(o % 5 == 3, F.concat(F.lit("31."), F.date_format("o_orderdate", "MM.yyyy"))).otherwise(F.col("o_orderpriority")))
    read = t.table("orders").select(o.alias("doc_id"), raw.alias("raw")).withColumn("n", N.date(F.col("raw")))
    return read.select("doc_id", "raw", F.col("n.value").alias("value"), F.col("n.reason").alias("reason"))


_CODES = ", ".join(f"'{c}'" for c in LISTS.countries)
_WORDS = ", ".join(f"('{w}', '{c}')" for w, c in N.COUNTRY_WORDS.items())


@query("normalize_customer_countries", f"""
SELECT doc_id, raw, value, CASE WHEN value IS NULL THEN 'unknown country "' || raw || '"' END AS reason
FROM (SELECT doc_id, raw, coalesce(CASE WHEN length(trim(raw)) = 2 AND upper(trim(raw)) IN ({_CODES}) THEN upper(trim(raw)) END, w.code) AS value
  FROM (SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(substring(n_name, 1, 2)) ELSE ' ' || substring(n_name, 1, 2) || ' ' END AS raw
    FROM customer JOIN nation ON n_nationkey = c_nationkey) LEFT JOIN (VALUES {_WORDS}) w(word, code) ON w.word = lower(trim(raw)))""")
def normalize_customer_countries(t: Tables) -> DataFrame:
    """Nations of customers by name and by their first two letters, some of which are codes of other countries."""
    k, name = F.col("c_custkey"), F.col("n_name")
    raw = F.when(k % 3 == 0, name).when(k % 3 == 1, F.lower(F.substring(name, 1, 2))).otherwise(F.concat(F.lit(" "), F.substring(name, 1, 2), F.lit(" ")))
    nations = t.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    read = t.table("customer").join(nations, "c_nationkey").select(k.alias("doc_id"), raw.alias("raw")).withColumn("n", N.country(F.col("raw"), LISTS))
    return read.select("doc_id", "raw", F.col("n.value").alias("value"), F.col("n.reason").alias("reason"))


@query("normalize_decimal_back", """
SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM lineitem""")
def normalize_decimal_back(t: Tables) -> DataFrame:
    """Prices printed in German or plain form come back as they were."""
    from ..functions.printing import print_amount
    nf = F.when(F.col("l_orderkey") % 2 == 0, "de").otherwise("plain")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    printed = t.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", nf.alias("nf"), print_amount(price, nf).alias("printed"))
    return printed.select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", "l_linenumber", N.decimal(F.col("printed"), F.col("nf"))["value"].alias("value"))


@query("normalize_decimal", r"""
SELECT o_orderkey AS doc_id, p || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' €' END AS raw,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN f = 'de' THEN w || t WHEN f = 'plain' THEN w || '.' || t END WHEN o_orderkey % 3 = 1 THEN w || '.' || t ELSE w || t || '.5' END AS value,
  CASE WHEN o_orderkey % 3 = 0 AND f IS NULL THEN 'ambiguous number "' || p || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' €' END || '"' END AS reason
FROM (SELECT *, CAST(1 + o_custkey % 99 AS VARCHAR) AS w, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS t, [NULL, 'de', 'plain'][o_orderkey // 3 % 3 + 1] AS f,
  CASE o_orderkey % 3 WHEN 0 THEN w || '.' || t WHEN 1 THEN w || ',' || t ELSE w || '.' || t || ',5' END AS p FROM orders)""")
def normalize_decimal(t: Tables) -> DataFrame:
    """Numbers that read differently in each convention."""
    o = F.col("o_orderkey")
    whole, three = (1 + F.col("o_custkey") % 99).cast("string"), F.lpad((o % 1000).cast("string"), 3, "0")
    printed = F.when(o % 3 == 0, F.concat(whole, F.lit("."), three)).when(o % 3 == 1, F.concat(whole, F.lit(","), three)).otherwise(F.concat(whole, F.lit("."), three, F.lit(",5")))
    fmt = F.get(F.array(F.lit(None).cast("string"), F.lit("de"), F.lit("plain")), (F.floor(o / 3) % 3).cast("int"))
    raw = t.table("orders").select(o.alias("doc_id"), F.concat(printed, F.when(o % 2 == 0, "").otherwise(" €")).alias("raw"), fmt.alias("f"))
    return raw.withColumn("n", N.decimal(F.col("raw"), F.col("f"))).select("doc_id", "raw", F.col("n.value").alias("value"), F.col("n.reason").alias("reason"))


@query("normalize_rate", "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 25 AS VARCHAR) || '.0' AS value FROM orders")
def normalize_rate(t: Tables) -> DataFrame:
    raw = F.concat((F.col("o_orderkey") % 25).cast("string"), F.lit(",0 %"))
    return t.table("orders").select(F.col("o_orderkey").alias("doc_id"), N.rate(raw, F.lit("de"))["value"].alias("value"))


@query("clean_up_texts", r"""
SELECT doc_id, trim(regexp_replace(replace(text, '\n', ' '), '\s+', ' ', 'g')) AS line_name, replace(replace(text, chr(10), '\n'), '\n', chr(10)) AS terms FROM documents""")
def clean_up_texts(t: Tables) -> DataFrame:
    docs = t.table("documents")
    marked = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return docs.select("doc_id", F.trim(N.line_name(F.col("text"))).alias("line_name"), N.payment_terms(marked).alias("terms"))


@query("address_scheme", """
SELECT doc_id, value, scheme FROM (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'a@b.example' WHEN 1 THEN '04011000-12345-03' ELSE '4000001' END AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN 'EM' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN '0204' END AS scheme FROM orders)""")
def address_scheme(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    value = F.when(o % 3 == 0, "a@b.example").when(o % 3 == 1, "04011000-12345-03").otherwise("4000001")
    return t.table("orders").select(o.alias("doc_id"), value.alias("value"), N.address_scheme(value, o % 2 == 0).alias("scheme"))


FACT_CASES: list[tuple[str, str, str | None, str | None]] = [
    ("lines.0.quantity", "1.234", "1234", None), ("lines.3.vatRate", "19,0 %", "19.0", None), ("lines.1.unitCode", "Stunde", "HUR", None),
    ("vatExemptions.0.category", "(steuerfrei)", "E", None), ("issueDate", "1. März 2026", "2026-03-01", None), ("currency", "Dollar", None, 'unknown currency "Dollar"'),
    ("payment.iban", "xx", None, "not an IBAN"), ("seller.address.countryCode", "Schweiz", "CH", None), ("buyer.electronicAddress.value", "x@y.example (Schema: EM)", "x@y.example", None),
    ("vatExemptions.1.reasonCode", "(VATEX-EU-O)", "VATEX-EU-O", None), ("number", " R-1 ", "R-1", None), ("documentTotals.grandTotal", "1.190,00 EUR", "1190.00", None)]


@query("normalize_facts_accepted", "SELECT doc_id, path, value, normalized FROM (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, '{p}' AS path, '{v}' AS value, '{n}' AS normalized FROM orders WHERE o_orderkey % {len(FACT_CASES)} = {i}"
    for i, (p, v, n, _) in enumerate(FACT_CASES) if n is not None) + ")")
def normalize_facts_accepted(t: Tables) -> DataFrame:
    return _fact_cases(t)[0].select("doc_id", "path", "value", "normalized")


@query("normalize_facts_rejected", " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, '{p}' AS path, '{v}' AS value, '{r}' AS reason FROM orders WHERE o_orderkey % {len(FACT_CASES)} = {i}"
    for i, (p, v, n, r) in enumerate(FACT_CASES) if n is None))
def normalize_facts_rejected(t: Tables) -> DataFrame:
    return _fact_cases(t)[1]


def _fact_cases(t: Tables) -> tuple[DataFrame, DataFrame]:
    pool = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v, _, _ in FACT_CASES])
    base = t.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.get(pool, (F.col("o_orderkey") % len(FACT_CASES)).cast("int")).alias("f")).select("doc_id", "f.*")
    formats = t.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("de").alias("number_format"))
    return normalization.normalize_facts(base, formats, LISTS)


@query("line_vat", with_parts("""
SELECT doc_id, line_index, CASE WHEN doc_id % 4 = 0 AND rate > 0 THEN 'S' WHEN doc_id % 4 = 0 THEN NULL ELSE vat_category END AS vat_category,
  CASE WHEN doc_id % 4 <> 0 AND vat_category = 'O' THEN NULL ELSE vat_rate END AS model_rate,
  CASE WHEN doc_id % 4 = 0 AND rate > 0 THEN 'derived' WHEN doc_id % 4 = 0 THEN NULL ELSE 'evidence' END AS kind,
  CASE WHEN doc_id % 4 = 0 AND coalesce(rate, -1) = 0 THEN '0 % without a category is ambiguous' END AS reason
FROM line""", "line"))
def line_vat(t: Tables) -> DataFrame:
    lines = t.lines.select("doc_id", "line_index", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("("), "vat_category", F.lit(")"))).alias("category_text"), "vat_rate")
    return normalization.line_vat(lines, LISTS).select("doc_id", "line_index", "vat_category", "model_rate", "kind", "reason")


@query("exemption_rows", with_parts("""
, firsts AS (SELECT doc_id, arg_min(vat_category, line_index) AS c FROM line WHERE vat_category <> 'S' GROUP BY doc_id),
given AS (SELECT doc_id, ex_index, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE category END AS category, reason, reason_code FROM ex),
kept AS (SELECT doc_id, ex_index, coalesce(category, c) AS category, reason, reason_code, CASE WHEN category IS NULL THEN 'derived' ELSE 'evidence' END AS kind
  FROM given LEFT JOIN firsts USING (doc_id) WHERE coalesce(category, c) IS NOT NULL AND (reason IS NOT NULL OR reason_code IS NOT NULL))
SELECT * FROM kept UNION ALL
SELECT doc_id, CAST(coalesce(m, -1) + 1 AS INTEGER), 'O', NULL, 'VATEX-EU-O', 'derived' FROM (SELECT DISTINCT doc_id FROM line WHERE vat_category = 'O')
LEFT JOIN (SELECT doc_id, max(ex_index) AS m FROM kept GROUP BY doc_id) USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM kept WHERE category = 'O')""", "line", "ex").replace(")\n\n, firsts", "),\nfirsts"))
def exemption_rows(t: Tables) -> DataFrame:
    given = t.exemptions.withColumn("category", F.when(F.col("doc_id") % 5 != 0, F.col("category")))
    return normalization.exemption_rows(given, t.unplaced_lines)


@query("user_inputs", """
WITH base AS (SELECT o_orderkey AS doc_id, 'payment.iban' AS path, 'OLD' AS value, 'evidence' AS kind, CAST(NULL AS VARCHAR) AS entered_at FROM orders
  UNION ALL SELECT o_orderkey, 'number', CAST(o_orderkey AS VARCHAR), 'evidence', NULL FROM orders)
SELECT * FROM base WHERE NOT (path = 'payment.iban' AND doc_id % 2 = 0)
UNION ALL SELECT o_orderkey, 'payment.iban', 'DE1200' || o_custkey, 'user', '2026-01-02T00:00:00.000Z' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'payment.meansCode', '58', 'derived', NULL FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'buyerReference', 'ref', 'user', '2026-01-01T00:00:00.000Z' FROM orders WHERE o_orderkey % 3 = 0""")
def user_inputs(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    pair = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    facts = t.table("orders").select(o.alias("doc_id"), F.explode(F.array(pair("payment.iban", F.lit("OLD")), pair("number", o.cast("string")))).alias("f")).select(
        "doc_id", "f.*", F.lit("evidence").alias("kind"), none.alias("entered_at"))
    answer = lambda p, v, at: F.struct(F.lit(p).alias("path"), v.alias("value"), F.lit(at).alias("entered_at"))
    iban = F.concat(F.lit("de12 00"), F.col("o_custkey").cast("string"))
    inputs = t.table("orders").select(o.alias("doc_id"), F.explode(F.array_compact(F.array(
        F.when(o % 2 == 0, answer("payment.iban", F.lit("first"), "2026-01-01T00:00:00.000Z")), F.when(o % 2 == 0, answer("payment.iban", iban, "2026-01-02T00:00:00.000Z")),
        F.when(o % 3 == 0, answer("buyerReference", F.lit("ref"), "2026-01-01T00:00:00.000Z"))))).alias("f")).select("doc_id", "f.*")
    return normalization.apply_user_inputs(facts, inputs)


# --- shapes ----------------------------------------------------------------------------------------

SHAPE_CASES: list[tuple[str, str, str | None]] = [
    ("seller.address.city", "12345", "city without letters"), ("buyer.address.city", "DE", "a country is not a city"), ("seller.address.city", "Moorbach", None),
    ("seller.address.line1", "12345 Moorbach", "street line looks like 'postcode city'"), ("seller.address.line2", "DE", "country printed as an address line"),
    ("seller.address.line2", "Gebäude B", None), ("seller.contact.phone", "Tel.", "phone number with fewer than 5 digits"), ("seller.contact.email", "Jana Wiesner", "not an e-mail address"),
    ("seller.id", "ATU246813579", "a VAT ID is not a seller identifier"), ("seller.id", "4711002233446", None), ("seller.vatId", "DE 123456789", None), ("seller.vatId", "DE", "not a VAT identifier"),
    ("seller.vatId", "Ulmenhof Seminare e. V.", "not a VAT identifier"), ("buyer.address.postcode", "12345678901", "postcode without digits"), ("buyerReference", "a@b.example", "an e-mail address is not a buyer reference"),
    ("buyer.name", "4711", "name without letters"), ("lines.0.name", "4711", None)]
KIND_OF = {"seller.contact.phone": "phone", "seller.contact.email": "email", "seller.id": "id", "seller.vatId": "vatId", "buyerReference": "buyerReference", "buyer.name": "party-name", "lines.0.name": "party-name"}


def _shape_sql() -> str:
    q = lambda s: "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"
    kind = lambda p: KIND_OF.get(p, p.rsplit(".", 1)[-1])
    rows = ", ".join(f"({i}, {q(p)}, {q(v)}, {q(r)}, {q(kind(p))})" for i, (p, v, r) in enumerate(SHAPE_CASES))
    return f"SELECT o_orderkey AS doc_id, path, value, reason, kind FROM orders JOIN (VALUES {rows}) s(i, path, value, reason, kind) ON o_orderkey % {len(SHAPE_CASES)} = i"


@query("shape_problems", _shape_sql())
def shape_problems(t: Tables) -> DataFrame:
    pool = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v, _ in SHAPE_CASES])
    facts = t.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.get(pool, (F.col("o_orderkey") % len(SHAPE_CASES)).cast("int")).alias("f")).select("doc_id", "f.*")
    return facts.withColumn("reason", shapes.shape_problem(F.col("path"), F.col("value"))).withColumn("kind", shapes.field_kind(F.col("path")))


# --- text items, prompts, gate ------------------------------------------------------------------------

part("item", """
SELECT conv_id AS doc_id, turn AS seq, CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END AS str, CASE WHEN role = 'user' THEN 700.0 ELSE 700.5 + conv_id % 2 END AS y, turn % 3 = 1 AS eol FROM conversations""")
part("item_p", "SELECT *, coalesce(sum(CAST(eol AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM item", "item")
part("item_text", r"""
SELECT doc_id, string_agg(sep || str, '' ORDER BY seq) AS text FROM (SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN '' WHEN e > lag(e) OVER w OR abs(y - lag(y) OVER w) > 1 THEN chr(10) ELSE ' ' END AS sep
FROM item_p WHERE trim(str) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) GROUP BY doc_id""", "item_p")


@query("page_text", with_parts("SELECT doc_id, 1 AS page, coalesce(text, '') AS text FROM (SELECT DISTINCT doc_id FROM item) LEFT JOIN item_text USING (doc_id)", "item_text"))
def page_text(t: Tables) -> DataFrame:
    return extractions.assemble_page_text(t.text_items)


@query("prompts", with_parts("""
SELECT doc_id, 'sha256:' || sha256('SYSTEM' || string_agg('--- page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS prompt_hash,
  CAST(length(string_agg('--- page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS BIGINT) AS n FROM page GROUP BY doc_id""", "page"))
def prompts(t: Tables) -> DataFrame:
    return extractions.build_prompt(t.pages, "SYSTEM").select("doc_id", "prompt_hash", F.length("prompt").cast("long").alias("n"))


_GATE = """
SELECT doc_id, CASE WHEN n_chars * 1000 > 5242880 THEN 'file too large' WHEN doc_id % 9 = 0 THEN 'not a PDF' WHEN doc_id % 10 = 1 THEN 'too many pages' WHEN length(trim(text, ' ' || chr(10))) < 20 THEN 'no text layer' END AS reason FROM documents"""


def _gate(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.table("documents")
    files = docs.select("doc_id", (F.col("n_chars") * 1000).alias("size"), F.when(F.col("doc_id") % 9 == 0, "PK\u0003").otherwise("%PDF-").alias("head"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 10 == 1, 6).otherwise(1)))
    return extractions.gate_documents(files, docs.select("doc_id", copies.alias("page"), "text"))


@query("gate_accepted", f"SELECT doc_id, CAST(1 AS BIGINT) AS n_pages FROM ({_GATE}) WHERE reason IS NULL")
def gate_accepted(t: Tables) -> DataFrame:
    return _gate(t)[0]


@query("gate_refused", f"SELECT * FROM ({_GATE}) WHERE reason IS NOT NULL")
def gate_refused(t: Tables) -> DataFrame:
    return _gate(t)[1]
