"""The adapters once more, as common table expressions for the SQL side of the comparison."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql)


def with_parts(body: str, *names: str) -> str:
    """body with the named parts, and whatever they need, in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {head}\n{body}" if head else body


part("inv", """
SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 101 <> 0 THEN 'R-' || o_orderkey END AS number,
  CASE WHEN o_orderkey % 103 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS issue_date,
  '380' AS type_code,
  CASE WHEN o_orderkey % 89 = 0 THEN 'USD' WHEN o_orderkey % 97 = 0 THEN '€' WHEN o_orderkey % 107 = 0 THEN NULL ELSE 'EUR' END AS currency,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS due_date,
  CASE WHEN o_orderkey % 7 <> 0 THEN '04011000-' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') || '-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS buyer_reference,
  CASE WHEN o_orderkey % 2 = 0 THEN 'PO-' || o_orderkey END AS order_reference,
  CASE WHEN o_orderkey % 5 = 0 THEN '#SKONTO#TAGE=14#PROZENT=2.00#' ELSE 'Zahlbar innerhalb von 30 Tagen' END AS payment_terms,
  CASE WHEN o_orderkey % 3 = 0 THEN 'L-' || s_suppkey END AS seller_id,
  CASE WHEN o_orderkey % 109 = 0 THEN '' ELSE s_name END AS seller_name,
  CASE WHEN o_orderkey % 6 = 0 THEN 'HRB ' || s_suppkey || ' Amtsgericht' END AS seller_reg,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'DE' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS seller_vat,
  CASE WHEN o_orderkey % 8 = 0 THEN '12/345/' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS seller_tax,
  CASE WHEN o_orderkey % 113 = 0 THEN '' WHEN o_orderkey % 11 <> 0 THEN 'EM' END AS seller_scheme,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'rechnung@s' || s_suppkey || '.example' END AS seller_ea,
  'Hafenstraße ' || (s_suppkey + 1) AS seller_line1,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Gebäude B' END AS seller_line2,
  CASE WHEN o_orderkey % 13 <> 0 THEN sn.n_name END AS seller_city,
  CASE WHEN o_orderkey % 37 <> 0 THEN CAST(10000 + s_nationkey * 37 AS VARCHAR) END AS seller_postcode,
  CASE WHEN o_orderkey % 71 = 0 THEN 'ZZ' ELSE 'DE' END AS seller_country,
  CASE WHEN o_orderkey % 41 <> 0 THEN 'Kontakt ' || s_suppkey END AS contact_name,
  CASE WHEN o_orderkey % 19 <> 0 THEN '+49 30 ' || (100000 + s_suppkey) END AS contact_phone,
  CASE WHEN o_orderkey % 23 <> 0 THEN 'kontakt@s' || s_suppkey || '.example' END AS contact_email,
  c_name AS buyer_name,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN 'EM' ELSE '0204' END AS buyer_scheme,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN 'c' || o_custkey || '@kunde.example' ELSE '04011000-12345-03' END AS buyer_ea,
  'Am Markt ' || (o_custkey + 1) AS buyer_line1,
  CAST(NULL AS VARCHAR) AS buyer_line2,
  CASE WHEN o_orderkey % 31 <> 0 THEN cn.n_name END AS buyer_city,
  CAST(20000 + c_nationkey * 11 AS VARCHAR) AS buyer_postcode,
  CASE WHEN c_nationkey % 5 = 0 THEN 'AT' ELSE 'DE' END AS buyer_country,
  CASE WHEN o_orderkey % 17 <> 0 THEN '58' END AS means_code,
  CASE WHEN o_orderkey % 17 <> 0 THEN 'DE79' || lpad(CAST(o_custkey AS VARCHAR), 18, '0') END AS iban,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 2 = 1 THEN s_name END AS account_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = o_custkey // 15
JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey""")

part("line0", """
SELECT *, CASE WHEN pct > 0 THEN 'S' WHEN l_returnflag = 'R' THEN 'O' WHEN l_returnflag = 'A' THEN 'E' ELSE 'Z' END AS vat_category
FROM (SELECT l_orderkey AS doc_id, *, CAST(round(l_tax * 100) AS INTEGER) AS pct, CAST(l_quantity AS BIGINT) AS q,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS line_index
  FROM lineitem)""")

part("line", """
SELECT doc_id, line_index, CAST(line_index + 1 AS VARCHAR) AS id, 'Artikel ' || l_partkey AS name, CAST(q AS VARCHAR) AS quantity,
  ['H87', 'HUR', 'KGM', 'C62', 'XPP', 'Stück', 'MTR'][(l_linenumber - 1) % 7 + 1] AS unit_code,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS net_price,
  CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR) END AS price_base_quantity, vat_category,
  CASE WHEN vat_category <> 'O' THEN CAST(pct AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '.00' ELSE '' END END AS vat_rate,
  CASE WHEN vat_category = 'O' THEN NULL ELSE pct END AS rate,
  (2 * q * price_cents + l_linenumber) // (2 * l_linenumber) AS net_cents
FROM line0""", "line0")

part("grp", """
SELECT doc_id, vat_category, rate, CAST(sum(net_cents) AS BIGINT) AS taxable_cents, min(line_index) AS first_line,
  CAST((2 * sum(net_cents) * coalesce(rate, 0) + 100) // 200 AS BIGINT) AS tax_cents
FROM line GROUP BY doc_id, vat_category, rate""", "line")

part("tot", """
SELECT doc_id, CAST(sum(taxable_cents) AS BIGINT) AS line_cents, CAST(sum(tax_cents) AS BIGINT) AS tax_cents,
  CAST(sum(taxable_cents) + sum(tax_cents) AS BIGINT) AS grand_cents FROM grp GROUP BY doc_id""", "grp")

part("ex", """
SELECT doc_id, CASE WHEN vat_category = 'E' THEN 0 ELSE 1 END AS ex_index, vat_category AS category,
  CASE WHEN vat_category = 'E' THEN 'als gemeinnützig anerkannt' END AS reason,
  CASE WHEN vat_category = 'O' THEN 'VATEX-EU-O' WHEN doc_id % 4 = 0 THEN 'VATEX-EU-132' END AS reason_code
FROM (SELECT DISTINCT doc_id, vat_category FROM line0)
WHERE (vat_category = 'E' AND doc_id % 2 = 0) OR (vat_category = 'O' AND doc_id % 3 = 0)""", "line0")

part("printed", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN line_cents END AS p_line,
  CASE WHEN doc_id % 2 = 0 THEN tax_cents + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END END AS p_tax,
  CASE WHEN doc_id % 2 = 0 THEN grand_cents ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS p_grand
FROM tot JOIN orders ON o_orderkey = doc_id""", "tot")

part("page", """
SELECT doc_id, 1 AS page, text FROM documents UNION ALL
SELECT doc_id, 2, 'Summe: ' || CASE WHEN doc_id % 3 = 0 THEN CAST(CAST(n_chars AS DECIMAL(12,2)) AS VARCHAR) || ' USD'
  ELSE CAST(n_chars // 1000 AS VARCHAR) || '.' || lpad(CAST(n_chars % 1000 AS VARCHAR), 3, '0') || ',50 €' END || chr(10) || 'Datum 04.04.2016'
FROM documents""")

part("page_c", r"""SELECT doc_id, page, lower(trim(regexp_replace(replace(text, '\n', ' '), '\s+', ' ', 'g'))) AS text_c FROM page""", "page")
part("text_c", """SELECT doc_id, trim(string_agg(text_c, ' ' ORDER BY page)) AS text_c FROM page_c WHERE text_c <> '' GROUP BY doc_id""", "page_c")

part("quote", """
SELECT doc_id, path, quote, page, CASE WHEN k % 13 = 0 THEN 'fehlt' WHEN k % 17 = 0 THEN ' ' ELSE substring(quote, 5, 12) END AS value FROM (
SELECT doc_id, k, 'paymentTerms' AS path,
  CASE WHEN k % 5 = 1 THEN translate(piece, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN k % 5 = 2 THEN reverse(piece) WHEN k % 5 = 3 THEN replace(piece, ' ', '  ')
    WHEN k % 50 = 4 THEN '  ' ELSE piece END AS quote,
  CASE WHEN k % 7 = 0 THEN 3 WHEN k % 11 = 0 THEN 2 ELSE 1 END AS page
FROM (SELECT doc_id, doc_id + i AS k, substring(text, 10 + 1000 * i, 40) AS piece
  FROM (SELECT doc_id, text, unnest(range(1 + greatest(length(text) - 10, 0) // 1000)) AS i FROM documents)))""")

part("quote_c", r"""
SELECT *, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS quote_c, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS value_c FROM quote""", "quote")

part("audit", """
SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS ts,
  CASE event_type WHEN 'view' THEN 'INGEST' WHEN 'signup' THEN 'DERIVE' WHEN 'error' THEN 'REJECTED' WHEN 'click' THEN 'EVIDENCE_CHECK' ELSE 'OUTPUT' END AS type,
  replace(props, '": ', '":') AS data, event_id
FROM events""")

part("chain", """
SELECT run_id, seq, ts, type, data, event_id, 'sha256:' || repeat('0', 64) AS prev_hash,
  'sha256:' || sha256('{"actor":{"kind":"core","version":"0.1.0"},"data":' || data || ',"prevHash":"' || 'sha256:' || repeat('0', 64) || '","seq":' || seq || ',"ts":"' || ts || '","type":"' || type || '"}') AS hash
FROM audit WHERE seq = 0
UNION ALL
SELECT a.run_id, a.seq, a.ts, a.type, a.data, a.event_id, c.hash,
  'sha256:' || sha256('{"actor":{"kind":"core","version":"0.1.0"},"data":' || a.data || ',"prevHash":"' || c.hash || '","seq":' || a.seq || ',"ts":"' || a.ts || '","type":"' || a.type || '"}')
FROM chain c JOIN audit a ON a.run_id = c.run_id AND a.seq = c.seq + 1""", "audit")

part("call", """
SELECT event_id AS call_id, CAST(user_id AS VARCHAR) AS run_id, ts, strftime(ts, '%Y-%m-%d') AS day,
  CASE event_type WHEN 'view' THEN 'nvidia/NVIDIA-Nemotron-3-Nano-30B-A3B' WHEN 'signup' THEN 'nvidia/Nemotron-3_5-Lightning'
    WHEN 'click' THEN 'nvidia/nemotron-3-super-120b-a12b' WHEN 'purchase' THEN 'nvidia/Nemotron-3-Ultra-550b-a55b' ELSE 'unknown/model' END AS model,
  1000 + event_id * 37 % 5000 AS prompt_tokens, 100 + event_id * 11 % 900 AS completion_tokens FROM events""")

# Costs in units of 1e-8 USD: cents per million tokens times tokens.
part("priced", """
SELECT *, CAST(prompt_tokens * i + completion_tokens * o AS BIGINT) AS units FROM call JOIN (VALUES
  ('nvidia/NVIDIA-Nemotron-3-Nano-30B-A3B', 6, 24), ('nvidia/Nemotron-3_5-Lightning', 6, 24),
  ('nvidia/nemotron-3-super-120b-a12b', 30, 90), ('nvidia/Nemotron-3-Ultra-550b-a55b', 100, 300)) p(model, i, o) USING (model)""", "call")


def money(cents: str) -> str:
    """Cents as a two-digit decimal."""
    return f"CAST(CAST({cents} AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


def usd(units: str) -> str:
    return f"CAST(CAST({units} AS DECIMAL(18,0)) * CAST(0.00000001 AS DECIMAL(9,8)) AS DECIMAL(18,8))"


HEADER = (
    ("number", "BT-1", "number"), ("issueDate", "BT-2", "issue_date"), ("currency", "BT-5", "currency"), ("dueDate", "BT-9", "due_date"),
    ("buyerReference", "BT-10", "buyer_reference"), ("orderReference", "BT-13", "order_reference"), ("paymentTerms", "BT-20", "payment_terms"),
    ("seller.name", "BT-27", "seller_name"), ("seller.id", "BT-29", "seller_id"), ("seller.legalRegistrationId", "BT-30", "seller_reg"),
    ("seller.vatId", "BT-31", "seller_vat"), ("seller.taxNumber", "BT-32", "seller_tax"), ("seller.electronicAddress.value", "BT-34", "seller_ea"),
    ("seller.address.line1", "BT-35", "seller_line1"), ("seller.address.line2", "BT-36", "seller_line2"), ("seller.address.city", "BT-37", "seller_city"),
    ("seller.address.postcode", "BT-38", "seller_postcode"), ("seller.address.countryCode", "BT-40", "seller_country"),
    ("seller.contact.name", "BT-41", "contact_name"), ("seller.contact.phone", "BT-42", "contact_phone"), ("seller.contact.email", "BT-43", "contact_email"),
    ("buyer.name", "BT-44", "buyer_name"), ("buyer.electronicAddress.value", "BT-49", "buyer_ea"), ("buyer.address.line1", "BT-50", "buyer_line1"),
    ("buyer.address.line2", "BT-51", "buyer_line2"), ("buyer.address.city", "BT-52", "buyer_city"), ("buyer.address.postcode", "BT-53", "buyer_postcode"),
    ("buyer.address.countryCode", "BT-55", "buyer_country"), ("payment.iban", "BT-84", "iban"), ("payment.accountName", "BT-85", "account_name"),
)
LINE = (
    ("id", "BT-126", "id"), ("name", "BT-153", "name"), ("quantity", "BT-129", "quantity"), ("unitCode", "BT-130", "unit_code"),
    ("netPrice", "BT-146", "net_price"), ("priceBaseQuantity", "BT-149", "price_base_quantity"), ("vatCategory", "BT-151", "vat_category"), ("vatRate", "BT-152", "vat_rate"),
)
_BY_VALUE = lambda c: f"CASE WHEN contains({c}, '.') THEN regexp_replace({c}, '\\.?0*$', '') ELSE {c} END"


def flat_sql(inv: str, line: str, ex: str | None) -> str:
    """Unpivoted facts of the named parts, by business term."""
    header = " UNION ALL ".join(f"SELECT doc_id, '{bt}' AS key, {c} AS value FROM {inv}" for _, bt, c in HEADER)
    lines = " UNION ALL ".join(
        f"SELECT doc_id, '{bt}#' || line_index, {_BY_VALUE(c) if p in ('quantity', 'netPrice', 'priceBaseQuantity', 'vatRate') else c} FROM {line}" for p, bt, c in LINE)
    tail = "" if ex is None else f" UNION ALL SELECT doc_id, 'BT-120[' || category || ']', reason FROM {ex} UNION ALL SELECT doc_id, 'BT-121[' || category || ']', reason_code FROM {ex}"
    return (
        r"SELECT doc_id, key, regexp_replace(key, '[#\[].*$', '') AS term, trim(regexp_replace(value, '\s+', ' ', 'g')) AS value FROM ("
        + f"{header} UNION ALL {lines}{tail}) WHERE value IS NOT NULL AND value <> ''")


part("truth", flat_sql("inv", "line", "ex"), "inv", "line", "ex")
part("got_inv", """
SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN number || 'x' ELSE number END AS number,
  CASE WHEN doc_id % 14 = 0 THEN 'erfunden' ELSE buyer_reference END AS buyer_reference,
  CASE WHEN doc_id % 6 <> 0 THEN order_reference END AS order_reference) FROM inv""", "inv")
part("got_line", """
SELECT * REPLACE (CASE WHEN doc_id % 8 = 0 AND line_index = 1 THEN '999' ELSE quantity || '.0' END AS quantity) FROM line
WHERE doc_id % 9 <> 0 OR line_index > 0""", "line")
part("got", flat_sql("got_inv", "got_line", "ex"), "got_inv", "got_line", "ex")
part("compared", """
SELECT coalesce(t.doc_id, g.doc_id) AS doc_id, coalesce(t.key, g.key) AS key, coalesce(t.term, g.term) AS term,
  CASE WHEN t.value IS NULL THEN 'invented' WHEN g.value IS NULL THEN 'not extracted' WHEN t.value = g.value THEN 'correct' ELSE 'wrong' END AS status,
  t.value AS want, g.value AS got
FROM truth t FULL OUTER JOIN got g ON t.doc_id = g.doc_id AND t.key = g.key""", "truth", "got")
