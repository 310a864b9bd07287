"""Named queries: amounts and printed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import printing as P
from ..operators import amounts
from .bindings import Tables
from .oracle_parts import money, with_parts
from .registry import query


@query("invoice_amounts", with_parts(f"""
SELECT t.doc_id, {money('line_cents')} AS line_total, {money('t.tax_cents')} AS tax_total, {money('grand_cents')} AS grand_total,
  n_groups, CASE WHEN p_grand <> grand_cents THEN {money('p_grand')} - {money('grand_cents')} END AS grand_difference
FROM tot t JOIN printed p USING (doc_id) JOIN (SELECT doc_id, count(*) AS n_groups FROM grp GROUP BY doc_id) USING (doc_id)""", "tot", "printed", "grp"))
def invoice_amounts(t: Tables) -> DataFrame:
    """Per invoice the computed totals, its VAT groups, and the gap to the printed total."""
    groups = t.breakdown.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_groups"))
    printed = t.printed_totals.select("doc_id", F.col("grand_total").alias("printed"))
    gap = F.col("printed") - F.col("grand_total")
    return t.totals.join(groups, "doc_id").join(printed, "doc_id").select(
        "doc_id", "line_total", "tax_total", "grand_total", "n_groups", F.when(gap != 0, gap).alias("grand_difference"))


@query("line_net_amounts", with_parts(f"SELECT doc_id, line_index, {money('net_cents')} AS net_amount FROM line", "line"))
def line_net_amounts(t: Tables) -> DataFrame:
    return t.placed_nets.select("doc_id", "line_index", "net_amount")


_WIDE = "SELECT doc_id, line_index, l_partkey || repeat('0', (2 * l_linenumber)::INT) AS quantity, '0.' || repeat('0', l_linenumber::INT) || l_partkey AS net_price FROM line0"


@query("refused_amounts", with_parts(f"""
SELECT doc_id, line_index, 'quantity' AS field, quantity AS value, 'more digits than can be kept' AS reason FROM ({_WIDE}) WHERE length(ltrim(quantity, '0')) > 12
UNION ALL SELECT doc_id, line_index, 'net_price', net_price, 'more digits than can be kept' FROM ({_WIDE}) WHERE length(rtrim(net_price, '0')) > 10""", "line0"))
def refused_amounts(t: Tables) -> DataFrame:
    """Lines with quantities of many digits and prices with many decimals: those that cannot be kept exactly are named."""
    n, part = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("string")
    wide = t.placed_facts.withColumns({
        "quantity": F.concat(part, F.repeat(F.lit("0"), 2 * n)), "net_price": F.concat(F.lit("0."), F.repeat(F.lit("0"), n), part)})
    return amounts.refused_amounts(wide)


@query("vat_breakdown", with_parts(f"""
SELECT doc_id, vat_category, CAST(coalesce(rate, 0) AS VARCHAR) AS rate, rate IS NULL AS no_rate,
  {money('taxable_cents')} AS taxable_amount, {money('tax_cents')} AS tax_amount FROM grp""", "grp"))
def vat_breakdown(t: Tables) -> DataFrame:
    return t.breakdown.drop("first_line")


@query("vat_breakdown_order", with_parts("SELECT doc_id, vat_category, first_line FROM grp", "grp"))
def vat_breakdown_order(t: Tables) -> DataFrame:
    """The VAT groups in the order of their first line."""
    return t.placed_breakdown.select("doc_id", "vat_category", "first_line")


@query("invoice_totals", with_parts(f"""
SELECT doc_id, {money('line_cents')} AS line_total, {money('line_cents')} AS tax_basis_total, {money('tax_cents')} AS tax_total,
  {money('grand_cents')} AS grand_total, {money('grand_cents')} AS due_payable FROM tot""", "tot"))
def invoice_totals(t: Tables) -> DataFrame:
    return t.totals


def _warning(bt: str, p: str, c: str) -> str:
    m = lambda x: f"CAST({money(x)} AS VARCHAR)"
    return (f"SELECT doc_id, '{bt}' AS bt, {m(p)} AS printed, {m(c)} AS computed, '{bt}: printed ' || {m(p)} || ', computed ' || {m(c)} AS message "
            f"FROM printed JOIN tot USING (doc_id) WHERE {p} <> {c}")


@query("total_warnings", with_parts(" UNION ALL ".join([
    _warning("BT-106", "p_line", "line_cents"), _warning("BT-110", "p_tax", "tax_cents"), _warning("BT-112", "p_grand", "grand_cents")]), "printed", "tot"))
def total_warnings(t: Tables) -> DataFrame:
    return amounts.check_totals(t.printed_totals, t.totals)


def printed_lines(t: Tables) -> DataFrame:
    off = F.when(F.col("doc_id") % 2 == 1, F.lit("0.01")).otherwise("0.00").cast("decimal(18,2)")
    return t.placed_nets.select("doc_id", "line_index", (F.col("net_amount") + off).cast("decimal(18,2)").alias("amount"))


@query("line_mismatches", with_parts(f"""
SELECT doc_id, 'LINE-MISMATCH' AS id, '/lines/' || line_index AS location,
  'line ' || (line_index + 1) || ': quantity × price / base quantity = ' || {money('net_cents')} || ', but the printed line amount is '
  || {money('net_cents + 1')} || '. Check quantity, unit price and base quantity of this line.' AS message
FROM line WHERE doc_id % 2 = 1""", "line"))
def line_mismatches(t: Tables) -> DataFrame:
    return amounts.line_mismatch_issues(amounts.check_lines(printed_lines(t), t.placed_nets)).drop("seq")


@query("totals_within_tolerance", with_parts("""
SELECT doc_id, doc_id % 5 <> 0 AS line_total_ok, true AS tax_basis_ok, true AS tax_total_ok, doc_id % 3 <> 2 AS grand_total_ok, true AS due_payable_ok
FROM tot""", "tot"))
def totals_within_tolerance(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    cents = lambda n: n.cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")
    printed = t.totals.select(
        "doc_id", (F.col("line_total") + cents((d % 5 == 0).cast("int"))).alias("line_total"), "tax_basis_total",
        (F.col("tax_total") - cents(d % 2)).alias("tax_total"), (F.col("grand_total") + cents(d % 3)).alias("grand_total"), "due_payable")
    return amounts.within_tolerance(printed, t.totals)


@query("line_positions", with_parts("SELECT doc_id, line_index, l_linenumber, l_partkey, l_suppkey FROM line0", "line0"))
def line_positions(t: Tables) -> DataFrame:
    from ..operators.ordering import index_rows
    placed = index_rows(t._line_facts, ["doc_id"], [F.col(c) for c in t.ORDER], [F.col("l_linenumber"), F.expr("l_partkey div 64")], "line_index")
    return placed.select("doc_id", "line_index", "l_linenumber", "l_partkey", "l_suppkey")


@query("printed_values", f"""
SELECT o_orderkey AS doc_id, o_custkey,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' EUR'
    ELSE replace(replace(replace(format('{{:,.2f}}', CAST(o_totalprice AS DECIMAL(18,2))), ',', '#'), '.', ','), '#', '.') || ' €' END AS amount,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
    ELSE day(o_orderdate) || '. ' || ['Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember'][month(o_orderdate)] || ' ' || year(o_orderdate) END AS date,
  ['Stk. (H87)', 'Std. (HUR)', 'kg (KGM)', 'XYZ'][o_orderkey % 4 + 1] AS unit,
  (o_orderkey % 20) || CASE WHEN o_orderkey % 3 = 0 THEN '.5 %' ELSE ',5 %' END AS rate
FROM orders""")
def printed_values(t: Tables) -> DataFrame:
    """Amounts, dates, units and rates as a page shows them."""
    o = F.col("o_orderkey")
    nf = F.when(o % 3 == 0, "plain").otherwise("de")
    df = F.when(o % 3 == 0, "iso").when(o % 3 == 1, "de").otherwise("long")
    code = F.get(F.array(*[F.lit(u) for u in ("H87", "HUR", "KGM", "XYZ")]), (o % 4).cast("int"))
    return t.table("orders").select(
        o.alias("doc_id"), "o_custkey",
        P.print_amount(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), nf).alias("amount"),
        P.print_date(F.date_format("o_orderdate", "yyyy-MM-dd"), df).alias("date"), P.print_unit(code).alias("unit"),
        P.print_rate(F.concat((o % 20).cast("string"), F.lit(".5")), nf).alias("rate"))
