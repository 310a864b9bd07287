"""Every amount of an invoice, computed from its lines with decimals, and compared with what is printed.

line(doc_id, line_index, quantity, net_price, price_base_quantity, vat_category, vat_rate); numbers may be
decimal strings or decimals. A number that its type cannot hold exactly is not rounded: it has no value, the line has
no net amount, its VAT group and document have no totals, and `refused_amounts` names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURE = "decimal(18,6)"
#: quantity * price has 38 digits at most, so the product is exact.
PRICE = "decimal(19,8)"
MONEY = "decimal(18,2)"


def measure(col: str | Column, kind: str = MEASURE) -> Column:
    """The number in the type `kind`, null unless it is exactly what is stated."""
    c = F.col(col) if isinstance(col, str) else col
    text, wide = c.cast("string"), c.try_cast("decimal(38,18)")
    # Only a long text can state a 19th digit after the point; the pattern is costly. The text is read as a number once.
    beyond = F.coalesce((F.length(text) > 19) & text.rlike(r"\.\d{18}0*[1-9]"), F.lit(False))
    fitted = wide.try_cast(kind)
    return F.when((fitted == wide) & ~beyond, fitted)


def _stated(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string") != "", F.lit(False))


def net_amount(quantity: Column, price: Column, base: Column) -> Column:
    """round_half_up(quantity * price / base, 2), free of double rounding.

    The quotient keeps seven decimals; where that step already lifted it to the half cent, the
    cross-multiplied comparison takes the cent back.
    """
    exact = quantity * price
    rounded = F.round(F.try_divide(exact, base), 2).try_cast(MONEY)
    cent = F.lit("0.01").cast(MONEY)
    half = (F.abs(rounded) - F.lit("0.005").cast("decimal(4,3)")).cast("decimal(19,3)")
    too_high = (half > 0) & (half * F.abs(base) > F.abs(exact))
    return F.when(too_high, rounded - F.sign(rounded).cast("decimal(2,0)") * cent).otherwise(rounded).try_cast(MONEY)


def derive_line_net(lines: DataFrame) -> DataFrame:
    """A base quantity that is not stated is 1; one that cannot be kept exactly leaves the line without an amount."""
    base = F.when(_stated("price_base_quantity"), measure("price_base_quantity")).otherwise(F.lit(1).cast(MEASURE))
    return lines.withColumn("net_amount", net_amount(measure("quantity"), measure("net_price", PRICE), base))


def refused_amounts(lines: DataFrame) -> DataFrame:
    """(doc_id, line_index, field, value, reason): every stated number of a line that has no exact value, and lines
    whose numbers are fine but whose net amount is not. A line is either here or has a net amount, or states no number."""
    fields = (("quantity", MEASURE), ("net_price", PRICE), ("price_base_quantity", MEASURE))
    bad = {f: _stated(f) & measure(f, kind).isNull() for f, kind in fields}
    number = {f: F.col(f).cast("string").try_cast("double").isNotNull() for f, _ in fields}
    said = lambda f: F.when(number[f], "more digits than can be kept").otherwise("not a number")
    row = lambda f, value, reason: F.struct(F.lit(f).alias("field"), value.alias("value"), reason.alias("reason"))
    each = [F.when(bad[f], row(f, F.col(f).cast("string"), said(f))) for f, _ in fields]
    whole = _stated("quantity") & _stated("net_price") & ~bad["quantity"] & ~bad["net_price"] & ~bad["price_base_quantity"]
    net = F.when(whole & F.col("net_amount").isNull(), row(
        "net_amount", F.lit(None).cast("string"),
        F.when(measure("price_base_quantity") == 0, "the base quantity is zero").otherwise("more digits than can be kept")))
    return derive_line_net(lines).select("doc_id", "line_index", F.explode(F.array_compact(F.array(*each, net))).alias("r")).select(
        "doc_id", "line_index", "r.*")


def vat_breakdown(nets: DataFrame) -> DataFrame:
    """Per (category, rate by value): taxable amount, tax, and the first line that has it.

    A line without a rate is a group of its own, printed as rate 0.
    """
    rate = measure("vat_rate")
    grouped = nets.groupBy("doc_id", "vat_category", rate.alias("__rate")).agg(
        _all_known("net_amount").alias("taxable_amount"), F.min("line_index").alias("first_line"))
    known = F.coalesce("__rate", F.lit(0).cast(MEASURE))
    tax = F.round(F.col("taxable_amount") * known / F.lit(100).cast("decimal(3,0)"), 2).try_cast(MONEY)
    return grouped.select(
        "doc_id", "vat_category", plain_decimal(known).alias("rate"), F.col("__rate").isNull().alias("no_rate"),
        "taxable_amount", tax.alias("tax_amount"), "first_line")


def _all_known(column: str) -> Column:
    """The sum, null when any part of it is."""
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column).try_cast(MONEY))


def plain_decimal(col: Column) -> Column:
    """Decimal text by value: no trailing zeros, no exponent."""
    text = col.cast("string")
    return F.regexp_replace(F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"0+\z", "")).otherwise(text), r"\.\z", "")


def invoice_totals(breakdown: DataFrame) -> DataFrame:
    """Totals from the breakdown alone: its taxable amounts add up to the line total exactly."""
    sums = breakdown.groupBy("doc_id").agg(
        _all_known("taxable_amount").alias("line_total"), _all_known("tax_amount").alias("tax_total"))
    grand = (F.col("line_total") + F.col("tax_total")).try_cast(MONEY)
    return sums.select(
        "doc_id", "line_total", F.col("line_total").alias("tax_basis_total"), "tax_total",
        grand.alias("grand_total"), grand.alias("due_payable"))


def check_totals(printed: DataFrame, totals: DataFrame) -> DataFrame:
    """printed(doc_id, line_total, tax_total, grand_total) -> warning(doc_id, bt, printed, computed, message)."""
    p = printed.select("doc_id", *[F.col(c).cast("string").alias(f"p_{c}") for c in ("line_total", "tax_total", "grand_total")])
    both = p.join(totals, "doc_id")
    rows = []
    for bt, c in (("BT-106", "line_total"), ("BT-110", "tax_total"), ("BT-112", "grand_total")):
        differs = F.col(f"p_{c}").try_cast("decimal(38,10)") != F.col(c)
        rows.append(F.when(differs, F.struct(
            F.lit(bt).alias("bt"), F.col(f"p_{c}").alias("printed"), F.col(c).cast("string").alias("computed"))))
    return (
        both.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("w")).select("doc_id", "w.*")
        .withColumn("message", F.concat("bt", F.lit(": printed "), "printed", F.lit(", computed "), "computed"))
    )


def check_lines(printed: DataFrame, nets: DataFrame) -> DataFrame:
    """printed(doc_id, line_index, amount) against computed nets -> mismatch rows, which block the output.

    A line without a net amount never equals what is printed, so it blocks as well.
    """
    p = printed.select("doc_id", "line_index", F.col("amount").cast("string").alias("printed"))
    differs = F.col("printed").try_cast("decimal(38,10)") != F.col("net_amount")
    return (
        nets.select("doc_id", "line_index", "net_amount").join(p, ["doc_id", "line_index"])
        .where(differs | (F.col("net_amount").isNull() & F.col("printed").isNotNull()))
        .select("doc_id", "line_index", F.coalesce(F.col("net_amount").cast("string"), F.lit("not computable")).alias("computed"), "printed")
    )


def line_mismatch_issues(mismatches: DataFrame) -> DataFrame:
    number = (F.col("line_index") + 1).cast("string")
    return mismatches.select(
        "doc_id",
        F.col("line_index").alias("seq"),
        F.lit("LINE-MISMATCH").alias("id"),
        F.concat(
            F.lit("line "), number, F.lit(": quantity × price / base quantity = "), "computed",
            F.lit(", but the printed line amount is "), "printed",
            F.lit(". Check quantity, unit price and base quantity of this line.")).alias("message"),
        F.concat(F.lit("/lines/"), F.col("line_index").cast("string")).alias("location"),
    )


def within_tolerance(printed: DataFrame, totals: DataFrame) -> DataFrame:
    """Net totals must be equal; totals that depend on rounded tax may be off by one cent."""
    p = printed.select("doc_id", *[F.col(c).cast(MONEY).alias(f"p_{c}") for c in (
        "line_total", "tax_basis_total", "tax_total", "grand_total", "due_payable")])
    gap = lambda c: F.abs(F.col(f"p_{c}") - F.col(c))
    exact = lambda c: F.coalesce(gap(c) == 0, F.lit(True))
    near = lambda c: F.coalesce(gap(c) <= F.lit("0.01").cast(MONEY), F.lit(True))
    return p.join(totals, "doc_id").select(
        "doc_id", exact("line_total").alias("line_total_ok"), exact("tax_basis_total").alias("tax_basis_ok"),
        near("tax_total").alias("tax_total_ok"), near("grand_total").alias("grand_total_ok"),
        near("due_payable").alias("due_payable_ok"))
