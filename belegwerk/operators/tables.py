"""Long fact tables <-> invoice, line and exemption tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model

_NUMBERED = r"^(lines|vatExemptions)\.([0-9]+)\.([A-Za-z]+)\z"


def _nest(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    c = {path: F.col(f"`{column}`") for path, column in fields}
    at = lambda p: c[p].alias(dict(fields)[p].rsplit(".", 1)[-1])

    def group(prefix: str, names: list[str]):
        cols = [c[f"{prefix}.{n}"] for n in names]
        return F.when(F.coalesce(*cols).isNotNull(), F.struct(*[at(f"{prefix}.{n}") for n in names]))

    def party(p: str, own: list[str], contact: bool):
        parts = [at(f"{p}.{n}") for n in own]
        parts.append(group(f"{p}.electronicAddress", ["scheme", "value"]).alias("electronic_address"))
        parts.append(F.struct(*[at(f"{p}.address.{n}") for n in ("line1", "line2", "city", "postcode", "countryCode")]).alias("address"))
        if contact:
            parts.append(F.struct(*[at(f"{p}.contact.{n}") for n in ("name", "phone", "email")]).alias("contact"))
        return F.struct(*parts)

    plain = ["number", "issueDate", "typeCode", "currency", "dueDate", "buyerReference", "orderReference", "paymentTerms"]
    return df.select(
        "doc_id", *[at(p) for p in plain],
        party("seller", ["id", "name", "legalRegistrationId", "vatId", "taxNumber"], True).alias("seller"),
        party("buyer", ["name"], False).alias("buyer"),
        group("payment", ["meansCode", "iban", "accountName"]).alias("payment"),
    )


HEADER_COLUMNS = [(p, c) for p, _, c in model.HEADER_FIELDS] + list(model.EXTRA_FIELDS)


def nest_invoice(flat: DataFrame) -> DataFrame:
    """Flat columns named like seller.address.city -> canonical nested invoice rows."""
    return _nest(flat, HEADER_COLUMNS)


def invoices_of(facts: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Pivot header facts into one invoice row per document (also for documents of docs without a fact)."""
    flat = facts.where(F.col("path").isin(*[p for p, _ in HEADER_COLUMNS])).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("path") == p, F.col("value"))).alias(c) for p, c in HEADER_COLUMNS])
    if docs is not None:
        flat = docs.select("doc_id").join(flat, "doc_id", "left")
    return nest_invoice(flat)


def _numbered(facts: DataFrame, prefix: str, index: str, fields: list[tuple[str, str]]) -> DataFrame:
    part = lambda i: F.regexp_extract("path", _NUMBERED, i)
    rows = facts.where(F.startswith("path", F.lit(f"{prefix}."))).select(
        "doc_id", part(2).try_cast("int").alias(index), part(3).alias("field"), "value")
    return rows.groupBy("doc_id", index).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(c) for f, c in fields])


def lines_of(facts: DataFrame, line_ids: DataFrame | None = None) -> DataFrame:
    """One row per line; line_ids(doc_id, line_index) keeps extracted lines that lost every value."""
    rows = _numbered(facts, "lines", "line_index", [(p, c) for p, _, c in model.LINE_FIELDS])
    return rows if line_ids is None else line_ids.join(rows, ["doc_id", "line_index"], "left")


def exemptions_of(facts: DataFrame) -> DataFrame:
    return _numbered(facts, "vatExemptions", "ex_index", [("category", "category"), ("reason", "reason"), ("reasonCode", "reason_code")])
