"""Recorded model output, text items and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model
from ..functions.text import strip, tagged_sha256
from ..operators.ordering import join_in_order

# Field of the recorded output -> model path.
HEADER_PATHS = (
    ("header.invoiceNumber", "number"), ("header.issueDate", "issueDate"), ("header.dueDate", "dueDate"),
    ("header.buyerReference", "buyerReference"), ("header.orderReference", "orderReference"),
    ("header.currency", "currency"), ("header.paymentTerms", "paymentTerms"),
    ("seller.sellerId", "seller.id"), ("seller.legalRegistrationId", "seller.legalRegistrationId"),
    ("seller.vatId", "seller.vatId"), ("seller.taxNumber", "seller.taxNumber"),
    ("seller.contactName", "seller.contact.name"), ("seller.contactPhone", "seller.contact.phone"),
    ("seller.contactEmail", "seller.contact.email"),
    *((f"{p}.{f}", f"{p}.{t}") for p in ("seller", "buyer") for f, t in (
        ("name", "name"), ("street", "address.line1"), ("addressLine2", "address.line2"), ("city", "address.city"),
        ("postcode", "address.postcode"), ("country", "address.countryCode"),
        ("electronicAddress", "electronicAddress.value"))),
    ("payment.iban", "payment.iban"), ("payment.accountName", "payment.accountName"),
    ("documentTotals.lineTotal", "documentTotals.lineTotal"), ("documentTotals.taxTotal", "documentTotals.taxTotal"),
    ("documentTotals.grandTotal", "documentTotals.grandTotal"),
)
LINE_PATHS = (
    ("lineId", "id"), ("name", "name"), ("quantity", "quantity"), ("unit", "unitCode"), ("netPrice", "netPrice"),
    ("priceBaseQuantity", "priceBaseQuantity"), ("vatCategory", "vatCategory"), ("vatRate", "vatRate"),
)


def parse_extractions(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """attempts(.., content) -> (usable rows with the parsed record, unusable rows).

    Usable: valid JSON with a header, and lines is an array. Nothing is guessed from a broken record.
    """
    schema = model.EXTRACTION_DDL + ", _corrupt_record string"
    shape = F.try_parse_json("content")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(shape, path, "variant"))
    usable = (
        shape.isNotNull()
        & F.coalesce(F.startswith(F.schema_of_variant(shape), F.lit("OBJECT")), F.lit(False))
        & kind("$.header").isNotNull()
        & F.coalesce(F.startswith(kind("$.lines"), F.lit("ARRAY")), F.lit(False))
    )
    marked = attempts.withColumn("__ok", F.coalesce(usable, F.lit(False)))
    parsed = F.from_json("content", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    ok = marked.where("__ok").withColumn("raw", parsed).drop("__ok")
    bad = marked.where("not __ok").drop("__ok")
    return ok, bad


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines of {doc_id, attempt, content, ..call columns}; content is the recorded model text."""
    schema = "doc_id string, attempt int, model string, prompt_tokens long, completion_tokens long, content string"
    return parse_extractions(spark.read.schema(schema).json(path))


def pick_first_valid_attempt(ok: DataFrame, bad: DataFrame, max_attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(first usable attempt per document, documents whose attempts all failed). Costs stay in the attempts table."""
    in_time = ok.where(F.col("attempt") < max_attempts)
    cols = [c for c in in_time.columns if c != "doc_id"]
    first = in_time.groupBy("doc_id").agg(F.min_by(F.struct(*cols), "attempt").alias("r")).select("doc_id", "r.*")
    failed = (
        bad.where(F.col("attempt") < max_attempts).groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempts"))
        .join(first.select("doc_id"), "doc_id", "left_anti")
        .withColumn("error", F.lit("extraction returned invalid JSON twice"))
    )
    return first, failed


def facts_of(extractions: DataFrame) -> DataFrame:
    """extractions(doc_id, raw) -> fact(doc_id, path, value, quote, page). One row per field that is not null."""
    fact = lambda path, value, quote, page: F.struct(
        path.alias("path"), value.alias("value"), quote.alias("quote"), page.alias("page"))
    ev = lambda path, e: F.when(e["value"].isNotNull(), fact(path, e["value"], e["quote"], e["page"]))
    at = lambda prefix, i, name: F.concat(F.lit(prefix), i.cast("string"), F.lit("." + name if name else ""))

    header = F.array(*[ev(F.lit(path), F.col(f"raw.{field}")) for field, path in HEADER_PATHS])
    per_line = F.flatten(F.transform("raw.lines", lambda l, i: F.array(
        *[F.when(l[f].isNotNull(), fact(at("lines.", i, p), l[f], l["rowQuote"], l["page"])) for f, p in LINE_PATHS],
        F.when(l["lineAmount"].isNotNull(), fact(at("documentTotals.lines.", i, ""), l["lineAmount"], l["rowQuote"], l["page"])),
    )))
    per_exemption = F.flatten(F.transform("raw.vatExemptions", lambda e, i: F.array(
        *[ev(at("vatExemptions.", i, f), e[f]) for f in ("category", "reason", "reasonCode")])))
    none = F.array().cast("array<struct<path:string,value:string,quote:string,page:int>>")
    every = F.concat(header, F.coalesce(per_line, none), F.coalesce(per_exemption, none))
    return extractions.select("doc_id", F.explode(F.array_compact(every)).alias("f")).select("doc_id", "f.*")


def raw_lines(extractions: DataFrame) -> DataFrame:
    """(doc_id, line_index) of every extracted line, also of lines without a single value."""
    return extractions.select("doc_id", F.posexplode("raw.lines").alias("line_index", "l")).select("doc_id", "line_index")


def assemble_page_text(items: DataFrame) -> DataFrame:
    """items(doc_id, page, seq, str, y, has_eol) -> page(doc_id, page, text).

    Blank items print nothing and leave the baseline, but their line end counts. A new line starts after a line
    end or where the baseline moves by more than 1; otherwise items are joined by a space.
    """
    page = W.partitionBy("doc_id", "page").orderBy("seq")
    ends = F.coalesce(F.sum(F.col("has_eol").cast("int")).over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    printed = items.withColumn("ends", ends).where(F.length(strip(F.col("str"))) > 0)
    moved = (F.col("ends") > F.lag("ends").over(page)) | (F.abs(F.col("y") - F.lag("y").over(page)) > 1)
    separator = F.when(F.lag("seq").over(page).isNull(), "").when(moved, "\n").otherwise(" ")
    pieces = printed.withColumn("piece", F.concat(separator, F.col("str")))
    text = join_in_order(pieces, ["doc_id", "page"], "seq", "piece", "", "text", chunk=4096)
    empty = items.select("doc_id", "page").distinct().join(text, ["doc_id", "page"], "left")
    return empty.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def build_prompt(pages: DataFrame, system_prompt: str = "") -> DataFrame:
    """doc_id, prompt, prompt_hash: all pages with their page marks, in order."""
    marked = pages.withColumn(
        "__m", F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---\n"), "text"))
    prompts = join_in_order(marked, ["doc_id"], "page", "__m", "\n\n", "prompt")
    return prompts.withColumn("prompt_hash", tagged_sha256(F.concat(F.lit(system_prompt), "prompt")))


def gate_documents(files: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(doc_id, size, head) and page texts -> (accepted doc_id, refused doc_id with reason)."""
    shown = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.bool_and(F.length(strip(F.col("text"))) < model.MIN_PAGE_CHARS).alias("no_text"))
    reason = (
        F.when(F.col("size") > model.MAX_UPLOAD_BYTES, "file too large")
        .when(~F.startswith(F.col("head"), F.lit("%PDF-")), "not a PDF")
        .when(F.coalesce("n_pages", F.lit(0)) > model.MAX_PAGES, "too many pages")
        .when(F.coalesce("no_text", F.lit(True)), "no text layer")
    )
    judged = files.join(shown, "doc_id", "left").withColumn("reason", reason)
    return judged.where("reason is null").select("doc_id", "n_pages"), judged.where("reason is not null").select("doc_id", "reason")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """files(doc_id, size, head) of uploaded binaries; only the first bytes are kept."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(
        F.col("path").alias("doc_id"), F.col("length").alias("size"),
        F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("head"))
