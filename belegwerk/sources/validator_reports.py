"""Stored reports of the official validator -> decisions and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

_MESSAGE = "message:array<struct<_VALUE:string,_code:string,_level:string,_xpathLocation:string>>"
_STEPS = f"struct<validationStepResult:array<struct<{_MESSAGE}>>>"
REPORT_DDL = (
    f"scenarioMatched {_STEPS}, noScenarioMatched {_STEPS}, assessment struct<accept:string,reject:string>, "
    "_corrupt_record string"
)


def parse_validator_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reports(doc_id, report, processing_errors array<string>) -> (decision, finding).

    valid is the recommendation of the report, not the absence of errors. Without a readable report every
    processing error is a finding of rule PROCESSING, and there is no hash.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_", "valueTag": "_VALUE", "nullValue": "\u0000"}
    parsed = reports.select("*", F.explode(F.array(F.from_xml("report", REPORT_DDL, options))).alias("x"))
    readable = F.col("report").isNotNull() & F.col("x").isNotNull() & F.col("x._corrupt_record").isNull()
    marked = parsed.withColumn("ok", readable)
    decision = marked.select(
        "doc_id",
        (F.col("ok") & F.col("x.assessment.accept").isNotNull()).alias("valid"),
        F.when(F.col("ok"), F.sha2("report", 256)).alias("report_hash"))
    steps = F.concat(
        F.coalesce("x.scenarioMatched.validationStepResult", F.array()), F.coalesce("x.noScenarioMatched.validationStepResult", F.array()))
    messages = F.flatten(F.filter(F.transform(steps, lambda s: s["message"]), lambda m: m.isNotNull()))
    blank = lambda c: F.coalesce(c, F.lit(""))
    listed = marked.where("ok").select("doc_id", F.posexplode(messages).alias("seq", "m")).select(
        "doc_id", "seq", blank(F.col("m._code")).alias("rule_id"), blank(F.col("m._level")).alias("severity"),
        strip(blank(F.col("m._VALUE"))).alias("message"), blank(F.col("m._xpathLocation")).alias("location"))
    failed = marked.where("not ok").select(
        "doc_id", F.posexplode(F.coalesce("processing_errors", F.array(F.lit("report is not readable")))).alias("seq", "message")).select(
        "doc_id", "seq", F.lit("PROCESSING").alias("rule_id"), F.lit("error").alias("severity"), "message", F.lit("").alias("location"))
    return decision, listed.unionByName(failed)


def read_validator_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One XML report per file; the file name is the document id."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("report"),
        F.lit(None).cast("array<string>").alias("processing_errors"))
    return parse_validator_reports(files)
