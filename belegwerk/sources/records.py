"""Audit logs, recorded runs, corpus manifests and evaluation reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

NOISE = "struct<numberFormat:string,dateFormat:string,labelVariant:int,shuffleBlocks:boolean,smallFont:boolean,splitPages:boolean>"
MUTATION = "struct<id:string,expect:struct<kind:string,fields:array<string>>,detectedBy:string,acceptedAnyway:boolean>"
MANIFEST_DDL = (
    "testsuite string, generator string, entries array<struct<id:string,`set`:string,holdout:boolean,source:string,"
    f"invoiceId:string,layout:string,noise:{NOISE},mutation:{MUTATION},pdf:string,groundTruth:string,sha256:string>>"
)
_PARTY = "name:string,electronicAddress:struct<scheme:string,value:string>,address:struct<line1:string,line2:string,city:string,postcode:string,countryCode:string>"
TRUTH_DDL = (
    "invoice struct<number:string,issueDate:string,typeCode:string,currency:string,dueDate:string,buyerReference:string,"
    "orderReference:string,paymentTerms:string,"
    f"seller:struct<id:string,legalRegistrationId:string,vatId:string,taxNumber:string,contact:struct<name:string,phone:string,email:string>,{_PARTY}>,"
    f"buyer:struct<{_PARTY}>,payment:struct<meansCode:string,iban:string,accountName:string>,"
    "vatExemptions:array<struct<category:string,reason:string,reasonCode:string>>,"
    "lines:array<struct<id:string,name:string,quantity:string,unitCode:string,netPrice:string,priceBaseQuantity:string,vatCategory:string,vatRate:string>>>,"
    "printed struct<lineNet:array<string>,lineTotal:string,taxTotal:string,grandTotal:string>"
)


def log_lines(texts: DataFrame) -> DataFrame:
    """texts(run_id, text) -> line(run_id, line_no, line); blank lines do not count."""
    kept = F.filter(F.split("text", "\n", -1), lambda l: strip(l) != "")
    return texts.select("run_id", F.posexplode(kept).alias("line_no", "line"))


def read_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest entries, ground truth per entry id, entries whose ground truth cannot be read: id, groundTruth)."""
    manifest = (
        spark.read.schema(MANIFEST_DDL).option("multiLine", True).json(f"{root}/manifest.json")
        .select(F.explode("entries").alias("e")).select("e.*")
    )
    files = (
        spark.read.schema(TRUTH_DDL).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(root)
        .withColumn("file", F.col("_metadata.file_path")).where("invoice is not null")
    )
    # The path inside the corpus folder is the join key; the prefix depends on the file system.
    inside = F.regexp_extract("file", r"((?:holdout/)?(?:clean|noisy|mutated)/[^/]+\.json)\z", 1)
    truth = files.withColumn("groundTruth", inside).join(manifest.select("id", "groundTruth"), "groundTruth")
    truth = truth.select("id", "invoice", "printed")
    return manifest, truth, manifest.select("id", "groundTruth").join(truth.select("id"), "id", "left_anti")


def parse_run_events(recordings: DataFrame) -> DataFrame:
    """recordings(case_id, run, followUp: arrays of struct(at, event json)) -> run_event(case_id, pass, seq, at_ms, type, event)."""
    one = lambda col, n: recordings.where(F.col(col).isNotNull()).select(
        "case_id", F.lit(n).alias("pass"), F.posexplode(col).alias("seq", "r"))
    rows = one("run", 1).unionByName(one("followUp", 2))
    return rows.select(
        "case_id", "pass", "seq", F.col("r.at").alias("at_ms"), F.get_json_object("r.event", "$.type").alias("type"),
        F.col("r.event").alias("event"))


def read_run_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, names of files without a readable run), one recorded case per JSON file."""
    step = "array<struct<at:bigint,event:string>>"
    cases = spark.read.schema(f"id string, title string, run {step}, followUp {step}").option("multiLine", True).json(path)
    cases = cases.withColumnRenamed("id", "case_id").withColumn("file", F.col("_metadata.file_name"))
    return parse_run_events(cases.where("run is not null")), cases.where("run is null").select("file")


def not_as_expected(rows: DataFrame) -> DataFrame:
    return rows.where("not as_expected").select("doc_id", "state", "expected")
