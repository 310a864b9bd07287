"""Audit logs as files: one JSONL file per run, read by byte ranges and written in order."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import strip
from ..operators.ordering import index_rows

FORMAT = "audit_files"
_SUFFIX = ".jsonl"


def read_audit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, lines) of one JSONL file per run: runs(run_id), lines(run_id, line_no, line). Blank lines do not count.
    Runs without a line are kept, they verify as empty; a file of no bytes at all is not seen by Spark's readers.

    A file is read by byte ranges, so a long log is spread over tasks. Inside a range rows keep their order; a small
    table with the number of lines per range carries the offset of each."""
    def plain(text: Column) -> Column:
        # A plus sign is itself here, not a space.
        text = F.replace(text, F.lit("+"), F.lit("%2B"))
        return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("%2B"), F.lit("+")))

    def run(name: str) -> Column:
        # Spark escapes the name of a file; the writer has escaped the run before.
        return plain(plain(F.regexp_replace(f"_metadata.{name}", rf"\{_SUFFIX}\z", ""))).alias("run_id")

    # Without its content column this only lists the files.
    runs = spark.read.format("binaryFile").load(path).select(run("file_name"))
    rows = spark.read.option("lineSep", "\n").text(path).select(
        run("file_name"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    kept = rows.where(strip(F.col("line")) != "")
    return runs, index_rows(kept, ["run_id"], [F.col("at")], [F.col("begin")], "line_no").select("run_id", "line_no", "line")


def _file_name(run: str) -> str:
    """Names that begin with an underscore or a dot are no data to Spark."""
    name = quote(run, safe=" ")
    return (f"%{ord(name[0]):02X}" + name[1:] if name[:1] in ("_", ".") else name) + _SUFFIX


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    """Rows come sorted by run and place. Each run is written beside its final name and then moved there at once, so a
    task that is run again writes the same files again."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = pa.fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        now, stream, beside = None, None, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                store.move(beside, posixpath.join(folder, _file_name(now)))

        for batch in batches:
            runs, lines = batch.column("run_id").to_pylist(), batch.column("line").to_pylist()
            begin = 0
            for end in range(1, len(runs) + 1):
                if end < len(runs) and runs[end] == runs[begin]:
                    continue
                if runs[begin] is None:
                    raise ValueError("a line without a run cannot be written")
                if runs[begin] != now:
                    close()
                    now = runs[begin]
                    beside = posixpath.join(folder, f"_{uuid.uuid4().hex}")
                    stream = store.open_output_stream(beside)
                stream.write("".join(f"{line}\n" for line in lines[begin:end]).encode())
                begin = end
        close()
        return _Written()

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class AuditFiles(DataSource):
    """Sink for rows (run_id, line). The folder must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "run_id string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_audit_log(events: DataFrame, path: str) -> None:
    """event(run_id, seq, line) -> one file per run in `path`, its lines in the order of seq.

    A file that is there already is replaced. A run is one file and so one task, which holds a batch of lines at a time."""
    spark = events.sparkSession
    spark.dataSource.register(AuditFiles)
    rows = events.select(F.col("run_id").cast("string").alias("run_id"), "seq", "line").repartition("run_id").sortWithinPartitions("run_id", "seq")
    rows.select("run_id", "line").write.format(FORMAT).mode("append").option("path", path).save()
