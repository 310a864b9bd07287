"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "belegwerk", cores: str | int = "*") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own, with the package on the executors."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        # Python workers start in the caller's folder, which need not be this one.
        os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (root, path) if p)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`. Without it a local master gets a temporary folder, which
    goes when the driver ends; any other master is refused, since its executors would each write to their own disk."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share; the master is {master}")
    made = tempfile.mkdtemp(prefix="belegwerk-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def fresh_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store Spark writes to; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: While a table is stored: files of a shuffle go with the job that made them; tables that lie by one key are read as they
#: lie, joined on that key and others without another shuffle, and written without a sort, a task having one bucket or few.
_STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "4"}


@contextmanager
def _storing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STORING}
    for k, v in _STORING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table, so that a lost executor does not replay every round."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with _storing(spark):
        df.write.mode("errorifexists").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored = path, None
    return kept


def materialise_by(df: DataFrame, name: str, *keys: str, placed: bool = False) -> DataFrame:
    """As `materialise`, in buckets of `keys`: tables stored by the same keys are joined on them without a shuffle, however
    often. A bucket is one partition of a shuffle by the keys, and one file. `placed` says that the rows of df lie by
    the keys already, since it is made from tables stored by them; another df would come in many small files."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    rows = df if placed else df.repartition(n, *keys)
    path = fresh_dir(spark, name)
    with _storing(spark):
        rows.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    kept = spark.table(table)
    kept._stored = path, table
    return kept


def discard(*stored: DataFrame) -> None:
    """Delete tables that `materialise` or `materialise_by` has returned, once nothing reads them any more."""
    for df in stored:
        path, table = df._stored
        if table is not None:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        remove(df.sparkSession, path)
