"""Tables in the folder that all executors share: where long lineages are cut."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own is set only where the session has none and one machine does all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote on the way, when their results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strandlake/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting that drops an execution's shuffle files at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, by: str | None = None, **options) -> DataFrame:
    """Writes df as a table in the shared folder, in a folder for each value of a last column `by`, and reads it back: later jobs and lost executors start from the table, so its shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        writer = df.write.options(**({"compression": "zstd"} | options))
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Lets the driver drop what ended jobs leave in it: their plans, generated classes and Python objects; freed memory goes back to the system."""
    gc.collect()
    spark._jvm.System.gc()
    give_back()


def give_back() -> None:
    """Memory that Arrow and numpy have freed goes back to the system: a process that is kept would hold on to its peak."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@cache
def _trim():
    """glibc's malloc_trim, or nothing elsewhere."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:
        return lambda _: 0


def discard(*tables: DataFrame, part: str = "") -> None:
    """Deletes tables that materialize() wrote, once everything made from them is a table itself; views over several of them lose all. part: the folder of one value (name=value), of a table that has one for each."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if "/strandlake/" in folder and (not part or folder.endswith(f"/{part}")):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
