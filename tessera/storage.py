"""Tables in the folder that driver and executors share: they cut lineages and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local folder serves in local mode, as in tests; on a cluster
    executors would not share it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when it has ended: a written table doesn't need them any more, and
    without this they stay on the executors' disks until the driver's JVM collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Where the shared folder is a mounted one (file:) and Hadoop's native library is absent, Hadoop starts a chmod process for
#: every folder, file and checksum file, each for a moment in the memory of the executor or driver. So these tables have
#: neither checksum files nor a mark of success; Parquet's own checksums of pages are verified instead, wherever the folder is.
_FEW_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "parquet.page.write-checksum.enabled": "true",
}


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read back.

    The table goes when the driver's Python ends; loops delete superseded ones earlier with ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").options(**_FEW_FILES)
    with _shuffles_go(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    atexit.register(_forget, spark, path)
    back = spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)
    back._tessera_path = path
    return back


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, observed as they are written."""
    seen = Observation()
    back = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return back, seen.get["n"]


def _forget(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        _delete(spark, path)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``written`` returned."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)
