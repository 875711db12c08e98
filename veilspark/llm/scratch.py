"""Intermediate tables in the folder that all executors share.

A cluster names it in spark.checkpoint.dir; where it does not, this raises. A local session without it, as in tests, gets a
local folder, which is set.
A table that was written cuts lineage: after the loss of an executor it is read, not computed, again.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Within it, Arrow batches hold at most so many rows; None leaves them as they are."""
    before = spark.conf.get(BATCH)
    try:
        if rows:
            spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
        yield
    finally:
        spark.conf.set(BATCH, before)


def kept(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """df as written to the shared folder and read from it.

    batch: rows in an Arrow batch while it is written, for functions whose results are much larger than their rows.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/veilspark/{label}-{uuid.uuid4().hex}"
    with batches_of(spark, batch):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veilspark_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that kept() wrote, once nothing reads it any more."""
    path = getattr(df, "_veilspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
