"""Helpers of the llm operators: scratch tables, batch settings, text columns."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telemill.session import checkpoint_root

#: Rows and bytes of one Arrow batch.  A Python worker holds a batch or two of texts at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch may hold; documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Python workers import this package from where the driver did; a cluster gets it installed or by --py-files.
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return spark


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    spark = staged.sparkSession
    for path in sorted({f.rsplit("/", 1)[0] for f in staged.inputFiles()}):
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are done and staged.

    It acts when the driver collects its garbage, which a driver with a large heap seldom does.  Spark's listeners
    hold the plan that ran last, so a query of one row runs before.
    """
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.java.lang.System.gc()
