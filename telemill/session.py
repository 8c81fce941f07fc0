"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_RUNTIME = {
    # Event time is UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Duplicate attribute keys: the last one wins, as in a hash map built in order.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A repeated attribute key inside one JSON object is legal; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Small per-group buffers (sets of services, bucket lists): hash more groups before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    # Hot keys in plain shuffle joins are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "telemill", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a private one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def workers_import(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did; a cluster gets it installed or by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
