"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Join sides are broadcast only when Spark's own size statistics say they are
# small; skewed shuffle partitions are split by AQE even where that costs one more exchange. Generated methods above 8000 bytes of
# bytecode are never compiled by the JVM, so wider stages run operator by operator, whose code Spark cuts into small methods.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a fresh temporary folder, once per application; on a cluster the setting
    is required, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = spark.conf.get("spark.onledger.localWorkDir", None)
        if not root:
            root = tempfile.mkdtemp(prefix="onledger-")
            spark.conf.set("spark.onledger.localWorkDir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared work folder."""
    return f"{work_root(spark)}/onledger/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = work_dir(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
