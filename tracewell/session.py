"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Readings are wall-clock UTC; every text or epoch conversion relies on it.
    "spark.sql.session.timeZone": "UTC",
    # Spark refuses TIMESTAMP(NANOS) columns; read them as bigint and derive ts.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    # Wide readings: with the default of 100 fields, 100 sensors lose generated code and the
    # columnar scan, which makes down-sampling a good third slower.
    "spark.sql.codegen.maxFields": "500",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a fresh temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tracewell-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"



def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read from there, so that it is computed once."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
