"""Written intermediate tables.

An operator that reads an intermediate result twice writes it once as parquet in the
shared folder of the session (``spark.checkpoint.dir``). That cuts the lineage, survives
lost executors, fixes values that depend on the partitioning, and gives Catalyst the real
size of the table, so that small sides are broadcast by the optimizer's own size check.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None


def stage_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates; a local one only where none is set and driver
    and executors are one process."""
    global _fallback
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="pulsegrid-")
    return _fallback


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path; every call gives a new one, so a retried job never meets old files."""
    app = spark.sparkContext.applicationId
    return f"{stage_root(spark)}/pulsegrid/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Write ``df`` once and return the DataFrame that reads it back; options go to the writer."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("error").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
