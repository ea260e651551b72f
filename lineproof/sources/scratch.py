"""Tables that cut the lineage of longer jobs, in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder shared by all executors. A session in one JVM may leave it unset (tests); on a cluster it must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineproof-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/lineproof/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", file_rows: int = 0) -> DataFrame:
    """df from a Parquet table in the shared folder; a lost executor costs no recomputation. file_rows: so many rows a file at most, 0 for any."""
    at = path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
