"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only where that is unset and Spark runs in one process it is a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lakeloom-")
    return f"{at.rstrip('/')}/lakeloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """df as a Parquet table: computed once, and safe from lost executors."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
