"""Tables from files, with their schemas stated where the format has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, form: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Files of a form Spark reads. csv and json need a schema, as inferring one reads everything twice."""
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, form: str, partition_by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    writer = df.write.format(form).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
