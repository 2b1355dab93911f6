"""Structured Streaming over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, folder: str, schema, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, by: list[str], value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Count and sum of each window and group; state is dropped once the watermark has passed a window. slide: windows that overlap."""
    marked = stream.withWatermark(time, late)
    window = F.window(time, width, slide or width)
    return marked.groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def session_counts(stream: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Sessions of `by`, each given out once the watermark has passed its end."""
    marked = stream.withWatermark(time, late)
    return marked.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("first_time"), "n")


def first_of_each(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; a key is remembered until the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def followed_by(causes: DataFrame, effects: DataFrame, key: str, cause_time: str, effect_time: str, within: str, late: str) -> DataFrame:
    """Pairs of two streams with one key, the effect at or after its cause and less than `within` later; both sides' state ends with the watermarks.

    Columns of the two streams must differ but for key.
    """
    clash = (set(causes.columns) & set(effects.columns)) - {key}
    if clash:
        raise ValueError(f"columns of both streams: {', '.join(sorted(clash))}")
    right = effects.withColumnRenamed(key, "_key").withWatermark(effect_time, late)
    near = F.expr(f"{effect_time} >= {cause_time} AND {effect_time} < {cause_time} + INTERVAL {within}")
    return causes.withWatermark(cause_time, late).join(right, (F.col(key) == F.col("_key")) & near).drop("_key")


def to_files(stream: DataFrame, folder: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Append what the stream gives to Parquet files and stop when all input there is has been read; a later call goes on from the checkpoint."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.partitionBy(*by) if by else writer).start()
    query.awaitTermination()
    return query
