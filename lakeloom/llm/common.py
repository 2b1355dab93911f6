"""What the corpus operators share: the shared folder, cut lineage, batches of bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs in one process (tests) a temporary folder is used.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="lakeloom-"))


#: Folders of intermediate tables that this process has written and not deleted, the oldest first.
_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/lakeloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(at)
    return at


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors. by: a column that parts its files."""
    at = fresh_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at).select(df.columns)


def deleted(spark: SparkSession, at: str) -> None:
    """Delete a folder that fresh_path() gave."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.remove(at)


def removed(table: DataFrame) -> None:
    """A table that written() gave is deleted; nothing that is computed later may read it."""
    files = table.inputFiles()
    for at in [x for x in _WRITTEN if files and f"/{x.rsplit('/', 1)[-1]}/" in files[0]]:
        deleted(table.sparkSession, at)


@contextmanager
def swept(spark: SparkSession, keep: int = 0):
    """Tables written inside are deleted at the end, but for the last `keep`: for callers who have written what they return."""
    before = set(_WRITTEN)
    yield
    made = [x for x in _WRITTEN if x not in before]
    for at in made[: len(made) - keep]:
        deleted(spark, at)


def released(spark: SparkSession) -> None:
    """The driver collects its garbage, so that Spark deletes shuffle files of finished steps now and not at its next half hour.

    A small job comes first: each queue of listeners holds the last event, and with it the plan of the step that it ended.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of documents that an Arrow batch holds, where the session keeps Spark's own 10,000.
ROWS_AT_ONCE = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of documents in hundreds of rows: both ends of a pipe hold some whole, outside the JVM's heap."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS_AT_ONCE))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and the columns named), a null text as empty; other columns can't clash with ours."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


#: Ids, or rows as small, that may be broadcast: 16 bytes or so each.
SMALL = 1_000_000


def few(rows: DataFrame) -> bool:
    return rows.count() <= SMALL


def sized(rows: DataFrame) -> DataFrame:
    """For a join: broadcast if the rows are counted few, else dealt out with the other side."""
    return F.broadcast(rows) if few(rows) else rows


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids (one column, written)."""
    name = "dropped_id"
    while name in docs.columns:
        name += "_"
    return docs.join(sized(ids.toDF(name)), docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array) -> pa.Array:
    """The same buffers seen as bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def crc_mod(m: int, column: str = "doc_id"):
    """crc32 of the id's decimal text, mod m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)


def held_out(m: int, remainder: int):
    """Whether a document is held out; without a doc_id it is not."""
    return F.coalesce(crc_mod(m) == remainder, F.lit(False)).alias("held_out")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's strings in one array, and each string's bounds (n + 1 offsets)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
