"""Exact deduplication by a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table of one row per distinct text: its digest and the document that stays.
New data are reduced to distinct digests, deduplicated against the index by a sort-merge anti-join
(the index side is read by its buckets and needs no shuffle; Spark sorts each bucket again, as every append
adds a sorted file to it), and what is new is appended. One writer at a time may append to an index.

Defined cases: a null text is the empty text; an empty table gives no rows; rows that repeat a doc_id
are one document, which stays if one of its texts does; texts of any length are read whole; groups of any
size are counted in tasks before they meet; other columns of the input are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import deleted, fresh_path, read, texts, without, written

SPACE = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256: SHA-256 in hex of the text with each run of white space as one space."""
    return texts(docs).select("doc_id", F.sha2(F.regexp_replace("text", SPACE, " ").cast("binary"), 256).alias("text_sha256"))


class DigestIndex:
    """A bucketed table of digests. Opening an existing name goes on with what it holds.

    buckets: fixed for a table; about one per 128 MB of the index expected at full size.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.at = None
        if not spark.catalog.tableExists(self.name):
            at = path or fresh_path(spark, self.name)
            self.at = None if path else at
            spark.sql(
                f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT) USING parquet "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{at}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def discard(self) -> None:
        """Delete an index that this object made in the folder of intermediate tables; decisions already given stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.at:
            deleted(self.spark, self.at)

    def add(self, docs: DataFrame) -> DataFrame:
        """Append the new texts of docs; a decision for each row: doc_id, keep_id, group_size, kept, text_sha256.

        keep_id is the indexed document of an equal text, else the smallest doc_id of its group here;
        group_size counts the rows of docs with that text.
        """
        each = written(digests(docs), "digests")
        groups = written(each.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        fresh = groups.hint("merge").join(self.rows(), "text_sha256", "left_anti")
        fresh.select("text_sha256", F.col("first_id").alias("keep_id")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        decided = written(groups.hint("merge").join(self.rows(), "text_sha256").select("text_sha256", "keep_id", "group_size"), "decided")
        return each.join(decided, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def decided(docs: DataFrame) -> DataFrame:
    """What a new index decides on docs alone."""
    index = DigestIndex(docs.sparkSession)
    out = index.add(docs)
    index.discard()
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is the first of its group, by a new index."""
    each = decided(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return without(docs, written(each.where("not kept").select("doc_id"), "dropped"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
