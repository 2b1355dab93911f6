"""Nearest vectors by an inverted-file index kept in tables.

The index holds each distinct vector once, in the list of its nearest centre, with the ids that have it apart
(`members`). Centres are fitted by k-means on a bounded sample, SAMPLE vectors for each list, drawn by a hash; every
vector is in a list. A search takes the distinct query vectors to their `probes` nearest lists (None: to all, which is
exact; then lists make no difference, and all vectors are dealt out together). Lists and their queries are dealt out in
parts and blocks of bounded size, so neither a list with most of the vectors nor one that most queries probe is one
task's work; a task returns the k + 1 nearest of its part for each query of its block, and those are merged by a top-k
that starts before the shuffle.

`probes_for` measures, on a bounded number of queries searched exactly, how many lists must be probed for a recall.

Distances are Euclidean, in doubles; ties go to the smaller id. Rows without an id are left, as are vectors that are
null, empty, hold a null or non-finite entry or have another length than most (of equal counts the longer).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.skew import skew_join
from lakeloom.sources.shared import written

#: Lists at most, and vectors of the sample for each.
LISTS, SAMPLE = 4096, 64
#: Vectors of a list, and queries that probe it, in one task.
PART, BLOCK = 20_000, 2_000
#: Entries of vectors that a task hands on at once.
ROOM = 2_000_000
#: Queries that are searched exactly to measure recall.
MEASURED = 256


def whole(rows: DataFrame, name: str, vector: str) -> DataFrame:
    """id, v (doubles) of the rows that have both; v's entries are finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where(F.col(name).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(name).cast("long").alias("id"), v.alias("v"))


def classes(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """rows: id, v. The distinct vectors (rep, v; rep their smallest id) and who has them (rep, id), written."""
    distinct = written(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_rows")), f"{path}/distinct")
    members = skew_join(rows, distinct.select("v", "rep"), ["v"], keys=distinct.select("v", "_rows"))
    return distinct.select("rep", "v"), written(members.select("rep", "id"), f"{path}/members")


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centre_order(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each row of x its n nearest centres, the nearest first."""
    far = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    some = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(x), 1))
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


def copies(some: pa.RecordBatch, lists: np.ndarray, d: int):
    """list, rep, v: the rows (rep, v) of some, each for all its lists; ROOM entries of vectors at once, as a vector stands there many times."""
    flat, at, most = lists.ravel().astype(np.int32), np.repeat(np.arange(some.num_rows), lists.shape[1]), max(1, ROOM // d)
    for j in range(0, len(at), most):
        own = pa.array(at[j : j + most])
        yield pa.RecordBatch.from_arrays([pa.array(flat[j : j + most]), some.column(0).take(own), some.column(1).take(own)], names=["list", "rep", "v"])


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray

    @property
    def d(self) -> int:
        return self.centres.shape[1]

    @property
    def lists(self) -> DataFrame:
        """list, rep, v: each distinct vector."""
        return self.spark.read.parquet(f"{self.path}/lists")

    @property
    def members(self) -> DataFrame:
        """rep, id: who has it."""
        return self.spark.read.parquet(f"{self.path}/members")

    @staticmethod
    def build(rows: DataFrame, path: str, name: str, vector: str, lists: int | None = None, seed: int = 1) -> VectorIndex:
        spark = rows.sparkSession
        known = whole(rows, name, vector)
        sizes = known.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
        if not sizes:
            raise ValueError("no vectors")
        d = sizes[0]["d"]
        distinct, _ = classes(known.where(F.size("v") == d), path)
        n = distinct.count()
        lists = min(n, lists or min(LISTS, max(1, round(n**0.5))))
        drawn = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(n)) < SAMPLE * lists).select(array_to_vector("v").alias("features"))
        centres = np.zeros((1, d)) if lists == 1 else np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(drawn).clusterCenters())
        VectorIndex._store(spark, path, centres)
        index = VectorIndex(spark, path, centres)
        dealt = index._probed(distinct, 1).repartition("list", F.pmod(F.xxhash64("rep"), F.lit(8))).sortWithinPartitions("list", "rep")
        dealt.write.parquet(f"{path}/lists")
        return index

    @staticmethod
    def _store(spark: SparkSession, path: str, centres: np.ndarray) -> None:
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        """An index that was built before; its centres are LISTS at most."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
        return VectorIndex(spark, path, np.array([r["centre"] for r in rows]))

    def _probed(self, distinct: DataFrame, probes: int) -> DataFrame:
        """distinct: rep, v. list, rep, v: a row for each of the `probes` nearest lists."""
        held, d = self.spark.sparkContext.broadcast(self.centres), self.d

        def each(batches):
            centres = held.value
            n, step = min(probes, len(centres)), max(1, min(1000, ROOM // len(centres)))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    some = batch.slice(i, step)
                    yield from copies(some, centre_order(matrix(some.column(1), d), centres, n), d)

        return distinct.select("rep", "v").mapInArrow(each, "list int, rep long, v array<double>")

    def _near(self, queries: DataFrame, k: int, probes: int | None) -> DataFrame:
        """queries: rep, v, each vector once. rep, near (a distinct vector of the index), distance: the k nearest."""
        d, lists = self.d, self.lists
        if probes is None:  # each part of all vectors meets each block of all queries
            lists, asked = lists.withColumn("list", F.lit(0)), queries.select(F.lit(0).alias("list"), F.col("rep").alias("query"), F.col("v").alias("w"))
        else:
            asked = self._probed(queries, probes).select("list", F.col("rep").alias("query"), F.col("v").alias("w"))
        size = PART if probes is None else BLOCK
        ours = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).alias("parts"))
        theirs = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("blocks"))
        deal = F.broadcast(ours.join(theirs, "list"))  # a row for each list: LISTS at most
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = lists.join(deal, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("block", upto("blocks")).select("list", "part", "block", "rep", "v")
        right = asked.join(deal, "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks"))).withColumn("part", upto("parts")).select("list", "part", "block", "query", "w")
        keys = ["list", "part", "block"]

        def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"rep": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            x, ids = matrix(a["v"], d), a["rep"].to_numpy()
            norms = (x * x).sum(axis=1)
            out: tuple[list, list, list] = ([], [], [])
            for i in range(0, b.num_rows, 64):
                q, own = matrix(b["w"].slice(i, 64), d), b["query"].slice(i, 64).to_numpy()
                far = norms - 2 * (q @ x.T)
                n = min(len(ids), k + 8)  # some more, as products round
                some = np.argpartition(far, n - 1, axis=1)[:, :n]
                true = np.sqrt(((x[some] - q[:, None, :]) ** 2).sum(axis=2))
                order = np.lexsort((ids[some], true), axis=1)[:, :k]
                out[0].append(np.repeat(own, order.shape[1]))
                out[1].append(np.take_along_axis(ids[some], order, axis=1).ravel())
                out[2].append(np.take_along_axis(true, order, axis=1).ravel())
            return pa.table({c: np.concatenate(v) for c, v in zip(("rep", "near", "distance"), out, strict=True)})

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "rep long, near long, distance double")
        place = F.row_number().over(Window.partitionBy("rep").orderBy("distance", "near"))
        return found.withColumn("place", place).where(F.col("place") <= k).drop("place")

    def search(self, queries: DataFrame, name: str, vector: str, k: int, path: str, probes: int | None = None) -> DataFrame:
        """query_id, near_id, place, distance: for each row of queries its k nearest rows of the index but one of its own id. path: a new folder for the tables between."""
        known = whole(queries, name, vector).where(F.size("v") == self.d)
        distinct, members = classes(known, path)
        near = written(self._near(distinct, k + 1, probes), f"{path}/near")
        # k + 1 ids of a vector are enough, and k + 1 rows of a query vector
        first = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
        some = self.members.withColumn("n", first).where(F.col("n") <= k + 1).select(F.col("rep").alias("near"), F.col("id").alias("near_id"))
        each = near.join(some, "near")
        place = F.row_number().over(Window.partitionBy("rep").orderBy("distance", "near_id"))
        best = written(each.withColumn("n", place).where(F.col("n") <= k + 1).select("rep", "near_id", "distance"), f"{path}/best")
        asked = skew_join(members, best, ["rep"]).where("id <> near_id")
        place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "near_id"))
        return asked.withColumn("place", place).where(F.col("place") <= k).select(F.col("id").alias("query_id"), "near_id", "place", "distance")

    def probes_for(self, recall: float, queries: DataFrame, name: str, vector: str, k: int, path: str) -> int:
        """The least number of lists that hold so much of the k nearest vectors of MEASURED queries or so, drawn by a hash and searched exactly."""
        known = whole(queries, name, vector).where(F.size("v") == self.d)
        drawn = written(known.where(F.pmod(F.xxhash64("id"), F.lit(max(1, known.count()))) < MEASURED).groupBy("v").agg(F.min("id").alias("rep")).select("rep", "v"), f"{path}/drawn")
        near = written(self._near(drawn, k + 1, None), f"{path}/drawn-near")
        own = self.lists.select(F.col("rep").alias("near"), "list")
        found = near.where("distance > 0").join(own, "near").select("rep", "list").collect()  # MEASURED times k or so
        vectors = {r["rep"]: r["v"] for r in drawn.collect()}
        ranks = {rep: np.argsort(centre_order(np.array([v]), self.centres, len(self.centres))[0]) for rep, v in vectors.items()}
        places = np.sort([ranks[r["rep"]][r["list"]] for r in found])
        return int(places[max(0, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else 1
