"""An index of a vector collection: points in lists around centres, so that a search reads a few lists and not all vectors.

build fits the centres by a few steps of k-means on a bounded sample of different vectors, puts each point into the list of its
nearest centre, and writes a folder for each list, sorted by year, with the payload beside the vector: year and rating are skipped
by their statistics. search reads the lists of the centres nearest to the query; collections of fewer than EXACT points are
read whole, as an index doesn't pay there.

Defined results: points without an id or a usable vector are not in the index; of a point delivered twice the best row counts;
an empty collection gives an empty index and no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..schemas import DIM
from ..sources.tables import create, exists

#: Vectors that the centres are fitted to, points in a list, lists at most, steps of k-means, and the share of lists that a search reads.
SAMPLE, LIST, MOST_LISTS, STEPS, SHARE = 8192, 4000, 4096, 8, 0.25
#: Fixed value: points from which on the index is used.
EXACT = 10_000
KEPT = ("id", "movie_id", "movie_title", "rating", "year", "genre_ids", "source")


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    c = x[np.random.default_rng(1).choice(len(x), k, replace=False)]
    for _ in range(STEPS):
        own = (x @ c.T).argmax(1)
        for i in range(k):
            if (own == i).any():
                m = x[own == i].mean(0)
                c[i] = m / (np.linalg.norm(m) or 1)
    return c


def _assign(centres: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = V._matrix(batch.column("vector"), centres.shape[1])
            own = (x @ centres.T).argmax(1) if len(x) else np.zeros(0, np.int64)
            part = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(own.astype(np.int32))], [*names, "list"])

    return run


def build(points: DataFrame, path: str, dim: int = DIM, recreate: bool = True) -> bool:
    """Writes the index of points to path, unless there is one that is to be kept; says whether it did."""
    spark = points.sparkSession
    if exists(spark, f"{path}/points") and not recreate:
        return False
    rows = points.where(F.col("id").isNotNull() & (F.size("vector") == dim)).select(*KEPT, F.col("vector").cast("array<float>").alias("vector"))
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("vector"), F.lit(max(n, 1))) < SAMPLE).select("vector").distinct().toArrow()
    x = V._matrix(sample.column("vector").combine_chunks(), dim)[1] if sample.num_rows else np.zeros((0, dim))
    x = np.unique(x, axis=0)
    lists = min(max(16, n // LIST), MOST_LISTS, max(len(x) // 2, 1))
    centres = _centres(x, lists) if len(x) else np.zeros((1, dim))
    spark.createDataFrame([(i, c.tolist(), n) for i, c in enumerate(centres)], "list int, centre array<double>, points long").write.mode("overwrite").parquet(f"{path}/centres")
    placed = rows.mapInArrow(_assign(centres, rows.columns), T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))
    # a list of many points is written by several tasks
    placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (lists * LIST))))).sortWithinPartitions("list", "year").write.mode("overwrite").partitionBy("list").parquet(f"{path}/points")
    return True


def create_collection(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> bool:
    """An empty collection, unless there is one and it is to be kept."""
    return create(spark, f"{path}/points", schema, recreate)


def search(spark: SparkSession, path: str, query: list[float], limit: int, threshold: float, condition: Column | None = None, share: float = SHARE) -> DataFrame:
    """(id, score) of the limit most similar points in the nearest lists, at least four of them; condition is on the payload and reaches the scan."""
    if not exists(spark, f"{path}/points/_SUCCESS"):
        raise ValueError(f"no index at {path}")
    q = np.asarray(query, np.float64)
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").toPandas()
    order = np.argsort(-(np.stack(centres["centre"]) @ q), kind="stable")
    near = [int(centres["list"][i]) for i in order[: len(order) if centres["points"][0] < EXACT else max(4, round(share * len(order)))]]
    if not centres["points"][0]:
        return spark.createDataFrame([], "id string, score double")
    rows = spark.read.parquet(f"{path}/points").where(F.col("list").isin(near))
    if condition is not None:
        rows = rows.where(condition)
    scored = V.score_against(rows, "vector", query, ["id"], threshold, limit).groupBy("id").agg(F.max("score").alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit).select("id", F.round("score", 4).alias("score"))
