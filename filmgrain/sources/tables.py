"""Table scans, landed pages, snapshots and upserts on Parquet."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest(df: DataFrame, key: str, by: str, *columns: str) -> DataFrame:
    """One row for each key, the last by a column (ties: the greatest of the other columns); map-side combined, no window.

    columns: the only ones that are wanted, so that no others are read and shuffled; without them all.
    """
    others = [c for c in (columns or df.columns) if c not in (key, by)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(by, *others)).alias("row"))
    return best.select(key, "row.*").select(*(columns or df.columns))


def latest_where(df: DataFrame, key: str, by: str, wanted: Column, *columns: str) -> DataFrame:
    """latest(df).where(wanted), with the condition at the scan: rows that meet it stay if they are their key's last; of all others only key and by are read."""
    some = latest(df.where(wanted), key, by, key, by, *(columns or [c for c in df.columns if c not in (key, by)]))
    newest = df.where(F.col(key).isNotNull()).select(key, by).join(some.select(key), key, "left_semi").groupBy(key).agg(F.max(by).alias("_by"))
    return some.join(newest, key).where(F.col(by).eqNullSafe(F.col("_by"))).select(*(columns or df.columns))


def movies(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Films as last crawled."""
    return latest(table(spark, folder, "movies"), "id", "updated_at", *columns)


def reviews(spark: SparkSession, folder: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Reviews, each once however often it was delivered. where: a condition on columns that a delivery never changes (id, movie_id, content, source)."""
    rows = table(spark, folder, "reviews")
    return latest(rows if where is None else rows.where(where), "id", "ingested_at", *columns)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """At most one row with these values; the conditions reach the scan. No row says that there is none."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.limit(1)


def collection_stats(points: DataFrame, name: str) -> DataFrame:
    """Name, points, different ids, vectors and dimension of a collection."""
    return points.agg(F.lit(name).alias("name"), F.count("*").alias("points"), F.count_distinct("id").alias("ids"), F.count("vector").alias("vectors"), F.max(F.size("vector")).alias("dim"))


def probe(spark: SparkSession) -> DataFrame:
    """One row, if the session answers."""
    return spark.range(1).select(F.lit(1).alias("ok"))


def wait_until(ready: Callable[[], bool], tries: int = 30, pause: float = 1.0) -> bool:
    """Whether ready() comes true (an error counts as no) within so many tries."""
    for i in range(tries):
        if i:
            time.sleep(pause)
        try:
            if ready():
                return True
        except Exception:  # what isn't there yet fails in many ways
            pass
    return False


def drop(spark: SparkSession, path: str) -> bool:
    """Removes a table's folder; says whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def create(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> bool:
    """An empty table, unless there is one (then recreate says to start anew); says whether it was made."""
    if exists(spark, path):
        if not recreate:
            return False
        drop(spark, path)
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def create_all(spark: SparkSession, base: str, reset: bool = False) -> list[str]:
    """The relational tables below base; reset empties them and leaves the vector store as it is. Returns those made."""
    return [name for name, schema in schemas.TABLES.items() if create(spark, f"{base}/{name}", schema, reset)]


def seed(spark: SparkSession, snapshot: str, base: str) -> list[str]:
    """Loads each table of a snapshot that base doesn't have yet; returns their names."""
    return [name for name in schemas.TABLES if exists(spark, f"{snapshot}/{name}.parquet") and restore(spark, f"{snapshot}/{name}.parquet", f"{base}/{name}")]


def movie_pages(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """Landed film pages: one row for each film with its page and place on the page."""
    pages = spark.read.schema(schemas.MOVIE_PAGE).json(path)
    if max_pages is not None:
        pages = pages.where(F.col("page") <= F.least(F.lit(max_pages), F.coalesce("total_pages", F.lit(max_pages))))
    return pages.select("page", F.posexplode("results").alias("pos", "movie")).select("page", "pos", "movie.*")


def review_pages(spark: SparkSession, path: str, max_pages: int = 3) -> DataFrame:
    """Landed review pages of films: one row for each review with the film's number, page and place."""
    pages = spark.read.schema(schemas.REVIEW_PAGE).json(path).where(F.col("page") <= F.least(F.lit(max_pages), F.coalesce("total_pages", F.lit(max_pages))))
    return pages.select(F.col("id").alias("tmdb_id"), "page", F.posexplode("results").alias("pos", "review")).select("tmdb_id", "page", "pos", "review.*")


def genre_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GENRE_PAGE).json(path).select(F.explode("genres").alias("g")).select("g.*")


def discover(spark: SparkSession, base: str, max_pages: int = 50, source: str = "popular") -> DataFrame:
    """Film pages of the popular list, or of the top-rated one for any other source."""
    return movie_pages(spark, f"{base}/{'popular' if source == 'popular' else 'top_rated'}", max_pages)


def concat_pages(*parts: DataFrame) -> DataFrame:
    """Several page scans as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new; of equal keys the one of new stays, of several in new the last by all columns."""
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in new.columns if c != key)))).where("_r = 1").drop("_r")
    return old.join(ranked.select(key), key, "left_anti").select(*old.columns).unionByName(ranked)


def write_version(df: DataFrame, base: str) -> str:
    """Writes a new version folder below base; never over what may be being read. Returns its path."""
    path = f"{base}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, snapshot: str, target: str) -> bool:
    """Copies a snapshot to target unless that exists; says whether it did."""
    if exists(spark, target):
        return False
    spark.read.parquet(snapshot).write.mode("ignore").parquet(target)
    return True


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds absent columns as NULLs of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
