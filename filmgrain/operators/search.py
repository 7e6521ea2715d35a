"""Semantic search. The order of steps is part of the result: filter and threshold, first 3 * limit reviews, best review of
each film, first limit films, join with films, genre filter, order by rounded score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..functions import vectors as V
from ..schemas import SearchRequest
from . import catalog

PAYLOAD = ["id", "movie_id", "movie_title"]


def hits(points: DataFrame, query: list[float], req: SearchRequest) -> DataFrame:
    """The first 3 * limit reviews by score; filters reach the scan. A point delivered twice counts once."""
    p = P.payload_filter(req.min_year, req.max_year, req.min_rating)
    rows = points if p is None else points.where(p)
    scored = V.score_against(rows, "vector", query, PAYLOAD, req.threshold, 3 * req.limit)
    once = scored.groupBy("id").agg(F.max(F.struct("score", "movie_id", "movie_title")).alias("s")).select("id", "s.*")
    return once.orderBy(F.desc("score"), "id").limit(3 * req.limit)


def best_per_movie(found: DataFrame, limit: int) -> DataFrame:
    """Each film's best review, then the first limit films; found has at most 150 rows."""
    w = Window.partitionBy("movie_id").orderBy(F.desc("score"), "id")
    return found.where("movie_id IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy(F.desc("score"), "id").limit(limit)


def topk(points: DataFrame, query: list[float], req: SearchRequest) -> DataFrame:
    best = best_per_movie(hits(points, query, req), req.limit)
    return best.select("movie_id", F.col("id").alias("review_id"), F.coalesce("movie_title", F.lit("Unknown")).alias("movie_title"), F.round("score", 4).alias("score"))


def search(points: DataFrame, movies: DataFrame, reviews: DataFrame, movie_genres: DataFrame, genres: DataFrame, query: list[float], req: SearchRequest) -> DataFrame:
    """The full search result; fewer than limit rows are normal, as films are joined and genres filtered last."""
    best = best_per_movie(hits(points, query, req), req.limit)
    few = F.broadcast(best.select("movie_id", "score"))  # at most 50 rows
    rows = movies.join(few, movies["id"] == few["movie_id"]).drop("movie_id")
    shown = F.broadcast(rows.select(F.col("id").alias("movie_id")))
    stats = catalog.with_stats(rows, reviews.join(shown, "movie_id", "left_semi"))
    names = catalog.genre_names(movie_genres.join(shown, "movie_id", "left_semi"), genres).withColumnRenamed("movie_id", "id")
    out = stats.join(names, "id", "left")
    if req.genres:
        out = out.where(P.any_genre(F.col("genres"), req.genres))
    out = out.select(
        F.col("id").alias("movie_id"), "title", F.year("release_date").alias("year"), "poster_path",
        X.shorten(F.col("overview")).alias("overview"), F.coalesce(F.array_join("genres", ","), F.lit("")).alias("genres"),
        "review_count", "average_rating", F.lit("").alias("matched_review"), F.round("score", 4).alias("score"), F.col("score").alias("raw"),
    )
    return out.orderBy(F.desc("score"), F.desc("raw"), "movie_id").limit(req.limit).drop("raw")


def similar_reviews(points: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.5) -> DataFrame:
    rows = V.score_against(points, "vector", query, ["id"], threshold, limit).groupBy("id").agg(F.max("score").alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(limit).select("id", F.round("score", 4).alias("score"))


def response(found: DataFrame, query: str) -> DataFrame:
    """The answer's envelope: the query, how many results there are after all filters, and the results in their order (at most 50)."""
    rows = found.agg(F.count("*").alias("total_results"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "movie_id", "title", "score"))).alias("results"))
    return rows.select(F.lit(query).alias("query"), "total_results", F.transform("results", lambda r: F.struct(r["movie_id"].alias("movie_id"), r["title"].alias("title"), r["score"].alias("score"))).alias("results"))


def score_bucket(score):
    """Named ranges of a score, as a Column."""
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def percent(score):
    return F.round(score * 100).cast("int")
