"""Ingestion of landed pages: projections with defaults, first occurrence wins, validity after the cap, idempotent additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranks import numbered


def stable_id(*parts: Column) -> Column:
    """An id that a repeated run gives again."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def movie_rows(pages: DataFrame) -> DataFrame:
    """Film pages as rows with defaults; a missing and a null field are alike. Votes and popularity are read but not kept."""
    return pages.select("page", "pos", F.col("id").alias("tmdb_id"), F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("overview", F.lit("")).alias("overview"), X.parse_date(F.col("release_date")).alias("release_date"), "poster_path", F.coalesce("genre_ids", F.array().cast("array<int>")).alias("genre_ids")).where("tmdb_id IS NOT NULL")


def review_rows(pages: DataFrame, image_prefix: str) -> DataFrame:
    """Review pages as rows: rating 0 is none, the author's name falls back to the account."""
    d = F.col("author_details")
    return pages.select(
        "tmdb_id", "page", "pos", F.col("id").alias("source_id"), F.coalesce("content", F.lit("")).alias("content"), F.try_to_timestamp("created_at").alias("created_at"),
        F.nullif(d["rating"].cast("double"), F.lit(0.0)).alias("rating"), F.coalesce(X.given(d["name"]), F.coalesce("author", F.lit("Anonymous"))).alias("author_name"), X.image_url(d["avatar_path"], image_prefix).alias("author_avatar_url"),
    )


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first by order; ranks are limited before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def not_yet(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet; existing rows are never changed."""
    return new.join(old.select(key), key, "left_anti")


def capped(rows: DataFrame, key: str, most: int, *order: str | Column) -> DataFrame:
    """The first rows of each key in arrival order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def valid_reviews(rows: DataFrame, key: str, most: int, *order: str | Column, text: str = "content") -> DataFrame:
    """Cap first, then the length filter: short reviews use up places."""
    return capped(rows, key, most, *order).where(X.is_valid_review(F.col(text)))


def genre_links(rows: DataFrame, genres: DataFrame, movie_key: str = "id") -> DataFrame:
    """(movie_id, genre_id) of known genres."""
    ids = rows.select(F.col(movie_key).alias("movie_id"), F.explode("genre_ids").alias("genre_id")).distinct()
    return ids.join(genres.select(F.col("id").alias("genre_id")), "genre_id", "left_semi").select("movie_id", "genre_id")


def get_or_create(names: DataFrame, genres: DataFrame) -> DataFrame:
    """genres with the new names; ids go on from the greatest."""
    new = names.select("name").where("name IS NOT NULL").distinct().join(genres.select("name"), "name", "left_anti")
    top = genres.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = numbered(new, "place", "name").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("place")).cast("int").alias("id"), "name")
    return genres.select("id", "name").unionByName(made)


def payload(reviews: DataFrame, movies: DataFrame, links: DataFrame) -> DataFrame:
    """The vector store's payload: no rating is 0.0, no release year is 2000, genre ids as strings."""
    ids = links.groupBy("movie_id").agg(F.transform(F.sort_array(F.collect_set("genre_id")), lambda x: x.cast("string")).alias("genre_ids"))
    m = movies.select(F.col("id").alias("movie_id"), F.col("title").alias("movie_title"), F.coalesce(F.year("release_date"), F.lit(2000)).alias("year"))
    out = reviews.join(m, "movie_id").join(ids, "movie_id", "left")
    return out.select("id", "movie_id", "movie_title", F.coalesce("rating", F.lit(0.0)).alias("rating"), "year", F.coalesce("genre_ids", F.array().cast("array<string>")).alias("genre_ids"), F.lit("tmdb").alias("source"))


def missing_points(reviews: DataFrame, points: DataFrame) -> DataFrame:
    """Reviews that have no vector yet: what a run has to embed, also after one that broke off."""
    return reviews.where(F.col("source") != "user").select("id").join(points.select("id"), "id", "left_anti")


def orphan_points(points: DataFrame, movies: DataFrame) -> DataFrame:
    return points.select("id", "movie_id").distinct().join(movies.select(F.col("id").alias("movie_id")), "movie_id", "left_anti").select("id", "movie_id")


def ingest(movie_pages: DataFrame, review_pages: DataFrame, genres: DataFrame, old_movies: DataFrame, max_reviews: int = 10, image_prefix: str = "") -> dict[str, DataFrame]:
    """New rows of films, reviews and links from landed pages; films without a valid review come in, but have nothing to embed."""
    films = not_yet(first_wins(movie_rows(movie_pages), "tmdb_id", "page", "pos"), old_movies, "tmdb_id").withColumn("id", stable_id(F.lit("movie"), F.col("tmdb_id")))
    texts = valid_reviews(review_rows(review_pages, image_prefix), "tmdb_id", max_reviews, "page", "pos")
    own = texts.join(films.select("tmdb_id", F.col("id").alias("movie_id")), "tmdb_id").withColumn("id", stable_id(F.lit("review"), F.col("source_id"))).withColumn("source", F.lit("tmdb"))
    return {
        "movies": films.select("id", "tmdb_id", "title", "overview", "release_date", "poster_path"),
        "reviews": own.select("id", "movie_id", "content", "source", "rating", "created_at", "author_name", "author_avatar_url"),
        "movie_genres": genre_links(films, genres),
    }


def with_reviews(movies: DataFrame, reviews: DataFrame, most: int) -> DataFrame:
    """(tmdb_id, title, reviews): each film with its first reviews in order of pages, by one join in the place of a request for each film."""
    few = capped(reviews.select("tmdb_id", "page", "pos", "source_id"), "tmdb_id", most, "page", "pos")
    each = few.groupBy("tmdb_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "pos", "source_id"))), lambda r: r["source_id"]).alias("reviews"))
    return movies.select("tmdb_id", "title").join(each, "tmdb_id", "left").select("tmdb_id", "title", F.coalesce("reviews", F.array().cast("array<string>")).alias("reviews"))


def totals(new: dict[str, DataFrame]) -> DataFrame:
    """What a run brings: films, films with valid reviews, and reviews."""
    r = new["reviews"].agg(F.count_distinct("movie_id").alias("movies_with_reviews"), F.count("*").alias("reviews"))
    return new["movies"].agg(F.count("*").alias("movies")).crossJoin(r)  # one row each


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation whose rows are those that a write of df has put out."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
