"""The catalogue: list, detail, genres, rating statistics, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..schemas import ListRequest
from .ranks import numbered

#: Genres up to which their names are sent to every task.
MOST_GENRES = 100_000


def rating_stats(reviews: DataFrame) -> DataFrame:
    """(movie_id, review_count, average_rating): NULL and zero ratings count as reviews but not for the average."""
    rated = F.when(F.col("rating") != 0, F.col("rating"))
    return reviews.where("movie_id IS NOT NULL").groupBy("movie_id").agg(F.count("*").alias("review_count"), F.round(F.avg(rated), 6).alias("average_rating"))


def with_stats(movies: DataFrame, reviews: DataFrame) -> DataFrame:
    stats = rating_stats(reviews).withColumnRenamed("movie_id", "id")
    return movies.join(stats, "id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)).cast("long"))


def genre_names(movie_genres: DataFrame, genres: DataFrame) -> DataFrame:
    """(movie_id, genres): sorted names; ids without a genre are dropped."""
    links = movie_genres.select("movie_id", "genre_id").distinct()
    return links.join(genres.select(F.col("id").alias("genre_id"), "name"), "genre_id").groupBy("movie_id").agg(F.sort_array(F.collect_list("name")).alias("genres"))


def filtered(movies: DataFrame, movie_genres: DataFrame, genres: DataFrame, req: ListRequest) -> DataFrame:
    """Films that the list's filters let through; the genre filter is a semi-join, so no film comes twice."""
    parts: list[Column] = []
    if req.year:
        parts.append(P.in_year(F.col("release_date"), req.year))
    if req.title:
        parts.append(X.contains_ilike(F.col("title"), req.title))
    out = movies if (p := P.all_of(parts)) is None else movies.where(p)
    if req.genre:
        named = genres.where(X.contains_ilike(F.col("name"), req.genre)).select(F.col("id").alias("genre_id"))
        out = out.join(movie_genres.join(named, "genre_id", "left_semi").select(F.col("movie_id").alias("id")), "id", "left_semi")
    return out


def total(movies: DataFrame, movie_genres: DataFrame, genres: DataFrame, req: ListRequest) -> DataFrame:
    return filtered(movies, movie_genres, genres, req).agg(F.count_distinct("id").alias("total"))


def page(movies: DataFrame, reviews: DataFrame, movie_genres: DataFrame, genres: DataFrame, req: ListRequest) -> DataFrame:
    """One page, newest first (ties by id), with genres and statistics of the page's films only."""
    rows = filtered(movies, movie_genres, genres, req).orderBy(F.desc("created_at"), "id").offset((req.page - 1) * req.page_size).limit(req.page_size)
    rows = rows.select("id", "tmdb_id", "title", "overview", "release_date", "poster_path", "created_at")
    shown = F.broadcast(rows.select("id"))  # at most 100 rows
    own = reviews.join(shown.withColumnRenamed("id", "movie_id"), "movie_id", "left_semi")
    names = genre_names(movie_genres.join(shown.withColumnRenamed("id", "movie_id"), "movie_id", "left_semi"), genres)
    return with_stats(rows, own).join(names.withColumnRenamed("movie_id", "id"), "id", "left").withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def detail_reviews(reviews: DataFrame, users: DataFrame, movie_id: str, places: bool = True) -> DataFrame:
    """A film's reviews with display names and avatars, and with their places, newest first (ties by id), or their created_at."""
    own = reviews.where(F.col("movie_id") == movie_id).alias("r")
    u = users.select(F.col("id").alias("uid"), "nickname", "avatar_url").alias("u")
    rows = own.join(u, F.col("r.user_id") == F.col("uid"), "left")
    name = X.author_name(F.col("author_name"), F.col("nickname"), F.col("uid").isNotNull(), F.col("source"))
    avatar = F.coalesce(X.given(F.col("author_avatar_url")), F.col("avatar_url"))
    out = rows.select("id", "content", "source", "rating", name.alias("author_name"), avatar.alias("author_avatar"), F.coalesce("likes_count", F.lit(0)).alias("likes_count"), "created_at")
    return out if not places else numbered(out, "place", F.desc("created_at"), "id").withColumn("place", F.col("place").cast("int")).drop("created_at")


def detail(movies: DataFrame, reviews: DataFrame, users: DataFrame, movie_genres: DataFrame, genres: DataFrame, movie_id: str) -> DataFrame:
    """One film with its genres and nested reviews; no average, as the reference has none here."""
    one = movies.where(F.col("id") == movie_id)
    w = F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "id", "author_name", "rating", "likes_count", "content")
    nested = detail_reviews(reviews, users, movie_id, False).agg(F.sort_array(F.collect_list(w)).alias("reviews"))
    names = genre_names(movie_genres.where(F.col("movie_id") == movie_id), genres).withColumnRenamed("movie_id", "id")
    out = one.join(names, "id", "left").crossJoin(F.broadcast(nested))  # one row each
    return out.select("id", "title", "overview", "release_date", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), F.size("reviews").cast("long").alias("review_count"), "reviews")


def genre_list(genres: DataFrame) -> DataFrame:
    return genres.select("id", "name").distinct().orderBy("name", "id")


def genre_name_or_unknown(ids: DataFrame, genres: DataFrame, column: str) -> DataFrame:
    """ids with the genre's name; ids without a genre, or that are no numbers, are Unknown."""
    names = genres.select(F.col("id").alias("_gid"), F.col("name").alias("_name"))
    out = ids.join(F.broadcast(names) if names.count() <= MOST_GENRES else names, F.col(column).try_cast("int") == F.col("_gid"), "left")
    return out.withColumn("name", F.coalesce("_name", F.lit("Unknown"))).drop("_gid", "_name")


def cards(movies: DataFrame, image_prefix: str) -> DataFrame:
    """What a film's card shows: year, date, initial, overview and poster with their defaults."""
    d = F.col("release_date")
    return movies.select("id", F.coalesce(F.year(d).cast("string"), F.lit("N/A")).alias("year"), F.date_format(d, "d/M/yyyy").alias("shown_date"), X.initial(F.col("title")).alias("initial"), F.coalesce(X.given(F.col("overview")), F.lit("No overview")).alias("overview"), X.image_url(F.col("poster_path"), image_prefix).alias("poster"))


def public_users(users: DataFrame) -> DataFrame:
    """What others see of users."""
    return users.select("id", "username", "nickname", "email", "avatar_url")


def preference(users: DataFrame, name: str) -> DataFrame:
    """(id, value): one preference of each user as text; NULL where there is none or the JSON is broken."""
    value = F.try_variant_get(F.try_parse_json("preferences"), f"$.{name}", "string")
    return users.select("id", value.alias("value"))


def health(movies: DataFrame | None, points: DataFrame | None) -> DataFrame:
    """Counts of both stores, and whether both can be read (None: one can't); empty stores are healthy."""
    some = movies if movies is not None else points
    if some is None:
        raise ValueError("neither store can be read")
    m = some.agg(F.count("*").alias("movies")) if movies is not None else some.agg(F.lit(0).cast("long").alias("movies"))
    p = points.agg(F.count("*").alias("points"), F.max(F.size("vector")).alias("dim")) if points is not None else some.agg(F.lit(0).cast("long").alias("points"), F.lit(None).cast("int").alias("dim"))
    up = F.lit(movies is not None) & F.lit(points is not None)
    return m.crossJoin(p).withColumn("status", F.when(up, "healthy").otherwise("degraded"))  # one row each
