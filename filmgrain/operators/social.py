"""Likes, added reviews and referential actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def like_parity(toggles: DataFrame, user: str, target: str) -> DataFrame:
    """(target, likes): a pair is liked after an odd number of toggles; counts per pair are combined before the shuffle."""
    pairs = toggles.where(F.col(user).isNotNull() & F.col(target).isNotNull()).groupBy(user, target).agg(F.count("*").alias("n"))
    return pairs.groupBy(target).agg(F.greatest(F.sum(F.col("n") % 2), F.lit(0)).cast("long").alias("likes"))


def like_counts(likes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(id, likes): distinct likers of each review, beside the stale stored count."""
    n = likes.select("user_id", "review_id").distinct().groupBy(F.col("review_id").alias("id")).agg(F.count("*").alias("n"))
    return reviews.select("id", "likes_count").join(n, "id", "left").select("id", F.coalesce("likes_count", F.lit(0)).alias("stored"), F.coalesce("n", F.lit(0)).cast("long").alias("likes"))


def accepted(new: DataFrame, movies: DataFrame) -> DataFrame:
    """New user reviews of films that are there, with content and a rating in range."""
    ok = new.where("length(content) >= 1 AND (rating IS NULL OR rating BETWEEN 0 AND 10)")
    return ok.join(movies.select(F.col("id").alias("movie_id")), "movie_id", "left_semi").withColumns({"source": F.lit("user"), "likes_count": F.lit(0)})


def cascade(children: DataFrame, parents: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Children whose parent is there."""
    return children.join(parents.select(F.col(key).alias(column)), column, "left_semi").select(*children.columns)


def set_null(children: DataFrame, parents: DataFrame, column: str, key: str = "id") -> DataFrame:
    """All children; references to parents that aren't there become NULL."""
    p = parents.select(F.col(key).alias("_key")).distinct()
    out = children.join(p, F.col(column) == F.col("_key"), "left")
    return out.withColumn(column, F.col("_key")).select(*children.columns)


def liked_by(reviews: DataFrame, likes: DataFrame, user: str) -> DataFrame:
    """reviews with is_liked: whether the user likes them; the user reaches the scan of likes."""
    own = likes.where(F.col("user_id") == user).select(F.col("review_id").alias("_review"), F.lit(True).alias("_liked")).distinct()
    out = reviews.join(own, F.col("id") == F.col("_review"), "left")
    return out.withColumn("is_liked", F.coalesce("_liked", F.lit(False))).drop("_review", "_liked")


def review_response(reviews: DataFrame, users: DataFrame, likes: DataFrame, user: str) -> DataFrame:
    """Reviews as they are answered: id, content, author, likes, moment in ISO form, and whether the user likes them."""
    u = users.select(F.col("id").alias("_uid"), "nickname")
    rows = liked_by(reviews, likes, user).join(u, F.col("user_id") == F.col("_uid"), "left")
    name = X.author_name(F.col("author_name"), F.col("nickname"), F.col("_uid").isNotNull(), F.col("source"))
    return rows.select("id", "movie_id", "content", "source", "rating", X.display_name(name).alias("author_name"), F.coalesce("likes_count", F.lit(0)).alias("likes_count"), X.iso(F.col("created_at")).alias("created_at"), "is_liked")


def registered(new: DataFrame, users: DataFrame) -> DataFrame:
    """New users whose name isn't taken, of several with one name the first by id; preferences start empty."""
    first = new.where("username IS NOT NULL").groupBy("username").agg(F.min("id").alias("id"))
    return first.join(users.select("username"), "username", "left_anti").select("id", "username", F.lit("{}").alias("preferences"))
