"""A few films with reviews, to try things out without a source."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

#: Films (title, overview, day of release, poster, genres) and their reviews (content, source, rating).
FILMS = [
    ("Inception", "A thief enters dreams to plant an idea.", date(2010, 7, 16), "/inception.jpg", ["Action", "Science Fiction"]),
    ("The Godfather", "A family's youngest son takes over its business.", date(1972, 3, 24), "/godfather.jpg", ["Crime", "Drama"]),
    ("Titanic", "Two passengers fall in love on a ship that sinks.", date(1997, 12, 19), "/titanic.jpg", ["Drama", "Romance", "Action"]),
]
REVIEWS = [
    ("Inception", "Dreams within dreams, and every layer holds.", "imdb", 9.0),
    ("Inception", "Dazzling, though it explains itself too often.", "user", 8.5),
    ("The Godfather", "Quiet rooms have never been so dangerous.", "imdb", 9.5),
    ("Titanic", "The ship is the star, and it sinks beautifully.", "imdb", 8.0),
    ("Titanic", "I knew how it would end and cried all the same.", "user", 8.5),
]


def movies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILMS, "title string, overview string, release_date date, poster_path string, genres array<string>")


def reviews(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REVIEWS, "title string, content string, source string, rating double")
