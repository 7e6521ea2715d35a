"""Schemas of the tables and of landed JSON pages, and the ranges of request parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields


MOVIES = "id string, tmdb_id int, title string, overview string, release_date date, poster_path string, created_at timestamp_ntz, updated_at timestamp_ntz"
REVIEWS = "id string, movie_id string, content string, source string, rating double, created_at timestamp_ntz, user_id string, author_name string, author_avatar_url string, likes_count int"
GENRES = "id int, name string"
MOVIE_GENRES = "movie_id string, genre_id int"
USERS = "id string, username string, nickname string, email string, avatar_url string, preferences string, created_at timestamp_ntz"
REVIEW_LIKES = "user_id string, review_id string, created_at timestamp_ntz"
WATCHLIST = "id string, user_id string, movie_id string, status string, created_at timestamp_ntz"
POINTS = "id string, vector array<float>, movie_id string, movie_title string, rating double, year int, genre_ids array<string>, source string"
DIM = 384
#: The relational tables by name.
TABLES = {"movies": MOVIES, "reviews": REVIEWS, "genres": GENRES, "movie_genres": MOVIE_GENRES, "users": USERS, "review_likes": REVIEW_LIKES, "watchlist": WATCHLIST}

#: A page of films, of reviews and of genres as they land; missing and null fields read alike.
MOVIE_PAGE = "page int, total_pages int, results array<struct<id: int, title: string, original_title: string, overview: string, release_date: string, poster_path: string, backdrop_path: string, vote_average: double, vote_count: int, popularity: double, genre_ids: array<int>>>"
REVIEW_PAGE = "id int, page int, total_pages int, results array<struct<id: string, author: string, content: string, created_at: string, url: string, author_details: struct<name: string, avatar_path: string, rating: double>>>"
GENRE_PAGE = "genres array<struct<id: int, name: string>>"


def _within(name: str, value, low, high) -> None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class SearchRequest:
    """Parameters of the semantic search. Falsy filters (None, empty, and 0 for years) mean no filter."""

    limit: int = 10
    min_year: int | None = None
    max_year: int | None = None
    min_rating: float | None = None
    genres: tuple[str, ...] = field(default=())
    threshold: float = 0.3
    query: str | None = None

    def __post_init__(self) -> None:
        if self.query is not None:
            _within("length of query", len(self.query.strip()), 2, 500)
        _within("limit", self.limit, 1, 50)
        _within("min_year", self.min_year, 1900, 2100)
        _within("max_year", self.max_year, 1900, 2100)
        _within("min_rating", self.min_rating, 0, 10)


@dataclass(frozen=True)
class ReviewRequest:
    """A review that a user posts."""

    content: str
    rating: float | None = None

    def __post_init__(self) -> None:
        if not self.content:
            raise ValueError("content must not be empty")
        _within("rating", self.rating, 0, 10)


@dataclass(frozen=True)
class Settings:
    """Settings of a run: defaults, over which variables with the prefix go."""

    tables: str = "tables"
    collection: str = "movie_reviews"
    image_prefix: str = ""
    max_pages: int = 10
    max_reviews: int = 10
    dim: int = DIM
    threshold: float = 0.3

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "FILMGRAIN_") -> Settings:
        given = {f.name: values[prefix + f.name.upper()] for f in fields(cls) if values.get(prefix + f.name.upper())}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items()})


@dataclass(frozen=True)
class ListRequest:
    """Parameters of the catalogue list."""

    page: int = 1
    page_size: int = 20
    genre: str | None = None
    year: int | None = None
    title: str | None = None

    def __post_init__(self) -> None:
        if self.page < 1:
            raise ValueError("page must be at least 1")
        _within("page_size", self.page_size, 1, 100)
