"""Queries that land pages, ingest them and answer requests, each with the SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import demo
from ..functions import predicates as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import catalog, index, ingest, search, social
from ..schemas import DIM, SearchRequest
from ..session import shared_folder
from ..sources import tables as S
from .catalogue_queries import ACTIVE, HITS, HOT, MOVIES, POINTS, QUERY, REVIEWS, SCORED, _query_vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Films on a page, pages that a film's reviews are spread over, and the prefix of images.
PER_PAGE, REVIEW_PAGES, IMAGES = 20, 40, "https://images.example"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def landed(spark: SparkSession, sf: str) -> str:
    """The tables as pages of JSON, in the shared folder: popular and top-rated films, reviews of films, and genres. Written once per application."""
    base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/landed-{md5(sf.encode()).hexdigest()}"
    if S.exists(spark, f"{base}/genres/_SUCCESS"):  # the last to be written
        return base
    movies = S.table(spark, sf, "movies").where("tmdb_id IS NOT NULL")
    links = S.table(spark, sf, "movie_genres").groupBy(F.col("movie_id").alias("id")).agg(F.sort_array(F.collect_set("genre_id")).alias("genre_ids"))
    film = F.struct(F.col("tmdb_id").alias("id"), "title", "overview", F.col("release_date").cast("string").alias("release_date"), "poster_path", "genre_ids")
    films = movies.join(links, "id", "left").withColumn("page", F.floor(F.col("tmdb_id") / PER_PAGE) + 1).withColumn("film", film)
    for name, some in (("popular", films), ("top_rated", films.where("release_date < DATE '1990-01-01'"))):
        pages = some.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "updated_at", "film"))), lambda x: x["film"]).alias("results"))
        pages.withColumn("total_pages", F.lit(1_000_000)).write.mode("overwrite").json(f"{base}/{name}")
    numbers = movies.groupBy(F.col("id").alias("movie_id")).agg(F.min("tmdb_id").alias("tmdb_id"))
    texts = S.reviews(spark, sf, "id", "movie_id", "content", "rating", "author_name", "author_avatar_url").join(numbers, "movie_id")
    page = 1 + F.conv(F.substring(F.md5("id"), 1, 3), 16, 10).cast("int") % REVIEW_PAGES
    review = F.struct("id", F.col("source_name").alias("author"), "content", F.struct(F.col("author_name").alias("name"), F.col("author_avatar_url").alias("avatar_path"), "rating").alias("author_details"))
    texts = texts.withColumn("source_name", F.lit("account")).select("tmdb_id", page.alias("page"), "id", review.alias("review"))
    pages = texts.groupBy(F.col("tmdb_id").alias("id"), "page").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("k"), "review"))), lambda x: x["review"]).alias("results"))
    pages.withColumn("total_pages", F.lit(REVIEW_PAGES)).write.mode("overwrite").json(f"{base}/reviews")
    S.table(spark, sf, "genres").agg(F.collect_list(F.struct("id", "name")).alias("genres")).write.mode("overwrite").json(f"{base}/genres")
    return base


FILMS = f"""f AS (SELECT *, tmdb_id // {PER_PAGE} + 1 AS page, row_number() OVER (PARTITION BY tmdb_id // {PER_PAGE} ORDER BY id, updated_at) pos FROM movies WHERE tmdb_id IS NOT NULL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tmdb_id ORDER BY page, pos) b FROM f) WHERE b = 1)"""
TEXTS = f"""t AS (SELECT r.*, n.tmdb_id, 1 + ('0x' || substr(md5(r.id), 1, 3))::INT % {REVIEW_PAGES} AS page FROM r JOIN (SELECT id, min(tmdb_id) tmdb_id FROM movies WHERE tmdb_id IS NOT NULL GROUP BY id) n ON n.id = r.movie_id),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tmdb_id ORDER BY page, id) k FROM t WHERE page <= {{pages}}) WHERE k <= {{most}})"""
LONG = f"length(regexp_replace(coalesce(content, ''), '^{X.SPACE}+|{X.SPACE}+$', '', 'g')) >= 20"


def _new(spark: SparkSession, sf: str, old: DataFrame | None = None) -> dict[str, DataFrame]:
    base = landed(spark, sf)
    old = spark.createDataFrame([], "tmdb_id int") if old is None else old
    return ingest.ingest(S.discover(spark, base, 1_000_000), S.review_pages(spark, f"{base}/reviews", 10), S.genre_pages(spark, f"{base}/genres"), old, 10, IMAGES)


@query(f"WITH {FILMS} SELECT md5('movie|' || tmdb_id) AS id, tmdb_id, title, coalesce(overview, '') AS overview, CAST(release_date AS VARCHAR) AS release_date, poster_path FROM w")
def ingest_movies(spark, sf):
    return _new(spark, sf)["movies"].withColumn("release_date", F.col("release_date").cast("string"))


@query(f"WITH {FILMS} SELECT tmdb_id FROM w WHERE tmdb_id NOT IN (SELECT tmdb_id FROM movies WHERE tmdb_id IS NOT NULL AND release_date < DATE '2000-01-01')")
def ingest_again(spark, sf):
    """A second run over the same pages, when the films before 2000 are there already."""
    old = S.table(spark, sf, "movies").where("release_date < DATE '2000-01-01'").select("tmdb_id")
    return _new(spark, sf, old)["movies"].select("tmdb_id")


@query(f"""WITH {REVIEWS}, {TEXTS.format(pages=10, most=10)} SELECT md5('review|' || id) AS id, md5('movie|' || tmdb_id) AS movie_id, md5(coalesce(content, '')) AS content_hash, 'tmdb' AS source, nullif(rating, 0) AS rating,
coalesce(nullif(author_name, ''), 'account') AS author_name, CASE WHEN nullif(author_avatar_url, '') IS NOT NULL THEN '{IMAGES}' || author_avatar_url END AS author_avatar_url FROM c WHERE {LONG}""")
def ingest_reviews(spark, sf):
    rows = _new(spark, sf)["reviews"]
    return rows.select("id", "movie_id", F.md5("content").alias("content_hash"), "source", "rating", "author_name", "author_avatar_url")


@query(f"WITH {FILMS} SELECT DISTINCT md5('movie|' || w.tmdb_id) AS movie_id, genre_id FROM w JOIN movie_genres g ON g.movie_id = w.id WHERE genre_id IN (SELECT id FROM genres)")
def ingest_links(spark, sf):
    return _new(spark, sf)["movie_genres"]


@query(f"WITH {FILMS}, {REVIEWS}, {TEXTS.format(pages=10, most=10)} SELECT (SELECT count(*) FROM w) AS movies, count(DISTINCT tmdb_id) AS movies_with_reviews, count(*) AS reviews FROM c WHERE {LONG}")
def ingest_totals(spark, sf):
    return ingest.totals(_new(spark, sf))


@query("SELECT id, name FROM genres WHERE id NOT IN (SELECT id FROM genres WHERE id % 2 = 0)")
def ingest_genres(spark, sf):
    return ingest.not_yet(S.genre_pages(spark, f"{landed(spark, sf)}/genres"), S.table(spark, sf, "genres").where("id % 2 = 0"), "id")


@query(f"""WITH {FILMS} SELECT 'popular' AS list, page, count(*) AS films FROM f WHERE page <= 80 GROUP BY page
UNION ALL SELECT 'other', page, count(*) FROM f WHERE page <= 80 AND release_date < DATE '1990-01-01' GROUP BY page""")
def discover_pages(spark, sf):
    base = landed(spark, sf)
    lists = [S.discover(spark, base, 80, name).groupBy("page").agg(F.count("*").alias("films")).withColumn("list", F.lit(name)) for name in ("popular", "other")]
    return S.concat_pages(*lists)


@query(f"""WITH {FILMS}, {REVIEWS}, {TEXTS.format(pages=3, most=5)}, e AS (SELECT tmdb_id, string_agg(id, ',' ORDER BY page, id) ids FROM c GROUP BY 1)
SELECT w.tmdb_id, coalesce(ids, '') AS reviews FROM w LEFT JOIN e ON e.tmdb_id = w.tmdb_id""")
def movies_with_reviews(spark, sf):
    base = landed(spark, sf)
    films = ingest.first_wins(ingest.movie_rows(S.discover(spark, base, 1_000_000)), "tmdb_id", "page", "pos")
    return ingest.with_reviews(films, ingest.review_rows(S.review_pages(spark, f"{base}/reviews", 3), IMAGES), 5).select("tmdb_id", F.array_join("reviews", ",").alias("reviews"))


@query(f"WITH {REVIEWS} SELECT id, {DIM} AS dim, 1.0 AS norm FROM r WHERE {LONG}")
def embed_missing(spark, sf):
    """Vectors of all valid reviews: their dimension and length."""
    rows = S.reviews(spark, sf, "id", "content").where(X.is_valid_review(F.col("content")))
    v = rows.select("id", V.embed(X.preprocess(F.col("content"))).alias("vector"))
    return v.select("id", F.size("vector").alias("dim"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("norm"))


@query(f"""WITH {POINTS}, {QUERY}, {SCORED}, {HITS.format(t=0.2, f='AND year >= 1980', k3=150, k=50)}, {MOVIES}, o AS (SELECT m.id, m.title, round(score, 4) score FROM best JOIN m ON m.id = best.movie_id)
SELECT 'slow ferry' AS query, count(*) AS total_results, string_agg(id || ':' || score, ',' ORDER BY score DESC, id) AS results FROM o""")
def search_response(spark, sf):
    points, movies = S.table(spark, sf, "movie_reviews"), S.movies(spark, sf)
    links, genres = S.table(spark, sf, "movie_genres"), S.table(spark, sf, "genres")
    req = SearchRequest(limit=50, min_year=1980, threshold=0.2, query="  slow ferry ")
    found = search.search(points, movies, S.reviews(spark, sf, "id", "movie_id", "rating"), links, genres, _query_vector(spark, sf), req)
    out = search.response(found, req.query.strip())
    return out.select("query", "total_results", F.array_join(F.transform("results", lambda r: F.concat(r["movie_id"], F.lit(":"), r["score"].cast("string"))), ",").alias("results"))


@query(f"WITH {POINTS}, {QUERY}, {SCORED} SELECT id, round(score, 4) AS score FROM s WHERE score >= 0.5 AND year >= 1980 ORDER BY score DESC, id LIMIT 10")
def search_index(spark, sf):
    """The ten most similar points through the index of the collection."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/index-{md5(sf.encode()).hexdigest()}"
    index.build(S.table(spark, sf, "movie_reviews"), path, recreate=False)
    return index.search(spark, path, _query_vector(spark, sf), 10, 0.5, P.payload_filter(1980))


@query("SELECT 1 AS ok")
def probe(spark, sf):
    return S.probe(spark)


@query(f"WITH {REVIEWS} SELECT id, movie_id, source FROM r WHERE id = (SELECT max(id) FROM reviews)")
def review_lookup(spark, sf):
    top = S.table(spark, sf, "reviews").agg(F.max("id")).first()[0]
    return S.lookup(S.reviews(spark, sf, "id", "movie_id", "source", where=F.col("id") == top))


@query("SELECT id, username FROM users WHERE username = (SELECT max(username) FROM users) ORDER BY id LIMIT 1")
def user_lookup(spark, sf):
    users = S.table(spark, sf, "users")
    return S.lookup(users.select("id", "username"), username=users.agg(F.max("username")).first()[0])


@query(f"WITH {MOVIES} SELECT id, tmdb_id FROM m WHERE tmdb_id = (SELECT max(tmdb_id) FROM movies)")
def tmdb_lookup(spark, sf):
    top = S.table(spark, sf, "movies").agg(F.max("tmdb_id")).first()[0]
    return S.lookup(S.latest_where(S.table(spark, sf, "movies"), "id", "updated_at", F.col("tmdb_id") == top, "id", "tmdb_id", "updated_at")).select("id", "tmdb_id")


@query("SELECT id, name, 'id' AS by FROM genres WHERE id = (SELECT min(id) FROM genres) UNION ALL SELECT id, name, 'name' FROM genres WHERE name = (SELECT max(name) FROM genres)")
def genre_lookup(spark, sf):
    g = S.table(spark, sf, "genres").select("id", "name")
    low, high = g.agg(F.min("id"), F.max("name")).first()
    return S.lookup(g, id=low).withColumn("by", F.lit("id")).unionByName(S.lookup(g, name=high).withColumn("by", F.lit("name")))


@query(f"SELECT DISTINCT user_id, review_id FROM review_likes WHERE user_id = {ACTIVE} AND review_id = (SELECT max(review_id) FROM review_likes WHERE user_id = {ACTIVE})")
def like_lookup(spark, sf):
    likes = S.table(spark, sf, "review_likes")
    user = likes.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()["user_id"]
    review = likes.where(F.col("user_id") == user).agg(F.max("review_id")).first()[0]
    return S.lookup(likes.select("user_id", "review_id"), user_id=user, review_id=review)


@query("SELECT DISTINCT id, TRY_CAST(id AS UUID) IS NOT NULL AS ok FROM movies UNION SELECT username, TRY_CAST(username AS UUID) IS NOT NULL FROM users")
def uuid_check(spark, sf):
    ids = S.table(spark, sf, "movies").select("id").unionByName(S.table(spark, sf, "users").select(F.col("username").alias("id")))
    return ids.distinct().select("id", X.is_uuid(F.col("id")).alias("ok"))


@query(f"""WITH {REVIEWS} SELECT r.id, r.movie_id, md5(r.content) AS content_hash, r.rating, coalesce(nullif(r.author_name, ''), CASE WHEN u.id IS NOT NULL THEN u.nickname END, CASE r.source WHEN 'tmdb' THEN 'TMDB Reviewer' ELSE r.source END) AS author_name,
coalesce(r.likes_count, 0) AS likes_count, strftime(r.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, r.id IN (SELECT review_id FROM review_likes WHERE user_id = {ACTIVE}) AS is_liked FROM r LEFT JOIN users u ON u.id = r.user_id WHERE r.movie_id = {HOT}""")
def review_response(spark, sf):
    from .catalogue_queries import _hot

    hot, likes = _hot(spark, sf), S.table(spark, sf, "review_likes")
    user = likes.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()["user_id"]
    out = social.review_response(S.reviews(spark, sf, where=F.col("movie_id") == hot), S.table(spark, sf, "users"), likes, user)
    return out.select("id", "movie_id", F.md5("content").alias("content_hash"), "rating", "author_name", "likes_count", "created_at", "is_liked")


@query("""SELECT id, CASE WHEN json_valid(preferences) THEN json_extract_string(preferences, '$.theme') END AS value FROM users""")
def user_preference(spark, sf):
    return catalog.preference(S.table(spark, sf, "users"), "theme")


@query("""SELECT min(id) AS id, nickname AS username, '{}' AS preferences FROM users WHERE nickname IS NOT NULL AND nickname NOT IN (SELECT username FROM users WHERE username IS NOT NULL) GROUP BY nickname""")
def register_users(spark, sf):
    """Nicknames as the user names of new users."""
    users = S.table(spark, sf, "users")
    return social.registered(users.select("id", F.col("nickname").alias("username")), users)


@query("SELECT DISTINCT source, CASE source WHEN 'tmdb' THEN 'TMDB Reviewer' ELSE source END AS shown FROM reviews")
def source_names(spark, sf):
    return S.table(spark, sf, "reviews").select("source").distinct().select("source", X.display_name(F.col("source")).alias("shown"))


@query("SELECT 3 AS movies, 5 AS reviews, 5 AS genres, 8.0 AS least_rating, 9.5 AS most_rating")
def mock_load(spark, sf):
    movies, reviews = demo.movies(spark), demo.reviews(spark)
    g = movies.select(F.explode("genres").alias("g")).agg(F.count_distinct("g").cast("int").alias("genres"))
    r = reviews.agg(F.count("*").cast("int").alias("reviews"), F.min("rating").alias("least_rating"), F.max("rating").alias("most_rating"))
    return movies.agg(F.count("*").cast("int").alias("movies")).crossJoin(g).crossJoin(r)  # one row each
