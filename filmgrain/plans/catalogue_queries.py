"""Queries over the catalogue's own operators, each with the SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import catalog, ingest, search, social
from ..schemas import DIM, ListRequest, SearchRequest
from ..sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

USABLE = f"vector IS NOT NULL AND len(vector) = {DIM} AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0"
MOVIES = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) rn FROM movies) WHERE rn = 1)"
REVIEWS = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) rn FROM reviews) WHERE rn = 1)"
POINTS = f"p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) rn FROM movie_reviews WHERE {USABLE}) WHERE rn = 1)"
QUERY = "q AS (SELECT vector::DOUBLE[] qv FROM p ORDER BY id LIMIT 1)"
SCORED = "s AS (SELECT p.*, list_cosine_similarity(vector::DOUBLE[], qv) score FROM p, q)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The usable vector with the least id stands in for an embedded query."""
    rows = S.table(spark, sf, "movie_reviews").where(f"size(vector) = {DIM} AND exists(vector, x -> x <> 0)")
    return list(rows.orderBy("id").select("vector").first()["vector"])


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    return S.table(spark, sf, "movie_reviews"), S.movies(spark, sf), S.reviews(spark, sf, "id", "movie_id", "rating"), S.table(spark, sf, "movie_genres"), S.table(spark, sf, "genres")


HITS = """hits AS (SELECT * FROM s WHERE score >= {t} {f} ORDER BY score DESC, id LIMIT {k3}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY score DESC, id) b FROM hits WHERE movie_id IS NOT NULL) WHERE b = 1 ORDER BY score DESC, id LIMIT {k})"""


@query(f"WITH {POINTS}, {QUERY}, {SCORED}, {HITS.format(t=0.3, f='', k3=30, k=10)} SELECT movie_id, id AS review_id, coalesce(movie_title, 'Unknown') AS movie_title, round(score, 4) AS score FROM best")
def search_topk(spark, sf):
    return search.topk(S.table(spark, sf, "movie_reviews"), _query_vector(spark, sf), SearchRequest(limit=10))


@query(f"WITH {POINTS}, {QUERY}, {SCORED}, {HITS.format(t=0.2, f='AND year >= 1990 AND year <= 2015 AND rating >= 6', k3=60, k=20)} SELECT movie_id, id AS review_id, coalesce(movie_title, 'Unknown') AS movie_title, round(score, 4) AS score FROM best")
def search_filtered(spark, sf):
    return search.topk(S.table(spark, sf, "movie_reviews"), _query_vector(spark, sf), SearchRequest(limit=20, min_year=1990, max_year=2015, min_rating=6.0, threshold=0.2))


STATS = "st AS (SELECT movie_id, count(*) n, round(avg(CASE WHEN rating <> 0 THEN rating END), 6) a FROM r WHERE movie_id IS NOT NULL GROUP BY movie_id)"
NAMES = "g AS (SELECT movie_id, list_sort(list(name)) names FROM (SELECT DISTINCT movie_id, genre_id FROM movie_genres) JOIN genres ON genres.id = genre_id GROUP BY movie_id)"


@query(f"""WITH {POINTS}, {QUERY}, {SCORED}, {HITS.format(t=0.2, f='AND year >= 1980', k3=150, k=50)}, {MOVIES}, {REVIEWS}, {STATS}, {NAMES}
SELECT m.id AS movie_id, m.title, year(m.release_date)::INT AS year, m.poster_path, CASE WHEN length(m.overview) > 200 THEN substr(m.overview, 1, 200) || '...' ELSE m.overview END AS overview,
array_to_string(names, ',') AS genres, coalesce(n, 0) AS review_count, a AS average_rating, '' AS matched_review, round(score, 4) AS score
FROM best JOIN m ON m.id = best.movie_id LEFT JOIN st ON st.movie_id = m.id LEFT JOIN g ON g.movie_id = m.id
WHERE list_has_any(names, ['Drama', 'Comedy', 'Horror', 'Action']) ORDER BY round(score, 4) DESC, score DESC, m.id LIMIT 50""")
def search_enriched(spark, sf):
    points, movies, reviews, links, genres = _tables(spark, sf)
    return search.search(points, movies, reviews, links, genres, _query_vector(spark, sf), SearchRequest(limit=50, min_year=1980, genres=("Drama", "Comedy", "Horror", "Action"), threshold=0.2))


@query(f"WITH {POINTS}, {QUERY}, {SCORED} SELECT id, round(score, 4) AS score FROM s WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 10")
def similar_reviews(spark, sf):
    return search.similar_reviews(S.table(spark, sf, "movie_reviews"), _query_vector(spark, sf))


@query(f"WITH {POINTS}, qs AS (SELECT id qid, vector::DOUBLE[] qv FROM p ORDER BY id LIMIT 10) SELECT qid AS query_id, id, round(list_cosine_similarity(vector::DOUBLE[], qv), 6) AS score FROM p, qs WHERE list_cosine_similarity(vector::DOUBLE[], qv) >= 0.25")
def cosine_pairs(spark, sf):
    rows = S.table(spark, sf, "movie_reviews").where(f"size(vector) = {DIM} AND exists(vector, x -> x <> 0)")
    ids = [r["id"] for r in rows.select("id").distinct().orderBy("id").limit(10).collect()]
    first = {r["id"]: list(r["vector"]) for r in rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).collect()}
    return V.score_many(rows, "id", "vector", first, 0.25).groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))


#: Query vectors that are held at a time.
QUERY_BLOCK = 4096


@query("SELECT q.vec_id::VARCHAR AS query_id, e.vec_id::VARCHAR AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.25")
def cosine_pairs_stated(spark, sf):
    """Every row whose id is divisible by 50 against all rows; cosine_pairs is the small form with ten queries."""
    rows = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0")
    blocks, out = max(1, -(-asked.count() // (QUERY_BLOCK * 3 // 4))), None
    for b in range(blocks):
        block = {str(r["vec_id"]): list(r["embedding"]) for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toLocalIterator()}
        if block:
            part = V.score_many(rows, "vec_id", "embedding", block, 0.25)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id string, id string, score double")
    return out.withColumn("score", F.round("score", 6))


@query("SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings")
def cosine_expression(spark, sf):
    rows = S.table(spark, sf, "embeddings")
    one = [float(x) for x in rows.where("vec_id = 7").select("embedding").first()["embedding"]]
    return rows.select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.lit(one)), 6).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e) score FROM embeddings, q)
SELECT vec_id, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, round(score * 100)::INT AS percent FROM s""")
def score_bucket(spark, sf):
    rows = S.table(spark, sf, "embeddings")
    one = [float(x) for x in rows.where("vec_id = 7").select("embedding").first()["embedding"]]
    scored = rows.select("vec_id", V.cosine(F.col("embedding"), F.lit(one)).alias("score"))
    return scored.select("vec_id", search.score_bucket(F.col("score")).alias("bucket"), search.percent(F.col("score")).alias("percent"))


LIST = ListRequest(page=2, page_size=10, genre="dr", title="e")
FILTER = "lower(m.title) LIKE '%e%' AND m.id IN (SELECT movie_id FROM movie_genres mg JOIN genres g ON g.id = mg.genre_id WHERE lower(g.name) LIKE '%dr%')"


@query(f"""WITH {MOVIES}, {REVIEWS}, {STATS}, {NAMES}, pg AS (SELECT * FROM m WHERE {FILTER} ORDER BY created_at DESC, id LIMIT 10 OFFSET 10)
SELECT pg.id, pg.tmdb_id, pg.title, CAST(pg.release_date AS VARCHAR) AS release_date, array_to_string(coalesce(names, []), ',') AS genres, coalesce(n, 0) AS review_count, a AS average_rating FROM pg LEFT JOIN st ON st.movie_id = pg.id LEFT JOIN g ON g.movie_id = pg.id""")
def movies_list_page(spark, sf):
    _, movies, reviews, links, genres = _tables(spark, sf)
    rows = catalog.page(movies, reviews, links, genres, LIST)
    return rows.select("id", "tmdb_id", "title", F.col("release_date").cast("string").alias("release_date"), F.array_join("genres", ",").alias("genres"), "review_count", "average_rating")


@query(f"WITH {MOVIES} SELECT count(DISTINCT id) AS total FROM m WHERE {FILTER}")
def movies_total_distinct(spark, sf):
    _, _, _, links, genres = _tables(spark, sf)
    return catalog.total(S.movies(spark, sf, "id", "title", "release_date"), links, genres, LIST)


@query(f"WITH {MOVIES} SELECT id, title FROM m WHERE title ILIKE '%o_e%'")
def movies_title_ilike(spark, sf):
    return S.movies(spark, sf, "id", "title").where(X.contains_ilike(F.col("title"), "o_e")).select("id", "title")


@query(f"WITH {MOVIES} SELECT id, CAST(release_date AS VARCHAR) AS release_date FROM m WHERE year(release_date) = 1999")
def movies_year_range(spark, sf):
    rows = S.latest_where(S.table(spark, sf, "movies"), "id", "updated_at", P.in_year(F.col("release_date"), 1999), "id", "updated_at", "release_date")
    return rows.select("id", F.col("release_date").cast("string").alias("release_date"))


HOT = "(SELECT movie_id FROM reviews GROUP BY movie_id ORDER BY count(DISTINCT id) DESC, movie_id LIMIT 1)"
DETAIL = f"""d AS (SELECT r.id, r.content, r.source, r.rating, coalesce(nullif(r.author_name, ''), CASE WHEN u.id IS NOT NULL THEN u.nickname END, r.source) AS author_name,
coalesce(nullif(r.author_avatar_url, ''), u.avatar_url) AS author_avatar, coalesce(r.likes_count, 0) AS likes_count, row_number() OVER (ORDER BY r.created_at DESC, r.id)::INT AS place
FROM r LEFT JOIN users u ON u.id = r.user_id WHERE r.movie_id = {HOT})"""


def _hot(spark, sf) -> str:
    n = S.table(spark, sf, "reviews").groupBy("movie_id").agg(F.count_distinct("id").alias("n"))
    return n.orderBy(F.desc("n"), "movie_id").first()["movie_id"]


@query(f"WITH {REVIEWS}, {DETAIL} SELECT * FROM d")
def movie_detail_reviews(spark, sf):
    hot = _hot(spark, sf)
    return catalog.detail_reviews(S.reviews(spark, sf, where=F.col("movie_id") == hot), S.table(spark, sf, "users"), hot)


@query(f"""WITH {REVIEWS}, {MOVIES}, {DETAIL}, {NAMES} SELECT m.id, m.title, array_to_string(coalesce(names, []), ',') AS genres, (SELECT count(*) FROM d) AS review_count,
(SELECT string_agg(id || ':' || coalesce(author_name, ''), '|' ORDER BY place) FROM d) AS reviews FROM m LEFT JOIN g ON g.movie_id = m.id WHERE m.id = {HOT}""")
def movie_detail_nested(spark, sf):
    _, movies, _, links, genres = _tables(spark, sf)
    hot = _hot(spark, sf)
    d = catalog.detail(movies, S.reviews(spark, sf, where=F.col("movie_id") == hot), S.table(spark, sf, "users"), links, genres, hot)
    each = F.transform("reviews", lambda x: F.concat(x["id"], F.lit(":"), F.coalesce(x["author_name"], F.lit(""))))
    return d.select("id", "title", F.array_join("genres", ",").alias("genres"), "review_count", F.array_join(each, "|").alias("reviews"))


@query("SELECT DISTINCT id, name FROM genres")
def genres_list(spark, sf):
    return catalog.genre_list(S.table(spark, sf, "genres"))


@query(f"WITH {MOVIES}, {REVIEWS}, {STATS} SELECT m.id, coalesce(n, 0) AS review_count, a AS average_rating FROM m LEFT JOIN st ON st.movie_id = m.id")
def rating_stats(spark, sf):
    return catalog.with_stats(S.table(spark, sf, "movies").where("id IS NOT NULL").select("id").distinct(), S.reviews(spark, sf, "id", "movie_id", "rating")).select("id", "review_count", "average_rating")


@query("SELECT (SELECT count(DISTINCT id) FROM movies) AS movies, (SELECT count(*) FROM movie_reviews) AS points, (SELECT max(len(vector))::INT FROM movie_reviews) AS dim, 'healthy' AS status")
def health_counts(spark, sf):
    return catalog.health(S.movies(spark, sf, "id"), S.table(spark, sf, "movie_reviews"))


_SQL_SPACE = X.SPACE
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(coalesce(content, ''), '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _name, _char in X.ENTITIES:
    _CLEAN = f"replace({_CLEAN}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"WITH {REVIEWS} SELECT id, lower(trim(regexp_replace({_CLEAN}, '{_SQL_SPACE}+', ' ', 'g'))) AS text FROM r")
def text_preprocess(spark, sf):
    return S.reviews(spark, sf, "id", "content").select("id", X.preprocess(F.col("content")).alias("text"))


@query(f"WITH {REVIEWS} SELECT id, length(regexp_replace(coalesce(content, ''), '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g')) AS chars FROM r WHERE length(regexp_replace(coalesce(content, ''), '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g')) >= 20")
def review_valid(spark, sf):
    return S.reviews(spark, sf, "id", "content").where(X.is_valid_review(F.col("content"))).select("id", X.stripped_length(F.col("content")).alias("chars"))


@query(f"WITH {REVIEWS}, c AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY created_at, id) k FROM r) SELECT id, movie_id FROM c WHERE k <= 10 AND length(regexp_replace(coalesce(content, ''), '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g')) >= 20")
def review_cap(spark, sf):
    return ingest.valid_reviews(S.reviews(spark, sf, "id", "movie_id", "content", "created_at"), "movie_id", 10, "created_at", "id").select("id", "movie_id")


@query("SELECT text_hash, doc_id FROM (SELECT md5(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
def ingest_first_wins(spark, sf):
    rows = S.table(spark, sf, "documents").where("text IS NOT NULL").select(F.md5("text").alias("text_hash"), "doc_id")
    return ingest.first_wins(rows, "text_hash", "doc_id")


@query("SELECT DISTINCT d.tmdb_id FROM documents d WHERE d.tmdb_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM movies m WHERE m.tmdb_id = d.tmdb_id AND m.release_date < DATE '2000-01-01')")
def ingest_antijoin(spark, sf):
    old = S.table(spark, sf, "movies").where("release_date < DATE '2000-01-01'")
    return ingest.not_yet(S.table(spark, sf, "documents").where("tmdb_id IS NOT NULL").select("tmdb_id").distinct(), old, "tmdb_id")


@query("SELECT DISTINCT p.movie_id, g.id AS genre_id FROM (SELECT movie_id, unnest(genre_ids) gid FROM movie_reviews) p JOIN genres g ON g.id = TRY_CAST(gid AS INT)")
def genre_map(spark, sf):
    rows = S.table(spark, sf, "movie_reviews").select("movie_id", F.transform("genre_ids", lambda x: x.try_cast("int")).alias("genre_ids"))
    return ingest.genre_links(rows, S.table(spark, sf, "genres"), "movie_id")


@query("""WITH n AS (SELECT id, 'new' AS name FROM genres WHERE id % 3 = 0 UNION ALL SELECT max(id) + 1, 'added' FROM genres)
SELECT id, name FROM n UNION ALL SELECT id, name FROM genres WHERE id NOT IN (SELECT id FROM n)""")
def keyed_upsert(spark, sf):
    g = S.table(spark, sf, "genres").select("id", "name")
    new = g.where("id % 3 = 0").select("id", F.lit("new").alias("name")).unionByName(g.agg((F.max("id") + 1).alias("id")).select("id", F.lit("added").alias("name")))
    return S.upsert(g, new, "id")


@query("""WITH n AS (SELECT id, rating + 1 AS rating, list_transform(vector, lambda x: -x) AS vector FROM movie_reviews WHERE source = 'tmdb' AND year > 2000),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rating DESC) b FROM n) WHERE b = 1)
SELECT id, rating, round(vector[1], 5) AS first, len(vector)::INT AS dim FROM k UNION ALL SELECT id, rating, round(vector[1], 5), len(vector)::INT FROM movie_reviews WHERE id NOT IN (SELECT id FROM k)""")
def vector_upsert(spark, sf):
    p = S.table(spark, sf, "movie_reviews").select("id", "rating", "vector", "source", "year")
    new = p.where("source = 'tmdb' AND year > 2000").select("id", (F.col("rating") + 1).alias("rating"), F.transform("vector", lambda x: -x).alias("vector"))
    out = S.upsert(p.select("id", "rating", "vector"), new, "id")
    return out.select("id", "rating", F.round(F.get("vector", F.lit(0)), 5).alias("first"), F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"))


@query("SELECT DISTINCT id FROM reviews WHERE source <> 'user' AND id NOT IN (SELECT id FROM movie_reviews)")
def reconcile_vectors(spark, sf):
    return ingest.missing_points(S.reviews(spark, sf, "id", "source"), S.table(spark, sf, "movie_reviews"))


@query("SELECT DISTINCT id, movie_id FROM movie_reviews WHERE movie_id IS NOT NULL AND movie_id NOT IN (SELECT id FROM movies)")
def orphan_vectors(spark, sf):
    return ingest.orphan_points(S.table(spark, sf, "movie_reviews").where("movie_id IS NOT NULL"), S.table(spark, sf, "movies"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 11 = 0 THEN NULL ELSE CAST(CAST(json_extract(props, '$.k') AS INT) % 11 AS DOUBLE) END AS rating FROM events")
def json_parse(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return S.table(spark, sf, "events").select("event_id", k.alias("k"), F.nullif((k % 11).cast("double"), F.lit(0.0)).alias("rating"))


@query("""WITH t AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) target FROM events WHERE event_type = 'click'), n AS (SELECT user_id, target, count(*) c FROM t GROUP BY 1, 2)
SELECT target, greatest(sum(c % 2), 0)::BIGINT AS likes FROM n WHERE user_id IS NOT NULL AND target IS NOT NULL GROUP BY target""")
def like_parity(spark, sf):
    rows = S.table(spark, sf, "events").where("event_type = 'click'").select("user_id", F.from_json("props", "k int")["k"].alias("target"))
    return social.like_parity(rows, "user_id", "target")


@query(f"WITH {REVIEWS}, n AS (SELECT review_id, count(*) c FROM (SELECT DISTINCT user_id, review_id FROM review_likes) GROUP BY 1) SELECT r.id, coalesce(r.likes_count, 0) AS stored, coalesce(c, 0) AS likes FROM r LEFT JOIN n ON n.review_id = r.id")
def like_counts(spark, sf):
    return social.like_counts(S.table(spark, sf, "review_likes"), S.reviews(spark, sf, "id", "likes_count"))


@query(f"WITH {REVIEWS} SELECT id, movie_id, 'user' AS source, 0 AS likes_count FROM r WHERE length(content) >= 1 AND (rating IS NULL OR rating BETWEEN 0 AND 10) AND movie_id IN (SELECT id FROM movies WHERE release_date >= DATE '2000-01-01')")
def review_insert_semi(spark, sf):
    recent = S.table(spark, sf, "movies").where("release_date >= DATE '2000-01-01'")
    return social.accepted(S.reviews(spark, sf, "id", "movie_id", "content", "rating"), recent).select("id", "movie_id", "source", "likes_count")


@query("SELECT user_id, review_id FROM review_likes WHERE review_id IN (SELECT id FROM reviews WHERE source = 'user')")
def cascade_prune(spark, sf):
    return social.cascade(S.table(spark, sf, "review_likes"), S.table(spark, sf, "reviews").where("source = 'user'"), "review_id").select("user_id", "review_id")


@query(f"WITH {REVIEWS} SELECT r.id, u.id AS user_id FROM r LEFT JOIN (SELECT DISTINCT id FROM users WHERE email IS NOT NULL) u ON u.id = r.user_id")
def cascade_set_null(spark, sf):
    return social.set_null(S.reviews(spark, sf, "id", "user_id"), S.table(spark, sf, "users").where("email IS NOT NULL"), "user_id")


@query(f"WITH {REVIEWS} SELECT r.id, coalesce(nullif(r.author_name, ''), CASE WHEN u.id IS NOT NULL THEN u.nickname END, r.source) AS author FROM r LEFT JOIN users u ON u.id = r.user_id")
def author_fallback(spark, sf):
    u = S.table(spark, sf, "users").select(F.col("id").alias("user_id"), "nickname", F.lit(True).alias("known"))
    return S.reviews(spark, sf, "id", "user_id", "author_name", "source").join(u, "user_id", "left").select("id", X.author_name(F.col("author_name"), F.col("nickname"), F.col("known"), F.col("source")).alias("author"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\*\*(.*?)\*\*', '<strong>\1</strong>', 'g'), '\*(.*?)\*', '<em>\1</em>', 'g')) AS html FROM documents")
def markdown_render(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.md5(X.markdown(F.col("text"))).alias("html"))


@query(f"WITH {NAMES} SELECT movie_id, array_to_string(names[1:2], ', ') AS first_two, array_to_string(names, ', ') AS every FROM g")
def genre_join_slice(spark, sf):
    g = catalog.genre_names(S.table(spark, sf, "movie_genres"), S.table(spark, sf, "genres"))
    return g.select("movie_id", F.array_join(F.slice("genres", 1, 2), ", ").alias("first_two"), F.array_join("genres", ", ").alias("every"))


@query(f"""WITH {MOVIES} SELECT id, coalesce(CAST(year(release_date) AS VARCHAR), 'N/A') AS year, strftime(release_date, '%-d/%-m/%Y') AS shown_date, upper(substr(title, 1, 1)) AS initial,
coalesce(nullif(overview, ''), 'No overview') AS overview, CASE WHEN nullif(poster_path, '') IS NOT NULL THEN 'https://images.example/' || poster_path END AS poster FROM m""")
def card_fields(spark, sf):
    return catalog.cards(S.movies(spark, sf), "https://images.example/")


@query("SELECT id, username, nickname, email, avatar_url FROM users")
def user_public(spark, sf):
    return catalog.public_users(S.table(spark, sf, "users"))


@query(f"""WITH {MOVIES}, {REVIEWS}, l AS (SELECT movie_id, array_to_string(list_transform(list_sort(list(DISTINCT genre_id)), lambda x: CAST(x AS VARCHAR)), ',') ids FROM movie_genres GROUP BY 1)
SELECT r.id, r.movie_id, m.title AS movie_title, coalesce(r.rating, 0.0) AS rating, coalesce(year(m.release_date), 2000)::INT AS year, coalesce(ids, '') AS genre_ids, 'tmdb' AS source FROM r JOIN m ON m.id = r.movie_id LEFT JOIN l ON l.movie_id = r.movie_id""")
def vector_payload(spark, sf):
    p = ingest.payload(S.reviews(spark, sf, "id", "movie_id", "rating"), S.movies(spark, sf, "id", "title", "release_date"), S.table(spark, sf, "movie_genres"))
    return p.withColumn("genre_ids", F.array_join("genre_ids", ","))


@query("SELECT 'movie_reviews' AS name, count(*) AS points, count(DISTINCT id) AS ids, count(vector) AS vectors, max(len(vector))::INT AS dim FROM movie_reviews")
def collection_stats(spark, sf):
    return S.collection_stats(S.table(spark, sf, "movie_reviews"), "movie_reviews")


@query("SELECT id, name FROM genres UNION ALL SELECT ((SELECT max(id) FROM genres) + row_number() OVER (ORDER BY name))::INT, name FROM (SELECT DISTINCT source AS name FROM reviews WHERE source NOT IN (SELECT name FROM genres))")
def genre_get_or_create(spark, sf):
    return ingest.get_or_create(S.table(spark, sf, "reviews").select(F.col("source").alias("name")), S.table(spark, sf, "genres"))


@query(f"WITH {MOVIES} SELECT id, title, year(release_date)::INT AS year FROM m WHERE id = {HOT}")
def movie_lookup(spark, sf):
    one = S.latest(S.table(spark, sf, "movies").where(F.col("id") == _hot(spark, sf)), "id", "updated_at")
    return S.lookup(one).select("id", "title", F.year("release_date").alias("year"))


ACTIVE = "(SELECT user_id FROM review_likes GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"


@query(f"WITH {REVIEWS} SELECT r.id, r.movie_id, r.id IN (SELECT review_id FROM review_likes WHERE user_id = {ACTIVE}) AS is_liked FROM r")
def liked_by_user(spark, sf):
    likes = S.table(spark, sf, "review_likes")
    user = likes.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()["user_id"]
    return social.liked_by(S.reviews(spark, sf, "id", "movie_id"), likes, user)


@query("SELECT p.movie_id, g.name, count(*) AS mentions FROM (SELECT movie_id, unnest(genre_ids) gid FROM movie_reviews) p LEFT JOIN genres gg ON gg.id = TRY_CAST(gid AS INT), LATERAL (SELECT coalesce(gg.name, 'Unknown') AS name) g WHERE p.movie_id IS NOT NULL GROUP BY 1, 2")
def genre_name_default(spark, sf):
    ids = S.table(spark, sf, "movie_reviews").where("movie_id IS NOT NULL").select("movie_id", F.explode("genre_ids").alias("g"))
    return catalog.genre_name_or_unknown(ids, S.table(spark, sf, "genres"), "g").groupBy("movie_id", "name").agg(F.count("*").alias("mentions"))


@query()
def embed_reviews(spark, sf):
    rows = S.reviews(spark, sf, "id", "content").where(X.is_valid_review(F.col("content")))
    return rows.select("id", V.embed(X.preprocess(F.col("content"))).alias("vector"))


@query()
def html_parsed(spark, sf):
    return S.reviews(spark, sf, "id", "content").select("id", X.normalize_whitespace(X.parse_html("content")).alias("text"))
