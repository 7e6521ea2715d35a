"""Traps of the catalogue's semantics on tiny tables, plans, and every query against its SQL."""

import importlib
import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmgrain.functions import predicates, text, vectors
from filmgrain.operators import catalog, ingest, search, social
from filmgrain.schemas import ListRequest, SearchRequest
from filmgrain.sources import tables

SF = "/root/testdata/sf0.001"
MOVIE = "id string, tmdb_id int, title string, overview string, release_date date, poster_path string, created_at timestamp_ntz, updated_at timestamp_ntz"
REVIEW = "id string, movie_id string, content string, source string, rating double, created_at timestamp_ntz, user_id string, author_name string, author_avatar_url string, likes_count int"
T0 = datetime(2020, 1, 1)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.fixture(scope="module")
def shop(spark):
    movies = spark.createDataFrame([("m1", 1, "Up 100%", "o" * 201, date(1999, 5, 1), "/a.jpg", T0, T0), ("m2", 2, "The_One", None, None, None, T0, T0), ("m3", 3, "Third", "", date(2001, 1, 1), "", T0, T0)], MOVIE)
    reviews = spark.createDataFrame([("r1", "m1", "good", "tmdb", 8.0, T0, None, "", "", 1), ("r2", "m1", "bad", "tmdb", 0.0, T0, None, None, None, None), ("r3", "m1", "mine", "user", None, T0, "u1", "", "", 0), ("r4", "m2", "x", "tmdb", 0.0, T0, None, "Ann", None, 0)], REVIEW)
    genres = spark.createDataFrame([(1, "Drama"), (2, "drama"), (3, "Dramedy")], "id int, name string")
    links = spark.createDataFrame([("m1", 1), ("m1", 3), ("m2", 2), ("m2", 9), ("m1", 1)], "movie_id string, genre_id int")
    users = spark.createDataFrame([("u1", "ann", "", None, "/u.png", None, T0)], "id string, username string, nickname string, email string, avatar_url string, preferences string, created_at timestamp_ntz")
    axis = np.eye(3)
    at = [("r1", axis[0], "m1"), ("r2", axis[0] * 0.9 + axis[1] * 0.1, "m1"), ("r4", axis[0] * 0.6 + axis[1] * 0.4, "m2"), ("r9", axis[0] * 0.95 + axis[2] * 0.05, "gone"), ("r8", axis[1], "m3"), ("r7", axis[0] * 0, "m3")]
    points = spark.createDataFrame([(i, [float(x) for x in v], m, None, 5.0, 2000, ["1"], "tmdb") for i, v, m in at], "id string, vector array<float>, movie_id string, movie_title string, rating double, year int, genre_ids array<string>, source string")
    return points, movies, reviews, links, genres, users


def test_average_leaves_out_null_and_zero(shop):
    got = {r["id"]: (r["review_count"], r["average_rating"]) for r in catalog.with_stats(shop[1].select("id"), shop[2]).collect()}
    assert got == {"m1": (3, 8.0), "m2": (1, None), "m3": (0, None)}


def test_search_order_of_steps(shop):
    q = [1.0, 0.0, 0.0]
    assert [r["movie_id"] for r in search.topk(shop[0], q, SearchRequest(limit=2)).collect()] == ["m1", "gone"]
    rows = search.search(*shop[:5], q, SearchRequest(limit=2)).collect()
    assert [r["movie_id"] for r in rows] == ["m1"]  # a point without a film has used up a place
    assert rows[0]["overview"] == "o" * 200 + "..." and rows[0]["score"] == 1.0 and rows[0]["review_count"] == 3
    assert search.search(*shop[:5], q, SearchRequest(limit=1, genres=("drama",))).count() == 0  # exact and case-sensitive, after the limit
    assert search.search(*shop[:5], q, SearchRequest(limit=5, genres=("drama",))).count() == 1
    assert search.topk(shop[0], q, SearchRequest(min_rating=6.0)).count() == 0
    assert search.topk(shop[0], q, SearchRequest(min_year=2001)).count() == 0 and search.topk(shop[0], q, SearchRequest(max_year=2000)).count() == 3
    assert search.topk(shop[0].limit(0), q, SearchRequest()).count() == 0
    assert all(r["score"] >= 0.3 for r in search.topk(shop[0], q, SearchRequest()).collect())


def test_list_filters_and_pages(shop):
    ids = lambda **k: sorted(r["id"] for r in catalog.filtered(shop[1], shop[3], shop[4], ListRequest(**k)).collect())
    assert ids(genre="drama") == ["m1", "m2"] and ids(genre="dramedy") == ["m1"] and ids(title="0%") == ["m1"] and ids(title="e_o") == ["m2"]
    assert ids(title="") == ["m1", "m2", "m3"] and ids(year=1999) == ["m1"]
    pages = [[r["id"] for r in catalog.page(shop[1], shop[2], shop[3], shop[4], ListRequest(page=p, page_size=2)).orderBy(F.desc("created_at"), "id").collect()] for p in (1, 2, 3)]
    assert pages == [["m1", "m2"], ["m3"], []]


def test_detail(shop):
    rows = {r["id"]: r for r in catalog.detail_reviews(shop[2], shop[5], "m1").collect()}
    assert rows["r3"]["author_name"] == "" and rows["r1"]["author_name"] == "tmdb" and rows["r3"]["author_avatar"] == "/u.png"
    d = catalog.detail(shop[1], shop[2], shop[5], shop[3], shop[4], "m1").first()
    assert d["genres"] == ["Drama", "Dramedy"] and [r["id"] for r in d["reviews"]] == ["r1", "r2", "r3"]
    assert catalog.detail(shop[1], shop[2], shop[5], shop[3], shop[4], "none").count() == 0


def test_validation():
    for bad in ({"limit": 0}, {"limit": 51}, {"min_year": 1800}, {"min_rating": 11}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)
    with pytest.raises(ValueError):
        ListRequest(page=0)


def test_text_functions(spark):
    assert one(spark, "<p>Great Movie!</p>  Loved it.", text.preprocess) == "great movie! loved it."
    assert one(spark, None, text.preprocess) == ""
    assert one(spark, "a<script>x<y</script>b<!-- c -->&amp;lt; d", text.clean_html) == "a b &lt; d"
    assert one(spark, "<b>x &eacute;</b><style>q</style>", text.parse_html) == "x é"
    assert one(spark, "  a \n b ", text.normalize_whitespace) == "a b"
    assert [one(spark, x, text.shorten) for x in (None, "", "a" * 200, "a" * 201)] == [None, "", "a" * 200, "a" * 200 + "..."]
    assert one(spark, "**b** *i*", text.markdown) == "<strong>b</strong> <em>i</em>"
    assert [one(spark, x, text.parse_date) for x in ("2020-02-30", "2020-5-1", "", "2020-05-01")] == [None, None, None, date(2020, 5, 1)]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.7071]
    got = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "t string").select(vectors.embed(F.col("t")).alias("v")).collect()
    assert got[0]["v"] == got[1]["v"] and abs(np.linalg.norm(got[0]["v"]) - 1) < 1e-6 and not any(got[3]["v"]) and len(got[0]["v"]) == 384


def test_landed_pages_come_in_once(spark, tmp_path):
    films = [{"page": 1, "total_pages": 2, "results": [{"id": 1, "title": "A", "release_date": "2020-01-02", "genre_ids": [1, 99]}, {"id": 2}]}, {"page": 2, "total_pages": 2, "results": [{"id": 1, "title": "again"}, {"id": 3, "release_date": ""}]}]
    texts = [{"id": 1, "page": 1, "total_pages": 1, "results": [{"id": f"s{i}", "content": "short" if i < 8 else "long enough to be a review", "author": "acc", "author_details": {"rating": 0, "name": "", "avatar_path": "/p"}} for i in range(12)]}]
    for name, pages in (("films", films), ("texts", texts)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.json").write_text("\n".join(json.dumps(p) for p in pages))
    m, r = tables.movie_pages(spark, f"{tmp_path}/films"), tables.review_pages(spark, f"{tmp_path}/texts")
    genres = spark.createDataFrame([(1, "Drama")], "id int, name string")
    new = ingest.ingest(m, r, genres, spark.createDataFrame([], "tmdb_id int"), 10, "https://i")
    got = {x["tmdb_id"]: x["title"] for x in new["movies"].collect()}
    assert got == {1: "A", 2: "Unknown", 3: "Unknown"}
    rows = new["reviews"].collect()
    assert len(rows) == 2 and {x["author_name"] for x in rows} == {"acc"} and rows[0]["rating"] is None and rows[0]["author_avatar_url"] == "https://i/p"  # the cap comes before the length filter
    assert new["movie_genres"].count() == 1
    assert ingest.ingest(m, r, genres, new["movies"])["movies"].count() == 0
    assert tables.movie_pages(spark, f"{tmp_path}/films", 1).count() == 2
    path = tables.write_version(new["movies"], f"{tmp_path}/store")
    assert tables.restore(spark, path, f"{tmp_path}/copy") and not tables.restore(spark, path, f"{tmp_path}/copy")


def test_upsert_and_links(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, name string")
    assert sorted(map(tuple, tables.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert tables.upsert(old, new.limit(0), "id").count() == 2
    assert sorted(map(tuple, ingest.get_or_create(new, old).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    edges = spark.createDataFrame([("x", 1), ("y", 9), ("z", None)], "k string, id_ref int")
    assert social.cascade(edges, old, "id_ref").count() == 1
    assert sorted(r["id_ref"] or 0 for r in social.set_null(edges, old, "id_ref").collect()) == [0, 0, 1]


def test_likes_batch_and_stream_agree(spark, tmp_path):
    rows = [("u1", "r1"), ("u1", "r1"), ("u2", "r1"), ("u1", "r2"), ("u1", "r2"), ("u1", "r2"), (None, "r1")]
    log = spark.createDataFrame(rows, "u string, r string")
    batch = {r["r"]: r["likes"] for r in social.like_parity(log, "u", "r").collect()}
    assert batch == {"r1": 1, "r2": 1}
    from filmgrain.streaming.likes import ingest_stream, like_states

    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "u string, r string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("u string, r string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = like_states(stream, "u", "r").writeStream.outputMode("update").format("memory").queryName("likes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = {}
    for r in spark.table("likes").collect():
        seen[(r["user_id"], r["review_id"])] = seen.get((r["user_id"], r["review_id"]), []) + [r["liked"]]
    last = {k: sum(1 for x in rows if x == k) % 2 == 1 for k in seen}
    assert set(seen) == {("u1", "r1"), ("u2", "r1"), ("u1", "r2")} and all(last[k] in v for k, v in seen.items())
    store = f"{tmp_path}/store"
    spark.createDataFrame([("u9", "r1")], "u string, r string").write.parquet(store)
    ingest_stream(stream, "r", lambda: spark.read.schema("u string, r string").parquet(store), lambda df: df.write.mode("append").parquet(store), f"{tmp_path}/cp2").awaitTermination(120)
    assert sorted(r["r"] for r in spark.read.parquet(store).collect()) == ["r1", "r2"]


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    p = plan(tables.table(spark, SF, "movies").where(predicates.in_year(F.col("release_date"), 1999)))
    assert "GreaterThanOrEqual(release_date" in p and "LessThan(release_date" in p
    q = importlib.import_module("filmgrain.plans.catalogue_queries").QUERIES
    p = plan(q["movies_year_range"](spark, SF))
    assert "GreaterThanOrEqual(release_date" in p and "LessThan(release_date" in p and "overview" not in p.split("== Physical Plan ==")[1]
    p = plan(q["rating_stats"](spark, SF)).split("== Physical Plan ==")[1]
    assert "content" not in p and "title" not in p
    for name in ("movie_detail_nested", "movie_lookup"):
        assert "EqualTo(movie_id," in (p := plan(q[name](spark, SF))) or "EqualTo(id," in p
    assert "TakeOrderedAndProject" in plan(q["movies_list_page"](spark, SF)) and "vector" not in plan(q["movies_list_page"](spark, SF))


def test_every_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for name in "movies reviews genres movie_genres users review_likes movie_reviews documents eval_items events embeddings".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")

    def norm(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple("" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    sql = {k: v for k, v in sql.items() if not (k[0] == "p" and k[1].isdigit())}  # those have tests of their own
    for name, s in sql.items():
        a, b = queries[name](spark, SF).toPandas(), con.execute(s).fetchdf()
        assert sorted(a.columns) == sorted(b.columns) and norm(a) == norm(b), name
    assert entry.entry(spark).count() >= 0


def test_cosine_pairs_take_every_stated_query(spark, tmp_path, monkeypatch):
    import numpy as np

    from filmgrain.plans import catalogue_queries

    x = np.random.default_rng(5).standard_normal((1001, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(str(50 * q), str(i)) for q, i in zip(*np.nonzero(x[::50] @ x.T >= 0.25))}
    assert len({q for q, _ in want}) == 21
    for size in (4096, 4):  # one block of queries, several
        monkeypatch.setattr(catalogue_queries, "QUERY_BLOCK", size)
        got = [(r["query_id"], r["id"]) for r in catalogue_queries.QUERIES["cosine_pairs_stated"](spark, str(tmp_path)).collect()]
        assert len(got) == len(want) and set(got) == want
