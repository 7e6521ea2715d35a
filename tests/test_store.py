"""The store, the page source, ingestion, requests and the index on tiny tables."""

import json
import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmgrain import demo
from filmgrain.functions import text, vectors
from filmgrain.operators import catalog, index, ingest, search, social
from filmgrain.operators.ranks import numbered
from filmgrain.schemas import POINTS, ReviewRequest, SearchRequest, Settings
from filmgrain.sources import pages, tables


def test_latest_reads_what_is_wanted(spark):
    rows = [(1, 1, date(1999, 1, 1), "a"), (1, 2, date(2001, 1, 1), "b"), (2, 5, date(1999, 2, 2), "c"), (None, 9, date(1999, 1, 1), "d"), (3, 1, None, "e"), (2, 4, date(2000, 1, 1), "f")]
    df = spark.createDataFrame(rows, "id int, at int, day date, name string")
    assert sorted(map(tuple, tables.latest(df, "id", "at", "id", "name").collect())) == [(1, "b"), (2, "c"), (3, "e")]
    got = tables.latest_where(df, "id", "at", F.col("day") < F.lit(date(2000, 1, 1)), "id", "at", "name").collect()
    assert [tuple(r) for r in got] == [(2, 5, "c")]  # 1 was before 2000 only in its first crawl
    assert tables.latest_where(df.limit(0), "id", "at", F.col("day").isNotNull()).count() == 0


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 1000, f"n{i}") for i in range(1000)], "x int, name string").repartition(5)
    got = {r["x"]: r["place"] for r in numbered(df, "place", F.desc("x")).collect()}
    assert got == {x: 1000 - x for x in range(1000)}
    assert numbered(df.limit(0), "place", "x").count() == 0


def test_tables_are_made_filled_and_dropped(spark, tmp_path):
    base = f"{tmp_path}/db"
    assert set(tables.create_all(spark, base)) == set(tables.schemas.TABLES) and tables.create_all(spark, base) == []
    spark.createDataFrame([(1, "Drama")], "id int, name string").write.mode("overwrite").parquet(f"{base}/genres")
    assert "genres" in tables.create_all(spark, base, reset=True) and spark.read.parquet(f"{base}/genres").count() == 0
    tables.backup(spark.createDataFrame([(1, "Drama")], "id int, name string"), f"{tmp_path}/snap/genres.parquet")
    assert tables.seed(spark, f"{tmp_path}/snap", f"{tmp_path}/new") == ["genres"] and tables.seed(spark, f"{tmp_path}/snap", f"{tmp_path}/new") == []
    assert tables.drop(spark, f"{base}/genres") and not tables.drop(spark, f"{base}/genres") and not tables.exists(spark, f"{base}/genres")
    old = spark.createDataFrame([(1,)], "id int")
    assert tables.add_missing(old, {"id": "int", "preferences": "string"}).columns == ["id", "preferences"]
    tries = iter([False, True])
    assert tables.wait_until(lambda: next(tries), 3, 0) and not tables.wait_until(lambda: 1 / 0, 2, 0)
    assert [r["ok"] for r in tables.probe(spark).collect()] == [1]
    assert tables.lookup(old, id=1).count() == 1 and tables.lookup(old, id=2).count() == 0


def test_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    rows = [(f"p{i:03}", v.tolist(), "m", None, 5.0, 1900 + i % 100, ["1"], "tmdb") for i, v in enumerate(x)]
    rows += [rows[0], ("null", None, "m", None, 0.0, 2000, [], "tmdb"), ("zero", [0.0] * 8, "m", None, 0.0, 2000, [], "tmdb"), (None, x[3].tolist(), "m", None, 0.0, 2000, [], "tmdb")]
    df = spark.createDataFrame(rows, POINTS).withColumn("list", F.lit("clash"))
    path = f"{tmp_path}/ix"
    assert index.build(df, path, 8) and not index.build(df, path, 8, recreate=False)
    q = x[0].tolist()
    exact = [(r["id"], r["score"]) for r in search.similar_reviews(df, q, 10, 0.2).collect()]
    assert [(r["id"], r["score"]) for r in index.search(spark, path, q, 10, 0.2).collect()] == exact and exact[0] == ("p000", 1.0)
    some = index.search(spark, path, q, 10, 0.2, F.col("year") < 1950)
    assert {r["id"] for r in some.collect()} <= {f"p{i:03}" for i in range(600) if i % 100 < 50}
    index.build(df.limit(0), f"{tmp_path}/none", 8)
    assert index.search(spark, f"{tmp_path}/none", q, 10, 0.2).count() == 0
    assert index.create_collection(spark, f"{tmp_path}/made", POINTS) and not index.create_collection(spark, f"{tmp_path}/made", POINTS)
    assert tables.collection_stats(df.drop("list"), "c").first().asDict() == {"name": "c", "points": 604, "ids": 602, "vectors": 603, "dim": 8}


def test_top_hits_of_tasks_are_all_that_is_needed(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 4)).astype(np.float32)
    rows = [(f"i{i % 350:03}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").repartition(3)
    q = [1.0, 0.2, 0.0, 0.1]
    every = vectors.score_against(df, "vector", q, ["id"], 0.0).groupBy("id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "id").limit(12).collect()
    few = vectors.score_against(df, "vector", q, ["id"], 0.0, 12)
    assert few.count() <= 36
    assert few.groupBy("id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "id").limit(12).collect() == every


def test_requests_and_settings():
    for bad in ({"query": " a "}, {"query": "x" * 501}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)
    for bad in ({"content": ""}, {"content": "x", "rating": 11}):
        with pytest.raises(ValueError):
            ReviewRequest(**bad)
    assert SearchRequest(query=" ok ").query == " ok " and ReviewRequest("x", 10).rating == 10
    assert Settings.read({"FILMGRAIN_MAX_PAGES": "3", "FILMGRAIN_THRESHOLD": "0.5", "OTHER": "1", "FILMGRAIN_DIM": ""}) == Settings(max_pages=3, threshold=0.5)


def test_text_of_answers(spark):
    df = spark.createDataFrame([("tmdb", "{0d0480152-6fe5", datetime(2020, 5, 1, 3, 4, 5)), (None, None, None), ("x", "D0480152-6FE5-4527-AA65-BF2353DB4C7A", None)], "s string, u string, t timestamp_ntz")
    got = df.select(text.display_name(F.col("s")), text.is_uuid(F.col("u")), text.iso(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("TMDB Reviewer", False, "2020-05-01T03:04:05"), (None, False, None), ("x", True, None)]
    assert [r[0] for r in spark.createDataFrame([("   a b\n",)], "q string").select(text.trimmed_query(F.col("q"))).collect()] == ["a b"]


def test_users(spark):
    users = spark.createDataFrame([("u1", "ann", '{"theme": "dark"}'), ("u2", "bo", "{bad"), ("u3", "cy", None)], "id string, username string, preferences string")
    assert {r["id"]: r["value"] for r in catalog.preference(users, "theme").collect()} == {"u1": "dark", "u2": None, "u3": None}
    new = spark.createDataFrame([("n2", "dee"), ("n1", "dee"), ("n3", "ann"), ("n4", None)], "id string, username string")
    assert [tuple(r) for r in social.registered(new, users).collect()] == [("n1", "dee", "{}")]


def test_health_is_about_reading(spark):
    none = spark.createDataFrame([], "id string, vector array<float>")
    assert catalog.health(none, none).first()["status"] == "healthy"
    assert catalog.health(none, None).first()["status"] == catalog.health(None, none).first()["status"] == "degraded"


def test_embedding_in_batches():
    model = vectors.HashingEmbedder(16)
    every = vectors.embed_texts(model, [f"word{i}" for i in range(70)])
    assert every.shape == (70, 16) and (every == model.embed([f"word{i}" for i in range(70)]).astype(np.float32)).all()
    assert vectors.embed_texts(model, []).shape == (0, 16)


def test_demo_and_observation(spark, tmp_path):
    assert demo.movies(spark).count() == 3 and demo.reviews(spark).count() == 5
    rows, seen = ingest.observed(demo.reviews(spark), "reviews")
    rows.write.parquet(f"{tmp_path}/r")
    assert seen.get["rows"] == 5


def test_first_occurrence_comes_in_by_streams(spark, tmp_path):
    from filmgrain.streaming.likes import ingest_stream

    rows = [("k1", 2, 0, "later"), ("k1", 1, 5, "first"), ("k2", 1, 0, "only")]
    spark.createDataFrame(rows, "k string, page int, pos int, v string").write.parquet(f"{tmp_path}/in")
    store = f"{tmp_path}/store"
    tables.create(spark, store, "k string, page int, pos int, v string")
    stream = spark.readStream.schema("k string, page int, pos int, v string").parquet(f"{tmp_path}/in")
    ingest_stream(stream, "k", lambda: spark.read.parquet(store), lambda df: df.write.mode("append").parquet(store), f"{tmp_path}/cp", ("page", "pos")).awaitTermination(120)
    assert sorted(r["v"] for r in spark.read.parquet(store).collect()) == ["first", "only"]


def test_pages_over_http(spark, tmp_path):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            busy = "page=2" in self.path and sum("page=2" in p for p in asked) == 1 or "page=3" in self.path
            self.send_response(429 if busy else 200)
            if busy:
                self.send_header("Retry-After", "0")
            self.end_headers()
            if not busy:
                n = int(self.path.split("page=")[1].split("&")[0])
                self.wfile.write(json.dumps({"page": n, "results": [{"id": n}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = pages.read_pages(spark, "page int, results array<struct<id: int>>", f"http://127.0.0.1:{server.server_port}", "films?page={page}&x=1", 3, pause="0").collect()
    finally:
        server.shutdown()
    assert sorted((r["page"], r["results"][0]["id"]) for r in got if r["page"]) == [(1, 1), (2, 2)] and len(got) == 3
    (tmp_path / "1.json").write_text('{"page": 1}')
    url = f"file://{tmp_path}"
    assert pages.fetch(f"{url}/1.json", pause=0) == '{"page": 1}'
    with pytest.raises(OSError):
        pages.fetch(f"{url}/2.json", retries=2, pause=0)
    one = pages.read_pages(spark, "page int", url, "{page}.json", 1, pause="0")
    assert pages.self_test(spark, one, one) and not pages.self_test(spark, one, pages.read_pages(spark, "page int", url, "x{page}.json", 1, pause="0", retries="1"))
