"""The queries of the nine training-data problems and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import latest

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _latest_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """(id, content): one row for each review, the last delivered; rows without an id stay."""
    rows = table(spark, sf, "reviews")
    return latest(rows, "id", "ingested_at", "id", "content").unionByName(rows.where("id IS NULL").select("id", "content"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from .splitting import split

    pieces = split(table(spark, sf, "reviews"), "id", "content")
    return pieces.where("n_pieces > 1").select(F.col("id").alias("review_id")).distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from .splitting import split

    return split(_latest_reviews(spark, sf), "id", "content").select(F.col("id").alias("review_id"), "piece_no", "n_pieces", "begin", "end", "new_from", "piece")


def p1_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each review without their overlaps, put together again, and the greatest size."""
    p = p1_pieces(spark, sf).where("review_id IS NOT NULL")
    new = F.struct("piece_no", F.expr("substring(piece, new_from - begin + 1)").alias("new"))
    each = p.groupBy("review_id").agg(F.sort_array(F.collect_list(new)).alias("news"), F.max(F.length("piece")).alias("longest"))
    return each.select("review_id", F.md5(F.array_join(F.transform("news", lambda x: x["new"]), "")).alias("text_hash"), (F.coalesce("longest", F.lit(0)) <= 1000).alias("within"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from .neighbours import similar_pairs

    pairs = similar_pairs(table(spark, sf, "movie_reviews"), "id", "vector", 0.8)
    return pairs.select(F.col("id_a").alias("point_id_a"), F.col("id_b").alias("point_id_b"))


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from .neighbours import neighbours

    near = neighbours(table(spark, sf, "movie_reviews"), "id", "vector")
    return near.select(F.col("id").alias("point_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 4).alias("similarity"), "rank")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from .privacy import findings

    return findings(table(spark, sf, "reviews"), "id", "content").select(F.col("id").alias("review_id"), "kind").distinct()


def p3_findings(spark: SparkSession, sf: str) -> DataFrame:
    from .privacy import findings

    return findings(table(spark, sf, "reviews"), "id", "content").distinct().withColumnRenamed("id", "review_id")


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    from .privacy import redacted

    return redacted(_latest_reviews(spark, sf), "id", "content").select(F.col("id").alias("review_id"), F.col("text").alias("content"), "findings")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from .neardup import near_duplicate_pairs

    pairs = near_duplicate_pairs(table(spark, sf, "reviews"), "id", "content", shingle=3, least=0.6, min_words=40)
    return pairs.select(F.col("id_a").alias("review_id_a"), F.col("id_b").alias("review_id_b"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    from .neardup import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf, "reviews"), "id", "content", shingle=3, least=0.6, min_words=40).withColumnRenamed("id", "review_id")


def _abuse_model(spark: SparkSession, sf: str):
    from .abuse import learn

    return learn(table(spark, sf, "reviews"), "id", "content", table(spark, sf, "review_labels"), "review_id", "toxic")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from .abuse import flagged

    return flagged(table(spark, sf, "reviews"), "id", "content", _abuse_model(spark, sf)).withColumnRenamed("id", "review_id")


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    from .abuse import scores

    out = scores(table(spark, sf, "reviews"), "id", "content", _abuse_model(spark, sf), "source")
    return out.select(F.col("id").alias("review_id"), F.col("grp").alias("source"), "score", "flagged")


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = p5_scores(spark, sf)
    return rows.groupBy("source").agg(F.count("*").alias("reviews"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"))


def p5_passages(spark: SparkSession, sf: str) -> DataFrame:
    from .abuse import passages

    return passages(table(spark, sf, "reviews"), "id", "content", _abuse_model(spark, sf)).withColumnRenamed("id", "review_id")


def _latest_movies(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each movie: the last crawl's."""
    rows = table(spark, sf, "movies").select("id", F.struct("updated_at", "overview", "lang").alias("row"))
    return rows.groupBy("id").agg(F.max("row").alias("row")).select("id", "row.overview", "row.lang")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from .language import learn, wrong_labels

    reviews = table(spark, sf, "reviews")
    model = learn(reviews, "content", "lang")
    parts = [wrong_labels(reviews, "id", "content", "lang", model).withColumn("record_kind", F.lit("review")), wrong_labels(_latest_movies(spark, sf), "id", "overview", "lang", model).withColumn("record_kind", F.lit("movie"))]
    return parts[0].unionByName(parts[1]).select("record_kind", F.col("id").alias("record_id"), "lang")


def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    from .language import learn, segments

    reviews = table(spark, sf, "reviews")
    model = learn(reviews, "content", "lang")
    parts = [segments(reviews, "id", "content", model).withColumn("record_kind", F.lit("review")), segments(_latest_movies(spark, sf), "id", "overview", model).withColumn("record_kind", F.lit("movie"))]
    return parts[0].unionByName(parts[1]).select("record_kind", F.col("id").alias("record_id"), "begin", "end", F.col("found").alias("lang"), "confidence", "ambiguous", "runner_up").distinct()


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    from .language import languages_of, learn

    reviews = table(spark, sf, "reviews")
    model = learn(reviews, "content", "lang")
    parts = [languages_of(reviews, "id", "content", model, "lang", 1).withColumn("record_kind", F.lit("review")), languages_of(_latest_movies(spark, sf), "id", "overview", model, "lang", 1).withColumn("record_kind", F.lit("movie"))]
    return parts[0].unionByName(parts[1]).select("record_kind", F.col("id").alias("record_id"), F.array_join("found", ",").alias("langs"), F.col("main").alias("lang"), "main_share", "confidence")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from .leakage import leaks

    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "item_id").where("longest_run >= 12").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    from .leakage import leaks

    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "item_id")


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "doc_id", "source", "text")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    from ..session import cut
    from .mixing import shares

    return shares(cut(p8_mixture(spark, sf)), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from .sharedspans import shared_pieces

    return shared_pieces(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    from .sharedspans import shared_spans

    return shared_spans(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from .sharedspans import shared_coverage

    return shared_coverage(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_groups(spark: SparkSession, sf: str) -> DataFrame:
    from .sharedspans import sharing_groups

    return sharing_groups(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_removals(spark: SparkSession, sf: str) -> DataFrame:
    from .sharedspans import removals

    return removals(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pieces, p1_rejoined, p2_found, p2_neighbours, p3_found, p3_findings, p3_redacted, p4_found, p4_groups, p5_found, p5_scores, p5_rates, p5_passages, p6_found, p6_segments, p6_texts, p7_found, p7_leaks, p8_mixture, p8_shares, p9_found, p9_spans, p9_coverage, p9_groups, p9_removals)}

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

PAIRS = f"""w AS (SELECT id, {WORDS.format("content")} ws FROM (SELECT DISTINCT id, content FROM reviews)),
t AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) >= 40)),
n AS (SELECT id, count(*) n FROM t GROUP BY id), b AS (SELECT x.id a, y.id b, count(*) k FROM t x JOIN t y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
p AS (SELECT a, b FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9)"""
WINDOWS = """w AS (SELECT doc_id, i, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), o AS (SELECT DISTINCT doc_id, i FROM w JOIN s USING (h)),
q AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM o), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) k FROM q),
sp AS (SELECT doc_id, (min(i) - 1)::INT AS "begin", (max(i) + 199)::INT AS "end" FROM g GROUP BY doc_id, k)"""
#: What is kept of the windows above: all that are shared, or those that an earlier text has.
KEPT, REMOVED = "SELECT DISTINCT doc_id, i FROM w JOIN s USING (h)", "SELECT DISTINCT doc_id, i FROM w JOIN (SELECT h, min(doc_id) m FROM w GROUP BY h) USING (h) WHERE doc_id > m"
REACH = "r AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)"

SQL: dict[str, str] = {
    "p1_rejoined": """SELECT id AS review_id, md5(coalesce(content, '')) AS text_hash, true AS within FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) k FROM reviews WHERE id IS NOT NULL) WHERE k = 1""",
    "p4_groups": f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a x, b y FROM p UNION SELECT b, a FROM p), {REACH}
SELECT x AS review_id, min(y) AS group_id, (SELECT count(*) FROM e WHERE e.x = r.x) AS links FROM r GROUP BY x""",
    "p9_spans": f"WITH {WINDOWS} SELECT * FROM sp",
    "p9_removals": f"WITH {WINDOWS.replace(KEPT, REMOVED)} SELECT * FROM sp",
    "p9_coverage": f"""WITH {WINDOWS} SELECT d.doc_id, length(coalesce(text, '')) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, round(coalesce(n, 0) / greatest(length(coalesce(text, '')), 1), 6) AS shared_share
FROM documents d LEFT JOIN (SELECT doc_id, sum("end" - "begin") n FROM sp GROUP BY 1) x ON x.doc_id = d.doc_id""",
    "p9_groups": f"""WITH RECURSIVE {WINDOWS}, c AS (SELECT h, min(doc_id) m FROM w WHERE h IN (FROM s) GROUP BY h), e AS (SELECT DISTINCT w.doc_id x, m y FROM w JOIN c USING (h) UNION SELECT m, w.doc_id FROM w JOIN c USING (h)), {REACH}
SELECT x AS doc_id, min(y) AS group_id FROM r GROUP BY x""",
    "p1_found": "SELECT DISTINCT id AS review_id FROM reviews WHERE length(content) > 1000",
    "p2_found": """WITH p AS (SELECT DISTINCT id, vector::DOUBLE[] v FROM movie_reviews WHERE len(vector) = 384 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0),
s AS (SELECT a.id x, b.id y, list_cosine_similarity(a.v, b.v) c FROM p a, p b WHERE a.id <> b.id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) k FROM s) WHERE k <= 10 AND c >= 0.8)
SELECT DISTINCT least(x, y) AS point_id_a, greatest(x, y) AS point_id_b FROM t""",
    "p4_found": f"""WITH w AS (SELECT id, {WORDS.format("content")} ws FROM (SELECT DISTINCT id, content FROM reviews)),
t AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) >= 40)),
n AS (SELECT id, count(*) n FROM t GROUP BY id), b AS (SELECT x.id a, y.id b, count(*) k FROM t x JOIN t y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT a AS review_id_a, b AS review_id_b FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9""",
    "p7_found": f"""WITH d AS (SELECT doc_id id, {WORDS.format("text")} ws FROM documents), e AS (SELECT item_id id, {WORDS.format("text")} ws FROM eval_items),
dg AS (SELECT id, array_to_string(ws[i : i + 11], ' ') g FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) i FROM d WHERE len(ws) >= 12)),
eg AS (SELECT id, array_to_string(ws[i : i + 11], ' ') g FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) i FROM e WHERE len(ws) >= 12))
SELECT DISTINCT dg.id AS doc_id, eg.id AS item_id FROM dg JOIN eg USING (g)""",
    "p9_found": """WITH w AS (SELECT doc_id, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1) SELECT DISTINCT doc_id FROM w JOIN s USING (h)""",
}
