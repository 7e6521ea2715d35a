"""Vector functions. Similarities with a few query vectors are one matrix product per Arrow batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns as an expression; 0.0 where a vector has length zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    row = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))
    x = col.take(pa.array(row)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    size = np.linalg.norm(x, axis=1)
    ok = np.isfinite(size) & (size > 0)
    return row[ok], x[ok] / size[ok, None]


def score_against(df: DataFrame, vector_col: str, query: list[float], keep: list[str], least: float, most: int | None = None) -> DataFrame:
    """Rows of df whose vector has at least this cosine similarity with query: the columns keep and score.

    Unusable vectors (NULL, other length, length zero, NULL or NaN inside) never score. most: from each task only the rows of
    the so many ids (the first of keep) with the greatest scores, of each id the best row; no others can be among the first most.
    """
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    dim = len(q)

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by([("score", "descending"), (keep[0], "ascending"), *((k, "ascending") for k in keep[1:])])
        ids = t.column(keep[0]).combine_chunks().dictionary_encode()
        once = np.unique(ids.indices.to_numpy(zero_copy_only=False), return_index=True)[1]
        return t.take(pa.array(np.sort(once)[:most]))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in run(batches):
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                held = first(t if held is None else pa.concat_tables([held, t]))
        yield from held.to_batches() if held is not None else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = _matrix(batch.column(vector_col), dim)
            score = x @ q
            some = score >= least
            at = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keep), pa.array(score[some], pa.float64())], [*keep, "score"])

    fields = [df.schema[k] for k in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    return df.where(F.size(vector_col) == dim).select(*keep, vector_col).mapInArrow(top if most else run, schema)


def score_many(df: DataFrame, id_col: str, vector_col: str, queries: dict[str, list[float]], least: float) -> DataFrame:
    """(query_id, id, score) for a bounded set of queries against all rows."""
    names = np.array(list(queries), object)
    q = np.array([np.asarray(v, np.float64) / (np.linalg.norm(v) or 1.0) for v in queries.values()])
    dim = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = _matrix(batch.column(vector_col), dim)
            s = x @ q.T
            i, j = np.nonzero(s >= least)
            yield pa.record_batch({"query_id": pa.array(names[j], pa.string()), "id": batch.column(id_col).take(pa.array(row[i])).cast(pa.string()), "score": s[i, j]})

    return df.select(id_col, vector_col).mapInArrow(run, "query_id string, id string, score double")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: signed hashing of words, unit length; an empty text is the zero vector."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        memo: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(texts):
            for w in (t or "").split():
                if w not in memo:
                    h = int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:8], "little")
                    memo[w] = (h >> 1) % self.dim, 1 if h & 1 else -1
                at, sign = memo[w]
                out[i, at] += sign
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)


def embed_texts(model: Embedder, texts: list[str], size: int = 32) -> np.ndarray:
    """Vectors of texts, size of them at a time; no texts give no vectors."""
    parts = [model.embed(texts[i : i + size]) for i in range(0, len(texts), size)]
    return np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, model.dim), np.float32)


def embed(text: Column, embedder: Embedder | None = None, size: int = 32) -> Column:
    """Vectors of preprocessed texts in batches of size; the embedder is loaded once per worker."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embed_texts(model, texts.fillna("").tolist(), size)))

    return run(text)
