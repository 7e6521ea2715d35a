"""Problem 8: mixing sources to target shares of tokens, by pivotal dependent rounding.

With A the tokens of a source, w its share (shares of sources without tokens are spread over the others in proportion) and r its cap,
the mixture has T tokens, by default the most that every source can give: T = min(r A / w). Each document of a source then should
occur x = w T / A times: floor(x) copies for certain, and a fraction that pivotal rounding makes 0 or 1. Two undecided documents
meet; tokens move from one to the other, in a direction drawn so that expectations stay, until one is at 0 or 1; the other goes
on. Every step keeps the source's tokens, so that a source misses its target by less than one document.

Rounding runs in buckets of about BUCKET documents; the at most one undecided document of each bucket goes on to the next level, where FAN
buckets of one source make one, until one is left and is drawn by itself. Draws depend on the seed and the document alone.

Defined results: rows with a NULL id or source and sources without a target take no part; NULL and empty texts have no tokens and are
never used; NULL shares count as 0, NULL caps as 1; a target listed twice is an error; repeated ids are separate documents
with the same draw; without any usable source the mixture is empty.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BUCKET, FAN = 5000, 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary expects texts to be cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(vocabulary: bytes):
    """The encoding of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(vocabulary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "source": batch.column("source"), "tokens": pa.array(n, pa.int64())})

    return run


def token_sizes(df: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens); the tokenizer's file is read on the driver and its content goes to the tasks."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.where("doc_id IS NOT NULL AND source IS NOT NULL").mapInArrow(_sizes(Path(tokenizer).read_bytes()), "doc_id long, source string, tokens long")


def pivot(part: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Parts made 0 or 1 one after the other, with the sum of part * size kept; and the row left undecided (-1: none)."""
    p = part.astype(float).tolist()
    s, u = size.tolist(), draw.tolist()
    eps = 1e-9
    held = -1
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(round(p[i]))
            continue
        if held < 0:
            held = i
            continue
        give, take = min((1 - p[held]) * s[held], p[i] * s[i]), min(p[held] * s[held], (1 - p[i]) * s[i])
        move = give if u[i] * (give + take) < take else -take
        p[held] += move / s[held]
        p[i] -= move / s[i]
        left = [k for k in (held, i) if eps < p[k] < 1 - eps]
        for k in (held, i):
            if k not in left:
                p[k] = float(round(p[k]))
        held = left[0] if left else -1
    return np.array(p), held


SCHEMA = "doc_id long, source string, tokens long, base long, part double, bucket long, open boolean"


def _round(seed: int, fan: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"]).reset_index(drop=True)
        with np.errstate(over="ignore"):
            h = (pdf["doc_id"].to_numpy().astype(np.uint64) + np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            order = np.argsort(h, kind="stable")
            h = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(11)
        pdf, draw = pdf.iloc[order].reset_index(drop=True), h[order] / 2.0**53
        part, held = pivot(pdf["part"].to_numpy(), pdf["tokens"].to_numpy(), draw)
        if held >= 0 and fan == 0:
            part[held] = float(draw[held] < part[held])
            held = -1
        pdf["part"], pdf["open"] = part, np.arange(len(pdf)) == held
        pdf["bucket"] = pdf["bucket"] // max(fan, 1)
        return pdf

    return run


def mixture(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, text_col: str, total: float | None = None, tokenizer: str = TOKENIZER, seed: int = 1, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mixture and how often each is used; total: tokens wanted."""
    rows = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").toLocalIterator()
    wanted: dict[str, tuple[float, int]] = {}
    for r in rows:
        if r["source"] in wanted:
            raise ValueError(f"two targets for {r['source']}")
        wanted[r["source"]] = (r["target_share"] or 0.0, 1 if r["max_repeats"] is None else r["max_repeats"])
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    sizes = cut(token_sizes(docs, id_col, source_col, text_col, tokenizer).where("tokens > 0").join(names, "source", "left_semi").select("doc_id", "source", "tokens"))
    have = {r["source"]: (r["tokens"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).toLocalIterator()}
    usable = {s: w for s, (w, r) in wanted.items() if s in have and w > 0 and r > 0}
    if not usable:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, copies long")
    share = {s: w / sum(usable.values()) for s, w in usable.items()}
    most = min(wanted[s][1] * have[s][0] / share[s] for s in share)
    times = {s: min(wanted[s][1], share[s] * (most if total is None else total) / have[s][0]) for s in share}
    times = {s: round(x) if abs(x - round(x)) < 1e-9 else x for s, x in times.items()}
    plan = spark.createDataFrame([(s, int(x), float(x - int(x)), max(1, math.ceil(have[s][1] / bucket))) for s, x in times.items()], "source string, base long, part double, buckets long")
    now = sizes.join(F.broadcast(plan), "source").select("doc_id", "source", "tokens", "base", "part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "buckets").alias("bucket"), (F.col("part") > 0).alias("open"))
    certain = now.where("NOT open")
    left = max(math.ceil(have[s][1] / bucket) for s in times)
    out, now = certain, now.where("open")
    while True:
        last = left <= 1
        done = cut(now.groupBy("source", "bucket").applyInPandas(_round(seed, 0 if last else fan), SCHEMA))
        out = out.unionByName(done.where("NOT open"))
        if last:
            break
        now, left = done.where("open"), math.ceil(left / fan)
    copies = F.col("base") + F.round("part").cast("long")
    return out.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, most_copies, tokens, actual_share): what each target's source really has."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    every = got.agg(F.sum("tokens").alias("every"))
    rows = targets.select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(every))
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "most_copies", "tokens")]
    return rows.select("source", "target_share", *number, F.round(F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)), 6).alias("actual_share"))
