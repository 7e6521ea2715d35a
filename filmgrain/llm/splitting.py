"""Problem 1: splitting oversized texts by content-defined chunking.

A rolling hash over 32 characters marks landmarks about every 64 characters. From each cut the next cut is sought
between a least and a greatest distance: the first landmark in that window is snapped to the nearest end of the strongest
natural kind the window has (paragraph, line, sentence, word); a window without any such end is cut at the landmark
itself. As landmarks depend on the characters around them alone, an edit changes the pieces around it and cuts fall into step
again behind it. A piece begins about overlap characters before the cut, at the nearest natural end.

Every piece has at most size characters; pieces without their overlaps, one after the other, are the text. Defined
results: NULL text and empty text make one piece that is the text; a text of at most size characters is one piece; rows
with a NULL id are kept; repeated rows come out repeated; a cut never parts a letter from its combining marks unless the marks
alone fill the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

WINDOW, LANDMARK_BITS = 32, 6
#: Ends of sentences, closing marks that may follow them, and joining characters that no cut stands before.
STOPS = ".!?…。！？"
CLOSING = "\"')]»”’"
JOINERS = [*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x20D0, 0x2100), *range(0xFE00, 0xFE10), 0x200D, *range(0x1F3FB, 0x1F400)]


def _table(chars) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[list(chars)] = True
    return out


_TABLES: dict[str, np.ndarray] = {}


def _is(name: str, cps: np.ndarray) -> np.ndarray:
    if not _TABLES:
        _TABLES.update(stop=_table(map(ord, STOPS)), close=_table(map(ord, CLOSING)), join=_table(JOINERS), space=_table(c for c in range(0x3001) if chr(c).isspace()))
    return _TABLES[name][cps]


def landmarks(cps: np.ndarray) -> np.ndarray:
    """Whether the WINDOW characters that end before each position mark it."""
    if not len(cps):
        return np.zeros(0, bool)
    h = ta.mix(cps.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < WINDOW:
        h[size:] = h[size:] + (h[:-size] << np.uint64(size))
        size *= 2
    return (ta.mix(h) & np.uint64((1 << LANDMARK_BITS) - 1)) == 0


def ends(cps: np.ndarray) -> np.ndarray:
    """For each position between characters (0 to n) how natural a cut there is: 4 paragraph, 3 line, 2 sentence, 1 word, 0 none, -1 never."""
    n = len(cps)
    rank = np.zeros(n + 1, np.int8)
    space, stop = _is("space", cps), _is("stop", cps)
    newline = cps == 10
    after = np.zeros(n, bool)  # a space run ends here: the next character isn't a space
    after[:-1] = space[:-1] & ~space[1:]
    after[-1:] = space[-1:]
    rank[1:][after] = 1
    run = np.maximum.accumulate(np.where(~space, np.arange(n), -1))  # last character before the run of spaces
    lines = np.concatenate([[0], np.cumsum(newline)])
    at = np.flatnonzero(after)
    before = run[at]
    closed = before.copy()
    for _ in range(2):
        shut = (closed >= 0) & _is("close", cps[closed])
        closed = np.where(shut, closed - 1, closed)
    rank[at[(closed >= 0) & stop[closed]] + 1] = 2
    breaks = lines[at + 1] - lines[before + 1]
    rank[at[breaks == 1] + 1] = 3
    rank[at[breaks >= 2] + 1] = 4
    rank[:n][_is("join", cps)] = -1
    rank[1:][cps == 0x200D] = -1
    return rank


def cuts(cps: np.ndarray, mark: np.ndarray, size: int, overlap: int) -> list[int]:
    """Start and end of each piece and where its new part begins, flat, for one text longer than size."""
    n, rank, out = len(cps), ends(cps), []
    start = cut = 0
    least = max(1, (size - overlap) // 2)
    while n - start > size:
        lo, hi = min(cut + least, start + size), start + size
        window = rank[lo : hi + 1]
        hit = np.flatnonzero(mark[lo - 1 : hi])
        aim = lo + int(hit[0]) if len(hit) else hi
        best = int(window.max())
        pick = np.flatnonzero(window == best)
        end = lo + int(pick[np.argmin(np.abs(pick + lo - aim))]) if best > 0 else aim
        if best <= 0 and rank[end] < 0:
            good = np.flatnonzero(window >= 0)
            end = lo + int(good[np.argmin(np.abs(good + lo - aim))]) if len(good) else end
        out += [start, end, cut]
        cut = end
        target = cut - overlap
        a, b = max(out[-1] + 1, target - overlap // 2), min(cut, target + overlap // 2)
        near = np.flatnonzero(rank[a:b] > 0) + a
        start = int(near[np.argmin(np.abs(near - target))]) if len(near) else max(target, out[-1] + 1)
        while start > a and rank[start] < 0:
            start -= 1
    return out + [start, n, cut]


def _plan(size: int, overlap: int):
    def plan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[int]] = []
            for _, cps, offs in ta.chunks(pa.record_batch({"text": pa.array(texts, pa.string())})):
                for lo, hi in zip(offs[:-1], offs[1:]):
                    c = cps[lo:hi]
                    out.append(cuts(c, landmarks(c), size, overlap) if hi - lo > size else [0, int(hi - lo), 0])
            yield pd.Series(out)

    return plan


def split(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, piece_no, n_pieces, begin, end, new_from, piece): the pieces of every text in order; offsets count characters from 0.

    piece is text[begin:end]; what stands before new_from repeats the piece before. Only oversized texts go through Python.
    """
    if not 0 <= overlap * 2 < size:
        raise ValueError("overlap must be less than half of size")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > size, F.lit(False))
    plan = F.pandas_udf(_plan(size, overlap), "array<int>").asNondeterministic()  # else conditions on its result make it run twice
    spans = rows.where(long).withColumn("plan", plan("text")).withColumn("n_pieces", (F.size("plan") / 3).cast("int"))
    pieces = spans.select("id", "text", "plan", "n_pieces", F.explode(F.sequence(F.lit(1), "n_pieces")).alias("piece_no"))
    at = [F.element_at("plan", F.col("piece_no") * 3 - k) for k in (2, 1, 0)]
    pieces = pieces.select("id", "piece_no", "n_pieces", at[0].alias("begin"), at[1].alias("end"), at[2].alias("new_from"), F.substring("text", at[0] + 1, at[1] - at[0]).alias("piece"))
    whole = rows.where(~long).select("id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("begin"), F.coalesce(F.length("text"), F.lit(0)).alias("end"), F.lit(0).alias("new_from"), F.col("text").alias("piece"))
    return pieces.unionByName(whole)
