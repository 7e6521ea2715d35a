"""Problem 7: evaluation passages in a corpus, through a distributed positional inverted index.

Indexing: each task turns blocks of texts into index segments. A segment has, for each of its words, the ascending word
positions (one running count over the segment's texts, with a free place between texts) as delta-coded variable-length bytes,
and a directory of its texts. Segments are written to the shared folder; the index has every word of every text.

Searching: the posting lists of the test words, laid side by side, give the runs of NEAR test words in a segment; these are joined
with the runs of NEAR words of the items, all of them, so no match depends on a word that may have been edited. Joined runs of one
alignment that follow one another are one run. Runs of least words or more are exact matches; runs of NEAR words or more that
together cover half of an item are proximity matches.

Items go to the segments in blocks of at most BLOCK_CHARS characters of item text, which bounds what is broadcast.

Defined results: NULL ids, NULL and empty texts and items of fewer than least words match nothing; repeated rows count once;
items with equal texts are each reported; ids must be integers; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import textarrays as ta
from .runs import column, whole_runs

BLOCK_CHARS = 4_000_000
#: Words in a row that count towards the covered part of an item.
NEAR = 4
#: Joined runs of a segment and of items that are held at a time.
PAIRS = 4_000_000
INDEX = "seg long, term long, n int, posts binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of unsigned values, seven bits a byte, and where each value ends."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[end[some] - size[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, end


def unpack(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    size, out = end - start + 1, np.zeros(len(end), np.int64)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[some] |= (data[start[some] + k].astype(np.int64) & 127) << 7 * k
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, cps, offs in ta.chunks(batch):
            start, end, first = ta.words(cps, offs)
            number += 1
            if not len(start):
                continue
            term = ta.word_hashes(cps, start, end).view(np.int64)
            pos = np.arange(len(term)) + np.repeat(np.arange(len(part)), np.diff(first))
            order = np.argsort(term, kind="stable")
            term, pos = term[order], pos[order]
            border = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]]))
            delta = np.diff(pos, prepend=0)
            delta[border[:-1]] = pos[border[:-1]]
            data, at = pack(delta)
            offsets = np.concatenate([[0], at[border[1:] - 1]]).astype(np.int32)
            posts = pa.Array.from_buffers(pa.binary(), len(border) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            n = len(border) - 1
            yield pa.record_batch({"seg": np.full(n, number), "term": term[border[:-1]], "n": np.diff(border).astype(np.int32), "posts": posts})
            texts = np.stack([part.column("id").to_numpy(), first[:-1] + np.arange(len(part))]).astype(np.int64).tobytes()
            yield pa.record_batch({"seg": np.array([number]), "term": pa.nulls(1, pa.int64()), "n": np.array([len(part)], np.int32), "posts": pa.array([texts], pa.binary())})


def build_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index of all words of all texts, kept in the shared folder."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return cut(rows.mapInArrow(_segments, INDEX))


class Items:
    """One block of items: their words, and the runs of words that any match contains."""

    def __init__(self, rows: pa.Table, least: int):
        batch = rows.combine_chunks()
        cps, offs = ta.decode(batch.column("text").combine_chunks() if batch.num_rows else pa.array([], pa.string()))
        start, end, self.first = ta.words(cps, offs)
        self.term = ta.word_hashes(cps, start, end).view(np.int64) if len(start) else np.empty(0, np.int64)
        self.id = batch.column("id").to_numpy()
        self.least = least
        self.terms = np.unique(self.term)
        word = (np.searchsorted(self.terms, self.term) + 1).astype(np.uint64)
        self.run = min(NEAR, least)
        width = np.diff(self.first)
        self.at = np.arange(len(word)) - np.repeat(self.first[:-1], width)
        self.item = np.repeat(np.arange(len(self.id)), width)
        start = np.flatnonzero((self.at + self.run <= width[self.item]) & (width[self.item] >= least))
        gram = grams(word, self.run)[start]
        order = np.argsort(gram, kind="stable")
        self.start, (self.gram, begin) = start[order], np.unique(gram[order], return_index=True)
        self.begin = np.append(begin, len(start))


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, as many as there are places with n words."""
    h = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for j in range(n):
        h = ta.mix(h * np.uint64(ta.BASE) + word[j : j + len(h)])
    return h


def _search(items: Items, near_share: float):
    def segment(t: pa.Table) -> Iterator[pa.RecordBatch]:
        directory = t.filter(t.column("term").is_null())
        lists = t.filter(t.column("term").is_valid())
        if not directory.num_rows or not lists.num_rows:
            return
        ids, begin = np.frombuffer(directory.column("posts")[0].as_py(), np.int64).reshape(2, -1)
        term, n = column(lists, "term"), column(lists, "n").astype(np.int64)
        pos = unpack(np.frombuffer(b"".join(x.as_py() for x in lists.column("posts")), np.uint8))
        end = np.cumsum(n)
        total = np.cumsum(pos)
        pos = total - np.repeat(np.concatenate([[0], total[end[:-1] - 1]]), n)
        # the word at each place of the segment, as far as it is a test word; 0 elsewhere
        at = np.zeros(int(pos.max()) + 1, np.uint64)
        at[pos] = np.repeat(np.searchsorted(items.terms, term) + 1, n)
        gap = np.concatenate([[0], np.cumsum(at == 0)])
        place = np.flatnonzero(gap[items.run :] == gap[: -items.run])
        gram = grams(at, items.run)[place]
        if not len(gram):
            return
        row = np.minimum(np.searchsorted(items.gram, gram), len(items.gram) - 1)
        hit = items.gram[row] == gram
        place, row = place[hit], row[hit]
        order = np.argsort(row, kind="stable")
        place, row = place[order], row[order]
        # each run of an item with the places of the same run; whole items at a time, as many as memory is meant for
        lo, hi = (np.searchsorted(row, np.arange(len(items.gram)), side) for side in ("left", "right"))
        own = np.repeat(np.arange(len(items.gram)), np.diff(items.begin))
        some = np.flatnonzero(hi[own] > lo[own])
        some = some[np.argsort(items.item[items.start[some]], kind="stable")]
        start, lo, count = items.start[some], lo[own[some]], (hi - lo)[own[some]]
        border = np.flatnonzero(np.diff(items.item[start], prepend=-1, append=-1))
        total = np.concatenate([[0], np.cumsum(count)])
        x = 0
        while x < len(border) - 1:
            y = max(x + 1, int(np.searchsorted(total[border], total[border[x]] + PAIRS, "right")) - 1)
            own = slice(border[x], border[y])
            k = np.repeat(start[own], count[own])
            p = place[np.arange(len(k)) + np.repeat(lo[own] - total[own] + total[border[x]], count[own])]
            yield from matches(ids, begin, items.item[k], items.at[k], p)
            x = y

    def matches(ids: np.ndarray, begin: np.ndarray, item: np.ndarray, at: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((at, p - at, item))
        item, at, p = item[order], at[order], p[order]
        doc = np.searchsorted(begin, p, "right") - 1
        new = np.ones(len(p), bool)
        new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (p[1:] != p[:-1] + 1)
        length = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0)) + items.run
        order = np.lexsort((at, item, doc))
        item, at, doc, length = item[order], at[order], doc[order], length[order]
        new = np.ones(len(p), bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
        border = np.flatnonzero(new)
        long = np.maximum.reduceat(length, border)
        step = np.full(len(p), items.run)
        step[1:][~new[1:]] = np.minimum(at[1:] - at[:-1], items.run)[~new[1:]]
        covered = np.add.reduceat(step, border)
        item, doc = item[border], doc[border]
        words = np.diff(items.first)[item]
        ok = (long >= items.least) | (covered >= near_share * words)
        yield pa.record_batch({"doc_id": ids[doc][ok], "item_id": items.id[item][ok], "longest_run": long[ok].astype(np.int32), "covered_words": covered[ok].astype(np.int32), "item_words": words[ok].astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "seg"):
            seg = column(t, "seg")
            border = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1], [True]]))
            for lo, hi in zip(border[:-1], border[1:]):
                yield from segment(t.slice(lo, hi - lo))

    return run


def leaks(corpus: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str = "text", least: int = 12, near_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, longest_run, covered_words, item_words): exact (longest_run >= least) and proximity matches."""
    return search(build_index(corpus, doc_id, text_col), items, item_id, text_col, least, near_share)


def search(index: DataFrame, items: DataFrame, item_id: str, text_col: str = "text", least: int = 12, near_share: float = 0.5) -> DataFrame:
    """leaks in the corpus of an index, which serves any number of searches."""
    spark = index.sparkSession
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    chars = tests.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(1.2 * chars / BLOCK_CHARS)) if chars > BLOCK_CHARS else 1
    out = None
    for b in range(blocks):
        block = Items(tests.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow(), least)
        terms = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(block.terms, pa.int64())})))
        known = index.join(terms, "term", "left_semi").select(*index.columns)
        if not len(block.gram):
            continue
        part = known.unionByName(index.where("term IS NULL")).repartition("seg").sortWithinPartitions("seg")
        hits = part.mapInArrow(_search(block, near_share), "doc_id long, item_id long, longest_run int, covered_words int, item_words int")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, longest_run int, covered_words int, item_words int")
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("longest_run", "covered_words", "item_words")))
