"""Problem 9: long exact spans shared between texts, through MinHash of overlapping passages.

The paragraphs that are banded are all passages of least characters, sliding by one character, as shared spans need not begin or
end at paragraph borders. A passage's MinHash is the least hash of its character shingles of GRAM characters (ties: the
first), in one band of one row. Identical passages always have the same MinHash at the same place, so recall is exactly 1,
and consecutive passages mostly have the same one, so a text has only about 2 / (least - GRAM + 2) MinHashes per character.

MinHashes that occur in two texts are joined, the passages around them are verified by hashes of all their characters, and
texts with a verified passage in common are linked to the passage's first text, for the components and for what may be removed.

Defined results: NULL ids take no part; NULL and short texts have no spans; several rows with the same id count as one text
(the least text is taken); spans that a text repeats only within itself are not shared; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import textarrays as ta
from .runs import column, whole_runs

GRAM = 100
#: Rows of one MinHash whose passages are compared at a time; more are compared in slices of passage offsets.
ROWS = 20_000
#: Rows of one MinHash beyond which its passages are compared by an aggregation over all tasks, which combines equal ones before the shuffle.
HOT = 100_000


def _anchors(least: int):
    reach = least - GRAM + 1  # shingles in a passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cps, offs in ta.chunks(batch):
                if len(cps) < least:
                    continue
                h = ta.rolling(ta.prefix(cps), GRAM)
                at = np.uint64(28)
                m = (h >> at << at) | np.arange(len(h), dtype=np.uint64)
                size = 1
                while 2 * size <= reach:
                    m = np.minimum(m[:-size], m[size:])
                    size *= 2
                if reach > size:
                    m = np.minimum(m[: size - reach], m[reach - size :])
                inside = np.repeat(offs[1:], np.diff(offs))[: len(m)] - np.arange(len(m)) >= least
                pos = (m[inside] & np.uint64((1 << 28) - 1)).astype(np.int64)
                if not len(pos):
                    continue
                pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
                row = np.searchsorted(offs, pos, "right") - 1
                yield pa.record_batch({"fp": h[pos].view(np.int64), "id": part.column("id").take(pa.array(row)), "pos": (pos - offs[row]).astype(np.int32)})

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MinHashes that occur in more than one text; the rows come sorted by MinHash and text, and stream through."""
    key, first, held, shared = None, None, [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, doc = batch.column("fp").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
        border = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1], [True]]))
        for lo, hi in ((border[0], border[1]), (border[-2], border[-1])) if len(border) > 2 else ((border[0], border[1]),):
            if lo == border[0]:  # may continue the run before
                if fp[lo] != key:
                    key, first, held, shared = fp[lo], doc[lo], [], False
                part = batch.slice(lo, hi - lo)
                if shared or doc[hi - 1] != first:
                    yield from [*held, part]
                    held, shared = [], True
                else:
                    held.append(part)
        if len(border) > 2:
            size = np.diff(border)
            many = doc[border[:-1]] != doc[border[1:] - 1]
            many[0] = many[-1] = False
            if many.any():
                yield batch.filter(pa.array(np.repeat(many, size)))
            lo, hi = border[-2], border[-1]
            key, first, shared = fp[lo], doc[lo], doc[hi - 1] != doc[lo]
            held = [] if shared else [batch.slice(lo, hi - lo)]
            if shared:
                yield batch.slice(lo, hi - lo)


def _one(col: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)


def _passages(t: pa.Table, least: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row's context, and key of the passages that begin lo to hi characters before the row's MinHash."""
    rows, starts, keys = [], [], []
    fp, lead = column(t, "fp").view(np.uint64), column(t, "lead").astype(np.int64)
    for at in range(0, t.num_rows, 2000):
        cps, offs = ta.decode(_one(t.column("text").slice(at, 2000)))
        n, d = np.diff(offs), lead[at : at + len(offs) - 1]
        begin, end = np.maximum(0, d - hi + 1), np.minimum(d - lo, n - least) + 1
        count = np.maximum(end - begin, 0)
        row = np.repeat(np.arange(len(n)), count)
        start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]
        s = offs[row] + start
        h = ta.span_hash(ta.prefix(cps), s, s + least)
        rows.append(row + at)
        starts.append(start)
        keys.append(ta.mix(h ^ ta.mix((d[row] - start).astype(np.uint64) + np.uint64(7))) ^ fp[at + row])
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(keys)


def _verify(least: int):
    def compare(t: pa.Table, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        row, start, key = _passages(t, least, lo, hi)
        if not len(row):
            return
        own = _one(t.column("id"))
        ids = own.dictionary_encode()
        by = pc.array_sort_indices(ids.dictionary).to_numpy()
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        names, doc = ids.dictionary.take(pa.array(by)), rank[ids.indices.to_numpy()][row]
        order = np.lexsort((doc, key))
        k, d = key[order], doc[order]
        border = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(border, len(k)))
        low, high = d[border], d[border + size - 1]
        shared = np.empty(len(k), bool)
        shared[order] = np.repeat(low != high, size)
        link = np.empty(len(k), np.int64)
        link[order] = np.repeat(low, size)
        row, start, link = row[shared], start[shared], link[shared]
        if not len(row):
            return
        # passages of one row that follow each other and have the same first text make one span
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (link[1:] != link[:-1])])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(row)) - 1
        base = (column(t, "pos").astype(np.int64) - column(t, "lead"))[row[a]]
        yield pa.record_batch({"id": own.take(pa.array(row[a])), "begin": (base + start[a]).astype(np.int32), "end": (base + start[b] + least).astype(np.int32), "link": names.take(pa.array(link[a]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = least - GRAM + 1
        for t in whole_runs(batches, "fp"):
            fp = column(t, "fp")
            border = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1], [True]]))
            lo = 0
            while lo < len(border) - 1:  # as many runs as make up to ROWS rows, or one larger run
                hi = max(lo + 1, int(np.searchsorted(border, border[lo] + ROWS, "right")) - 1)
                part = t.slice(border[lo], border[hi] - border[lo])
                step = max(1, reach * ROWS // max(part.num_rows, ROWS))
                for o in range(0, reach, step):
                    yield from compare(part, o, min(reach, o + step))
                lo = hi

    return run


def _each(least: int):
    """Every passage of rows by itself, for MinHashes too common for one task: its key, text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                t = pa.Table.from_batches([batch.slice(lo, 2000)])
                row, start, key = _passages(t, least, 0, least - GRAM + 1)
                begin = (column(t, "pos").astype(np.int64) - column(t, "lead"))[row] + start
                yield pa.record_batch({"key": key.view(np.int64), "id": _one(t.column("id")).take(pa.array(row)), "begin": begin.astype(np.int32)})

    return run


def shared_pieces(df: DataFrame, id_col: str, text_col: str, least: int = 200) -> DataFrame:
    """(id, begin, end, link): verified spans, overlapping and in pieces; link is a text that has the same span."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))
    anchors = docs.mapInArrow(_anchors(least), f"fp long, id {kind}, pos int")
    shared = anchors.repartition("fp").sortWithinPartitions("fp", "id").mapInArrow(_repeated, f"fp long, id {kind}, pos int")
    reach = least - GRAM
    lead = F.least("pos", F.lit(reach))
    texts = docs.groupBy("id").agg(F.min("text").alias("text"))

    def around(rows: DataFrame) -> DataFrame:
        return rows.join(texts, "id").select("fp", "id", "pos", lead.alias("lead"), F.substring("text", F.col("pos") - lead + 1, lead + least).alias("text"))

    shared = cut(shared)
    hot = cut(shared.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("fp"))
    some = not hot.isEmpty()
    cold = around(shared.join(hot, "fp", "left_anti") if some else shared)
    out = cold.repartition("fp").sortWithinPartitions("fp", "id").mapInArrow(_verify(least), f"id {kind}, begin int, end int, link {kind}")
    if some:
        each = around(shared.join(hot, "fp", "left_semi")).mapInArrow(_each(least), f"key long, id {kind}, begin int")
        known = each.groupBy("key").agg(F.min("id").alias("link"), F.max("id").alias("high")).where("link <> high")
        out = out.unionByName(each.join(known, "key").select("id", "begin", (F.col("begin") + least).alias("end"), "link"))
    return out


def shared_spans(df: DataFrame, id_col: str, text_col: str, least: int = 200) -> DataFrame:
    """(id, begin, end): the maximal stretches of each text every passage of which occurs in another text (offsets from 0)."""
    return _merged(shared_pieces(df, id_col, text_col, least))


def _merged(pieces: DataFrame) -> DataFrame:
    """Overlapping and adjoining pieces of a text as one."""
    pieces = pieces.groupBy("id", "begin").agg(F.max("end").alias("end"))
    w = Window.partitionBy("id").orderBy("begin")
    marked = pieces.withColumn("new", (F.col("begin") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    return marked.withColumn("n", F.sum("new").over(w)).groupBy("id", "n").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("n")


def shared_coverage(df: DataFrame, id_col: str, text_col: str, least: int = 200) -> DataFrame:
    """(id, n_chars, shared_chars, shared_share): for every text how much of it also occurs in another text."""
    spans = shared_spans(df, id_col, text_col, least).groupBy("id").agg(F.sum(F.col("end") - F.col("begin")).alias("shared"))
    size = df.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars")).where("id IS NOT NULL").groupBy("id").agg(F.max("n_chars").alias("n_chars"))
    shared = F.coalesce("shared", F.lit(0)).cast("long")
    return size.join(spans, "id", "left").select("id", "n_chars", shared.alias("shared_chars"), F.round(shared / F.greatest("n_chars", F.lit(1)), 6).alias("shared_share"))


def removals(df: DataFrame, id_col: str, text_col: str, least: int = 200) -> DataFrame:
    """(id, begin, end): what may be removed of each text so that every shared passage stays once, in the least text that has it."""
    return _merged(shared_pieces(df, id_col, text_col, least).where("id <> link"))


def sharing_groups(df: DataFrame, id_col: str, text_col: str, least: int = 200) -> DataFrame:
    """(id, group_id): components of texts linked by shared spans. What may be removed is not whole texts, see removals."""
    from .components import components

    links = shared_pieces(df, id_col, text_col, least).select(F.col("id").alias("a"), F.col("link").alias("b"))
    return components(links).select("id", F.col("component").alias("group_id"))
