"""Problem 4: near-duplicate texts through pigeonhole blocks over MinHash fingerprints.

A text's fingerprint has MinHash symbols of its word shingles, cut into blocks of 3; how many depends on the threshold. At J = 0.60
there are 40 blocks: two fingerprints that differ in fewer than 40 symbols share a block by the pigeonhole principle; pairs farther
apart share one with probability 1 - (1 - J**3)**40, which is 0.99994 at J = 0.60. Texts meet by an equi-join on blocks. Pairs that met
are verified by the Hamming distance of a 128-bit sketch (one bit for each of 128 MinHash values), then by their exact shingle sets.

Exact copies form one class, named by a content hash, before any pair is made. Copies are dropped from each batch before the
shuffle and while blocks are read, so a group of copies costs a block one entry a batch. Entries travel packed, many to a shuffle
row. Blocks shared by very many different texts are cut into chunks whose pairs of chunks are compared by separate tasks: no
cap, no lost pair. Only texts that met another (by a bitmap of fixed size, then by a join) are shuffled for verification.

Defined results: NULL ids and texts with fewer than min_words words take no part; NULL text is an empty text; rows delivered
again (same id, same text) count once; an id with two different texts is paired with both texts' partners, never with itself;
empty tables give empty results; other columns of the input are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import components
from .runs import column, whole_runs

WIDTH, BITS = 3, 128
#: Share of the pairs at the threshold itself that the blocks may lose.
LOSS = 6e-5


class Shape(NamedTuple):
    """Blocks of a fingerprint, and how many bits of two sketches must agree: of pairs that share one, two, and more blocks."""

    blocks: int
    agree: tuple[int, int, int]


def shape(least: float) -> Shape:
    """At J = 0.60: 40 blocks, and 92, 90 and 85 bits.

    There the mean is 102.4 bits, the deviation 4.5, so that six pairs in 100,000 have fewer than 85, as many as share no block; seven
    in 10,000 share one block and 0.35 % two, so that one in 100,000 is lost by the higher numbers. At J = 0.20 the mean is 76.8.
    """
    blocks = math.ceil(math.log(LOSS) / math.log(1 - least**WIDTH)) if least < 1 else 1
    p = (1 + least) / 2
    mean, deviation = BITS * p, math.sqrt(BITS * p * (1 - p))
    few, some, many = (round(mean - k * deviation) for k in (2.3, 2.75, 3.85))
    return Shape(min(blocks, BITS // WIDTH), (few, some, many))


#: Different texts in one block beyond which chunks of the block are compared by separate tasks.
CHUNK = 16384
#: Parts of the blocks' keys for each shuffle partition; bits of the map of classes that have met another.
PARTS, MARKS = 4, 1 << 26
#: Members of a class of exact copies that are written out as pairs. Larger classes stand in pairs through their first id.
EXPAND = 200

_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 2**32, BITS, np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, BITS, np.uint32)


def fingerprint(g: np.ndarray, begin: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block keys (texts x blocks) and sketches (texts x 2) from shingle hashes; begin: where each text's shingles begin, none empty."""
    x = (g >> np.uint64(32)).astype(np.uint32)
    mins = np.stack([np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], begin) for j in range(BITS)], 1).astype(np.uint64)
    keys = np.tile(np.arange(1, blocks + 1, dtype=np.uint64), (len(begin), 1))
    for j in range(WIDTH):
        keys = ta.mix(keys * np.uint64(ta.BASE) + mins[:, j : blocks * WIDTH : WIDTH])
    bits = ta.mix(mins * np.uint64(ta.BASE)) & np.uint64(1)
    return keys, (bits.reshape(-1, 2, 64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)


ENTRY = np.dtype([("key", "<u4"), ("c", "<i8"), ("s", "<i8"), ("t", "<i8")])


def _blocks(shingle: int, min_words: int, blocks: int, parts: int):
    """Entries of texts in blocks, packed by the block and the part of its keys: a shuffle row holds many entries of 28 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cps, offs in ta.chunks(batch):
                start, end, first = ta.words(cps, offs)
                c = part.column("c").to_numpy()
                ok = np.flatnonzero(np.diff(first) >= max(min_words, shingle))
                ok = ok[np.unique(c[ok], return_index=True)[1]]
                if not len(ok):
                    continue
                ok.sort()
                g, begin = ta.shingle_hashes(ta.word_hashes(cps, start, end), first, shingle)
                count = np.diff(begin)
                keep = np.zeros(len(count), bool)
                keep[ok] = True
                g = g[np.repeat(keep, count)]
                keys, sketch = fingerprint(g, np.concatenate([[0], np.cumsum(count[ok])[:-1]]), blocks)
                entry = np.empty(keys.shape, ENTRY)
                entry["key"] = keys & np.uint64(0xFFFFFFFF)
                for name, x in (("c", c[ok]), ("s", sketch[:, 0].view(np.int64)), ("t", sketch[:, 1].view(np.int64))):
                    entry[name] = x[:, None]
                to = (((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32) + parts * np.arange(blocks, dtype=np.int32)).ravel()
                order = np.argsort(to, kind="stable")
                border = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
                data = entry.ravel()[order]
                blobs = pa.Array.from_buffers(pa.binary(), len(border) - 1, [None, pa.py_buffer((border * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.record_batch({"part": to[order][border[:-1]], "blob": blobs})

    return run


def _agree(s: np.ndarray, t: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """In how many bits the sketches (s, t) and (u, v) agree."""
    return BITS - (np.bitwise_count((s ^ u).view(np.uint64)) + np.bitwise_count((t ^ v).view(np.uint64))).astype(np.int16)


def _ordered(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs of different classes with the smaller class first."""
    keep = a != b
    return {"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "bits": bits[keep]}


def _meet(agree: int):
    """Pairs of classes in one block, and the chunks of blocks of more than CHUNK classes, whose pairs are compared elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "part"):
            part = column(t, "part")
            border = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for lo, hi in zip(border[:-1], border[1:]):
                e = np.frombuffer(b"".join(x.as_py() for x in t.column("blob").slice(lo, hi - lo)), ENTRY)
                yield from _compare(e, int(part[lo]), agree)

    return run


def _compare(e: np.ndarray, part: int, agree: int) -> Iterator[pa.RecordBatch]:
    key = e["key"]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    same[:-1] |= same[1:]  # the others are alone in their blocks
    order, key = order[same], key[same]
    c = e["c"][order]
    by = np.lexsort((c, key))
    order, key, c = order[by], key[by], c[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
    order, key, c = order[new], key[new], c[new]
    s, t = e["s"][order], e["t"][order]
    border = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    size = np.diff(border)
    for at, n in zip(border[:-1][size > CHUNK], size[size > CHUNK]):
        hot, chunks = (part << 32) | int(key[at]), -(-int(n) // CHUNK)
        for i in range(chunks):
            x = slice(at + i * CHUNK, min(at + (i + 1) * CHUNK, at + n))
            blob = np.stack([c[x], s[x], t[x]]).tobytes()
            one = {k: pa.array([v], pa.int64()) for k, v in (("hot", hot), ("i", i), ("n", chunks))}
            yield pa.record_batch({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "bits": pa.nulls(1, pa.int16())} | one | {"blob": pa.array([blob], pa.binary())})
    keep = np.repeat((size > 1) & (size <= CHUNK), size)
    key, c, s, t = key[keep], c[keep], s[keep], t[keep]
    i, d, found = np.arange(len(key)), 1, []
    while len(i := i[i + d < len(key)]) and len(i := i[key[i + d] == key[i]]):
        bits = _agree(s[i], t[i], s[i + d], t[i + d])
        near = bits >= agree
        found.append((c[i[near]], c[i[near] + d], bits[near]))
        d += 1
        if sum(len(x) for x, _, _ in found) > 1_000_000:
            yield _pairs(found)
            found = []
    if found:
        yield _pairs(found)


def _pairs(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pair = _ordered(*(np.concatenate(x) for x in zip(*found)))
    none = pa.nulls(len(pair["a"]), pa.int64())
    return pa.record_batch(pair | {"hot": none, "i": none, "n": none, "blob": pa.nulls(len(none), pa.binary())})


def _settle(agree: int):
    """Compares two chunks of a hot block, or one with itself. The rows come sorted by block and pair of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for hot, i, j, blob in zip(*(batch.column(k).to_pylist() for k in ("hot", "i", "j", "blob"))):
                if i != j and (held is None or held[:3] != (hot, i, j)):
                    held = hot, i, j, blob
                    continue
                (cx, sx, tx), (cy, sy, ty) = (np.frombuffer(v, np.int64).reshape(3, -1) for v in (held[3] if i != j else blob, blob))
                held = None
                for lo in range(0, len(cx), 256):
                    bits = _agree(sx[lo : lo + 256, None], tx[lo : lo + 256, None], sy, ty)
                    near = bits >= agree
                    if i == j:
                        near &= np.arange(lo, lo + len(bits))[:, None] < np.arange(len(cy))
                    p, q = np.nonzero(near)
                    yield pa.record_batch(_ordered(cx[lo : lo + 256][p], cy[q], bits[p, q]))

    return run


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) marks, the row of each, and the number of words of each row."""
    cps, offs = ta.decode(texts)
    start, end, first = ta.words(cps, offs)
    g, begin = ta.shingle_hashes(ta.word_hashes(cps, start, end), first, shingle)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(begin))
    marks, at = np.unique(g ^ ta.mix(row + np.uint64(1)), return_index=True)
    return marks, row[at].astype(np.int64), np.diff(first)


def _verify(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                n = batch.num_rows
                (ma, ra, _), (mb, rb, _) = (_sets(batch.column(x), shingle) for x in ("ta", "tb"))
                both = np.bincount(ra[np.isin(ma, mb, assume_unique=True)], minlength=n)
                union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
                j = both / np.maximum(union, 1)
                ok = pa.array(j >= least - 1e-12)
                yield pa.record_batch({"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok), "similarity": pa.array(j).filter(ok)})

    return run


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(c, id, text): c names the class of exact copies of a text."""
    return df.select(F.xxhash64(F.col(text_col)).alias("c"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")


def _marked(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = ta.mix(batch.column("c").to_numpy().view(np.uint64)) % np.uint64(MARKS)
            yield batch.filter(pa.array(bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1 > 0))

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.array(np.concatenate([[0], *(np.diff(ta.words(cps, offs)[2]) for _, cps, offs in ta.chunks(batch))])[1:].astype(np.int32))
        yield pa.record_batch({"c": batch.column("c"), "id": batch.column("id"), "words": out})


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = ta.mix(batch.column("c").to_numpy().view(np.uint64)) % np.uint64(MARKS)
        yield pa.record_batch({"at": (h >> np.uint64(6)).astype(np.int64), "bit": (h & np.uint64(63)).astype(np.int32)})


def marked(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of df whose c may be among those of wanted; a bitmap of MARKS bits, whatever the tables' sizes, says so. A join has to follow."""
    words = wanted.select("c").mapInArrow(_marks, "at long, bit int").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bits = np.zeros(MARKS // 64, np.int64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return df.mapInArrow(_marked(bits.view(np.uint8)), df.schema)


def similar_classes(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, least: float = 0.8, min_words: int = 1) -> DataFrame:
    """(a, b, similarity): classes of different texts, a < b, whose sets of word shingles have at least this Jaccard similarity."""
    from ..session import cut

    docs = classes(df, id_col, text_col)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number, (one, two, more) = shape(least)
    blocks = docs.where(F.length("text") >= 2 * min_words - 1).select("c", "text").mapInArrow(_blocks(shingle, min_words, number, -(-PARTS * n // number)), "part int, blob binary")
    met = cut(blocks.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_meet(more), "a long, b long, bits smallint, hot long, i long, n long, blob binary"))
    chunks = met.where("hot IS NOT NULL").repartition("hot", "i").select("hot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"), "i", "blob")
    chunks = chunks.select("hot", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), F.col("i").alias("own"), "blob")
    settled = chunks.repartition("hot", "i", "j").sortWithinPartitions("hot", "i", "j", "own").mapInArrow(_settle(more), "a long, b long, bits smallint")
    met = met.where("a IS NOT NULL").select("a", "b", "bits").unionByName(settled).groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("bits").alias("bits"))
    enough = F.when(F.col("shared") == 1, one).when(F.col("shared") == 2, two).otherwise(more)
    pairs = cut(met.where(F.col("bits") >= enough).select("a", "b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    texts = marked(docs.select("c", "text"), wanted).join(wanted, "c", "left_semi").groupBy("c").agg(F.min("text").alias("text"))
    with_texts = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
    return with_texts.select("a", "b", "ta", "tb").mapInArrow(_verify(shingle, least), "a long, b long, similarity double")


def _long(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(c, id, text) of texts that may have min_words words."""
    return classes(df, id_col, text_col).where(F.length("text") >= 2 * min_words - 1)


def membership(df: DataFrame, id_col: str, text_col: str, min_words: int, far: DataFrame) -> DataFrame:
    """(c, id, n, first): members of classes with at least min_words words, the class's size and its smallest id.

    Only classes of several ids and those in far (a, b) come out.
    """
    from ..session import cut

    kind = df.schema[id_col].dataType.simpleString()
    rows = _long(df, id_col, text_col, min_words)
    several = rows.groupBy("c").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("c")
    wanted = cut(several.unionByName(far.select(F.explode(F.array("a", "b")).alias("c"))).distinct())
    ids = marked(rows, wanted).mapInArrow(_words_of, f"c long, id {kind}, words int").where(F.col("words") >= min_words).select("c", "id").distinct()
    ids = ids.join(wanted, "c", "left_semi")
    return ids.join(ids.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first")), "c")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, least: float = 0.8, min_words: int = 1, expand: int = EXPAND) -> DataFrame:
    """(id_a, id_b, similarity) with id_a < id_b. Classes of more than expand exact copies stand in for their members by their first id."""
    from ..session import cut

    far = cut(similar_classes(df, id_col, text_col, shingle, least, min_words))
    members = membership(df, id_col, text_col, min_words, far)
    shown = members.where((F.col("n") <= expand) | (F.col("id") == F.col("first"))).select("c", "id")
    across = far.join(shown.select(F.col("c").alias("a"), F.col("id").alias("x")), "a").join(shown.select(F.col("c").alias("b"), F.col("id").alias("y")), "b")
    copies = members.where("n > 1")
    every = copies.where(F.col("n") <= expand)
    within = every.select("c", F.col("id").alias("x")).join(every.select("c", F.col("id").alias("y")), "c").where("x < y")
    star = copies.where((F.col("n") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    pairs = across.select("x", "y", "similarity").unionByName(within.select("x", "y", F.lit(1.0).alias("similarity"))).unionByName(star.withColumn("similarity", F.lit(1.0)))
    return pairs.where("x <> y").groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, least: float = 0.8, min_words: int = 1) -> DataFrame:
    """(id, group_id, links): one row for each id that has a partner; group_id is the least id of the connected group.

    links is the number of partners. Ids with the same texts are one kind, and links are sums over kinds, so that no group of
    copies, of whatever size, is written out as pairs.
    """
    from ..session import cut

    far = cut(similar_classes(df, id_col, text_col, shingle, least, min_words).select("a", "b"))
    members = membership(df, id_col, text_col, min_words, far).select("c", "id")
    ids = cut(members.groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("cs")).select("id", F.xxhash64("cs").alias("k"), "cs"))
    kinds = cut(ids.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("cs").alias("cs")))
    of = kinds.select("k", "n", "first", F.explode("cs").alias("c"))
    meet = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(of.select(F.col("c").alias("a"), F.col("c").alias("b")).distinct())
    near = of.join(meet, F.col("c") == F.col("a")).select(F.col("k"), F.col("first").alias("x"), "b")
    near = cut(near.join(of.select(F.col("c").alias("b"), F.col("k").alias("l"), "n", F.col("first").alias("y")), "b").select("k", "x", "l", "n", "y").distinct())
    links = near.groupBy("k", "x").agg((F.sum("n") - 1).alias("links")).where("links > 0")
    group = components(near.where("k <> l").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("id", "x")
    every = links.join(group, "x", "left").select("k", F.coalesce("component", "x").alias("group_id"), "links")
    return ids.select("id", "k").join(every, "k").select("id", "group_id", "links")
