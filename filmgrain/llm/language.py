"""Problem 6: language labels through error-correcting output codes over character n-grams.

Each language has a codeword of the exhaustive code (15 bits for five languages, any two codewords differ in 8). Every bit has
a binary classifier: log-odds of hashed character n-grams (one to four characters, borders included, and whole words) between the
languages with the bit set and those without, every language weighing the same. The bits of a sentence are the means over its
words; loss-weighted decoding takes the codeword with the least sum of logistic losses, each bit weighted by its accuracy in
training. The confidence is the decoded language's share in the softmax of the losses; under SURE the sentence is ambiguous.

Fitting takes a sample of at most about SAMPLE labelled texts. The first fit trusts the labels, the second takes the sentences that the first
was sure of; so wrong labels and mixed texts do little harm. Copies without diacritics are added at a smaller weight.

A text's languages are those of its sure sentences of at least MIN_WORDS words (MIN_LETTERS letters); if there are none, the best
one for all its words. Neighbouring sentences of one language form a segment; ambiguous ones join the segment before.

Defined results: NULL ids take no part; NULL or wordless texts have no language and no segment; markup and
entities count as blanks; rows with one id and text count once; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

LANGUAGES = ("en", "vi", "es", "fr", "de")
SAMPLE, BUCKETS, GRAMS = 4_000, 1 << 16, (1, 2, 3, 4)
#: Distinct words whose bits a worker remembers; a memory that is full is emptied, which only costs time.
MEMORY = 400_000
SURE, MIN_WORDS, MIN_LETTERS = 0.90, 4, 12
#: Characters beyond which a text is not fitted on (its languages are found all the same).
FIT_CHARS = 50_000
MARKUP = re.compile(r"<[^<>]{1,200}>|&#?\w{1,10};|https?://\S+")


def code(k: int) -> np.ndarray:
    """The exhaustive code: k codewords of 2**(k-1) - 1 bits, as -1 and 1."""
    bits = (np.arange((1 << k - 1) - 1)[None, :] + (1 << k - 1)) >> np.arange(k - 1, -1, -1)[:, None] & 1
    return (2 * bits - 1).astype(np.float32)


def sentences(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where sentences begin: at texts' beginnings, behind line ends, and behind stops that a space follows."""
    stop = (cps == 46) | (cps == 33) | (cps == 63) | (cps == 0x2026)
    cut = np.zeros(len(cps) + 1, bool)
    cut[1:] = cps == 10
    cut[1:-1] |= stop[:-1] & (cps[1:] == 32)
    cut[offs[:-1]] = True
    return np.flatnonzero(cut[:-1])


class Words:
    """The distinct words of a chunk of text, each word's place, and the sentence of each."""

    def __init__(self, cps: np.ndarray, offs: np.ndarray):
        text = cps.tobytes().decode("utf-32-le", "replace")
        low = ta.lower(cps)
        for m in MARKUP.finditer(text):
            low[m.start() : m.end()] = np.where(cps[m.start() : m.end()] == 10, 10, 32)
        at = np.flatnonzero(cps == 64)
        if len(at):  # addresses up to the spaces around them
            blank = np.concatenate([[-1], np.flatnonzero((cps <= 32) | (cps == 160)), [len(cps)]])
            right = np.searchsorted(blank, at)
            for a, b in zip(blank[right - 1], blank[right]):
                low[a + 1 : b] = 32
        self.begin = sentences(low, offs)
        self.text_of = np.searchsorted(offs, self.begin, "right") - 1
        start, end, _ = ta.words(low, offs)
        digit = (low[start] >= 48) & (low[start] <= 57)
        start, end = start[~digit], end[~digit]
        self.hash, once, self.word = np.unique(ta.span_hash(ta.prefix(low), start, end), return_index=True, return_inverse=True)
        self.size = end - start
        self.sentence = np.searchsorted(self.begin, start, "right") - 1
        self.low, self.start, self.length, self.n = low, start[once], end[once] - start[once] + 2, len(self.begin)

    def grams(self, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and distinct word of every n-gram; some: of these distinct words only, numbered anew."""
        start, length = (self.start, self.length) if some is None else (self.start[some], self.length[some])
        flat = np.full(int(length.sum()), 32, np.uint32)
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        body = (inner > 0) & (inner < np.repeat(length, length) - 1)
        flat[body] = self.low[(np.repeat(start, length) + inner - 1)[body]]
        p = ta.prefix(flat)
        word = np.repeat(np.arange(len(length)), length)
        buckets, owners = [], []
        for n in GRAMS:
            h = ta.rolling(p, n)
            keep = word[: len(h)] == word[n - 1 :][: len(h)]
            if n == 1:
                keep &= flat[: len(h)] != 32
            buckets.append((h[keep] >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(word[: len(h)][keep])
        ends = np.cumsum(length)
        buckets.append((ta.span_hash(p, ends - length, ends) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(np.arange(len(ends)))
        return np.concatenate(buckets), np.concatenate(owners)


class Model:
    def __init__(self, languages: tuple[str, ...] = LANGUAGES):
        self.languages, self.code = languages, code(len(languages))
        self.weight = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.trust = np.ones(self.code.shape[1], np.float32)
        self.known, self.score = np.empty(0, np.uint64), np.empty((0, self.code.shape[1]), np.float32)

    def fit(self, count: np.ndarray) -> None:
        """count: languages x buckets, how often n-grams occur."""
        p = count / np.maximum(count.sum(1, keepdims=True), 1)
        one = (self.code > 0).astype(np.float64).T
        a, b = (one @ p) / one.sum(1, keepdims=True), ((1 - one) @ p) / (1 - one).sum(1, keepdims=True)
        floor = 2e-6
        self.known, self.score = self.known[:0], self.score[:0]
        self.weight = np.clip(np.log((a + floor) / (b + floor)), -4, 4).astype(np.float32).T.copy()

    def margins(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' bits in each sentence, and the words' number."""
        bits = self.code.shape[1]
        if not len(w.word):
            return np.zeros((w.n, bits), np.float32), np.zeros(w.n)
        at = np.minimum(np.searchsorted(self.known, w.hash), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != w.hash) if len(self.known) else np.arange(len(w.hash))
        if len(new):
            bucket, owner = w.grams(new)
            each = np.bincount(owner, minlength=len(new))
            order = np.argsort(owner, kind="stable")
            score = np.add.reduceat(self.weight[bucket[order]], np.cumsum(each) - each) / each[:, None].astype(np.float32)
            if len(self.known) > MEMORY:
                self.known, self.score = np.empty(0, np.uint64), np.empty((0, bits), np.float32)
                return self.margins(w)
            where = np.searchsorted(self.known, w.hash[new])
            self.known, self.score = np.insert(self.known, where, w.hash[new]), np.insert(self.score, where, score, axis=0)
            at = np.searchsorted(self.known, w.hash)
        score = self.score[at]
        first = np.searchsorted(w.sentence, np.arange(w.n))
        number = np.bincount(w.sentence, minlength=w.n)
        out = np.zeros((w.n, bits), np.float32)
        some = number > 0
        out[some] = np.add.reduceat(score[w.word], first[some])
        return out, number

    def decode(self, total: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence from sums of bits; more words make surer."""
        return self.ranked(total, number)[:2]

    def ranked(self, total: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, and the language that comes next."""
        m = total / np.sqrt(np.maximum(number, 1))[:, None]
        loss = np.stack([(self.trust * np.logaddexp(0, -m * c)).sum(1) for c in self.code], 1) / self.trust.sum()
        e = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        order = np.argsort(loss, axis=1, kind="stable")
        return order[:, 0], 1 / e.sum(1), order[:, 1]


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")


def train(texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES) -> Model:
    model = Model(languages)
    label = np.array([languages.index(x) for x in labels], np.int64)

    def counts(words: Words, of_sentence: np.ndarray) -> np.ndarray:
        """Counts of n-grams; a sentence of language -1 is left out."""
        out = np.zeros((len(languages), BUCKETS))
        bucket, owner = words.grams()
        kinds = np.zeros((len(words.length), len(languages)))
        lang = of_sentence[words.sentence]
        np.add.at(kinds, (words.word[lang >= 0], lang[lang >= 0]), 1)
        for k in range(len(languages)):
            out[k] = np.bincount(bucket, kinds[owner, k], BUCKETS)
        return out

    if not texts:
        return model
    parts = [(Words(*ta.decode(pa.array(texts, pa.string()))), 1.0), (Words(*ta.decode(pa.array([bare(x) for x in texts], pa.string()))), 0.3)]
    given = [label[w.text_of] for w, _ in parts]
    for _ in range(2):
        model.fit(sum(weight * counts(w, of) for (w, weight), of in zip(parts, given)))
        for i, (w, _) in enumerate(parts):
            total, number = model.margins(w)
            lang, sure = model.decode(total, number)
            given[i] = np.where((sure >= SURE) & (number >= MIN_WORDS), lang, -1)
        total, number = model.margins(parts[0][0])
        ok = given[0] >= 0
        right = (np.sign(total[ok]) == model.code[given[0][ok]]).mean(0) if ok.any() else np.full(model.code.shape[1], 0.75)
        model.trust = np.log(np.clip(right, 0.55, 0.999) / (1 - np.clip(right, 0.55, 0.999))).astype(np.float32)
    return model


def label_of(lang: Column) -> Column:
    """A label without its region and in lower case; NULL where it says nothing."""
    x = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return F.when(~x.isin("", "und"), x)


def learn(df: DataFrame, text_col: str, lang_col: str, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model fitted on the driver on about SAMPLE labelled texts, drawn by hash."""
    known = df.select(F.col(text_col).alias("text"), label_of(F.col(lang_col)).alias("lang")).where(F.col("lang").isin(*languages) & (F.length("text") >= 40))
    n = known.count()
    # each different text is drawn or not, so that copies neither count nor travel; what is fitted on is bounded in characters too
    rows = known.where((F.pmod(F.xxhash64("text"), F.lit(max(n, 1))) < SAMPLE) & (F.length("text") <= FIT_CHARS)).groupBy("text").agg(F.min("lang").alias("lang")).toArrow().sort_by([("text", "ascending")]).to_pydict()
    return train(rows["text"], rows["lang"], languages)


def _segments(model: Model):
    names = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cps, offs in ta.chunks(batch):
                if not len(cps):
                    continue
                w = Words(cps, offs)
                total, number = model.margins(w)
                letters = np.bincount(w.sentence, w.size, w.n) if len(w.word) else np.zeros(w.n)
                lang, conf, after = model.ranked(total, number)
                sure = (conf >= SURE) & (number >= MIN_WORDS) & (letters >= MIN_LETTERS)
                n = len(part)
                has = np.bincount(w.text_of[sure], minlength=n) > 0
                words = np.bincount(w.text_of, number, n)
                whole = np.stack([np.bincount(w.text_of, t, n) for t in total.T], 1)
                all_lang, all_conf, all_after = model.ranked(whole, words)
                lang = np.where(has[w.text_of], lang, all_lang[w.text_of])
                conf = np.where(has[w.text_of], conf, all_conf[w.text_of])
                after = np.where(has[w.text_of], after, all_after[w.text_of])
                # an unsure sentence takes the language of the last sure one of its text, or else of the next
                known = sure | ~has[w.text_of]
                row = np.arange(w.n)
                last = np.maximum.accumulate(np.where(known, row, -1))
                ok = (last >= 0) & (w.text_of[last] == w.text_of)
                nxt = np.minimum.accumulate(np.where(known, row, w.n)[::-1])[::-1]
                src = np.where(ok, last, np.minimum(nxt, w.n - 1))
                lang = lang[src]
                some = words[w.text_of] > 0
                row = row[some]
                if not len(row):
                    continue
                new = np.concatenate([[True], (w.text_of[row[1:]] != w.text_of[row[:-1]]) | (lang[row[1:]] != lang[row[:-1]])])
                first = row[new]
                end = np.append(w.begin[1:], len(cps))[np.append(row[np.flatnonzero(new)[1:] - 1], row[-1])]
                weight = np.where(known, np.maximum(number, 1e-9), 0)
                group = np.cumsum(new) - 1
                c = np.bincount(group, (conf * weight)[row]) / np.maximum(np.bincount(group, weight[row]), 1e-12)
                # a segment is ambiguous whose confidence is too low; its runner-up is that of its longest known sentence
                by = row[np.lexsort((weight[row], group))]
                longest = by[np.append(np.flatnonzero(np.diff(np.sort(group))), len(by) - 1)]
                text = w.text_of[first]
                keep = [k for k in part.schema.names if k != "text"]
                picked = {k: part.column(k).take(pa.array(text)) for k in keep}
                yield pa.record_batch(picked | {"begin": (w.begin[first] - offs[text]).astype(np.int32), "end": (end - offs[text]).astype(np.int32), "found": pa.array(names[lang[first]], pa.string()), "confidence": np.round(np.minimum(c, 1.0), 4), "ambiguous": c < SURE, "runner_up": pa.array(names[after[longest]], pa.string())})

    return run


def segments(df: DataFrame, id_col: str, text_col: str, model: Model, label_col: str | None = None) -> DataFrame:
    """(id, label, begin, end, found, confidence, ambiguous, runner_up): the one-language segments of each text.

    Offsets count characters from 0; an ambiguous segment may as well be of the runner-up language.
    """
    label = label_of(F.col(label_col)) if label_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("string").alias("id"), label.alias("label"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_segments(model), "id string, label string, begin int, end int, found string, confidence double, ambiguous boolean, runner_up string")


def languages_of(df: DataFrame, id_col: str, text_col: str, model: Model, label_col: str | None = None, min_chars: int = 40) -> DataFrame:
    """(id, label, found array, share and confidence of the main language): one row for each id and label with words."""
    parts = segments(df.where(F.length(text_col) >= min_chars), id_col, text_col, model, label_col).distinct()
    each = parts.groupBy("id", "label", "found").agg(F.sum(F.col("end") - F.col("begin")).alias("chars"), F.avg("confidence").alias("confidence"))
    main = F.max(F.struct("chars", "found", "confidence"))
    return each.groupBy("id", "label").agg(F.sort_array(F.collect_list("found")).alias("found"), F.round(main["chars"] / F.sum("chars"), 4).alias("main_share"), F.round(main["confidence"], 4).alias("confidence"), main["found"].alias("main"))


def wrong_labels(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Model, min_chars: int = 40) -> DataFrame:
    """(id, lang): for texts whose label is missing or not among their languages, or that have several, each language."""
    found = languages_of(df, id_col, text_col, model, label_col, min_chars)
    wrong = found.where(F.col("label").isNull() | ~F.array_contains("found", F.col("label")) | (F.size("found") > 1))
    return wrong.select("id", F.explode("found").alias("lang")).distinct()
