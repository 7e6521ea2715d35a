"""Problem 5: abusive, hateful or sexual content, by maximum-scoring segments over token log-odds.

Fitting: words and pairs of neighbouring words get the log-odds of abusive text against the whole corpus, under a Dirichlet prior
with the corpus's frequencies, lowered by their standard error as far as there are few labels. Labels are of whole texts, so fitting alternates: the best segment of each text labelled as a case is abusive text,
all else isn't. Scores less a drift have a negative mean on clean text, which is what segment statistics need. All labels and all
texts take part, of any length and number: texts stay with the tasks, as places of their words in the vocabulary of the cases, and
the driver gets sums over all of them (`Kernels`), which have the vocabulary's size at most.

Scanning: a linear pass over a text's scores finds every segment of maximal score. The greatest score of a text of n words
of clean text follows an extreme-value law, P(score > x) = 1 - exp(-K n exp(-L x)); L solves mean(exp(L s)) = 1 over the words of
the corpus's different texts and K is its maximum likelihood over their greatest scores. A segment is significant below
PASSAGE_P; a text's severity is the sum of -log10 p over its significant segments, and the cut-off is the one with the best F1
in the corpus, estimated from labelled cases, each scored by a model fitted without it, and from the flagged share of all its different texts.

Words are compared after undoing disguises: letter-like digits and signs inside words, stretched letters, letters
apart by spaces or dots, case and diacritics. Reported offsets are those of the text as it stands.

Defined results: rows with a NULL id take no part; NULL, empty and wordless texts score 0; rows with one id count once (the greatest
score); no labels of both kinds mean that every score is 0; labels other than 0 and 1 are left out; empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import textarrays as ta

FOLDS, PASSAGE_P, DRIFT, PRIOR, ROUNDS = 3, 0.01, 1.0, 30.0, 4
#: The share of the corpus's texts that may be cases; log-odds are multiples of 1 / GRID and cut-offs of 1 / STEPS, so that sums over all texts are exact, whatever their order.
CASES, GRID, STEPS = 0.05, 64, 100
#: Standard errors that log-odds are lowered by, of which the folds choose one, and the least cut-off: a clean text reaches it by chance about once in a thousand.
CAUTION, FLOOR = (0.0, 0.5, 1.0, 1.5), 3.0
#: Cases, and other labelled texts, without which there is no model; words that a task reads at once.
LEAST, BLOCK = 5, 500_000
#: Digits and signs that stand for letters.
LETTERLIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FAR = 1e4


@cache
def _fold() -> np.ndarray:
    """Letters without diacritics, code point for code point (Latin, Greek and Cyrillic)."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        out[c] = ord(base.lower()) if len(base.lower()) == 1 else ord(base)
    out[[0x110, 0x111]] = ord("d")
    return out


@cache
def _letterlike() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for a, b in LETTERLIKE.items():
        out[ord(a)] = ord(b)
    return out


def plain(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with disguises undone, their offsets, and the place of each in the text as it stands.

    A line end stands between two texts while they are read, so that no disguise reaches from one into the next.
    """
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    own = np.arange(len(cps)) + row
    c = np.full(len(cps) + len(offs), 10, np.uint32)
    c[own] = _fold()[ta.lower(cps)]
    word = ta.is_word(c)
    letter = word & ~((c >= 48) & (c <= 57))
    inner = word | (c == 64) | (c == 36)
    edge = np.flatnonzero(np.diff(np.pad(inner, 1).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start):
        sums = np.concatenate([[0], np.cumsum(letter)])
        letters = sums[end] - sums[start]
        mixed = (letters > 0) & (letters < end - start) & (2 * letters >= end - start)
        at = np.flatnonzero(inner)[np.repeat(mixed, end - start)]
        c[at] = _letterlike()[c[at]]
        letter[at] = c[at] > 57
    keep = np.zeros(len(c), bool)
    keep[own] = True
    # letters apart: four or more lone letters with one separator between each two
    lone = letter.copy()
    lone[1:] &= ~letter[:-1]
    lone[:-1] &= ~letter[1:]
    gap = np.zeros(len(c), bool)
    gap[1:-1] = lone[:-2] & lone[2:] & ((c[1:-1] == 32) | (c[1:-1] == 46) | (c[1:-1] == 45) | (c[1:-1] == 42))
    three = gap.copy()
    three[:-4] = gap[:-4] & gap[2:-2] & gap[4:]
    three[-4:] = False
    drop = three.copy()
    drop[2:] |= three[:-2]
    drop[4:] |= three[:-4]
    keep &= ~drop
    # stretched letters: of three or more equal ones, the first stays
    same = np.zeros(len(c), bool)
    same[1:] = (c[1:] == c[:-1]) & letter[1:]
    twice = np.zeros(len(c), bool)
    twice[1:] = same[1:] & same[:-1]
    stretched = twice.copy()
    stretched[:-1] |= twice[1:]
    keep &= ~(stretched & same)
    kept = np.flatnonzero(keep)
    whole = keep[own]
    return c[kept], np.concatenate([[0], np.cumsum(whole)])[offs], np.flatnonzero(whole)


class Tokens:
    """Hashes of the words and of the pairs that end in them, and each text's words."""

    def __init__(self, cps: np.ndarray, offs: np.ndarray):
        c, o, place = plain(cps, offs)
        start, end, self.first = ta.words(c, o)
        self.word = ta.span_hash(ta.prefix(c), start, end) if len(start) else np.empty(0, np.uint64)
        self.pair = self.word.copy()
        if len(self.word):
            self.pair[1:] = ta.mix(self.word[:-1] * np.uint64(ta.BASE) + self.word[1:])
            head = self.first[:-1][np.diff(self.first) > 0]
            self.pair[head] = ta.mix(self.word[head] + np.uint64(1))
        self.begin, self.end = (place[start], place[np.maximum(end, 1) - 1] + 1) if len(start) else (start, end)
        self.text_of = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.again = np.zeros(len(self.word), bool)  # a word said over and over counts once
        self.again[1:] = (self.word[1:] == self.word[:-1]) & (self.text_of[1:] == self.text_of[:-1])


def excursions(score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and score of every maximal segment: from where the running sum leaves its least value to its peak."""
    n, texts = len(score), len(first) - 1
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row = np.repeat(np.arange(texts), np.diff(first))
    x = np.full(n + texts, -FAR)
    at = np.arange(n) + row + 1  # one place before each text sends the sum to a new least value
    x[at] = score
    total = np.cumsum(x)
    height = total - np.minimum.accumulate(total)
    up = np.diff(np.pad(height > 1e-9, 1).astype(np.int8))
    a, b = np.flatnonzero(up == 1), np.flatnonzero(up == -1)
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    top = np.maximum.reduceat(np.append(height, 0.0), np.stack([a, b], 1).ravel())[::2]
    run = np.repeat(np.arange(len(a)), b - a)
    inside = np.flatnonzero(height > 1e-9)
    peak = inside[np.isclose(height[inside], top[run], rtol=0, atol=1e-12)]
    which = np.searchsorted(a, peak, "right") - 1
    peak = peak[np.unique(which, return_index=True)[1]]
    word = np.full(n + texts, -1)
    word[at] = np.arange(n)
    return word[a], word[peak], top


class Background:
    """Counts in the corpus of the words and pairs that occur in labelled cases, and the number of all words."""

    def __init__(self, key: np.ndarray, count: np.ndarray, total: float):
        self.key, self.count, self.total = key, count, total

    @staticmethod
    def tally(t: Tokens, vocabulary: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vocabulary))
        for h in (t.word, t.pair):
            if len(h) and len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                out += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        return out


class Vocabulary:
    """Hashes of the words and pairs of labelled cases in order, the place of each one's word, and their counts in the cases of each fold."""

    def __init__(self, key: np.ndarray, word: np.ndarray, fold: np.ndarray, count: np.ndarray):
        self.key, one, at = np.unique(key, return_index=True, return_inverse=True)
        self.of = np.searchsorted(self.key, word[one])
        self.count = np.zeros((FOLDS, len(self.key)))
        np.add.at(self.count, (fold, at), count)

    @staticmethod
    def entries(t: Tokens, fold: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words and pairs of t, the word of each, their fold and count."""
        own, key = fold[t.text_of], np.concatenate([t.word, t.pair])
        word, out = np.concatenate([t.word, t.word]), []
        for k in range(FOLDS):
            some = np.flatnonzero(np.concatenate([own, own]) == k)
            h, one, n = np.unique(key[some], return_index=True, return_counts=True)
            out.append((h, word[some[one]], np.full(len(h), k), n))
        return tuple(np.concatenate(x) for x in zip(*out))

    def ids(self, t: Tokens) -> np.ndarray:
        """For each word its pair's place or, where the vocabulary lacks that, its own, or behind the last; words said again come a vocabulary later."""
        n = len(self.key)
        out = np.full(len(t.word), n, np.int32)
        for h in (t.word, t.pair):
            at = np.minimum(np.searchsorted(self.key, h), n - 1).astype(np.int32)
            some = self.key[at] == h
            out[some] = at[some]
        return out + t.again * np.int32(n + 1)

    def counts(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Counts of the words and pairs from those of ids, and the number of words."""
        size = len(self.key)
        by = np.bincount(ids % (size + 1), n, size + 1)
        out = by[:-1].copy()
        pairs = np.flatnonzero(self.of != np.arange(size))
        np.add.at(out, self.of[pairs], by[pairs])
        return out, float(n.sum())


class Block:
    """Texts as ids of their words: where each begins, its fold (-1: of no fold), the rows that have it, and whether the law is fitted to it."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, fold: np.ndarray, rows: np.ndarray, clean: np.ndarray | None = None):
        self.ids, self.first, self.fold, self.rows = ids, first, fold, rows
        self.n = np.diff(first)
        self.text_of = np.repeat(np.arange(len(self.n)), self.n)
        self.clean = (self.n > 0) & (True if clean is None else clean)

    def segments(self, table: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, last word and score of every maximal segment of the texts among; only those with a score above 0 are scanned."""
        score = table[self.ids]
        some = np.zeros(len(self.n), bool)
        some[self.text_of[score > 0]] = True
        some &= among
        which = np.flatnonzero(some)
        at = np.flatnonzero(some[self.text_of])
        first = np.concatenate([[0], np.cumsum(self.n[which])])
        a, b, top = excursions(score[at].astype(float), first)
        return which[np.searchsorted(first, a, "right") - 1] if len(a) else a, at[a], at[b], top

    def best(self, table: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The greatest segment of each of these texts that has one."""
        text, a, b, top = self.segments(table, among)
        order = np.lexsort((top, text))
        order = order[np.append(text[order][1:] != text[order][:-1], True)] if len(order) else order
        return text[order], a[order], b[order], top[order]


class Kernels:
    """Sums over the texts of a block, as rows (model, key, two sums)."""

    def __init__(self, models: list[Model], vocabulary: Vocabulary | None = None):
        self.models = [(m.table(vocabulary), m.held, m.bar, m.rate, m.size) for m in models]

    def _each(self) -> Iterator[tuple]:
        for k, (table, *rest) in enumerate(self.models):
            yield k, np.concatenate([table, np.minimum(table, -DRIFT)]), *rest

    def words(self, x: Block) -> Iterator[tuple]:
        """Counts of ids in all rows, and in different texts."""
        k, at = np.unique(x.ids, return_inverse=True)
        yield 0, k, np.bincount(at, x.rows[x.text_of], len(k)), np.bincount(at, minlength=len(k))

    def abusive(self, x: Block) -> Iterator[tuple]:
        """Counts of ids in the best segments of the cases that a model is fitted on."""
        for k, table, held, *_ in self._each():
            _, a, b, _ = x.best(table, x.fold != held)
            step = np.zeros(len(x.ids) + 1)
            step[a] += 1
            np.add.at(step, b + 1, -1)
            key, n = np.unique(x.ids[np.cumsum(step[:-1]) > 0], return_counts=True)
            yield k, key, n, n

    def tops(self, x: Block) -> Iterator[tuple]:
        """Numbers of texts and of their words by the greatest score."""
        for k, table, held, *_ in self._each():
            among = x.clean & (x.fold != held)
            text, _, _, top = x.best(table, among)
            score = np.zeros(len(x.n), np.int64)
            score[text] = np.rint(top * 2 * GRID)
            key, at = np.unique(score[among], return_inverse=True)
            yield k, key, np.bincount(at, minlength=len(key)), np.bincount(at, x.n[among], len(key))

    def beyond(self, x: Block) -> Iterator[tuple]:
        """Numbers of words by score, in the texts with greater scores than those that the law is fitted to or that it is not fitted to at all."""
        for k, table, held, bar, *_ in self._each():
            text, _, _, top = x.best(table, x.clean & (x.fold != held))
            out = ~x.clean | (x.fold == held)
            out[text[top > bar]] = True
            key, n = np.unique(np.rint(table[x.ids[out[x.text_of]]] * 2 * GRID).astype(np.int64), return_counts=True)
            yield k, key, n, n

    def severe(self, x: Block) -> Iterator[tuple]:
        """Numbers of texts by severity, cases by the models that are fitted without them."""
        for k, table, held, _, rate, size in self._each():
            among = (x.fold < 0) | (x.fold == held)
            text, _, _, top = x.segments(table, among)
            p = chance(top, x.n[text], rate, size)
            some = p < PASSAGE_P
            severity = np.bincount(text[some], -np.log10(p[some]), len(x.n))[among]
            key, n = np.unique(np.floor(severity * STEPS).astype(np.int64), return_counts=True)
            yield k, key, n, n


Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _sum(parts: list[tuple]) -> Sums:
    """One row for each model and key."""
    k = np.concatenate([np.asarray(p[1], np.int64) for p in parts]) if parts else np.empty(0, np.int64)
    m = np.concatenate([np.broadcast_to(p[0], len(p[1])) for p in parts]).astype(np.int64) if parts else k
    a, b = (np.concatenate([np.asarray(p[j], float) for p in parts]) if parts else np.empty(0) for j in (2, 3))
    _, one, at = np.unique((m << 48) + k, return_index=True, return_inverse=True)
    return m[one], k[one], np.bincount(at, a, len(one)), np.bincount(at, b, len(one))


class Model:
    def __init__(self, caution: float = 0.0, held: int = FOLDS) -> None:
        """held: the fold of cases that it is fitted without."""
        self.key, self.value, self.every = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        self.rate, self.size, self.cutoff, self.caution, self.held, self.bar = 1.0, 1.0, np.inf, caution, held, 0.0

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[at] == h, self.value[at], 0.0)

    def scores(self, t: Tokens) -> np.ndarray:
        score = (self._lookup(t.word) + self._lookup(t.pair)) / 2 - DRIFT
        return np.where(t.again, np.minimum(score, -DRIFT), score)

    def table(self, v: Vocabulary) -> np.ndarray:
        """The score of each id of v."""
        own = self.every
        return np.append((own + np.where(v.of == np.arange(len(own)), 0.0, own[v.of])) / 2, 0.0).astype(np.float32) - np.float32(DRIFT)

    def learn(self, y: np.ndarray, n: float, corpus: Background) -> None:
        """Log-odds of the words and pairs of abusive text, of which y counts each and n the words, against the corpus."""
        n = max(n, 1)
        share = np.maximum(corpus.count, 0.5) / max(corpus.total, 1)
        odds = np.log((y + PRIOR * share) / (n + PRIOR)) - np.log(share)
        error = np.sqrt(1 / (y + 0.3) + 1 / (corpus.count + 0.3))
        odds = np.sign(odds) * np.maximum(np.abs(odds) - self.caution * error, 0) if self.caution else odds / np.maximum(error, 1)
        self.every = np.rint(np.where(np.abs(odds) > 0.1, np.clip(odds, -4, 6), 0.0) * GRID) / GRID
        some = self.every != 0
        self.key, self.value = corpus.key[some], self.every[some]

    def leave_out(self, top: np.ndarray, texts: np.ndarray) -> None:
        """The greatest score of the texts that the law is fitted to: CASES of them, those with greater ones, may be cases. top ascends."""
        if len(top):
            self.bar = float(top[np.searchsorted(np.cumsum(texts), int((texts.sum() - 1) * (1 - CASES)), "right")])

    def calibrate(self, score: np.ndarray, count: np.ndarray, top: np.ndarray, texts: np.ndarray, words: np.ndarray) -> None:
        """The extreme-value law, from the numbers of words by score and of texts and their words by greatest score."""
        if not texts.sum() or not len(self.value):
            return
        # one word more, with the greatest score of all, so that there is a solution where no clean word scores above 0
        score, count = np.append(score, self.value.max() - DRIFT if self.value.max() > DRIFT else 1.0), np.append(count, 1)
        lo_, hi_ = 1e-3, 10.0
        for _ in range(60):
            mid = (lo_ + hi_) / 2
            lo_, hi_ = (mid, hi_) if np.dot(count, np.exp(np.minimum(mid * score, 500))) < count.sum() else (lo_, mid)
        self.rate = lo_
        # K by maximum likelihood; a greatest score of 0 says that no segment scored above it
        self.size = float((texts[top > 0].sum() + 0.5) / np.dot(words, np.exp(-self.rate * top)))

    def p(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        return chance(score, n, self.rate, self.size)


def chance(score: np.ndarray, n: np.ndarray, rate: float, size: float) -> np.ndarray:
    """The extreme-value law's p of a score in a clean text of n words."""
    return np.maximum(-np.expm1(-size * n * np.exp(-rate * score)), 1e-300)


Pass = Callable[[Callable[[Block], Iterator[tuple]]], Sums]


def fit(v: Vocabulary, corpus: Background | None, cases: Pass, texts: Pass) -> Model:
    """A model with its cut-off. cases and texts sum a kernel over all labelled cases and over all different texts of the corpus.

    Each fold's cases are scored by a model fitted on the others. Few labels call for more caution, many for little: CAUTION and the
    cut-off, from FLOOR on, are chosen by the F1 of the corpus, from the share of labelled cases found and the share of its texts flagged.
    """
    _, ids, rows, once = texts(Kernels([]).words)
    corpus = corpus or Background(v.key, *v.counts(ids, rows))
    models = [Model(c, k) for c in CAUTION for k in range(FOLDS + 1)]
    own = v.of == np.arange(len(v.key))
    y = [v.count.sum(0) - (v.count[m.held] if m.held < FOLDS else 0) for m in models]
    n = [x[own].sum() for x in y]
    for left in range(ROUNDS, 0, -1):
        for m, *now in zip(models, y, n):
            m.learn(*now, corpus)
        if left > 1:
            k, at, count, _ = cases(Kernels(models, v).abusive)
            y, n = zip(*(v.counts(at[k == j], count[k == j]) for j in range(len(models))))
    k, top, some, words = texts(Kernels(models, v).tops)
    top = top / (2 * GRID)
    for j, m in enumerate(models):
        m.leave_out(top[k == j], some[k == j])
    out, score, count, _ = texts(Kernels(models, v).beyond)
    for j, m in enumerate(models):
        table = m.table(v)
        table = np.rint(np.concatenate([table, np.minimum(table, -DRIFT)])[ids] * 2 * GRID)
        key, at = np.unique(np.concatenate([table, score[out == j]]), return_inverse=True)
        law = (k == j) & (top <= m.bar)
        m.calibrate(key / (2 * GRID), np.bincount(at, np.concatenate([once, -count[out == j]])), top[law], some[law], words[law])
    held = [m for m in models if m.held < FOLDS]
    own, all_ = cases(Kernels(held, v).severe), texts(Kernels(held, v).severe)
    tried = []
    for c in CAUTION:
        mine, theirs = ([x[np.isin(s[0], [j for j, m in enumerate(held) if m.caution == c])] for x in s[1:3]] for s in (own, all_))
        at = np.unique(mine[0][mine[0] >= FLOOR * STEPS])
        found, flags = (np.array([x[1][x[0] >= b].sum() for b in at]) / max(x[1].sum(), 1) for x in (mine, theirs))
        tried.append((c, at / STEPS, found, np.maximum(flags, 1 / max(theirs[1].sum(), 1))))
    # the share of cases in the corpus is at most that of flagged texts over that of found cases, whatever the cut-off
    share = min((float((flags / found)[found >= 0.3].min()) for _, _, found, flags in tried if (found >= 0.3).any()), default=0.0)
    best, model = 0.0, Model()
    for caution, at, found, flags in tried:
        f1 = 2 * share * found / (flags + share) if share else np.zeros(0)
        if len(f1) and f1.max() > best:
            best, model = float(f1.max()), next(m for m in models if m.caution == caution and m.held == FOLDS)
            model.cutoff = float(at[f1.argmax()])
    return model


def train(texts: list[str], labels: list[int], count=None, background: list[str] | None = None, fold: list[int] | None = None) -> Model:
    """A model from texts in memory.

    count: gives the corpus's counts of a sorted array of hashes and its number of words; without it the texts passed are the corpus.
    background: the corpus's texts, whatever they are; without them the texts labelled clean stand for it. fold: that of each labelled text.
    """
    case = np.array(labels, bool)
    if case.sum() < LEAST or (~case).sum() < LEAST:
        return Model()
    fold = np.arange(len(texts)) % FOLDS if fold is None else np.array(fold)

    def tokens(texts: list[str]) -> Tokens:
        return Tokens(*ta.decode(pa.array(texts, pa.string())))

    known = tokens([x for x, c in zip(texts, case) if c])
    every = tokens(texts if background is None else background)
    v = Vocabulary(*Vocabulary.entries(known, fold[case]))
    if not len(v.key):
        return Model()
    n = len(every.first) - 1
    blocks = Block(v.ids(known), known.first, fold[case], np.ones(case.sum())), Block(v.ids(every), every.first, fold if background is None else np.full(n, -1), np.ones(n), ~case if background is None else None)
    return fit(v, Background(v.key, *count(v.key)) if count else None, *(lambda kernel, x=x: _sum(list(kernel(x))) for x in blocks))


def severities(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's severity, and first word, last word and p of every significant segment."""
    a, b, top = excursions(model.scores(t), t.first)
    text = t.text_of[a] if len(a) else a
    p = model.p(top, np.diff(t.first)[text])
    some = p < PASSAGE_P
    return np.bincount(text[some], -np.log10(p[some]), len(t.first) - 1).astype(float), a[some], b[some], p[some]


def learn(texts: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str) -> Model:
    """Fits on all labelled texts and all texts; several labels of a text count by majority, copies of a text are one in the law and the cut-off."""
    votes = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.avg(label_col).alias("vote")).where("vote <> 0.5")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # hashes, 8 bytes a label, take out most rows before the join
    hashes = votes.select(F.xxhash64(F.col("id").cast("string")).alias("hash")).distinct()
    near = rows.join(F.broadcast(hashes), F.xxhash64(F.col("id").cast("string")) == F.col("hash"), "leftsemi")
    known = near.join(votes, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("vote").alias("vote"))
    known = cut(known.select(fold_of("id").alias("fold"), F.lit(1.0).alias("rows"), F.expr("vote > 0.5").alias("case"), F.expr("if(vote > 0.5, text, '')").alias("text")))
    if known.groupBy("case").count().where(F.col("count") >= LEAST).count() < 2:
        return Model()
    cases = known.where("case").select("fold", "rows", "text")
    got = cases.mapInArrow(_entries, "fold int, key bigint, word bigint, n bigint").groupBy("fold", "key", "word").agg(F.sum("n").alias("n")).toArrow()
    v = Vocabulary(*(got.column(k).to_numpy().view(np.uint64) for k in ("key", "word")), *(got.column(k).to_numpy() for k in ("fold", "n")))
    if not len(v.key):
        return Model()
    different = rows.groupBy("text").agg(F.count("*").cast("double").alias("rows")).select(F.lit(-1).alias("fold"), "rows", "text")
    return fit(v, None, *(_pass(cut(x.mapInArrow(_encode(v), "fold int, rows double, ids binary"))) for x in (cases, different)))


def fold_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FOLDS)).cast("int")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, cps, offs in ta.chunks(batch):
            key, word, fold, n = Vocabulary.entries(Tokens(cps, offs), part.column("fold").to_numpy())
            yield pa.record_batch({"fold": fold.astype(np.int32), "key": key.view(np.int64), "word": word.view(np.int64), "n": n.astype(np.int64)})


def _encode(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cps, offs in ta.chunks(batch):
                t = Tokens(cps, offs)
                ids = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((4 * t.first).astype(np.int32)), pa.py_buffer(v.ids(t))])
                yield pa.record_batch({"fold": part.column("fold"), "rows": part.column("rows"), "ids": ids})

    return run


def _pass(encoded: DataFrame) -> Pass:
    """Sums over all rows; each task sends one row for each model and key."""

    def run(kernel: Callable[[Block], Iterator[tuple]]) -> Sums:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in batches:
                for part, ids, first in _blocks(batch):
                    parts += kernel(Block(ids, first, part.column("fold").to_numpy(), part.column("rows").to_numpy()))
                    if sum(len(p[1]) for p in parts) > 2 * size + 1_000_000:
                        parts = [_sum(parts)]
                        size = len(parts[0][1])
            m, k, a, b = _sum(parts)
            yield pa.record_batch({"m": m, "k": k, "a": a, "b": b})

        got = encoded.mapInArrow(task, "m bigint, k bigint, a double, b double").groupBy("m", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        return _sum([tuple(got.column(c).to_numpy() for c in "mkab")])

    return run


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about BLOCK words (at least one row), each with its ids and where each text begins."""
    col = batch.column("ids").cast(pa.large_binary())
    if not len(col):
        return
    _, offs, data = col.buffers()
    first = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] // 4
    ids = np.frombuffer(data, np.int32, int(first[-1])) if first[-1] else np.empty(0, np.int32)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + BLOCK, "right")) - 1)
        yield batch.slice(lo, hi - lo), ids[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]
        lo = hi


def _score(model: Model, passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cps, offs in ta.chunks(batch):
                t = Tokens(cps, offs)
                severity, a, b, p = severities(model, t)
                keep = [k for k in part.schema.names if k != "text"]
                if passages:
                    row = t.text_of[a] if len(a) else a
                    cols = {k: part.column(k).take(pa.array(row, pa.int64())) for k in keep}
                    yield pa.record_batch(cols | {"begin": (t.begin[a] - offs[row]).astype(np.int32), "end": (t.end[b] - offs[row]).astype(np.int32), "score": np.round(-np.log10(p), 4)})
                else:
                    yield pa.record_batch({k: part.column(k) for k in keep} | {"score": np.round(severity, 4), "flagged": severity >= model.cutoff})

    return run


def scores(df: DataFrame, id_col: str, text_col: str, model: Model, group_col: str | None = None) -> DataFrame:
    """(id, grp, score, flagged) for every text."""
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("string").alias("id"), group.alias("grp"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    out = rows.mapInArrow(_score(model, False), "id string, grp string, score double, flagged boolean")
    return out.groupBy("id").agg(F.min("grp").alias("grp"), F.max("score").alias("score"), F.max("flagged").alias("flagged"))


def passages(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, begin, end, score): every significant passage; offsets count characters from 0."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return rows.mapInArrow(_score(model, True), "id string, begin int, end int, score double").distinct()


def flagged(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id) of the texts at or above the cut-off."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return rows.mapInArrow(_score(model, False), "id string, score double, flagged boolean").where("flagged").select("id").distinct()
