"""Texts as flat code point arrays.

An Arrow string column holds its texts in one UTF-8 buffer. Decoding that buffer once gives every text of a batch as one
array of code points with offsets, on which word borders, word hashes and rolling hashes are a handful of NumPy passes; no
Python loop runs over characters, words or texts. Hashes are polynomials modulo 2**64 over randomised code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the mixing steps (the finaliser of a 64-bit avalanche hash) and of the polynomial.
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15
S33 = np.uint64(33)
CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> S33)
    x *= MIX_A
    x ^= x >> S33
    x *= MIX_B
    x ^= x >> S33
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    n, gap = 0x110000, range(0xD800, 0xE000)
    word, low = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for span in (range(gap.start), range(gap.stop, n)):
        chars = "".join(map(chr, span))
        word[span.start : span.stop] = np.fromiter(map(str.isalnum, chars), bool, len(chars))
        for lo in range(0, len(chars), 256):
            block = chars[lo : lo + 256]
            if block != (x := block.lower()):
                at = span.start + lo
                low[at : at + len(block)] = np.frombuffer(x.encode("utf-32-le"), np.uint32) if len(x) == len(block) else [ord(c.lower()[0]) for c in block]
    return word, low


def is_word(cps: np.ndarray) -> np.ndarray:
    """True where a code point is a Unicode letter or digit."""
    return _tables()[0][cps]


def lower(cps: np.ndarray) -> np.ndarray:
    """Code points in lower case, one for one."""
    return _tables()[1][cps]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b: int) -> np.ndarray:
        out = np.full(n, b % 2**64, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(BASE), up(pow(BASE, -1, 2**64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(21, int(n - 1).bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def prefix(cps: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] = hash(cps[i:j]) * BASE**i."""
    v = mix(cps.astype(np.uint64) + np.uint64(0x51ED2701))
    v *= powers(len(v))[0]
    out = np.empty(len(v) + 1, np.uint64)
    out[0] = 0
    np.cumsum(v, out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal contents wherever they stand."""
    return mix((p[end] - p[start]) * powers(len(p))[1][start])


def rolling(p: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k code points."""
    n = len(p) - k
    return mix((p[k:] - p[:n]) * powers(len(p))[1][:n]) if n > 0 else np.empty(0, np.uint64)


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together, and where each text begins (one more than there are texts). NULL counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(raw):
        return cps, o - o[0]
    first = np.empty(len(raw) + 1, np.int64)
    first[0] = 0
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    return cps, first[o - o[0]]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about size bytes of text (at least one row), each with its code points and offsets."""
    col = batch.column(column)
    n = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64))
    lo = 0
    while lo < len(col):
        base = n[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(n, base + size, "right")))
        part = batch.slice(lo, hi - lo)
        yield part, *decode(part.column(column))
        lo = hi


def words(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each text's words begin (one more than there are texts).

    A word is a maximal run of letters and digits and never crosses from one text into the next.
    """
    a = is_word(cps)
    before, after = np.zeros(len(a), bool), np.zeros(len(a), bool)
    before[1:] = a[:-1]
    after[:-1] = a[1:]
    inner = offs[(offs > 0) & (offs < len(a))]
    before[inner] = False
    after[inner - 1] = False
    start = np.flatnonzero(a & ~before)
    return start, np.flatnonzero(a & ~after) + 1, np.searchsorted(start, offs)


def word_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word in lower case."""
    return span_hash(prefix(lower(cps)), start, end)


def shingle_hashes(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and where each text's runs begin."""
    n = len(w) - k + 1
    count = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    if n <= 0 or not begin[-1]:
        return np.empty(0, np.uint64), np.zeros(len(first), np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(BASE) + w[j : j + n]
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    return mix(h[at]), begin
