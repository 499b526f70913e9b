"""Vectorised words and hashes over Arrow string buffers.

A word is a maximal run of ASCII letters and digits or of non-ASCII characters other than
U+0080-U+00BF, U+2000-U+2FFF and U+3000-U+303F, folded to lower case for ASCII and Latin-1.
Everything works on the UTF-8 bytes of a batch at once; no Python string is made per word.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The words above as a regular expression for SQL oracles, after lower().
WORD_RE = r"[^\x00-/:-@\[-`{-\x{BF}\x{2000}-\x{2FFF}\x{3000}-\x{303F}]+"

CHUNK = 1 << 16
SLICE = 1 << 20
BYTE_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD1342543DE82EF95
_TABLES: dict = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i below n."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK + 1024)
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _TABLES[base] = have = np.cumprod(up), np.cumprod(down)
    return have


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return word, fold


def _classify(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word-character mask and folded bytes."""
    word, fold = _byte_classes()
    m, b = word[raw], fold[raw]
    if len(raw) and raw.max() >= 128:
        for lead, n in ((0xC2, 2), (0xE2, 3)):
            at = np.flatnonzero(raw == lead)
            for i in range(n):
                m[at[at + i < len(raw)] + i] = False
        at = np.flatnonzero(raw[:-1] == 0xE3)
        at = at[raw[at + 1] == 0x80]
        for i in range(3):
            m[at[at + i < len(raw)] + i] = False
        at = np.flatnonzero(raw[:-1] == 0xC3) + 1
        low = raw[at]
        b[at[(low >= 0x80) & (low <= 0x9E) & (low != 0x97)]] += 0x20
    return m, b


@dataclass
class Words:
    """The words of the documents of a batch: hash, first and past-last byte, and by document the first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def doc(self) -> np.ndarray:
        """The document, as a row of the batch, of each word."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if big else np.int32, len(texts) + 1, texts.offset * (8 if big else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array) -> Words:
    raw, off = buffer(texts)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + CHUNK)
        while stop < len(raw):  # a chunk ends with a document or before an ASCII blank or sign
            cut = np.flatnonzero(~_byte_classes()[0][raw[at + 1 : stop]])
            own = off[np.searchsorted(off, stop, "right") - 1]
            best = max(at + 1 + int(cut[-1]) if len(cut) else 0, int(own))
            if best > at:
                stop = best
                break
            stop = min(len(raw), stop + CHUNK)
        m, b = _classify(raw[at:stop])
        new = np.zeros(len(m) + 1, bool)
        lo, hi = np.searchsorted(off, at), np.searchsorted(off, stop)
        new[off[lo:hi] - at] = True
        new[0] = True
        s = m.copy()
        s[1:] &= ~m[:-1] | new[1:-1]
        e = m.copy()
        e[:-1] &= ~m[1:] | new[1:-1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        up, down = _powers(BYTE_BASE, len(m) + 1)
        sums = np.zeros(len(m) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(m)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    start = join(starts, np.int64)
    return Words(join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, off))


def gram_sums(h: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums of word hashes; see gram_hash."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(GRAM_BASE, len(h) + 1)[0][: len(h)], out=sums[1:])
    return sums


def gram_hash(sums: np.ndarray, at: np.ndarray, k) -> np.ndarray:
    """The hash of the k words from at on."""
    return mix((sums[at + k] - sums[at]) * _powers(GRAM_BASE, len(sums))[1][at])


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one document."""
    n = len(w)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    sums, at = gram_sums(w.hash), np.arange(n - k + 1)
    h = np.zeros(n, np.uint64)
    h[: n - k + 1] = gram_hash(sums, at, k)
    return h, np.arange(n) + k <= np.repeat(w.first[1:], w.counts())


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (a minimum or maximum) over x[i : i + w], for each i that has w values."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some window of consecutive k-grams of their document.

    Each run of k + window - 1 words has one; which of its grams, depends on nothing outside the run.
    Equal least grams of a window all count.
    """
    n, span = len(w), k + window - 1
    h, _ = grams(w, k)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = slide(h[: n - k + 1], window, np.minimum)  # by first gram of the window
    inside = np.arange(len(least)) + span <= np.repeat(w.first[1:], w.counts())[: len(least)]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    most = slide(np.concatenate([pad, least, pad]), window, np.maximum)
    at = np.flatnonzero((most == h[: len(most)]) & (most != 0))
    return at, h[at]


def slices(batch, column: str = "text", most: int = SLICE):
    """The batch in pieces of about most bytes of the column; a longer text is a piece of its own."""
    _, off = buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
