"""Text to terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import stem

TOKEN = "[a-zA-Z0-9]+"


def tokens(text: Column) -> Column:
    """The runs of ASCII letters and digits, lower-cased after they are cut; a null text has none."""
    cut = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.coalesce(cut, F.array().cast("array<string>"))


#: By byte of UTF-8: itself in lower case if it is an ASCII letter or digit, else 0.
_FOLD = np.zeros(256, np.uint8)
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 0
#: Bytes of text that are cut at once, and stems beyond which a task forgets them.
SLICE, REMEMBERED = 4 << 20, 1 << 17


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null is an empty text."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if big else np.int32, len(texts) + 1, texts.offset * (8 if big else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, most: int = SLICE):
    """A batch in pieces of about most bytes of text; a longer text is a piece of its own."""
    off, at = buffer(batch.column("text"))[1], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, off): lower-cased bytes of all texts, 0 between tokens, where each token begins and ends, and each text."""
    raw, off = buffer(texts)
    folded = _FOLD[raw]
    word = folded != 0
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    at = off[:-1][off[:-1] < len(raw)]
    start[at] = word[at]
    at = off[1:][off[1:] > 0] - 1
    end[at] = word[at]
    return folded, np.flatnonzero(start), np.flatnonzero(end) + 1, off


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, first): what tokens() gives for all texts, one after the other, and where those of each text begin, and the end."""
    folded, start, end, off = _ends(texts)
    at = np.concatenate([[0], np.cumsum(end - start)])
    data = pa.py_buffer(folded[folded != 0])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), data), np.searchsorted(start, off)


@F.arrow_udf(T.IntegerType())
def n_tokens(texts: pa.Array) -> pa.Array:
    """How many tokens each text has."""
    rows = pa.RecordBatch.from_arrays([texts], ["text"])
    counts = [np.diff(np.searchsorted(start, off)) for _, start, _, off in (_ends(part.column("text")) for part in slices(rows))]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int32())


def coded(texts: pa.Array, stemmed: dict[str, str] | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code, terms, first): the terms of all texts one after the other as numbers of distinct terms, and where those of each text begin, and the end.

    stemmed: stems by token, kept from call to call; None leaves the tokens as they are.
    """
    flat, first = cut(texts)
    flat = flat.dictionary_encode()
    code, terms = flat.indices.to_numpy(), flat.dictionary.cast(pa.string())
    if stemmed is not None:
        if len(stemmed) > REMEMBERED:
            stemmed.clear()
        made = []
        for token in terms.to_pylist():
            if (known := stemmed.get(token)) is None:
                known = stemmed[token] = stem(token)
            made.append(known)
        found = pa.array(made, pa.string()).dictionary_encode()
        code, terms = found.indices.to_numpy()[code], found.dictionary
    return code, terms, first


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(lists: pa.Array) -> pa.Array:
    """Each token of each list stemmed; a batch stems its distinct tokens once."""
    flat = lists.flatten().dictionary_encode()
    known = pa.array([None if t is None else stem(t) for t in flat.dictionary.to_pylist()], pa.string())
    size = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
    off = pa.array([0, *size.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(off, known.take(flat.indices))


@dataclass(frozen=True)
class Analyzer:
    """How texts and queries become terms; stem=False leaves the tokens as they are."""

    stem: bool = True

    def terms(self, text: Column) -> Column:
        return stems(tokens(text)) if self.stem else tokens(text)

    def positions(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, pos, term): every token with its 0-based place."""
        return docs.select(key, F.posexplode(self.terms(F.col("text"))).alias("pos", "term"))


def trigrams(term: Column) -> Column:
    """Windows of three characters, repeats kept; shorter terms have none."""
    return F.when(F.length(term) >= 3, F.transform(F.sequence(F.lit(1), F.length(term) - 2), lambda i: F.substring(term, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_max(same), F.lit(0)))


def snippet(text: Column, most: int = 150) -> Column:
    """As many whole characters as fit `most` bytes of UTF-8, and dots where something is left out."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: F.octet_length(F.substring(text, F.lit(1), i)) <= most)
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, F.lit(1), F.array_max(fits)), F.lit("..."))).otherwise(text)


@F.arrow_udf(T.IntegerType())
def edit_distance_compat(left: pa.Array, right: pa.Array) -> pa.Array:
    """An edit distance whose rows start at 0 until they are filled, so that leading characters of the longer word can go free; never above the true one."""

    def distance(a: str, b: str) -> int:
        if len(a.encode()) > len(b.encode()):
            a, b = b, a
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                new[j + 1] = row[j] if x == y else 1 + min(row[j], row[j + 1], new[j])
            new[0] = i + 1
            row = new
        return row[-1]

    pairs = zip(left.to_pylist(), right.to_pylist())
    return pa.array([None if a is None or b is None else distance(a, b) for a, b in pairs], pa.int32())
