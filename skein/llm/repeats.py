"""Where a corpus repeats itself: what substring dedup by graph and by suffix sort have in common.

Both operators return the same relation. A run of `least` words that occurs at two places of the corpus or more is
repeated; the occurrence with the least (doc_id, position) is its first. A word is `removed` if it lies in an
occurrence that isn't the first, else `first` if it lies in one that is. Result rows are maximal runs of words of one
document with the same mark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import named, settle
from .text import WORD_RE, buffer, signed, slices, winnow, words

GRAM = 20


def marks(texts: DataFrame, least: int) -> DataFrame:
    """(doc_id, at): per document the positions of k-grams that winnowing keeps and that the corpus holds twice or more.

    Each run of `least` words holds one of the kept grams, so a repeated run lies around a position returned here.
    A settled table.
    """
    k = min(GRAM, max(1, least // 2))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                at, h = winnow(w, k, least - k + 1)
                doc = w.doc()[at]
                yield pa.RecordBatch.from_arrays(
                    [signed(h), part.column("doc_id").take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32))], ["h", "doc_id", "pos"]
                )

    kept = texts.mapInArrow(run, "h bigint, doc_id bigint, pos int")
    twice = kept.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    return settle(twice.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("at")))


def candidates(at: np.ndarray, n: int, least: int) -> np.ndarray:
    """Starts of the runs of `least` words, of a document of n words, that hold a marked gram."""
    k = min(GRAM, max(1, least // 2))
    edge, at = np.zeros(n + 2, np.int32), at[at <= n - k]  # places of another text under this doc_id may lie beyond
    np.add.at(edge, np.maximum(at - (least - k), 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n - least + 1)] > 0)


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal intervals of the union of half-open intervals."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def less(start: np.ndarray, end: np.ndarray, off_start: np.ndarray, off_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint sorted intervals without those of another such list."""
    points = np.concatenate([start, off_end])
    cover = np.unique(np.concatenate([start, end, off_start, off_end]))
    if not len(points):
        return start, end
    inside = lambda s, e: (np.searchsorted(s, cover[:-1], "right") - np.searchsorted(e, cover[:-1], "right")) > 0
    keep = inside(start, end) & ~inside(off_start, off_end)
    return union(cover[:-1][keep], cover[1:][keep])


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, removed) from repeated pieces (doc_id, s, e, is_first)."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                piece = batch.column("pieces")[i].values
                s, e, first = (piece.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "is_first"))
                gone = union(s[~first], e[~first])
                stay = less(*union(s[first], e[first]), *gone)
                for (a, z), removed in ((gone, True), (stay, False)):
                    for column, value in zip(out, ([doc] * len(a), a.tolist(), z.tolist(), [removed] * len(a))):
                        column.extend(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())],
                ["doc_id", "start_word", "end_word", "removed"],
            )

    packed = found.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "is_first")).alias("pieces"))
    return packed.mapInArrow(run, "doc_id bigint, start_word bigint, end_word bigint, removed boolean")


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the words of removed spans and what stands between them; n_chars follows the text.

    A document that loses its last word goes; one without a removed span stays as it is, as do rows without doc_id.
    """
    names = docs.columns
    mark = "__gone" + "_" * max(map(len, names))  # no column of docs
    gone = settle(found.where("removed").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias(mark)))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                col, marks_ = part.column("text"), part.column(mark)
                w, (raw, off) = words(col), buffer(col)
                keep, text, length = np.ones(part.num_rows, bool), {}, {}
                for i in np.flatnonzero(marks_.is_valid().to_numpy(zero_copy_only=False)):
                    piece = marks_[int(i)].values
                    s, e = (piece.field(c).to_numpy() for c in ("start_word", "end_word"))
                    keep[i] = (e - s).sum() < w.first[i + 1] - w.first[i]
                    lo = np.concatenate([[off[i]], w.end[w.first[i] + e - 1]])
                    hi = np.concatenate([w.start[w.first[i] + s], [off[i + 1]]])
                    text[int(i)] = "".join(raw[a:z].tobytes().decode() for a, z in zip(lo, hi))
                    length[int(i)] = len(text[int(i)])
                part = part.select(names)
                for name, new in (("text", text), ("n_chars", length)):
                    if new and name in names:
                        at, field = names.index(name), part.schema.field(name)
                        mask = np.zeros(part.num_rows, bool)
                        mask[list(new)] = True
                        values = pa.array([new[i] for i in sorted(new)], field.type)
                        part = part.set_column(at, field, pc.replace_with_mask(part.column(name), pa.array(mask), values))
                yield part.filter(pa.array(keep))

    return docs.join(gone, "doc_id", "left").select(*named(docs), mark).mapInArrow(run, docs.schema)


def oracle(least: int) -> str:
    return f"""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '{WORD_RE}') AS ws FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p + 1, p + {least}), ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(len(ws) - {least - 1})) AS p FROM w WHERE len(ws) >= {least})),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS later, count(*) OVER (PARTITION BY g) AS n FROM g),
c AS (SELECT doc_id, x, bool_or(later) AS removed
      FROM (SELECT doc_id, later, unnest(range(p, p + {least})) AS x FROM r WHERE n > 1) GROUP BY doc_id, x),
i AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, removed ORDER BY x) AS run FROM c)
SELECT doc_id, min(x) AS start_word, max(x) + 1 AS end_word, removed FROM i GROUP BY doc_id, removed, run"""
