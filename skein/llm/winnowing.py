"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import corpus, named, settle, small
from .text import WORD_RE, signed, slices, winnow, words


def fingerprints(texts: DataFrame, k: int, window: int) -> DataFrame:
    """(h, doc_id, pos, length) for each k-gram that winnowing keeps; length: words of the document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                at, h = winnow(w, k, window)
                doc = w.doc()[at]
                yield pa.RecordBatch.from_arrays(
                    [signed(h), part.column("doc_id").take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(w.counts()[doc].astype(np.int32))],
                    ["h", "doc_id", "pos", "length"],
                )

    return texts.mapInArrow(run, "h bigint, doc_id bigint, pos int, length int")


def _as_corpus(benchmark: DataFrame) -> DataFrame:
    return corpus(benchmark.select(F.col("item_id").alias("doc_id"), "text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, k: int = 6, window: int = 8) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): every maximal run of words that a document shares with an item.

    Of each document and item, the k-grams with the least hash of some `window` consecutive ones are kept. Any shared
    run of k + window - 1 words (13) keeps the same k-gram on both sides, so an equi-join of the kept hashes seeds it;
    seeds are then extended word by word to the whole run, and runs of 13 words and more are returned: all of them, as if
    every position had been compared. Starts are 0-based word positions.

    Null and empty texts, and documents or items under 13 words, share no run. Rows without doc_id or item_id take
    no part. Repeated rows give their runs once. A text that repeats an item's run, or an item that repeats itself, gives
    one row for each pair of places. An empty table gives none. Other columns are not read.
    """
    least = k + window - 1
    train, test = corpus(docs), _as_corpus(benchmark)
    d, b = fingerprints(train, k, window).alias("d"), fingerprints(test, k, window).alias("b")
    seeds = settle(
        d.join(b, F.col("d.h") == F.col("b.h"))
        .select(F.col("d.doc_id"), F.col("b.doc_id").alias("item_id"), (F.col("d.pos") - F.col("b.pos")).alias("diagonal"), F.col("b.length").alias("length"))
        .distinct()
    )
    wanted = settle(seeds.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "length")).alias("seeds")))

    def cut(batches):  # the words of each document that lie opposite an item
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                rows = ([], [], [], [], [])
                for i, (doc, seeds_) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("seeds").to_pylist())):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    for s in seeds_:
                        lo, hi = max(0, s["diagonal"]), min(len(h), s["diagonal"] + s["length"])
                        if hi - lo >= least:
                            for column, value in zip(rows, (doc, s["item_id"], lo, lo - s["diagonal"], h[lo:hi].view(np.int64))):
                                column.append(value)
                off = np.concatenate([[0], np.cumsum([len(x) for x in rows[4]])]).astype(np.int32)
                flat = np.concatenate(rows[4]) if rows[4] else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in rows[:4]), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                    ["doc_id", "item_id", "doc_start", "item_start", "theirs"],
                )

    def item_words(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), signed(w.hash))], ["item_id", "ours"]
                )

    def extend(batches):
        for batch in batches:
            rows = ([], [], [], [], [])
            theirs, ours = batch.column("theirs"), batch.column("ours")
            ids = [batch.column(c).to_pylist() for c in ("doc_id", "item_id", "doc_start", "item_start")]
            for i in range(batch.num_rows):
                a = theirs[i].values.to_numpy()
                b = ours[i].values.to_numpy()[ids[3][i] : ids[3][i] + len(a)]
                a = a[: len(b)]
                edge = np.diff(np.concatenate([[False], a == b, [False]]).astype(np.int8))
                for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    if hi - lo >= least:
                        for column, value in zip(rows, (ids[0][i], ids[1][i], ids[2][i] + lo, ids[3][i] + lo, hi - lo)):
                            column.append(int(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in rows], ["doc_id", "item_id", "doc_start", "item_start", "n_words"]
            )

    pieces = train.join(small(wanted), "doc_id").mapInArrow(cut, "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, theirs array<bigint>")
    items = test.mapInArrow(item_words, "item_id bigint, ours array<bigint>")
    found = pieces.join(items, "item_id").select("doc_id", "item_id", "doc_start", "item_start", "theirs", "ours")
    return found.mapInArrow(extend, "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 6, window: int = 8) -> DataFrame:
    """The rows of docs that share no run of k + window - 1 words with an item. Rows without doc_id stay."""
    return docs.join(small(settle(overlaps(docs, benchmark, k, window).select("doc_id").distinct())), "doc_id", "left_anti").select(*named(docs))


def oracle(least: int = 13) -> str:
    words_ = f"regexp_extract_all(lower(text), '{WORD_RE}')"
    grams = lambda t, i: (
        f"SELECT {i}, p, array_to_string(list_slice(ws, p + 1, p + {least}), ' ') AS g "
        f"FROM (SELECT {i}, ws, unnest(range(len(ws) - {least - 1})) AS p FROM (SELECT DISTINCT {i}, {words_} AS ws FROM {t}) WHERE len(ws) >= {least})"
    )
    return f"""
WITH d AS ({grams("documents", "doc_id")}), b AS ({grams("benchmark", "item_id")}),
hits AS (SELECT DISTINCT doc_id, item_id, d.p AS dp, b.p AS bp FROM d JOIN b USING (g)),
runs AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - bp ORDER BY dp) AS run FROM hits)
SELECT doc_id, item_id, min(dp) AS doc_start, min(bp) AS item_start, count(*) + {least - 1} AS n_words
FROM runs GROUP BY doc_id, item_id, dp - bp, run"""
