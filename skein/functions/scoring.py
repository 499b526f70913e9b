"""BM25 and the minimum window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
WINDOW_WEIGHT, BM25_WEIGHT = 3.0, 1.0
NO_WINDOW = 4294967295


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25(idf_: Column, tf: Column, length: Column, average: Column) -> Column:
    return idf_ * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average))


def min_window(occurrences: Column, n_tokens: Column) -> Column:
    """Length of the shortest stretch that holds every token; NO_WINDOW if one is missing.

    occurrences: array of (pos, i) in order, i being the number of the query token.
    """
    start = F.struct(F.array_repeat(F.lit(-1), n_tokens.cast("int")).alias("last"), F.lit(NO_WINDOW).cast("bigint").alias("win"))

    def step(state: Column, o: Column) -> Column:
        last = F.transform(state["last"], lambda p, i: F.when(i == o["i"], o["pos"]).otherwise(p))
        low = F.array_min(last)
        win = F.when(low >= 0, F.least(state["win"], (o["pos"] - low + 1).cast("bigint"))).otherwise(state["win"])
        return F.struct(last.alias("last"), win.alias("win"))

    return F.aggregate(occurrences, start, step, lambda s: s["win"])


def score(window: Column, n_tokens: Column, bm: Column, length: Column) -> Column:
    return F.lit(WINDOW_WEIGHT) * n_tokens / window + F.lit(BM25_WEIGHT) * bm / length
