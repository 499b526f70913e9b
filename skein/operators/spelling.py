"""Spelling correction by trigrams and edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import edit_distance_compat, trigrams


def candidates(words: DataFrame, vocabulary: DataFrame, index: DataFrame, compat: bool = False) -> DataFrame:
    """(word, term, df, at, distance): the terms that share a trigram with a word; at: the first of its trigrams that is shared."""
    own = words.select("word", F.posexplode(trigrams(F.col("word"))).alias("at", "trigram"))
    shared = own.join(index, "trigram").groupBy("word", "term").agg(F.min("at").alias("at"))
    distance = edit_distance_compat if compat else F.levenshtein
    return shared.join(vocabulary.select("term", "df"), "term").select("word", "term", "df", "at", distance(F.col("word"), F.col("term")).alias("distance"))


def correct(words: DataFrame, vocabulary: DataFrame, index: DataFrame, compat: bool = False) -> DataFrame:
    """(word, corrected) for each distinct word.

    A word of the vocabulary stays. Another becomes the closest term that shares a trigram with it, however far; ties
    go to the highest document frequency, then to the first shared trigram, then to the byte order. None: null.
    """
    words = words.select("word").distinct()
    known = vocabulary.select("term")
    unknown = words.join(known, F.col("word") == F.col("term"), "left_anti")
    order = F.struct("distance", (-F.col("df")).alias("df"), "at", "term")
    best = candidates(unknown, vocabulary, index, compat).groupBy("word").agg(F.min(order).alias("best")).select("word", F.col("best.term").alias("corrected"))
    same = words.join(known, F.col("word") == F.col("term"), "left_semi").select("word", F.col("word").alias("corrected"))
    return same.union(unknown.join(best, "word", "left").select("word", "corrected"))
