"""A small corpus with every awkward row, and the words of a text."""

import random
import re

from pyspark.sql import types as T

from skein.llm.text import WORD_RE

WORD = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), WORD_RE))

#: Names that operators use inside, as extra columns.
CLASHING = ["h", "v", "at", "pos", "rep", "a", "b", "cell", "cells", "term", "terms", "shard", "mark", "seeds", "n", "s", "e", "f0", "node", "root", "kept_doc_id", "host", "path", "poor", "toxic", "host_poor", "path_toxic", "keep", "__gone", "__host", "__text", "__poor", "item_id", "quality"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def words(text):
    return WORD.findall((text or "").lower())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(spark, texts, **columns):
    """texts: doc_id to text, or pairs of them; clashing columns hold junk."""
    pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
    row = lambda i, t: (i, t, columns.get("lang", "en"), columns.get("source", "s"), None if t is None else len(t), *["x"] * len(CLASHING))
    return spark.createDataFrame([row(i, t) for i, t in pairs], SCHEMA)


def awkward(spark, seed=3):
    """Null ids and texts, empty and long texts, repeated rows, ties, another text under one id, null columns."""
    rng = random.Random(seed)
    long = prose(rng, 20_000, 3000)
    copy = prose(rng, 120)
    pairs = [
        (None, copy), (1, None), (2, ""), (3, " \n!? "), (4, "word"), (5, long), (6, copy), (7, copy), (7, copy), (8, copy + " end"), (9, prose(rng, 60) + " " + copy), (9, prose(rng, 70)),
        (10, "a " * 3000), (11, "é" * 200_000), (12, prose(rng, 300)),
    ]
    made = corpus(spark, pairs)
    nothing = spark.createDataFrame([(13, prose(rng, 80), None, None, None, *[None] * len(CLASHING))], SCHEMA)
    return made.union(nothing)
