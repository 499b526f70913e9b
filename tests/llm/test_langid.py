import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.llm import langid
from tests.llm.helpers import awkward
from tests.oracle import SMALL

BIG = SMALL.replace("0.001", "0.01")


def likelihood(p, share):
    return np.log(p[:, share > 0] @ share[share > 0]).sum()


def best(p, steps=3000):
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(steps):
        share = share * (p / (p @ share)[:, None]).mean(0)
    return share


def test_sets_have_the_best_penalised_likelihood():
    rng = np.random.default_rng(2)
    blocks, penalty, agree = [], 6.0, 0
    for _ in range(60):
        n, mix = rng.integers(5, 200), rng.dirichlet([0.4] * 3)
        z = rng.choice(3, n, p=mix)
        p = np.exp(-rng.exponential(3, (n, 3)))
        p[np.arange(n), z] = 1
        blocks.append(p)
    first = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    found = langid.infer(np.concatenate(blocks).astype(np.float32), first, penalty)
    for p, share in zip(blocks, found):
        cost = penalty * math.log1p(len(p)) / 2
        value = {}
        for k in (1, 2, 3):
            for s in itertools.combinations(range(3), k):
                value[s] = likelihood(p[:, list(s)], best(p[:, list(s)])) - k * cost
        mine = tuple(np.flatnonzero(share > 0).tolist())
        agree += value[mine] >= max(value.values()) - 0.2
        assert abs(share.sum() - 1) < 1e-6 and np.abs(share[list(mine)] - best(p[:, list(mine)])).max() < 0.05
    assert agree >= 58  # backward elimination is greedy


def test_held_out_languages_and_mixtures(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where("n_chars > 200")
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = langid.languages(known).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").toPandas()
    assert len(found) > 300 and (found.language == found.lang).mean() > 0.99
    half = lambda lang: docs.where(f"lang = '{lang}' and doc_id % 2 = 1").select("doc_id", F.array_join(F.slice(F.split("text", "\\s+"), 1, 60), " ").alias("text")).limit(30).toPandas()
    a, b = half("en"), half("fr")
    mixed = [(1_000_001 + 2 * i, x + " " + y, None) for i, (x, y) in enumerate(zip(a.text, b.text))]
    both = langid.languages(known.select("doc_id", "text", "lang").union(spark.createDataFrame(mixed, "doc_id bigint, text string, lang string")))
    sets = [set(r.languages) for r in both.where("doc_id > 1000000").collect()]
    assert np.mean([s == {"en", "fr"} for s in sets]) > 0.9


def test_awkward_texts(spark):
    docs = awkward(spark)
    found = langid.languages(docs).collect()
    assert len(found) == docs.where("doc_id is not null").count()
    for r in found:
        assert (r.language is None) == (r.n_words == 0) == (not r.languages) and len(r.languages) == len(r.shares)
    assert langid.languages(docs.limit(0)).count() == 0
    unnamed = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.language is None and r.languages == [] for r in unnamed)


def test_word_trigrams_depend_on_the_word_alone():
    for a, b in (("ab cde", "cde ab"), ("xcde", "x cde"), ("a b c", "c")):
        w, code, first = langid._grams(pa.array([a, b]))
        by = {}
        for i, h in enumerate(w.hash):
            assert by.setdefault(h, code[first[i] : first[i + 1]].tolist()) == code[first[i] : first[i + 1]].tolist()
