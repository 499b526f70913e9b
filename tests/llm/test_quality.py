import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skein.llm import quality
from tests.llm.helpers import awkward
from tests.oracle import SMALL

BIG = SMALL.replace("0.001", "0.01")
#: Accuracy and recall on held-out labels of the large table; half the labels of BIG hold some twenty toxic documents only.
LARGE, TOXIC = SMALL.replace("0.001", "0.1"), (0.97, 0.8)


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("toxic", "p").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    poor, toxic = found.quality == 0, found.toxic == 1
    assert ((found.poor > 0.5) == poor).mean() > 0.97 and (found.poor[poor] > 0.5).mean() > 0.9
    assert ((found.p > 0.35) == toxic).mean() > TOXIC[0] and (found.p[toxic] > 0.35).mean() > TOXIC[1]
    print("toxic recall", (found.p[toxic] > 0.35).mean(), "false alarms", (found.p[~toxic] > 0.35).mean(), "poor recall", (found.poor[poor] > 0.35).mean(), (found.poor[~poor] > 0.35).mean())
    assert found.keep[~poor & ~toxic].mean() > 0.97


def test_classification_equals_brute_force(spark, tables):
    """Shrunk rates, each document's own evidence left out, posteriors and keep, from the evidence of the fitted model."""
    docs, labels = tables
    model = quality.fit(docs, labels)
    texts = pq.read_table(f"{BIG}/documents.parquet")
    ids, e = texts["doc_id"].to_pylist(), model.evidence(texts["text"])
    host, path = np.array(texts["source"].to_pylist()), np.array(texts["lang"].to_pylist())
    rates = {(r["__host"], r["__path"]): r for r in quality.posteriors(quality._evidence(docs, model, []), model).collect()}
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    worst = np.zeros(len(ids))
    for i, head in enumerate(quality.HEADS):
        p = 1 / (1 + np.exp(-(e[:, i] + model.base[head])))
        total = p.mean()

        def strength(n, m, up):
            between = (n * (m - up) ** 2).sum() / n.sum() - (up * (1 - up)).sum() / n.sum()
            return min(1e6, max(1.0, (n * up * (1 - up)).sum() / n.sum() / max(between, 1e-9) - 1))

        hosts = sorted(set(host))
        n, m = (np.array([f(p[host == h]) for h in hosts]) for f in (len, np.mean))
        k = strength(n, m, np.full(len(n), total))
        rate = dict(zip(hosts, (n * m + k * total) / (n + k)))
        paths = sorted(set(zip(host, path)))
        n, m = (np.array([f(p[(host == h) & (path == x)]) for h, x in paths]) for f in (len, np.mean))
        up = np.array([rate[h] for h, _ in paths])
        k = strength(n, m, up)
        of = dict(zip(paths, zip(n, m)))
        for h, x in paths:
            assert rates[h, x][f"host_{head}"] == pytest.approx(rate[h], rel=1e-9) and rates[h, x][f"k_{head}"] == pytest.approx(k, rel=1e-6)
        for d in range(len(ids)):
            size, mean = of[host[d], path[d]]
            others = (size * mean - p[d] + k * rate[host[d]]) / (size - 1 + k)
            value = 1 / (1 + np.exp(-(e[d, i] + np.log(others / (1 - others)))))
            assert found[ids[d]][head] == pytest.approx(value, rel=1e-6, abs=1e-12)
            worst[d] = max(worst[d], value)
    assert {d for d, w in zip(ids, worst) if w <= 0.35} == {d for d, r in found.items() if r.keep}


def test_texts_are_scored_twice(spark, tables):
    plans = []
    for df in (quality._evidence(tables[0], quality.fit(*tables), []), quality.keep_good(*tables)):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
    assert plans == [1, 1]  # the rates of keep_good are a settled table, from the other scoring


def test_sites(spark):
    rows = [("s", "en", "http://a.com/x/y", 1), ("s", None, None, 2), (None, "de", "/rel", 3), ("s", "en", "https://B.org", 4)]
    df = spark.createDataFrame(rows, "source string, lang string, url string, i int")
    got = df.select("i", *quality.site(df)).orderBy("i").collect()
    assert [(r["__host"], r["__path"]) for r in got] == [("a.com", "x"), ("s", ""), ("", "de"), ("b.org", "")]


def test_keeping_follows_the_classification(spark, tables):
    docs, labels = tables
    kept = sorted(r.doc_id for r in quality.keep_good(docs, labels).collect())
    assert kept == sorted(r.doc_id for r in quality.classify(docs, labels).where("keep").collect())


def test_awkward_documents(spark, tables):
    docs, (_, labels) = awkward(spark), tables
    odd = labels.union(labels.limit(1)).union(labels.select(F.lit(None).cast("bigint"), "quality", "toxic").limit(1)).union(labels.select("doc_id", F.lit(None).cast("int"), F.lit(1)).limit(3))
    found = quality.classify(docs, odd).collect()
    assert len(found) == docs.count() and {r.host for r in found} == {"s", ""}
    kept = quality.keep_good(docs, odd)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in found)
    assert quality.classify(docs, labels.limit(0)).where("not keep").count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0 == quality.keep_good(docs.limit(0), labels).count()
