import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from skein.llm import packing, queries, quality, winnowing
from skein.llm.store import settle
from tests.llm.helpers import WORD, awkward, corpus, prose, words
from tests.llm.test_copies import groups, near, runs
from tests.llm.test_packing import brute as packed
from tests.llm.test_packing import windows
from tests.llm.test_repeats import brute
from tests.oracle import SMALL


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SMALL)))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_every_stage_takes_effect(spark, stages):
    docs, good, single, cut, clean, packed = stages
    assert all(x.columns == docs.columns for x in stages[:-1])
    labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(good) == {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()} < ids(docs)
    assert ids(single) < ids(good) and ids(cut) <= ids(single) and ids(clean) <= ids(cut)
    assert ids(winnowing.overlaps(clean, benchmark)) == set() and ids(packing.features(clean)) == ids(packed)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_awkward_documents_pass_every_stage(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SMALL))
        if name == "near copies":
            assert {6} == ids(docs) & {6, 7, 8}
    empty = awkward(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SMALL).count() == 0


def test_the_entry_lists_them():
    names = list(__spark_entry__.queries())
    assert {x.split("_")[0] for x in names if x.startswith("op")} == {f"op{n}" for n in range(1, 11)} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage of a small corpus against plain Python, whole texts and all."""
    rng = random.Random(8)
    items = {i: prose(rng, 40, 5000) for i in range(4)}
    passages = [prose(rng, rng.randrange(55, 90), 5000) for _ in range(5)]
    texts = {}
    for i in range(90):
        texts[i] = prose(rng, rng.randrange(150, 400), 5000)
        if i % 9 == 0:
            texts[i] += " " + passages[i % 5]
        if i % 11 == 0:
            texts[i] += " " + " ".join(items[i % 4].split()[3:25])
        if i % 13 == 5:
            texts[i] = texts[i - 5] if i % 2 else texts[i - 5] + " once more"
    docs = corpus(spark, texts)
    spark.createDataFrame([(i, t) for i, t in items.items()], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    got = []
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)))
        got.append(docs)
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert read(got[0]) == texts  # no labels, nothing to reject
    ids_, values = list(texts), list(texts.values())
    gone = {a for a, _ in groups((ids_[i], ids_[j]) for i, j in near(values, 42))}
    single = {i: t for i, t in texts.items() if i not in gone}
    assert len(gone) >= 6 and read(got[1]) == single
    cut = dict(single)
    for i, s, e, removed in sorted(brute(list(single.items()), 50), reverse=True):
        if removed:
            w = list(WORD.finditer(cut[i]))
            cut[i] = cut[i][: w[s].start()] + cut[i][w[e - 1].end() :]
    cut = {i: t for i, t in cut.items() if words(t)}
    assert cut != single and read(got[2]) == cut
    clean = {i: t for i, t in cut.items() if not any(runs(words(t), words(u), 13) for u in items.values())}
    assert len(clean) < len(cut) and read(got[3]) == clean
    assert windows(got[4]) == packed(clean, dict.fromkeys(clean, 0), 2048)


def test_the_last_stage_drops_no_neighbour(spark, monkeypatch):
    """80 documents of 341 words that share one: six fill a window, though an answer holds 2 of a class of length."""
    for name, value in {"ALONE": 4, "SEEDS": 3, "PART": 12, "DEPTH": 2}.items():
        monkeypatch.setattr(packing, name, value)
    docs = corpus(spark, {i: "shared " + " ".join(f"v{i}x{j}" for j in range(340)) for i in range(80)})
    sizes = Counter(r.window_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect())
    assert sum(sizes.values()) == 80 and sum(n == 6 for n in sizes.values()) >= 12, sizes
