import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.llm import simhash, winnowing
from skein.llm.components import components
from tests.llm.helpers import awkward, corpus, prose, words
from tests.oracle import SMALL, same


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {(x, find(x)) for x in root if find(x) != x}


def near(texts, distance):
    """All pairs of one batch within the distance, by brute force."""
    f, count = simhash.fingerprint(pa.array(texts))
    for i in range(len(texts)):
        d = np.bitwise_count(f[i] ^ f[i + 1 :]).sum(axis=1)
        yield from ((i, i + 1 + j) for j in np.flatnonzero((d <= distance) & (count[i] > 0) & (count[i + 1 :] > 0)))


def test_near_duplicates_find_what_brute_force_does(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet")
    ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
    rng = random.Random(5)
    for k in range(60):  # near copies with some words changed
        w = texts[rng.randrange(len(texts))].split()
        texts.append(" ".join(x if rng.random() > 0.04 else f"new{k}" for x in w))
        ids.append(10_000 + k)
    want = groups((ids[i], ids[j]) for i, j in near(texts, 42))
    found = {tuple(r) for r in simhash.near_duplicates(corpus(spark, list(zip(ids, texts)))).collect()}
    assert len(want) > 50 and found == want


def clusters(rng, sizes, most):
    """Fingerprints in clusters: copies of a centre with up to `most` bits changed."""
    out = []
    for size in sizes:
        base = np.unpackbits(rng.integers(0, 2**63, 4, dtype=np.uint64).view(np.uint8))
        for _ in range(size):
            one = base.copy()
            one[rng.choice(256, rng.integers(0, most + 1), replace=False)] ^= 1
            out.append(np.packbits(one).view(np.uint64))
    return np.array(out)


def frame(spark, f, key):
    return spark.createDataFrame([(i, *map(int, r.view(np.int64))) for i, r in enumerate(f)], f"{key} bigint, " + ", ".join(f"{w} bigint" for w in simhash.WORDS))


def linked(f, distance):
    for i in range(len(f)):
        yield from ((i, i + 1 + int(j)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]).sum(axis=1) <= distance))


@pytest.mark.parametrize(("bits", "block"), [(0, 1 << 21), (7, 1 << 21), (12, 1 << 21), (10, 100)])
def test_pairs_connect_what_brute_force_connects(spark, monkeypatch, bits, block):
    """Whatever the pieces and blocks: no component is lost, with clusters whose members are near and far from each other; pairs are true ones."""
    monkeypatch.setattr(simhash, "plan", lambda n, distance: bits)
    monkeypatch.setattr(simhash, "CROWD", 8)
    f = clusters(np.random.default_rng(1), [60, 40, 30, *[2] * 40, *[1] * 100], 30)
    want = set(linked(f, 42))
    found = {tuple(r) for r in simhash.near_pairs(frame(spark, f, "rep"), len(f), 42, 42, block).collect()}
    assert found <= want and groups(found) == groups(want)


def test_a_large_cluster_of_near_copies_gives_few_pairs(spark):
    """5,000 near copies of one text, all different: 12.5 million pairs, of which a few for each copy leave the cells."""
    f = np.unique(clusters(np.random.default_rng(2), [5000], 12), axis=0)
    nodes = frame(spark, f, "rep")
    pairs = {tuple(r) for r in simhash.near_pairs(nodes, len(f), 42, 42).collect()}
    assert len(groups(pairs)) == len(f) - 1 and len(pairs) < 40 * len(f)


def test_no_pair_is_lost_with_pieces_of_a_large_corpus(spark, monkeypatch):
    """Pairs at 32, 36, 40 and 42 bits, planned as for 250,000 fingerprints with the defaults of near_duplicates; some were lost while 0.95 were planned for."""
    rng = np.random.default_rng(4)
    f, at = rng.integers(0, 2**63, (800, 4), dtype=np.uint64) ^ (rng.integers(0, 2, (800, 4), dtype=np.uint64) << np.uint64(63)), [32, 36, 40, 42]
    for i in range(400):
        f[400 + i] = f[i]
        for bit in rng.choice(256, at[i % 4], replace=False):
            f[400 + i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    made = spark.createDataFrame([(i, *map(int, r.view(np.int64))) for i, r in enumerate(f)], "doc_id bigint, " + ", ".join(f"{w} bigint" for w in simhash.WORDS))
    plan = simhash.plan
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    monkeypatch.setattr(simhash, "plan", lambda n, distance: plan(250_000, distance))
    found = {tuple(r) for r in simhash.near_duplicates(made).collect()}
    assert found == {(400 + i, i) for i in range(400)}


def test_awkward_copies(spark):
    found = {tuple(r) for r in simhash.near_duplicates(awkward(spark)).collect()}
    assert {(7, 6), (8, 6)} <= found and not {1, 2, 3} & {x for r in found for x in r}
    assert len({a for a, _ in found}) == len(found)
    assert simhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(5, 5), (3, 2), (3, 2)]
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {r for r in found if r[0] != r[1]} == groups(edges)


def runs(a, b, least):
    found = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    found.add((i, j, n))
    return found


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    items = {i: prose(rng, 40, 60) for i in range(6)} | {6: "b a " * 12}
    docs = {}
    for i in range(25):
        part = items[rng.randrange(7)].split()
        a = rng.randrange(20)
        docs[i] = " ".join([prose(rng, 20, 60), *part[a : a + rng.randrange(8, 30)], prose(rng, 10, 60)])
    want = {(d, i, *r) for d, t in docs.items() for i, u in items.items() for r in runs(words(t), words(u), 13)}
    test = spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id bigint, text string, h string")
    found = {tuple(r) for r in winnowing.overlaps(corpus(spark, docs), test).collect()}
    assert want and found == want
    kept = winnowing.decontaminate(corpus(spark, docs), test)
    assert {r.doc_id for r in kept.collect()} == set(docs) - {r[0] for r in want}


def test_overlaps_over_whole_tables(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    same(winnowing.overlaps(read("documents"), read("benchmark")), winnowing.oracle())


def test_awkward_overlaps(spark):
    docs = awkward(spark)
    copy = next(r.text for r in docs.where("doc_id = 6").collect())
    test = spark.createDataFrame([(1, copy), (1, copy), (2, None), (3, ""), (None, copy)], "item_id bigint, text string")
    found = {tuple(r) for r in winnowing.overlaps(docs, test).collect()}
    assert found == {(6, 1, 0, 0, 120), (7, 1, 0, 0, 120), (8, 1, 0, 0, 120), (9, 1, 60, 0, 120)}
    kept = winnowing.decontaminate(docs, test)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 10, 11, 12, 13}
    assert winnowing.overlaps(docs.limit(0), test).count() == 0 == winnowing.overlaps(docs, test.limit(0)).count()
    assert winnowing.decontaminate(docs, test.limit(0)).count() == docs.count()
