import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import debruijn, queries, repeats, suffixes
from skein.llm.text import gram_sums
from tests.llm.helpers import awkward, corpus, prose, words
from tests.oracle import SMALL, same


def brute(texts, least):
    """The relation of repeats for distinct (doc_id, text) pairs."""
    seen = {}
    docs = [(i, words(t)) for i, t in sorted(set(texts)) if i is not None]
    for i, w in docs:
        for p in range(len(w) - least + 1):
            seen.setdefault(tuple(w[p : p + least]), set()).add((i, p))
    mark = {}
    for places in seen.values():
        if len(places) > 1:
            first = min(places)
            for i, p in places:
                for x in range(p, p + least):
                    mark[i, x] = mark.get((i, x), False) or (i, p) != first
    rows, keys = set(), sorted(mark)
    for i, x in keys:
        if mark.get((i, x - 1)) != mark[i, x]:
            e = x
            while mark.get((i, e)) == mark[i, x]:
                e += 1
            rows.add((i, x, e, mark[i, x]))
    return rows


def rows(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_both_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = [prose(rng, rng.randrange(3, 25), 30) for _ in range(8)] + ["a " * 12, "b a " * 9]
    texts = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    want = brute(texts, 6)
    assert want and rows(debruijn.repeated_spans(corpus(spark, texts), 6)) == want == rows(suffixes.repeated_spans(corpus(spark, texts), 6))


def test_whole_tables(spark):
    sql = queries.oracle_sql()
    same(queries.op3_debruijn(spark, SMALL), sql["op3_debruijn"])
    same(queries.op8_suffixes(spark, SMALL), sql["op8_suffixes"])


def test_awkward_rows(spark):
    docs = awkward(spark)
    a, b = rows(debruijn.repeated_spans(docs)), rows(suffixes.repeated_spans(docs))
    assert a == b
    assert {(6, 0, 120, False), (7, 0, 120, True), (8, 0, 120, True), (9, 60, 180, True)} <= a
    assert {r[0] for r in a} == {6, 7, 8, 9, 10}
    kept = debruijn.without_repeats(docs).collect()
    by = {(r.doc_id, r.text) for r in kept}
    assert {r.doc_id for r in kept} == {None, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13}
    assert {t for i, t in by if i == 8} == {" end"} and all(r.n_chars == len(r.text) for r in kept if r.doc_id in (8, 9))
    assert debruijn.without_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("op", [debruijn, suffixes])
def test_empty_tables(spark, op):
    docs = corpus(spark, [(1, "x")])
    assert op.repeated_spans(docs.limit(0)).count() == 0 == op.repeated_spans(docs).count()
    assert debruijn.without_repeats(docs.limit(0)).count() == 0


def test_suffixes_sort_like_their_words():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 3, 400).astype(np.uint64)
    s, least = suffixes.Suffixes(word, 7), 7
    x = rng.permutation(390)
    first = np.array([0, 1, 40, 200])
    got = s.sort(x, first)
    for a, z in zip(first, [1, 40, 200, 390]):
        assert got[a:z].tolist() == sorted(x[a:z].tolist(), key=lambda i: tuple(word[i : i + least]))
    pairs = rng.integers(0, 390, (2, 500))
    common = s.common(*pairs)
    for i, j, n in zip(*pairs, common):
        assert n == next((k for k in range(least) if word[i + k] != word[j + k]), least)


def test_classes_of_colliding_hashes_are_split():
    ids = np.array([1, 2, 1, 3, 1, 2, 1, 3])
    x = np.array([0, 2, 4, 6])  # (1, 2), (1, 3), (1, 2), (1, 3) under one hash
    order, label = suffixes._classes(x, np.array([True, False, False, False]), ids, 2)
    groups = {}
    for at, c in zip(x[order], label):
        groups.setdefault(c, []).append(int(at))
    assert sorted(groups.values()) == [[0, 4], [2, 6]]


def test_every_run_holds_a_marked_gram():
    at = np.array([0, 35, 80])
    k = repeats.GRAM
    found = repeats.candidates(at, 140, 50)
    want = [s for s in range(91) if any(s <= p and p + k <= s + 50 for p in at)]
    assert found.tolist() == want
    assert gram_sums(np.zeros(0, np.uint64)).tolist() == [0]


def crowd(n):
    """Stretches of one gram at n places, by document: every third is another text around it, all others have 80 copies each."""
    passage = [f"p{i}" for i in range(20)]
    for doc in range(n):
        k = f"own{doc}" if doc % 3 == 0 else doc // 120
        text = [f"x{k}y{j}" for j in range(46)]
        yield 7, doc, 23, 3, " ".join(text[:20] + passage + text[20:])


def tabled(rows):
    h, doc, at, s, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(s, pa.int32()), pa.array(text)], ["h", "doc_id", "at", "s", "words"])


def found(batches):
    return sorted(tuple(r.values()) for b in batches for r in b.to_pylist())


@pytest.mark.parametrize("step", [1, 7, 100, 1000])
def test_a_gram_of_many_places_is_classed_by_chunks(monkeypatch, step):
    """Between two other grams, with repeated rows and a document of several stretches."""
    rows = list(crowd(300))
    rows = [(1, d, a, s, t) for _, d, a, s, t in rows[:9]] + sorted([*rows, *rows[4:60:5], *((7, d, 99, 79, t) for _, d, _, _, t in rows[10:50])], key=lambda r: r[1]) + [(9, *r[1:]) for r in rows[:9]]
    want = found([suffixes.pieces(pa.Table.from_batches([tabled(own)]), 50) for own in ([r for r in rows if r[0] == h] for h in (1, 7, 9))])
    assert len(want) > 100
    monkeypatch.setattr(suffixes, "HOT", 20)
    monkeypatch.setattr(suffixes, "SLOTS", 1 << 10)
    assert found(suffixes.sorted_pieces([tabled(rows[i : i + step]) for i in range(0, len(rows), step)], 50)) == want
    hot = rows[9:-9]
    assert found(suffixes.sorted_pieces([tabled(hot[i : i + step]) for i in range(0, len(hot), step)], 50)) == found([suffixes.pieces(pa.Table.from_batches([tabled(hot)]), 50)])


def test_the_places_of_one_gram_are_not_held_together():
    """Arrays of some thousand places at a time: before, 30,000 took over 400 MB."""
    rows = list(crowd(30_000))
    batches = [tabled(rows[i : i + 5000]) for i in range(0, 30_000, 5000)]
    tracemalloc.start()
    n = sum(b.num_rows for b in suffixes.sorted_pieces(batches, 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 250e6
