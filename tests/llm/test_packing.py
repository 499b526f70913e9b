import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import packing
from skein.llm.text import words as hashed
from tests.llm.helpers import awkward, corpus, prose


def brute(texts, shard_of, window):
    """The windows as sets of lists, from BM25 in plain Python."""
    terms = {}
    for i, t in texts.items():
        w = hashed(pa.array([t]))
        terms[i] = Counter((w.hash >> (64 - packing.BITS)).tolist())
    length = {i: sum(c.values()) for i, c in terms.items()}
    df = Counter(t for c in terms.values() for t in c)
    n, avg = len(texts), sum(length.values()) / len(texts)
    bm25 = lambda t, d: float(np.float32(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))) * terms[d][t] * 2.2 / (terms[d][t] + 1.2 * (0.25 + 0.75 * length[d] / avg))
    weight = lambda t, d: round(bm25(t, d) * 2**20)
    out = set()
    for shard in set(shard_of.values()):
        mine = sorted(i for i in texts if shard_of[i] == shard)
        for i in mine:
            for p in range(length[i] // window):
                out.add(((i, p * window, window),))
        unused = [i for i in mine if length[i] % window]
        score_of = lambda seed, of: {d: sum(weight(t, d) for t in terms[seed] if t in terms[d]) for d in of}
        rows = lambda chosen: tuple((d, length[d] - length[d] % window, length[d] % window) for d in chosen)
        begun = []  # windows that may have more, in rounds
        while len(unused) > packing.ALONE or begun:
            free = list(unused)
            new = unused[: min(packing.SEEDS, math.ceil(len(unused) / packing.PART))] if len(unused) > packing.ALONE else []
            turn, begun = begun + [[d] for d in new], []
            for chosen in turn:
                if len(chosen) == 1 and chosen[0] in new:
                    if chosen[0] not in unused:
                        continue
                    unused.remove(chosen[0])
                room = left = window - sum(length[d] % window for d in chosen)
                score = score_of(chosen[0], [d for d in free if d > chosen[0]])
                seen, more = Counter(), lambda: any(n >= packing.DEPTH and 2 ** (c - 1) <= left for c, n in seen.items())  # noqa: B023
                for d in sorted(score, key=lambda d: (-score[d], d)):
                    rest = length[d] % window
                    if score[d] > 0 and rest <= room and seen[rest.bit_length()] < packing.DEPTH:
                        if more():
                            break
                        seen[rest.bit_length()] += 1
                        if d in unused and rest <= left:
                            left -= rest
                            chosen.append(d)
                            unused.remove(d)
                if more():
                    begun.append(chosen)
                else:
                    assert not [d for d in unused if score.get(d, 0) > 0 and length[d] % window <= left]
                    out.add(rows(chosen))
        while unused:
            chosen = [unused.pop(0)]
            left = window - length[chosen[0]] % window
            score = score_of(chosen[0], unused)
            for d in sorted(unused, key=lambda d: (-score[d], d)):
                if score[d] > 0 and length[d] % window <= left:
                    left -= length[d] % window
                    chosen.append(d)
                    unused.remove(d)
            out.add(rows(chosen))
    return out


def windows(df):
    by = defaultdict(list)
    for r in df.collect():
        by[r.window_id].append((r.place, r.doc_id, r.start_word, r.n_words))
    assert all([p for p, *_ in sorted(v)] == list(range(len(v))) for v in by.values())
    return {tuple(x[1:] for x in sorted(v)) for v in by.values()}


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    texts = {i: prose(rng, rng.choice([3, 8, 20, 45, 130]), 60) + (f" topic{i % 5}" * rng.randrange(4)) for i in range(120)}
    docs = corpus(spark, texts)
    shard = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("s")).collect()}
    assert windows(packing.pack(docs, 50, 40)) == brute(texts, shard, 50)


def test_awkward_documents(spark):
    docs = awkward(spark)
    found = packing.pack(docs, 256, 4).collect()
    used = defaultdict(int)
    full = defaultdict(int)
    for r in found:
        used[r.doc_id] += r.n_words
        full[r.window_id] += r.n_words
    assert max(full.values()) <= 256 and set(used) == {4, 5, 6, 7, 8, 9, 10, 11, 12, 13}
    assert used[5] == 20_000 and used[7] == 240 and used[11] == 1 and used[9] == 250
    assert packing.pack(docs.limit(0)).count() == 0 == packing.pack(docs.where("doc_id < 4")).count()
    again = packing.pack(docs.repartition(7), 256, 4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_document_frequencies_cover_all_documents(spark):
    rng = random.Random(9)
    texts = {i: prose(rng, 30, 50) for i in range(50)}
    df = packing.document_frequencies(packing.features(corpus(spark, texts)))
    want = Counter(x for t in texts.values() for x in set((hashed(pa.array([t])).hash >> (64 - packing.BITS)).tolist()))
    assert {i: df[i] for i in want} == want and df.sum() == sum(want.values())


@pytest.mark.parametrize("merged", [0, 64])
def test_rounds_equal_brute_force(spark, monkeypatch, merged):
    """Many rounds over several blocks and tasks, in which answers run out, with repeated texts and one without a neighbour."""
    rng = random.Random(8)
    texts = {i: prose(rng, rng.choice([3, 8, 20, 45, 130]), 60) + (f" topic{i % 5}" * rng.randrange(4)) for i in range(200)}
    texts |= {i: texts[i - 200] for i in range(200, 230)} | {300: "other", 301: prose(rng, 100)}
    for name, value in {"ALONE": 10, "SEEDS": 7, "PART": 12, "DEPTH": 2, "MERGED": merged}.items():
        monkeypatch.setattr(packing, name, value)
    want = brute(texts, dict.fromkeys(texts, 0), 50)
    assert windows(packing.pack(corpus(spark, texts).repartition(3), 50)) == want


def test_copies_of_a_large_corpus_share_a_window(spark):
    """Each even document's nearest by BM25 over 2,600 documents is the copy after it; two fill a window."""
    rng = random.Random(12)
    texts = {}
    for i in range(0, 2600, 2):
        texts[i] = " ".join(f"v{i}x{j}" for j in range(20)) + " " + prose(rng, 10)
        texts[i + 1] = texts[i]
    of = {r.doc_id: r.window_id for r in packing.pack(corpus(spark, texts), 60).collect()}
    assert len(of) == 2600 and sum(of[i] == of[i + 1] for i in range(0, 2600, 2)) >= 0.9 * 1300


def test_windows_take_more_neighbours_than_an_answer_holds(spark, monkeypatch):
    """80 documents of 10 words that share one: windows of 60 words are full, though an answer holds 2 of a class of length."""
    for name, value in {"ALONE": 4, "SEEDS": 3, "PART": 12, "DEPTH": 2}.items():
        monkeypatch.setattr(packing, name, value)
    texts = {i: "shared " + " ".join(f"v{i}x{j}" for j in range(9)) for i in range(80)}
    sizes = Counter(r.window_id for r in packing.pack(corpus(spark, texts), 60).collect())
    assert sum(sizes.values()) == 80 and sum(n == 6 for n in sizes.values()) >= 12, sizes


def test_the_last_open_windows_make_no_pass_over_the_index(spark, monkeypatch):
    """Windows still open when ALONE documents or fewer are unused ask the driver's block of them, with the same windows."""
    for name, value in {"ALONE": 30, "SEEDS": 7, "PART": 4, "DEPTH": 2}.items():
        monkeypatch.setattr(packing, name, value)
    asked, ask = [], packing.ask
    monkeypatch.setattr(packing, "ask", lambda index, unused, *a: asked.append((int(unused.sum()), isinstance(index, DataFrame))) or ask(index, unused, *a))
    rng = random.Random(8)
    texts = {i: "shared " + prose(rng, rng.choice([3, 8, 20, 45]), 60) for i in range(150)}
    assert windows(packing.pack(corpus(spark, texts).repartition(3), 50)) == brute(texts, dict.fromkeys(texts, 0), 50)
    last = [passes for alive, passes in asked if 0 < alive <= 30]
    assert last and not any(last) and all(passes for alive, passes in asked if alive > 30), asked


@pytest.mark.parametrize("dense", [0, 20, 10**9])
@pytest.mark.parametrize("postings", [1, 40, 1 << 15])
def test_a_block_is_made_ready_once_for_all_groups(monkeypatch, dense, postings):
    """Scores of two groups of seeds over one block, by columns, by postings and by both, however they are cut."""
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "POSTINGS", postings, raising=False)
    rng = np.random.default_rng(5)
    has = rng.random((30, 50)) < np.linspace(0.01, 0.9, 30)[:, None]
    term, doc = np.nonzero(has)
    weight = rng.integers(1, 1 << 25, len(term)).astype(np.float64)
    held = np.zeros((30, 50))
    held[term, doc] = weight
    asks = [rng.random((n, 30)) < 0.4 for n in (7, 4)]
    block = packing.Block(50, doc, term, weight, 30)
    for order in (asks, asks[::-1], asks[:1]):
        assert (block.scores([(len(a), *np.nonzero(a)) for a in order]) == np.concatenate(order) @ held).all()
