"""Languages of documents, and their shares, by mixture inference."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import corpus
from .text import _classify, buffer, slices, words

BITS = 16
#: Part of each language's distribution that is the same for all: no word speaks against a language by more than this allows.
FLOOR = 0.02


def _grams(texts: pa.Array):
    """(Words, hashes of the byte trigrams of the words with their borders, first trigram of each word).

    A word of n bytes has n trigrams: each of its bytes with the two before it, a border counting as one.
    """
    w = words(texts)
    raw, _ = buffer(texts)
    m, b = _classify(raw)
    b = np.where(m, b, 0).astype(np.uint32)
    code = np.empty(len(b), np.uint32)
    code[:2] = b[:2] << 16
    code[2:] = (b[2:] << 16) | (b[1:-1] << 8) | np.where(b[1:-1] > 0, b[:-2], 0)
    code[1:2] |= b[:1] << 8
    size = w.end - w.start
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(w.start - first[:-1], size)
    code = code[at]
    if len(code):  # a word's first bytes see its border, not the word before it
        code[first[:-1]] &= np.uint32(0xFF0000)
        second = first[:-1][size > 1] + 1
        code[second] &= np.uint32(0xFFFF00)
    return w, ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), first


class Model:
    """Log-likelihoods of hashed byte trigrams by language.

    To a document's mixture, a word is at least e**-25 times as likely in any language as in its best, so that no word alone rules one out.
    """

    def __init__(self, langs: list[str], counts: np.ndarray):
        rate = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        rate = (1 - FLOOR) * rate + FLOOR * rate.sum(0) / max(len(langs), 1)
        self.langs, self.log = langs, np.ascontiguousarray(np.log(rate).T.astype(np.float32))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods (words, languages) of a batch's words, the largest of each word being 1, and each text's first word."""
        w, code, first = _grams(texts)
        if not len(w) or not self.langs:
            return np.zeros((len(w), len(self.langs)), np.float32), w.first
        out = np.add.reduceat(self.log[code], first[:-1], axis=0)
        return np.exp(np.maximum(out - out.max(1, keepdims=True), -25)), w.first


def fit(docs: DataFrame, rows: int = 4_000) -> Model:
    """Trigram counts of documents that have a lang: of each language its share of `rows` (rounded up), those whose ids hash lowest; languages in order of name."""
    known = docs.where("doc_id is not null and lang is not null and trim(text) <> ''")
    known = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")).distinct()
    languages_ = max(1, known.select("lang").distinct().count())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= math.ceil(rows / languages_)).select("doc_id", "lang")
    named = corpus(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null")
    sample = named.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")  # some `rows` rows, one more a language at most

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                w, code, first = _grams(part.column("text"))
                owner = np.repeat(w.doc(), np.diff(first))
                lang = part.column("lang").to_pylist()
                for name in set(lang):
                    mine = np.array([x == name for x in lang])[owner]
                    total[name] = total.get(name, 0) + np.bincount(code[mine], minlength=1 << BITS)
        for name in sorted(total):
            code = np.flatnonzero(total[name])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(total[name][code])], ["lang", "code", "n"])

    total: dict[str, np.ndarray] = {}
    # summed before they are gathered: 2**BITS rows a language at most, however many tasks there are
    got = sample.mapInArrow(run, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    name, code, n = (got.column(c).to_numpy() for c in ("lang", "code", "n"))
    for lang in set(name):
        total[lang] = np.zeros(1 << BITS)
        total[lang][code[name == lang]] = n[name == lang]
    langs = sorted(total)
    return Model(langs, np.array([total[x] for x in langs], np.float64).reshape(len(langs), 1 << BITS))


def maximise(p: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int = 60, gap: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Shares by expectation-maximisation, from given ones (0 stays 0), and the log-likelihood of each document.

    Every step is done for all documents that aren't settled; one is when no shares could raise its log-likelihood by
    more than `gap`, which the gradient bounds (the likelihood is concave). Each document has a word.
    """
    share, score = share.copy(), np.zeros(len(share))
    live = np.arange(len(share))
    q, begin = p, first[:-1]
    count = np.diff(first)
    for step in range(steps):
        own = np.repeat(np.arange(len(live)), count[live])
        s = share[live]
        total = np.einsum("ij,ij->i", q, s[own].astype(np.float32))
        gain = np.add.reduceat(q / total[:, None], begin, axis=0).astype(np.float64) / count[live, None]
        score[live] = np.add.reduceat(np.log(total), begin, dtype=np.float64)
        slack = count[live] * (np.where(s > 0, gain, 0).max(1) - 1)
        new = s * gain
        share[live] = new / new.sum(1, keepdims=True)
        go = slack > gap
        if not go.any() or step == steps - 1:
            break
        if go.mean() < 0.7:
            keep = go[own]
            live, q = live[go], q[keep]
            begin = np.concatenate([[0], np.cumsum(count[live])])[:-1]
    return share, score


def infer(p: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Shares (documents, languages) of the language set with the best penalised likelihood.

    A language costs penalty * log(1 + words) / 2. From the set of all, languages go one by one, the least share first, where the
    log-likelihood falls by less than that; each set has its shares maximised anew.
    """
    n, k = len(first) - 1, p.shape[1]
    out = np.zeros((n, k))
    some = np.flatnonzero(np.diff(first))
    if not k or not len(some):
        return out
    size = np.diff(first)[some]
    cost = penalty * np.log1p(size) / 2
    begin = first[some]
    alone = np.add.reduceat(np.log(p), begin, axis=0, dtype=np.float64)
    best = alone.max(1)
    single = np.zeros((len(some), k))
    single[np.arange(len(some)), alone.argmax(1)] = 1
    bounds = np.append(begin, first[-1])
    share, score = maximise(p, bounds, np.full((len(some), k), 1 / k))
    live = np.flatnonzero(score - best >= cost)  # the others are better off with one language
    result = single
    result[live] = share[live]
    for _ in range(k - 1):
        if not len(live):
            break
        changed = np.zeros(len(live), bool)
        s = result[live]
        for rank in range(k - 1):  # the least share first
            order = np.argsort(np.where(s > 0, s, 2), axis=1, kind="stable")
            at = order[:, rank]
            todo = np.flatnonzero(~changed & (s[np.arange(len(live)), at] > 0) & ((s > 0).sum(1) > 1))
            if not len(todo):
                continue
            trial = s[todo].copy()
            trial[np.arange(len(todo)), at[todo]] = 0
            trial = np.maximum(trial, (s[todo] > 0) * 1e-3)
            trial[np.arange(len(todo)), at[todo]] = 0
            trial /= trial.sum(1, keepdims=True)
            rows = live[todo]
            pick = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            sub = np.concatenate([[0], np.cumsum(size[rows])])
            new, value = maximise(p[pick], sub, trial)
            drop = score[rows] - value < cost[rows]
            result[rows[drop]], score[rows[drop]] = new[drop], value[drop]
            changed[todo[drop]] = True
        live = live[changed & ((result[live] > 0).sum(1) > 1)]
    out[some] = result
    return out


def languages(docs: DataFrame, penalty: float = 6.0, rows: int = 4_000) -> DataFrame:
    """(doc_id, language, languages, shares, n_words) for every row of documents that has a doc_id.

    Each language's byte trigrams are counted over a sample of some `rows` documents with a known lang, as many of each language (see fit).
    A word's likelihood under a language is the product of its trigrams' (borders count); a document draws each word's
    language from its own proportions, which expectation-maximisation estimates. The set of languages is the one with the
    best penalised likelihood (see infer). `languages` is the set by descending share, ties by name; `shares` are the
    proportions of words, to four digits; `language` is the first.

    Null and empty texts, texts without a word, and all texts where no document has a lang have an empty set and a null
    language. Repeated rows each have a row. Long texts are read whole. An empty table gives no row. Only doc_id, text and lang are read.
    """
    model = fit(docs, rows)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                p, first = model.words(part.column("text"))
                share = infer(p, first, penalty)
                order = np.argsort(-share, axis=1, kind="stable")
                sizes = (share > 0).sum(1)
                take = np.arange(share.shape[1]) < sizes[:, None]
                off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                names = pa.array([model.langs[i] for i in order[take]], pa.string())
                top = [model.langs[o[0]] if s else None for o, s in zip(order, sizes)] if model.langs else [None] * part.num_rows
                values = pa.array(np.round(np.take_along_axis(share, order, 1)[take], 4), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(top, pa.string()), pa.ListArray.from_arrays(off, names), pa.ListArray.from_arrays(off, values), pa.array(np.diff(first))],
                    ["doc_id", "language", "languages", "shares", "n_words"],
                )

    return corpus(docs).mapInArrow(run, "doc_id bigint, language string, languages array<string>, shares array<double>, n_words bigint")
