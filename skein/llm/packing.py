"""Packing of documents with their lexical neighbours into windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import corpus, release, settle
from .text import slices, words

BITS = 21
K1, B = 1.2, 0.75
#: Weights are whole multiples of 2**-STEP, so that sums of them are exact in any order.
STEP = 20
#: So many documents, or the last ones of a larger corpus, are packed one seed after another; the others in rounds.
ALONE = 2048
#: In a round one of so many unused documents is a seed at most, and the index returns to it so many neighbours of each class of length at a time.
PART, DEPTH = 32, 8
#: Seeds that begin in one round at most, documents of a block, and tasks beyond which answers are merged by tasks and not by the driver; matters of speed alone.
SEEDS, BLOCK, MERGED = 1024, 2048, 64
#: Documents that are sorted by their commonest terms before they are cut into blocks.
SORTED = 16_384
#: A term's column is dense in a block where that is cheaper than its postings: so many multiplications take the time of one posting.
DENSE = 250
#: Postings that are added up at once.
POSTINGS = 1 << 15


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Numbers as one binary value a row, which the JVM passes on whole; first: of each row, and the end."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first) of packed rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (off - off[0]) // np.dtype(kind).itemsize


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, terms, tfs) of each row that has a word; terms are ascending hashes of BITS bits, both packed."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                n = part.num_rows
                key = (w.doc().astype(np.int64) << BITS) | (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
                key, tf = np.unique(key, return_counts=True)
                first = np.searchsorted(key >> BITS, np.arange(n + 1))
                terms = (key & ((1 << BITS) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(w.counts().astype(np.int64)), packed(terms, first), packed(tf.astype(np.int32), first),
                    ],
                    ["doc_id", "n_words", "terms", "tfs"],
                ).filter(pa.array(w.counts() > 0))

    return corpus(docs).mapInArrow(run, "doc_id bigint, n_words bigint, terms binary, tfs binary")


def document_frequencies(made: DataFrame) -> np.ndarray:
    """How many documents of the corpus hold each hashed term: 2**BITS counts, whatever the corpus; summed before they are gathered."""

    def run(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("terms"))[0], minlength=1 << BITS)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], ["term", "df"])

    got = made.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(1 << BITS, np.int64)
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return df


def weights(terms: np.ndarray, tfs: np.ndarray, length: np.ndarray, idf: np.ndarray, avgdl: float) -> np.ndarray:
    """BM25 of each posting in steps of 2**-STEP; length: of its document."""
    tf = tfs.astype(np.float64)
    return np.rint(idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl)) * (1 << STEP))


class Shard:
    """A BM25 inverted index over some documents, in order of doc_id; weight: of each posting, see weights."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, first: np.ndarray):
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        order = np.argsort(terms, kind="stable")
        t, d, w = terms[order], doc[order], weight[order]
        new = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
        held = np.diff(np.append(np.flatnonzero(new), len(t)))  # documents of the shard that hold the term
        keep = np.repeat(held > 1, held)  # a term of one document finds no other
        d, w = d[keep], w[keep]
        held = held[held > 1]
        common = held > n // 8
        wide = np.repeat(common, held)
        column = np.repeat(np.cumsum(common) - 1, held)
        dense = np.zeros((n, int(common.sum())))
        has = np.zeros(dense.shape)
        dense[d[wide], column[wide]] = w[wide]
        has[d[wide], column[wide]] = 1
        self.n, self.has, self.dense = n, has, dense
        self.doc, self.weight = d[~wide], w[~wide]
        held = held[~common]
        self.begin = np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
        row = np.repeat(np.arange(len(held)), held)
        by = np.argsort(self.doc, kind="stable")
        self.terms, self.first = row[by], np.searchsorted(self.doc[by], np.arange(n + 1))

    def scores(self, i: int) -> np.ndarray:
        """BM25 of each document for the distinct terms of document i."""
        base = self.dense @ self.has[i]
        t = self.terms[self.first[i] : self.first[i + 1]]
        lo, size = self.begin[t], self.begin[t + 1] - self.begin[t]
        ends = np.cumsum(size)
        if not len(ends):
            return base
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
        return base + np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def fill(shard: Shard, length: np.ndarray, window: int) -> list[list[int]]:
    """Windows as lists of documents: each unused document in turn is a seed, and its best unused neighbours that fit follow."""
    unused = np.ones(shard.n, bool)
    out = []
    for seed in range(shard.n):
        if not unused[seed]:
            continue
        unused[seed] = False
        window_, left = [seed], window - int(length[seed])
        fits = np.flatnonzero(unused & (length <= left))
        if len(fits):
            s = shard.scores(seed)[fits]
            fits, s = fits[s > 0], s[s > 0]
            fits = fits[np.argsort(-s, kind="stable")]  # ties: the least doc_id first
            while len(fits):
                at = int(fits[0])
                unused[at] = False
                window_.append(at)
                left -= int(length[at])
                fits = fits[1:]
                fits = fits[length[fits] <= left]
        out.append(window_)
    return out


def kinds(rest: np.ndarray) -> np.ndarray:
    """The class of a length: the number of its bits."""
    return np.frexp(rest.astype(np.float64))[1]


def blocked(number, rest, first, terms, weight, idf):
    """Blocks (number, rest, doc, term, weight) of about BLOCK documents that share their commonest terms, postings in order of term.

    Which documents make up a block is a matter of speed alone. Within one they are in order of class of length and number.
    """
    size = np.diff(first)
    owner = np.repeat(np.arange(len(number)), size)
    order = np.lexsort((idf[terms], owner))
    top = np.full((len(number), 3), -1, np.int64)
    for i in range(3):
        has = np.flatnonzero(size > i)
        top[has, i] = terms[order[first[has] + i]]
    by = np.lexsort((number, top[:, 2], top[:, 1], top[:, 0]))
    for at in range(0, len(by), BLOCK):
        mine = by[at : at + BLOCK]
        mine = mine[np.lexsort((number[mine], kinds(rest[mine])))]
        n = size[mine]
        x = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.repeat(np.arange(len(mine)), n)
        o = np.argsort(terms[x], kind="stable")
        yield number[mine], rest[mine], doc[o], terms[x][o], weight[x][o]


class Block:
    """Postings of a block's documents, in order of term, made ready for any number of seeds; terms number the columns of held, how many of the postings each has."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, vocabulary: int):
        self.n, self.doc, self.weight = n_docs, doc, weight
        self.held = np.bincount(term, minlength=vocabulary)
        self.begin = np.concatenate([[0], np.cumsum(self.held)])
        self.common = np.flatnonzero(self.held > n_docs // 24)  # no other column can be worth it
        self.place = np.full(vocabulary, -1, np.int64)
        self.place[self.common] = np.arange(len(self.common))
        column = self.place[term]
        wide = np.flatnonzero(column >= 0)
        self.dense = np.zeros((len(self.common), n_docs))
        self.dense[column[wide], doc[wide]] = weight[wide]

    def scores(self, groups) -> np.ndarray:
        """BM25 (seeds, documents) of the block for groups of consecutive seeds.

        A group (count, owner, term) has the pairs of a seed's place in its group and a term it holds, by place.
        """
        out = np.zeros((sum(c for c, _, _ in groups), self.n))
        at = 0
        for count, owner, asked in groups:
            mine = out[at : at + count]
            at += count
            some = np.flatnonzero(self.held[asked])
            owner, asked = owner[some], asked[some]
            col = self.place[asked]
            asks = np.bincount(col + 1, minlength=len(self.common) + 1)[1:]
            worth = np.flatnonzero(asks * self.held[self.common] * DENSE > count * self.n)
            if len(worth):
                own = np.full(len(self.common) + 1, -1, np.int64)
                own[worth] = np.arange(len(worth))
                col = own[col]  # -1 stays -1
                asks = col >= 0
                has = np.zeros((count, len(worth)))
                has[owner[asks], col[asks]] = 1
                np.matmul(has, self.dense[worth], out=mine)
                owner, asked = owner[~asks], asked[~asks]
            begin, many = self.begin[asked], self.held[asked]
            ends = np.cumsum(many)
            lo = 0
            while lo < len(many):  # so many postings at once that what is made of them stays in the cache
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POSTINGS, "right")))
                n, top = many[lo:hi], int(owner[lo])
                x = np.repeat(begin[lo:hi] - (ends[lo:hi] - n - (ends[lo] - n[0])), n)
                x += np.arange(len(x))
                to = np.repeat((owner[lo:hi] - top) * self.n, n)
                to += self.doc[x]
                rows = mine[top : int(owner[hi - 1]) + 1]
                rows += np.bincount(to, self.weight[x], minlength=rows.size).reshape(rows.shape)
                lo = hi
        return out


class Best:
    """For each seed and class of length, the `depth` documents of highest score above 0 seen so far, ties by number."""

    def __init__(self, seeds: int, depth: int):
        self.depth, self.held = depth, 0
        self.least = np.ones((seeds, 64))  # what a score must reach
        self.parts: list[tuple[np.ndarray, ...]] = []

    def see(self, score: np.ndarray, number: np.ndarray, kind: np.ndarray) -> None:
        """Scores (seeds, documents) of documents in order of class; those that can't follow the seed are 0."""
        edges = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            c = int(kind[lo])
            s, need = score[:, lo:hi], self.least[:, c]
            many = np.flatnonzero((s >= need[:, None]).sum(1) > 2 * self.depth)
            if len(many):  # what none of the depth best of this block reaches, the best of all don't
                need[many] = np.partition(s[many], hi - lo - self.depth, axis=1)[:, hi - lo - self.depth]
            i, j = np.nonzero(s >= need[:, None])
            self.parts.append((i * 64 + c, s[i, j], number[lo + j]))
            self.held += len(i)
        if self.held > 400_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        key, score, number = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((number, -score, key))
        key, score, number = key[order], score[order], number[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        last = np.flatnonzero(rank == self.depth - 1)
        self.least.reshape(-1)[key[last]] = score[last]
        keep = rank < self.depth
        self.parts = [(key[keep], score[keep], number[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def ask(index: DataFrame | pa.RecordBatch, unused: np.ndarray, seeds: np.ndarray, left: np.ndarray, asked: list[np.ndarray], idf: np.ndarray) -> list[np.ndarray]:
    """(seed, number, score, kind) of the unused documents that can follow the seeds (numbers with room for left words and their terms).

    By seed, descending score and number: of each class of length the DEPTH best that score above 0. index: blocks, or one block that the driver holds.
    """
    bits, total, depth = np.packbits(unused), len(unused), DEPTH
    commonest = np.array([t[np.argmin(idf[t])] if len(t) else -1 for t in asked])
    by = np.lexsort((seeds, commonest, kinds(left)))  # seeds of one room and language beside each other
    vocabulary = np.unique(np.concatenate(asked))
    parts = []
    for at in range(0, len(by), 512):
        groups = []
        for lo in range(at, min(at + 512, len(by)), 256):
            mine = by[lo : min(lo + 256, at + 512)]
            groups.append((np.array([len(asked[i]) for i in mine]), np.searchsorted(vocabulary, np.concatenate([asked[i] for i in mine])).astype(np.int32)))
        parts.append((seeds[by[at : at + 512]], left[by[at : at + 512]], groups))

    def run(batches):
        free = np.unpackbits(bits, count=total).astype(bool)
        column = np.full(1 << BITS, -1, np.int32)
        column[vocabulary] = np.arange(len(vocabulary))
        best = [Best(len(after), depth) for after, _, _ in parts]
        wide = [(after, room, [(len(size), np.repeat(np.arange(len(size)), size), terms) for size, terms in groups]) for after, room, groups in parts]
        first, widest = min(after.min() for after, _, _ in parts), max(room.max() for _, room, _ in parts)
        for batch in batches:
            for row in range(batch.num_rows):
                number, rest, doc, term, weight = _columns(batch, row)
                live = free[number] & (number > first) & (rest <= widest)
                term = column[term]
                hit = (term >= 0) & live[doc]
                number, rest, doc, term, weight = _kept(number, rest, doc[hit], term[hit], weight[hit].astype(np.float64), live)
                block = None
                for (after, room, groups), found in sorted(zip(wide, best), key=lambda x: -x[0][1].max()):
                    fits = rest <= room.max()
                    if not fits.all():
                        hit = fits[doc]
                        number, rest, doc, term, weight = _kept(number, rest, doc[hit], term[hit], weight[hit], fits)
                        block = None
                    if not len(number):
                        break
                    block = block or Block(len(number), doc, term, weight, len(vocabulary))
                    s = block.scores(groups)
                    if number.min() <= after.max():
                        s[number[None, :] <= after[:, None]] = 0
                    if rest.max() > room.min():
                        s[rest[None, :] > room[:, None]] = 0
                    found.see(s, number, kinds(rest))
        for k, found in enumerate(best):
            key, score, number = found.merge()
            yield pa.RecordBatch.from_arrays([pa.array(by[k * 512 + key // 64], pa.int32()), pa.array(number, pa.int64()), pa.array(score.astype(np.int64)), pa.array(key % 64, pa.int32())], ["seed", "number", "score", "kind"])

    def merge(batches):
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best_of(pa.Table.from_batches(held), depth)], held[0].schema.names)

    if isinstance(index, pa.RecordBatch):
        return best_of(pa.Table.from_batches(list(run([index]))), depth)
    tasks = 2 * index.sparkSession.sparkContext.defaultParallelism  # each merges the answers of its blocks
    kinds_ = "seed int, number bigint, score bigint, kind int"
    answers = index.coalesce(tasks).mapInArrow(run, kinds_)
    if tasks > MERGED:
        answers = answers.repartition(max(1, tasks // 8), "seed").mapInArrow(merge, kinds_)
    return best_of(answers.toArrow(), depth)


def best_of(answers: pa.Table, depth: int) -> list[np.ndarray]:
    """(seed, number, score, kind) of the depth best answers for each seed and class, by seed, descending score and number."""
    seed, number, score, kind = (answers.column(c).to_numpy() for c in ("seed", "number", "score", "kind"))
    key = seed.astype(np.int64) * 64 + kind
    order = np.lexsort((number, -score, key))
    key = key[order]
    order = order[np.arange(len(key)) - np.searchsorted(key, key) < depth]
    order = order[np.lexsort((number[order], -score[order], seed[order]))]
    return [x[order] for x in (seed, number, score, kind)]


def follow(members: list[int], room: int, unused: np.ndarray, rest: np.ndarray, number: np.ndarray, kind: np.ndarray) -> tuple[int, bool]:
    """Adds to the members what follows by descending score; returns the room left, and whether the window is done.

    number, kind: the answer for its seed. A class with DEPTH answers may have more, all of which come after its last. So as soon as the last
    of a class has passed of which more can fit, the next best isn't certain, and the window must ask again.
    """
    count: dict[int, int] = {}
    passed = 1 << 62  # the least length of a class that may have more
    for n, c in zip(number.tolist(), kind.tolist()):
        if passed <= room:
            return room, False
        size = int(rest[n])
        if size <= room and unused[n]:
            members.append(n)
            unused[n] = False
            room -= size
        count[c] = count.get(c, 0) + 1
        if count[c] == DEPTH:
            passed = min(passed, 1 << (c - 1))
    return room, passed > room


def rounds(placed: DataFrame, index: DataFrame, ids: np.ndarray, rest: np.ndarray, idf: np.ndarray, window: int) -> list[list[int]]:
    """The windows of a corpus, as lists of numbers; rest are the lengths by number, ids their ids in placed. See pack."""
    unused = rest > 0
    out: list[list[int]] = []
    open_: list[tuple[list[int], int, np.ndarray]] = []  # members, room and terms of the seed, by ascending seed
    held, alive = index, int(unused.sum())
    rows = alive
    while alive > ALONE or open_:
        seeds = np.flatnonzero(unused)[: min(SEEDS, math.ceil(alive / PART)) if alive > ALONE else 0]
        terms = terms_of(placed, ids, seeds)[0] if len(seeds) else []
        asking = open_ + [([s], window - int(rest[s]), t) for s, t in zip(seeds.tolist(), terms)]
        seed, number, _, kind = ask(held, unused, np.array([m[0] for m, _, _ in asking]), np.array([room for _, room, _ in asking]), [t for _, _, t in asking], idf)
        begin = np.searchsorted(seed, np.arange(len(asking) + 1))
        was, open_ = len(open_), []
        for k, (members, room, t) in enumerate(asking):
            if k >= was:
                if not unused[members[0]]:
                    continue
                unused[members[0]] = False
            room, done = follow(members, room, unused, rest, number[begin[k] : begin[k + 1]], kind[begin[k] : begin[k + 1]])
            if done:
                out.append(members)
            else:
                open_.append((members, room, t))
        alive = int(unused.sum())
        if 0 < alive <= ALONE and open_ and not isinstance(held, pa.RecordBatch):  # few are left to ask for: no more passes
            held, old = _one(_only(held, np.packbits(unused), len(unused)).toArrow()), held
            if old is not index:
                release(old)
        elif 0 < alive < 0.6 * rows and not isinstance(held, pa.RecordBatch):
            held, old, rows = settle(_only(held, np.packbits(unused), len(unused))), held, alive
            if old is not index:
                release(old)
    if held is not index and not isinstance(held, pa.RecordBatch):
        release(held)
    numbers = np.flatnonzero(unused)
    if len(numbers):
        terms, weight = terms_of(placed, ids, numbers)
        shard = Shard(np.concatenate(terms), np.concatenate(weight), np.concatenate([[0], np.cumsum([len(t) for t in terms])]))
        out += [numbers[members].tolist() for members in fill(shard, rest[numbers], window)]
    return out


def terms_of(placed: DataFrame, ids: np.ndarray, numbers: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Terms and weights of some documents, at most ALONE or SEEDS of them, in the order of their numbers given."""
    wanted = ids[numbers]
    listed = ", ".join(map(str, wanted.tolist()))
    got = placed.where(f"id in ({listed})").select("id", "terms", "weights").toArrow()
    order = np.argsort(got.column("id").to_numpy())
    place = order[np.searchsorted(got.column("id").to_numpy(), wanted, sorter=order)]
    out = []
    for c in ("terms", "weights"):
        flat, off = unpacked(got.column(c))
        out.append([flat[off[i] : off[i + 1]] for i in place])
    return out[0], out[1]


def _only(index: DataFrame, bits: np.ndarray, total: int) -> DataFrame:
    """The blocks without the documents whose bit is 0."""

    def run(batches):
        free = np.unpackbits(bits, count=total).astype(bool)
        for batch in batches:
            for row in range(batch.num_rows):
                number, rest, doc, term, weight = _columns(batch, row)
                live = free[number]
                if live.any():
                    hit, place = live[doc], np.cumsum(live) - 1
                    yield _row(number[live], rest[live], place[doc[hit]], term[hit], weight[hit])

    return index.mapInArrow(run, index.schema)


def _one(blocks: pa.Table) -> pa.RecordBatch:
    """All blocks as one, in the order that blocked gives; for ALONE documents at most."""
    parts = [_columns(batch, row) for batch in blocks.to_batches() for row in range(batch.num_rows)]
    number, rest, doc, term, weight = (np.concatenate(x) for x in zip(*parts))
    sizes = [len(x[0]) for x in parts]
    doc = doc + np.repeat(np.cumsum(sizes) - sizes, [len(x[2]) for x in parts])
    order, by = np.lexsort((number, kinds(rest))), np.argsort(term, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return _row(number[order], rest[order], place[doc[by]], term[by], weight[by])


BLOCKED = {"number": np.int64, "rest": np.int64, "doc": np.uint16, "term": np.int32, "weight": np.int32}


def _kept(number, rest, doc, term, weight, live) -> tuple[np.ndarray, ...]:
    """A block without the documents that aren't live; the postings given are of live ones."""
    return number[live], rest[live], (np.cumsum(live) - 1)[doc], term, weight


def _row(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([packed(c.astype(t), np.array([0, len(c)])) for c, t in zip(columns, BLOCKED.values())], list(BLOCKED))


def _columns(batch: pa.RecordBatch, row: int) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in BLOCKED.items()]


def whole(made: DataFrame, idf: np.ndarray, avgdl: float, window: int) -> DataFrame:
    """The windows over the whole corpus, in rounds; made as features gives it."""

    def weigh(batches):
        for batch in batches:
            count, (terms, first) = batch.column("n_words").to_numpy(), unpacked(batch.column("terms"))
            w = weights(terms, unpacked(batch.column("tfs"))[0], np.repeat(count, np.diff(first)), idf, avgdl)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "terms")), packed(w.astype(np.int32), first)], ["doc_id", "n_words", "terms", "weights"])

    weighed = made.mapInArrow(weigh, "doc_id bigint, n_words bigint, terms binary, weights binary")
    placed = settle(weighed.orderBy("doc_id", "n_words", "terms", "weights").withColumn("id", F.monotonically_increasing_id()))
    release(made)
    got = placed.select("id", "n_words").toArrow()
    order = np.argsort(got.column("id").to_numpy())
    ids, count = got.column("id").to_numpy()[order], got.column("n_words").to_numpy()[order]

    def cut(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED:
                yield from blocks(held)
                held = []
        if held:
            yield from blocks(held)

    def blocks(held):
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table.column("n_words").to_numpy() % window
        (terms, first), (weight, _) = (unpacked(table.column(c)) for c in ("terms", "weights"))
        keep = np.flatnonzero(lengths > 0)  # whole windows take no part
        size = np.diff(first)[keep]
        x = np.repeat(first[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        number = table.column("number").to_numpy()[keep]
        for made_ in blocked(number, lengths[keep], np.concatenate([[0], np.cumsum(size)]), terms[x], weight[x], idf):
            yield _row(*made_)

    part = F.shiftright("id", 33)
    begins = {}
    for at in np.flatnonzero(np.concatenate([[True], (ids[1:] >> 33) != (ids[:-1] >> 33)])) if len(ids) else []:
        begins[int(ids[at] >> 33)] = int(at)
    first_ = F.create_map(*(F.lit(x) for pair in begins.items() for x in pair))
    number = (first_[part.cast("int")] + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint").alias("number")
    kinds_ = ", ".join(f"{c} binary" for c in BLOCKED)
    index = settle(placed.select(number, "n_words", "terms", "weights").mapInArrow(cut, kinds_))
    full = np.cumsum(count // window) - count // window
    win, place = np.zeros(len(count), np.int64), np.zeros(len(count), np.int32)
    for k, members in enumerate(rounds(placed, index, ids, count % window, idf, window), int((count // window).sum())):
        win[members], place[members] = k, np.arange(len(members))
    release(index)
    where = None
    for k in range(0, len(count), 500_000):
        s = slice(k, k + 500_000)
        some = pa.table({"id": pa.array(ids[s]), "full": pa.array(full[s]), "win": pa.array(win[s]), "place": pa.array(place[s])})
        some = settle(made.sparkSession.createDataFrame(some))
        where = some if where is None else where.union(some)
    rest = F.col("n_words") % window
    piece = lambda w, p, s, n: F.struct(F.concat(F.lit("0-"), w.cast("string")).alias("window_id"), p.cast("int").alias("place"), F.col("doc_id"), s.cast("bigint").alias("start_word"), n.cast("bigint").alias("n_words"))
    fulls = F.when(F.col("n_words") >= window, F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_words") / window) - 1)).otherwise(F.array().cast("array<bigint>"))
    pieces = F.concat(
        F.transform(fulls, lambda p: piece(F.col("full") + p, F.lit(0), p * window, F.lit(window))),
        F.when(rest > 0, F.array(piece(F.col("win"), F.col("place"), F.col("n_words") - rest, rest))).otherwise(F.array().cast("array<struct<window_id:string,place:int,doc_id:bigint,start_word:bigint,n_words:bigint>>")),
    )
    return placed.select("id", "doc_id", "n_words").join(where, "id").select(F.explode(pieces).alias("x")).select("x.*")


def pack(docs: DataFrame, window: int = 2048, shard_docs: int | None = None) -> DataFrame:
    """(window_id, place, doc_id, start_word, n_words): which words of which document stand where in which window.

    A window holds `window` words. The documents are numbered by ascending doc_id. In a round, the first unused ones are
    seeds of new windows, one PARTth of the unused and SEEDS at most. They and the windows still open, by ascending seed, ask the whole index for their unused
    neighbours: of each class of length (the number of its bits), the DEPTH documents that come after the seed, fit what room is left and have the
    highest BM25 (k1 1.2, b 0.75) for its distinct words, above 0; ties by number. Then the windows in turn take those that are still
    unused by descending score as long as they fit. Where a document beyond the DEPTH of a class could be the next, the window
    stays open and asks again in the next round, of what is unused then. So a window takes the best of all unused documents at every step, and is done
    only when none of them that scores above 0 fits. The last ALONE documents, and a corpus of no more, are packed one seed
    after another, from all of their neighbours. Every pair of a seed and an unused document is scored, so the work is
    quadratic. Only if `shard_docs` is given are the documents spread by the hash of their doc_id over shards of about so
    many that don't see each other, each packed one seed after another. Every word of every document is in one window. A document of `window` words and more fills windows of
    its own; what is left over takes part like a document, scored by the whole document. window_id is
    '<shard>-<number>'; it is stable for the same rows.

    Terms are hashed to 21 bits, so their document frequencies are 2**21 numbers at most for any corpus; terms of one hash
    count as one. Weights are rounded to steps of 2**-20, so scores are exact sums. Null and empty texts and texts without a
    word have no row, nor have rows without doc_id. Texts are read whole, however long. Repeated rows are documents of their own; equal ids are ordered by
    length, terms and weights. An empty table gives no row. Columns other than doc_id and text are not read.
    """
    made = settle(features(docs))
    n, total = made.agg(F.count("*"), F.sum("n_words")).first()
    shards, avgdl = max(1, math.ceil(n / shard_docs)) if shard_docs else 1, (total or 1) / max(n, 1)
    df = document_frequencies(made)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    if not shard_docs and n > ALONE:
        return whole(made, idf, avgdl, window)

    def run(table):
        ids, shard = table.column("doc_id").to_numpy(), table.column("shard")[0].as_py()
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        count = table.column("n_words").to_numpy()
        (all_terms, first), (all_tfs, _) = unpacked(terms), unpacked(tfs)
        order = np.lexsort((count, ids))
        same = np.flatnonzero((np.diff(ids[order]) == 0) & (np.diff(count[order]) == 0))
        if len(same):  # repeated rows: order by their terms as well
            order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], count[i], terms[i].as_py(), tfs[i].as_py())))
        size = np.diff(first)[order]
        at = np.repeat(first[:-1][order] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids, count = ids[order], count[order]
        rest = count % window
        part = np.flatnonzero(rest)
        t = all_terms[at]
        w = weights(t, all_tfs[at], np.repeat(count, size), idf, avgdl)
        keep = np.repeat(rest > 0, size)
        index = Shard(t[keep], w[keep], np.concatenate([[0], np.cumsum(size[part])]))
        windows = [[(int(ids[i]), p * window, window)] for i in np.flatnonzero(count >= window) for p in range(count[i] // window)]
        for members in fill(index, rest[part], window):
            windows.append([(int(ids[i]), int(count[i] - rest[i]), int(rest[i])) for i in part[members]])
        rows = [(f"{shard}-{k}", place, *x) for k, members in enumerate(windows) for place, x in enumerate(members)]
        columns = list(zip(*rows))
        kinds_ = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds_)], ["window_id", "place", "doc_id", "start_word", "n_words"])

    return (
        made.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(run, "window_id string, place int, doc_id bigint, start_word bigint, n_words bigint")
    )
