"""SimHash near-duplicates through pivot distance tables."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import corpus, settle
from .text import mix, slices, words

BITS = 256
WORDS = [f"f{i}" for i in range(BITS // 64)]
PIVOTS = 8
#: Fingerprints of one side that a task holds at most; more are cut into blocks, and each pair of blocks has tasks of its own.
BLOCK = 1 << 21
#: Pairs compared at once, so that they stay in the cache, and links that are held before they are thinned.
AT_ONCE, HELD = 1 << 17, 1 << 18
#: Copies of a bucket that are known to be connected aren't compared with each other if they are so many.
CROWD = 32


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n, BITS // 64) of texts and their numbers of distinct words: each bit is the majority over the set of words."""
    w = words(texts)
    n = len(w.first) - 1
    key = np.unique((w.doc().astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    doc = (key >> np.uint64(40)).astype(np.int64)
    count = np.bincount(doc, minlength=n)
    out = np.zeros((n, BITS // 8), np.uint8)
    if len(key):
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        rank = np.arange(len(key)) - np.repeat(first, count)
        at = np.flatnonzero(rank % 255 == 0)  # sums of at most 255 words fit the eight byte lanes of a 64-bit value
        owner, have = doc[at], np.flatnonzero(count)
        begin = np.searchsorted(owner, have)
        lanes = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
        feature = key & np.uint64((1 << 40) - 1)
        for part in range(BITS // 64):
            octets = mix(feature, part + 1).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                sums = np.add.reduceat(lanes[octets[:, j]], at).view(np.uint8).reshape(-1, 8).astype(np.int32)
                total = np.add.reduceat(sums, begin, axis=0)
                out[have, part * 8 + j] = np.packbits(2 * total > count[have, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64), count


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0..f3) of each document that has a word."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                f, count = fingerprint(part.column("text"))
                table = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(f[:, i].copy().view(np.int64)) for i in range(len(WORDS)))], ["doc_id", *WORDS]
                )
                yield table.filter(pa.array(count > 0))

    return corpus(docs).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{f} bigint" for f in WORDS))


def ball(bits: int, t: int) -> list[int]:
    """All settings of so many bits with t of them at most."""
    return [sum(1 << i for i in at) for r in range(t + 1) for at in combinations(range(bits), r)]


def pieces(bits: int, distance: int) -> list[tuple[int, int]]:
    """(first bit, t) of disjoint pieces of a fingerprint, of so many bits each.

    Two fingerprints at most `distance` bits apart differ in at most t bits of at least one of the pieces: were it more in each, it
    would be the sum of all t + 1, which is distance + 1. Without bits the only piece is empty, and any two agree in it.
    """
    if not bits:
        return [(0, 0)]
    each, more = divmod(distance + 1, BITS // bits)
    return [(i * bits, each - (i >= more)) for i in range(BITS // bits) if each - (i >= more) >= 0]


def plan(n: int, distance: int) -> int:
    """The bits of a piece by which n fingerprints are compared in least time; whichever it is, no pair is lost."""

    def seconds(bits: int) -> float:
        near = [sum(math.comb(bits, r) for r in range(t + 1)) for _, t in pieces(bits, distance)]
        return sum(6e-9 * n * n / 2 * m / 2**bits + min(n, 2**bits) * (6e-5 + 1e-6 * m) for m in near)

    return min((b for b in range(19) if b == 0 or b >= 6), key=seconds)


class Forest:
    """Links (i, j) among n places, of which only those are kept that connect what wasn't connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.waiting.append(np.stack([i, j]))
            self.held += len(i)
            if self.held > HELD:
                self.thin()

    def thin(self) -> None:
        """After it, root is the same for all that the links so far connect."""
        if not self.held:
            return
        links_ = np.concatenate(self.waiting, axis=1)
        self.waiting, self.held = [], 0
        links_ = links_[:, self.root[links_[0]] != self.root[links_[1]]]
        if not links_.shape[1]:
            return
        ends = np.sort(self.root[links_], axis=0)
        _, one = np.unique(ends[0] * len(self.root) + ends[1], return_index=True)
        nodes, at = np.unique(ends[:, one], return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        keep = []
        for k, (x, y) in enumerate(at.reshape(2, -1).T.tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(k)
        self.kept.append(links_[:, one[keep]])
        to = np.arange(len(self.root))
        to[nodes] = nodes[[find(x) for x in range(len(nodes))]]
        self.root = to[self.root]


def keys(f: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The piece of fingerprints (n, BITS // 64) that begins at a bit."""
    word, shift = divmod(first, 64)
    out = f[:, word] >> np.uint64(shift)
    if shift + bits > 64:
        out = out | (f[:, word + 1] << np.uint64(64 - shift))
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def links(f: np.ndarray, cut: int, first: int, bits: int, t: int, distance: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of fingerprints at most distance bits apart that connect all such pairs which differ in at most t bits of a piece.

    Pairs are those of one of the first `cut` fingerprints and one of the others, or, if those are all, any two. The first of a bucket (those that
    agree in the piece) is its hub, to which those near it are linked at once. So m near copies don't give m**2 pairs: a
    crowd that is known to be connected isn't compared with itself.
    """
    n = len(f)
    whole = cut == n
    forest = Forest(n)
    references = f[:PIVOTS]
    table = np.stack([np.bitwise_count(f ^ p).sum(axis=1) for p in references], axis=1).astype(np.int16)  # the pivot distance table
    key = keys(f, first, bits)
    x_of, y_of = (np.argsort(key, kind="stable"),) * 2 if whole else (np.argsort(key[:cut], kind="stable"), cut + np.argsort(key[cut:], kind="stable"))
    x_begin, y_begin = (np.searchsorted(key[o], np.arange((1 << bits) + 1)) for o in (x_of, y_of))
    far = sorted(range(BITS // 64), key=lambda w: (w == first // 64, w == (first + max(bits, 1) - 1) // 64))  # words without the piece say more
    words_ = [np.ascontiguousarray(f[y_of, w]) for w in far[:2]]

    def near(i, j):
        close = np.abs(table[i] - table[j]).max(axis=1) <= radius
        i, j = i[close], j[close]
        true = (np.bitwise_count(f[i] ^ f[j]).sum(axis=1) <= distance) & (i != j)
        return i[true], j[true]

    def compare(x, y, ywords):
        """Links between places x and places y, whose first words are given."""
        step = max(1, AT_ONCE // max(1, len(y)))
        for lo in range(0, len(x) if len(y) else 0, step):
            mine = f[x[lo : lo + step]]
            d = np.bitwise_count(mine[:, far[0], None] ^ ywords[0])
            d += np.bitwise_count(mine[:, far[1], None] ^ ywords[1])
            hit = np.flatnonzero(d <= distance)
            if len(hit):
                forest.add(*near(x[lo + hit // len(y)], y[hit % len(y)]))

    masks = np.array(ball(bits, t))
    filled = np.flatnonzero(np.diff(x_begin))
    hubs = y_of[np.minimum(y_begin[:-1], len(y_of) - 1)]
    for m in masks:  # hubs of near buckets, and the first of all: those of their own
        if m == 0:
            own = key[x_of]
            has = y_begin[own + 1] > y_begin[own]
            forest.add(*near(x_of[has], hubs[own[has]]))
        else:
            at = filled[y_begin[(filled ^ m) + 1] > y_begin[filled ^ m]]
            forest.add(*near(x_of[x_begin[at]], hubs[at ^ m]))
    if not whole:
        other = x_of[np.minimum(x_begin[:-1], len(x_of) - 1)]
        has = x_begin[key[y_of] + 1] > x_begin[key[y_of]]
        forest.add(*near(other[key[y_of[has]]], y_of[has]))
    forest.thin()
    for v in filled.tolist():
        to = v ^ masks
        if whole:
            to = to[to >= v]
        begin, size = y_begin[to], y_begin[to + 1] - y_begin[to]
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        x, y = x_of[x_begin[v] : x_begin[v + 1]], y_of[at]
        ywords = [w[at] for w in words_]
        if len(x) >= CROWD:
            kind, many = np.unique(forest.root[x], return_counts=True)
            if many.max() >= CROWD:
                crowd = forest.root[x] == kind[many.argmax()]
                others = forest.root[y] != kind[many.argmax()]
                compare(x[crowd], y[others], [w[others] for w in ywords])
                x = x[~crowd]
        compare(x, y, ywords)
    forest.thin()
    i, j = np.concatenate(forest.kept, axis=1) if forest.kept else np.zeros((2, 0), np.int64)
    return i, j


def near_pairs(nodes: DataFrame, n: int, distance: int, radius: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of fingerprints at most distance bits apart, which connect all such pairs; n: how many fingerprints.

    Exact: each pair is compared in the task of a piece in which it must nearly agree (see pieces and links). A task holds all
    fingerprints, or two blocks of them, and gives a forest, so pairs are fewer than fingerprints times pieces times blocks.
    """
    bits = plan(min(n, block), distance)
    parts, count = pieces(bits, distance), max(1, math.ceil(n / block))
    held = [(a, b) for a in range(count) for b in range(a, count)]  # the blocks of a task

    def spread(batches):
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("rep", *WORDS)], axis=1)
            own = mix(rows[:, 0].copy().view(np.uint64), 1) % np.uint64(count)
            for a in np.unique(own).tolist():
                data = rows[own == a].tobytes()
                for k, two in enumerate(held):
                    if a in two:
                        side = int(a != two[0])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k * len(parts) + i for i in range(len(parts))], pa.int32()), pa.array([side] * len(parts), pa.int32()), pa.array([data] * len(parts), pa.binary())],
                            ["task", "side", "data"],
                        )

    def run(batches):
        sides: list[list[bytes]] = [[], []]
        task = None
        for batch in batches:
            for t, side, data in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "data"))):
                task = t
                sides[side].append(data)
        if task is None:
            return
        k, i = divmod(task, len(parts))
        (a, b), (first, t) = held[k], parts[i]
        x, y = (np.frombuffer(b"".join(s), np.int64).reshape(-1, 1 + len(WORDS)) for s in sides)
        x, y = (s[np.lexsort((*s.T, mix(s[:, 0].copy().view(np.uint64))))] for s in (x, y))
        if a != b and not (len(x) and len(y)):
            return
        rows = np.concatenate([x, y])
        i, j = links(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), len(x), first, bits, t, distance, radius)
        a, b = rows[i, 0], rows[j, 0]
        differ = a != b
        a, b = a[differ], b[differ]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    sent = nodes.mapInArrow(spread, "task int, side int, data binary")
    return sent.repartitionById(len(held) * len(parts), "task").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, distance: int = 42, radius: int | None = None) -> DataFrame:
    """(doc_id, kept_doc_id) for every document that goes as a near copy; kept_doc_id is the least id of its group.

    A document's 256-bit SimHash takes the majority of the hashes of its set of words. Two documents are near copies
    where their fingerprints differ in at most `distance` bits; groups are connected components of near copies. Equal
    fingerprints are one node, so thousands of exact copies cost one. No link is lost: pieces of a fingerprint in which two near
    copies must nearly agree give the candidates (see pieces). A table of distances to PIVOTS reference fingerprints
    discards those whose largest coordinate difference exceeds `radius`; survivors are verified by their Hamming
    distance. The default radius, `distance`, discards no true pair (triangle inequality); a lesser one would.

    Null and empty texts and texts without a word have no fingerprint and are no copies of each other. Texts are read whole, however long. Rows without
    doc_id take no part. Repeated rows of one doc_id count once; texts that share a doc_id share its group. Ties don't
    arise: the least doc_id stays. An empty table gives no row. Columns other than doc_id and text are not read.
    """
    f = settle(fingerprints(docs))
    nodes = settle(f.groupBy(*WORDS).agg(F.min("doc_id").alias("rep")).select("rep", *WORDS))
    n = nodes.count()
    if not n:
        return f.select("doc_id", F.col("doc_id").alias("kept_doc_id"))
    pairs = near_pairs(nodes, n, distance, distance if radius is None else radius)
    copies = f.join(nodes, WORDS).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return components(copies.union(pairs)).where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))
