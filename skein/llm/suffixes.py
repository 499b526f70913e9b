"""Substring dedup by a hash-compared suffix sort."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import GRAM, marks, spans
from .store import corpus, settle
from .text import Words, _classify, buffer, gram_hash, gram_sums, grams, signed, slide, slices, winnow, words

#: Places of one gram up to which all of them are sorted together; slots in which its suffixes are counted if there are more.
HOT, SLOTS = 1 << 13, 1 << 25


def _normal(raw: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The folded words with one blank after each, and where each begins there."""
    _, b = _classify(raw)
    size = w.end - w.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(begin[-1]) + np.repeat(w.start - begin[:-1], size + 1)
    out = b[np.minimum(at, len(b) - 1)] if len(b) else np.zeros(0, np.uint8)
    out[begin[1:] - 1] = 32
    return out, begin


def _strings(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    size = hi - lo
    off = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(off[-1]) + np.repeat(lo - off[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(flat))


def stretches(texts: DataFrame, marked: DataFrame, least: int) -> DataFrame:
    """(h, doc_id, at, s, words): consecutive suffixes of a document whose first `least` words have the same least gram.

    h is the hash of that gram and `at` its place; the suffixes start from word s on, and `words` reaches from there to
    the end of the last one's first `least` words. Suffixes that agree in `least` words have equal h and distance to it,
    so the suffixes of one h can be sorted apart from all others. Only grams that the corpus holds twice are returned.
    """
    k = min(GRAM, max(1, least // 2))
    window = least - k + 1

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w, (raw, _) = words(part.column("text")), buffer(part.column("text"))
                n = len(w)
                kept, _ = winnow(w, k, window)
                if not len(kept):
                    continue
                h, _ = grams(w, k)
                low = slide(h[: n - k + 1], window, np.minimum)
                s = np.flatnonzero(np.arange(len(low)) + least <= np.repeat(w.first[1:], w.counts())[: len(low)])
                j = np.searchsorted(kept, s)
                todo = np.arange(len(s))
                while len(todo):  # the first of the kept grams that is the least of the window
                    todo = todo[h[kept[j[todo]]] != low[s[todo]]]
                    j[todo] += 1
                p = kept[j]
                places = part.column("at")
                shared = np.zeros(n, bool)
                for i in range(part.num_rows):
                    mine = places[i].values.to_numpy() + w.first[i]
                    shared[mine[mine < w.first[i + 1]]] = True
                s, p = s[shared[p]], p[shared[p]]
                if not len(s):
                    continue
                new = np.concatenate([[True], p[1:] != p[:-1]])
                lo = np.flatnonzero(new)
                a, z, p = s[lo], s[np.append(lo[1:], len(s)) - 1], p[lo]
                data, begin = _normal(raw, w)
                doc = w.doc()[a]
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(h[p]), part.column("doc_id").take(pa.array(doc)), pa.array((p - w.first[doc]).astype(np.int32)),
                        pa.array((a - w.first[doc]).astype(np.int32)), _strings(data, begin[a], begin[z + least] - 1).cast(pa.string()),
                    ],
                    ["h", "doc_id", "at", "s", "words"],
                )

    return texts.join(marked, "doc_id").mapInArrow(run, "h bigint, doc_id bigint, at int, s int, words string")


class Suffixes:
    """Suffixes of a word sequence, compared in their first `least` words by prefix polynomial hashes."""

    def __init__(self, hashes: np.ndarray, least: int):
        self.word, self.sums, self.least = hashes, gram_sums(hashes), least
        self.whole = gram_hash(self.sums, np.arange(max(0, len(hashes) - least + 1)), least)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, `least` at most, by binary search over equal hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.least)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = gram_hash(self.sums, x, mid) == gram_hash(self.sums, y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the order of the first words in which they differ, 0 if none of the first `least` does."""
        out = np.zeros(len(x), np.int8)
        at = np.flatnonzero(self.whole[x] != self.whole[y])
        a, b = x[at], y[at]
        n = np.minimum(self.common(a, b), self.least - 1)
        out[at] = np.where(self.word[a + n] < self.word[b + n], -1, 1)
        return out

    def sort(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """x with each of its groups, which begin at `first`, sorted: a stable bottom-up mergesort, all merges of a width at once."""
        size = np.diff(np.append(first, len(x)))
        same = np.concatenate([[True], self.whole[x][1:] == self.whole[x][:-1]])
        same[first] = True
        mixed = np.flatnonzero(~np.logical_and.reduceat(same, first)) if len(first) else first
        x, width = x.copy(), 1
        while len(mixed := mixed[size[mixed] > width]):
            begin = np.repeat(first[mixed], size[mixed])
            local = np.arange(len(begin)) - np.repeat(np.cumsum(size[mixed]) - size[mixed], size[mixed])
            n, run = np.repeat(size[mixed], size[mixed]), local // width
            right = run % 2 == 1
            lo = np.minimum((run ^ 1) * width, n)
            base, hi = lo.copy(), np.minimum(lo + width, n)
            own = x[begin + local]
            act = np.flatnonzero(lo < hi)
            while len(act):
                mid = (lo[act] + hi[act]) // 2
                c = self.compare(x[begin[act] + mid], own[act])
                before = (c < 0) | ((c == 0) & right[act])
                lo[act] = np.where(before, mid + 1, lo[act])
                hi[act] = np.where(before, hi[act], mid)
                act = act[lo[act] < hi[act]]
            x[begin + (run // 2) * 2 * width + local % width + lo - base] = own
            width *= 2
        return x


def _classes(sorted_x: np.ndarray, new: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and class numbers of sorted suffixes; classes of equal hash are split where their words themselves differ."""
    label = np.cumsum(new) - 1
    twin = np.flatnonzero(~new)
    differ = np.zeros(len(twin), bool)
    for i in range(least):
        differ |= ids[sorted_x[twin] + i] != ids[sorted_x[twin - 1] + i]
    order = np.arange(len(sorted_x))
    if differ.any():
        key = label.astype(np.int64) * (len(label) + 1)
        for c in np.unique(label[twin[differ]]):
            seen: dict[bytes, int] = {}
            for at in np.flatnonzero(label == c):
                key[at] += seen.setdefault(ids[sorted_x[at] : sorted_x[at] + least].tobytes(), len(seen))
        order = np.argsort(key, kind="stable")
        label = np.unique(key[order], return_inverse=True)[1]
    return order, label


def _places(table, least: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w, row, x, start, order): the words of some stretches; of each suffix its stretch, first word there and in the document; and each place once, by gram, distance to it, document and start."""
    w = words(table.column("words"))
    h, doc, at, s = (table.column(c).to_numpy() for c in ("h", "doc_id", "at", "s"))
    n = np.maximum(w.counts() - least + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    x, start = w.first[row] + step, s[row] + step
    order = np.lexsort((start, doc[row], at[row] - start, h[row]))
    # the same place twice, from repeated rows, is one place
    key = np.stack([h[row], doc[row], start])[:, order]
    order = order[np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])] if len(order) else order
    return w, row, x, start, order


def _runs(doc: np.ndarray, row: np.ndarray, start: np.ndarray, head: np.ndarray, least: int) -> pa.RecordBatch:
    """(doc_id, s, e, is_first) of repeated suffixes by stretch and start: those that follow one another are one run."""
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (head[1:] != head[:-1])]) if len(row) else np.zeros(0, bool)
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(row)) - 1 if len(lo) else lo
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[lo], pa.int64()), pa.array(start[lo], pa.int32()), pa.array(start[hi] + least, pa.int32()), pa.array(head[lo], pa.bool_())], ["doc_id", "s", "e", "is_first"]
    )


def pieces(table: pa.Table, least: int) -> pa.RecordBatch:
    """Repeated runs (doc_id, s, e, is_first) among the stretches of some grams, all places of which are in the table."""
    table = table.combine_chunks()
    w, row, x, start, order = _places(table, least)
    (raw, _), doc = buffer(table.column("words")), table.column("doc_id").to_numpy()
    ids = _strings(raw, w.start, w.end).dictionary_encode().indices.to_numpy()
    h, at = (table.column(c).to_numpy() for c in ("h", "at"))
    group = np.stack([h[row], at[row] - start])[:, order]
    first = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)])) if len(order) else order
    suffixes = Suffixes(w.hash, least)
    where = np.full(len(w) + 1, -1)
    where[x] = np.arange(len(x))
    y = suffixes.sort(x[order], first)
    new = np.concatenate([[True], suffixes.whole[y][1:] != suffixes.whole[y][:-1]]) if len(y) else np.zeros(0, bool)
    new[first] = True
    by, label = _classes(y, new, ids, least)
    found = where[y[by]]
    head = np.concatenate([[True], label[1:] != label[:-1]]) if len(label) else np.zeros(0, bool)
    many = np.bincount(label)[label] > 1 if len(label) else head
    found, head = found[many], head[many]
    o = np.argsort(found, kind="stable")  # by stretch and start
    found, head = found[o], head[o]
    return _runs(doc[row[found]], row[found], start[found], head, least)


class Many:
    """The stretches of one gram that has more than HOT places, which come by document: kept in a file of the task's machine.

    Three passes hold some thousand places each. The first counts suffixes by the hash of their words, so that most of
    those without an equal are left out; the second gives the others classes by a 128-bit digest of their words and finds
    the least place of each class; the third makes the runs. In memory are the counts and, by class, a digest and a place.
    """

    def __init__(self, least: int):
        self.least, self.dir, self.rest = least, tempfile.TemporaryDirectory(), []
        self.path, self.writer = f"{self.dir.name}/places", None

    def add(self, batch: pa.RecordBatch, end: bool = False) -> None:
        """Keep a batch; what is written at once ends with a document."""
        doc = batch.column("doc_id").to_numpy()
        self.rest.append(batch)
        at = batch.num_rows if end else int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
        if not end and not at:
            if not len(doc) or self.rest[0].column("doc_id")[0].as_py() == doc[-1]:
                return
        self.rest[-1] = batch.slice(0, at)
        table = pa.Table.from_batches(self.rest).combine_chunks()
        self.writer = self.writer or pa.ipc.new_stream(self.path, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
        for b in table.to_batches():
            self.writer.write_batch(b)
        self.rest = [batch.slice(at)]

    def _chunks(self):
        with pa.OSFile(self.path) as file, pa.ipc.open_stream(file) as reader:
            for batch in reader:
                w, row, x, start, order = _places(batch, self.least)
                order = np.sort(order)  # by stretch and start
                x = x[order]
                yield batch, w, row[order], x, start[order], Suffixes(w.hash, self.least).whole[x]

    def pieces(self):
        self.writer.close()
        count, mask = np.zeros(SLOTS, np.uint8), np.uint64(SLOTS - 1)
        for *_, whole in self._chunks():
            slot, n = np.unique(whole & mask, return_counts=True)
            count[slot] = np.minimum(2, count[slot] + np.minimum(2, n))
        known: dict[bytes, int] = {}
        size, doc_of, start_of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunks = 0
        with open(f"{self.dir.name}/classes", "wb") as file:
            for batch, w, row, x, start, whole in self._chunks():
                twice = count[whole & mask] > 1
                row, x, start = row[twice], x[twice], start[twice]
                text, doc = batch.column("words"), batch.column("doc_id").to_numpy()[row]
                raw, code = buffer(text)[0], text.dictionary_encode().indices.to_numpy().astype(np.int64)
                _, one, same = np.unique((code[row] << 32) | (x - w.first[row]), return_index=True, return_inverse=True)  # equal stretches are looked at once
                name = [hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(w.start[x[one]], w.end[x[one] + self.least - 1])]
                label = np.fromiter((known.setdefault(d, len(known)) for d in name), np.int64, len(name))[same]
                more = len(known) - len(size)
                size, start_of = (np.append(v, np.zeros(more, np.int64)) for v in (size, start_of))
                doc_of = np.append(doc_of, np.full(more, np.iinfo(np.int64).max))
                o = np.lexsort((start, doc, label))
                o = o[np.concatenate([[True], label[o][1:] != label[o][:-1]])] if len(o) else o
                c, d, t = label[o], doc[o], start[o].astype(np.int64)
                less = (size[c] == 0) | (d < doc_of[c]) | ((d == doc_of[c]) & (t < start_of[c]))
                doc_of[c[less]], start_of[c[less]] = d[less], t[less]
                size += np.bincount(label, minlength=len(size))
                for v in (doc, row, start, label):
                    np.save(file, v)
                chunks += 1
        known.clear()
        with open(f"{self.dir.name}/classes", "rb") as file:
            for _ in range(chunks):
                doc, row, start, label = (np.load(file) for _ in range(4))
                many = size[label] > 1
                doc, row, start, label = doc[many], row[many], start[many], label[many]
                yield _runs(doc, row, start, (doc == doc_of[label]) & (start == start_of[label]), self.least)
        self.dir.cleanup()


def sorted_pieces(batches, least: int):
    """The pieces of stretches sorted by h and doc_id. A gram's places are sorted together up to HOT of them; more go through Many."""
    held: list[pa.RecordBatch] = []
    many = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        if many or held:
            own = many_h if many else held[0].column("h")[0].as_py()
            if own == h[-1]:  # one gram all through
                if many is None and sum(b.num_rows for b in held) + batch.num_rows > HOT:
                    many, many_h = Many(least), own
                    for b in held:
                        many.add(b)
                    held = []
                many.add(batch) if many else held.append(batch)
                continue
        if many:
            to = int(np.searchsorted(h, many_h, "right"))
            many.add(batch.slice(0, to), end=True)
            yield from many.pieces()
            many, batch, h = None, batch.slice(to), h[to:]
        last = int(np.searchsorted(h, h[-1]))
        if held or last:
            yield pieces(pa.Table.from_batches([*held, batch.slice(0, last)]), least)
        held = [batch.slice(last)]
    if many:
        many.add(many.rest[0].slice(0, 0), end=True)
        yield from many.pieces()
    if held:
        yield pieces(pa.Table.from_batches(held), least)


def repeated_spans(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, removed): where runs of `least` words and more repeat in the corpus.

    See repeats for the relation. The suffixes that can begin a repeated run are spread by the hash of the least gram
    of their first `least` words and sorted there by mergesort; two are compared at the word after their common
    extension, which a binary search over prefix polynomial hashes finds. Neighbours that agree in `least` words by
    hash are compared word by word, and a class of equal hashes is split where words differ. The suffixes of a gram with
    more than HOT places are classed by digests instead, chunk by chunk, so that no task holds all of them (see Many).

    Documents under `least` words (null and empty ones too) have no row. Rows without doc_id take no part. Repeated
    rows of one doc_id count once; other texts under one doc_id count as further places of that document, and the same
    word number as the same place. Of equal runs the one with the least (doc_id, position) is first. Runs may overlap
    themselves. An empty table gives no row. Other columns are not read.
    """
    texts = corpus(docs)

    def run(batches):
        yield from sorted_pieces(batches, least)

    spread = stretches(texts, marks(texts, least), least).repartition("h").sortWithinPartitions("h", "doc_id")
    return spans(settle(spread.mapInArrow(run, "doc_id bigint, s int, e int, is_first boolean")))
