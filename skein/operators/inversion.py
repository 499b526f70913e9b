"""Texts to postings, some documents at a time: by numpy over Arrow's buffers, without a row for each token.

A document lies in one slice, so what is made here of documents with different ids needs no more grouping by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, coded, slices
from ..functions.codes import gamma_sizes, vbyte_sizes

#: Rows of a batch that is given back.
ROWS = 1 << 16


@dataclass
class Slice:
    """The postings of some documents by term, doc_id and position: of each its term, doc_id, length of the document, and where its positions begin (and the end)."""

    terms: pa.Array
    code: np.ndarray
    ids: np.ndarray
    length: np.ndarray
    first: np.ndarray
    positions: np.ndarray

    @property
    def tf(self) -> np.ndarray:
        return np.diff(self.first)

    def by_term(self) -> np.ndarray:
        """The first posting of each term."""
        return np.flatnonzero(np.concatenate([[True], self.code[1:] != self.code[:-1]])) if len(self.code) else np.zeros(0, np.int64)

    def rest_bits(self) -> np.ndarray:
        """By posting: bits of gamma tf, vbyte count and gamma position gaps."""
        gap = np.diff(self.positions, prepend=0)
        gap[self.first[:-1]] = self.positions[self.first[:-1]]
        inner = np.add.reduceat(gamma_sizes(gap), self.first[:-1]) if len(gap) else np.zeros(0, np.int64)
        return gamma_sizes(self.tf) + vbyte_sizes(self.tf) + inner


def inverted(part: pa.RecordBatch, stemmed: dict[str, str] | None, only: list[str] | None = None) -> Slice:
    """The postings of (doc_id, text), of some terms only if these are given; stemmed: see coded."""
    ids = part.column("doc_id").to_numpy()
    if (ids[1:] < ids[:-1]).any():
        part = part.take(pa.array(np.argsort(ids, kind="stable")))
        ids = part.column("doc_id").to_numpy()
    code, terms, first = coded(part.column("text"), stemmed)
    at = np.arange(len(code))
    if only is not None:
        at = np.flatnonzero(pc.is_in(terms, pa.array(only, pa.string())).to_numpy(zero_copy_only=False)[code])
    key = np.sort((code[at].astype(np.int64) << 32) | at)
    code, at = key >> 32, key & 0xFFFFFFFF
    n = np.diff(first)
    doc = np.repeat(np.arange(len(ids)), n)[at]
    lo = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else at
    return Slice(terms, code[lo], ids[doc[lo]], n[doc[lo]], np.append(lo, len(at)), (at - first[doc]).astype(np.int32))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def _sliced(docs: DataFrame, analyzer: Analyzer, make: Callable[[Slice], list[pa.Array]], schema: str, only: list[str] | None = None) -> DataFrame:
    names, stem = [x.split()[0] for x in schema.split(", ")], analyzer.stem

    def run(batches):
        stemmed = {} if stem else None
        for batch in batches:
            for part in slices(batch):
                made = pa.RecordBatch.from_arrays(make(inverted(part, stemmed, only)), names)
                for i in range(0, made.num_rows, ROWS):
                    yield made.slice(i, ROWS)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def postings(docs: DataFrame, analyzer: Analyzer, only: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, positions) of each row of docs."""

    def make(s: Slice) -> list[pa.Array]:
        return [s.terms.take(pa.array(s.code)), pa.array(s.ids), pa.array(s.tf), _lists(s.positions, s.first)]

    return _sliced(docs, analyzer, make, "term string, doc_id bigint, tf bigint, positions array<int>", only)


def seen(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(term, df, doc_id, pos): how many documents of a slice hold the term, and its place in the one with the least id."""

    def make(s: Slice) -> list[pa.Array]:
        lo = s.by_term()
        return [s.terms.take(pa.array(s.code[lo])), pa.array(np.diff(np.append(lo, len(s.code)))), pa.array(s.ids[lo]), pa.array(s.positions[s.first[lo]])]

    return _sliced(docs, analyzer, make, "term string, df bigint, doc_id bigint, pos int")


#: What lists() can give of a term's documents in a slice, besides how many they are.
LISTS = {"docs": "array<bigint>", "tfs": "array<bigint>", "lengths": "array<int>", "rest": "bigint"}


def lists(docs: DataFrame, analyzer: Analyzer, *columns: str) -> DataFrame:
    """(term, n, columns): by term the n documents of a slice that hold it: their ids in order, tf, lengths, and bits without those of the gaps."""

    def make(s: Slice) -> list[pa.Array]:
        lo = s.by_term()
        first = np.append(lo, len(s.code))
        made = {
            "docs": lambda: _lists(s.ids, first), "tfs": lambda: _lists(s.tf, first), "lengths": lambda: _lists(s.length.astype(np.int32), first),
            "rest": lambda: pa.array(np.add.reduceat(s.rest_bits(), lo) if len(lo) else lo),
        }
        return [s.terms.take(pa.array(s.code[lo])), pa.array(np.diff(first)), *(made[c]() for c in columns)]

    return _sliced(docs, analyzer, make, ", ".join(["term string, n bigint", *(f"{c} {LISTS[c]}" for c in columns)]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by term as tables that hold all rows of their terms."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column("term")
        if held and held[0].column("term")[0] == terms[-1]:  # one term all through
            held.append(batch)
            continue
        n = pc.index(terms, terms[-1]).as_py()
        if held or n:
            yield pa.Table.from_batches([*held, batch.slice(0, n)])
        held = [batch.slice(n)]
    if held:
        yield pa.Table.from_batches(held)


def _gaps(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, term, ids, gap): distinct terms, the first row of each; and by posting, in order, the number of its term, doc_id and distance from the one before."""
    name = table.column("term").combine_chunks()
    row = np.flatnonzero(np.concatenate([[True], pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)]))
    docs = table.column("docs").combine_chunks()
    number = np.repeat(np.arange(len(row)), np.diff(np.append(row, len(name))))
    term, ids = np.repeat(number, pc.list_value_length(docs).to_numpy()), docs.flatten().to_numpy()
    if ((term[1:] == term[:-1]) & (ids[1:] < ids[:-1])).any():
        ids = ids[np.lexsort((ids, term))]
    gap = np.diff(ids, prepend=0)
    new = np.concatenate([[True], term[1:] != term[:-1]])
    gap[new] = ids[new]
    return name.take(pa.array(row)), row, term, ids, gap


def _by_term(packed: DataFrame) -> DataFrame:
    return packed.repartition("term").sortWithinPartitions("term")


def doc_gaps(packed: DataFrame) -> DataFrame:
    """(term, doc_id, gap) of lists with docs: each posting's distance from the one before it in its list, the first from 0."""

    def run(batches):
        for table in _whole(batches):
            terms, _, term, ids, gap = _gaps(table)
            for i in range(0, len(ids), ROWS):
                own = slice(i, i + ROWS)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[own])), pa.array(ids[own]), pa.array(gap[own])], ["term", "doc_id", "gap"])

    return _by_term(packed.select("term", "docs")).mapInArrow(run, "term string, doc_id bigint, gap bigint")


def gap_bits(packed: DataFrame) -> DataFrame:
    """(term, n, bits, rest) of lists with docs and rest: documents of each term, bits of their gaps in gamma code, and all other bits."""

    def run(batches):
        for table in _whole(batches):
            terms, row, term, _, gap = _gaps(table)
            first = np.searchsorted(term, np.arange(len(terms)))
            bits, rest = np.add.reduceat(gamma_sizes(gap), first), np.add.reduceat(table.column("rest").to_numpy(), row)
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.diff(np.append(first, len(term)))), pa.array(bits), pa.array(rest)], ["term", "n", "bits", "rest"])

    return _by_term(packed.select("term", "docs", "rest")).mapInArrow(run, "term string, n bigint, bits bigint, rest bigint")
