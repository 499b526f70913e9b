"""Substring dedup by compaction of the de Bruijn graph of token k-mers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import candidates, cut, marks, spans
from .store import corpus, settle
from .text import _classify, buffer, gram_hash, gram_sums, mix, signed, slices, words


def visits(texts: DataFrame, marked: DataFrame, k: int) -> DataFrame:
    """(v, before, after, doc_id, pos): each visit of a document to a node, a (k - 1)-gram, and the words around it.

    Edges are the k-mers that may be repeated; at an end of a chain of them, before or after is 0.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                sums, word = gram_sums(w.hash), mix(w.hash, 3) | np.uint64(1)
                out = ([], [], [], [], [])
                for i in range(part.num_rows):
                    a, z = w.first[i], w.first[i + 1]
                    edge = candidates(part.column("at")[i].values.to_numpy(), int(z - a), k)
                    node = np.union1d(edge, edge + 1)
                    if not len(node):
                        continue
                    has = np.zeros(int(z - a) + 2, bool)
                    has[edge + 1] = True  # has[p + 1]: the k-mer at p is an edge
                    near = lambda at: word[np.clip(a + at, 0, len(word) - 1)]  # noqa: E731, B023
                    out[0].append(gram_hash(sums, a + node, k - 1))
                    out[1].append(np.where(has[node], near(node - 1), np.uint64(0)))
                    out[2].append(np.where(has[node + 1], near(node + k - 1), np.uint64(0)))
                    out[3].append(np.full(len(node), i))
                    out[4].append(node.astype(np.int32))
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [*(signed(np.concatenate(c)) for c in out[:3]), part.column("doc_id").take(pa.array(np.concatenate(out[3]))), pa.array(np.concatenate(out[4]))],
                        ["v", "before", "after", "doc_id", "pos"],
                    )

    return texts.join(marked, "doc_id").mapInArrow(run, "v bigint, before bigint, after bigint, doc_id bigint, pos int")


def unitig_visits(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, edges, first_doc, first_pos): each passage of a document along a compacted path.

    A node where every visit comes from the same word and goes on to the same word lies inside a path. Only visits to
    the other nodes leave this step, so the paths between them need no step of their own: a document's next branching
    node ends the path that starts at the last. first_* is the path's first source coordinate in the corpus.
    """
    way = Window.partitionBy("v", "after")
    first = way.orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    node = Window.partitionBy("v")
    seen = (
        nodes.repartition("v")
        .withColumn("first_doc", F.first("doc_id").over(first))
        .withColumn("first_pos", F.first("pos").over(first))
        .withColumn("repeated", (F.col("after") != 0) & ((F.min("doc_id").over(way) != F.max("doc_id").over(way)) | (F.min("pos").over(way) != F.max("pos").over(way))))
        .withColumn("shared", (F.min("doc_id").over(node) != F.max("doc_id").over(node)) | (F.min("pos").over(node) != F.max("pos").over(node)))
        .withColumn(
            "branching",
            (F.col("before") == 0) | (F.col("after") == 0)
            | (F.min("before").over(node) != F.max("before").over(node)) | (F.min("after").over(node) != F.max("after").over(node)),
        )
        .where("shared and branching")
        .select("doc_id", "pos", "repeated", "first_doc", "first_pos")
        .distinct()
    )
    order = Window.partitionBy("doc_id").orderBy("pos")
    return (
        seen.withColumn("edges", F.lead("pos").over(order) - F.col("pos")).where("repeated").select("doc_id", "pos", "edges", "first_doc", "first_pos")
    )


def verified(texts: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """Repeated pieces (doc_id, s, e, is_first) whose words equal those at their path's first coordinate.

    Paths are joined to their passages by coordinate; lengths and 128-bit digests of the words themselves must agree.
    """
    listed = settle(passages.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "edges", "first_doc", "first_pos")).alias("at")))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                col = part.column("text")
                w, (raw, _) = words(col), buffer(col)
                rows = ([], [], [], [], [], [])
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    piece = part.column("at")[i].values
                    pos, edges, fd, fp = (piece.field(c).to_numpy() for c in ("pos", "edges", "first_doc", "first_pos"))
                    a = w.first[i]
                    for p, n, d, q in zip(pos.tolist(), edges.tolist(), fd.tolist(), fp.tolist()):
                        if p + n + k - 1 > w.first[i + 1] - a:
                            continue  # a coordinate of another text under this doc_id
                        lo, hi = w.start[a + p], w.end[a + p + n + k - 2]
                        m, b = _classify(raw[lo:hi])
                        gap = np.zeros(len(m), bool)
                        gap[1:] = m[:-1] & ~m[1:]
                        b[gap] = 32
                        value = hashlib.blake2b(b[m | gap].tobytes(), digest_size=16).digest()
                        for column, x in zip(rows, (doc, p, n, d, q, value)):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", "pos", "edges", "first_doc", "first_pos", "digest"])

    seen = settle(texts.join(listed, "doc_id").mapInArrow(run, "doc_id bigint, pos int, edges int, first_doc bigint, first_pos int, digest binary").distinct())
    path = seen.where("doc_id = first_doc and pos = first_pos").select("first_doc", "first_pos", "edges", "digest")
    return seen.join(path, ["first_doc", "first_pos", "edges", "digest"], "left_semi").select(
        "doc_id", F.col("pos").alias("s"), (F.col("pos") + F.col("edges") + F.lit(k - 1)).alias("e"),
        ((F.col("doc_id") == F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))).alias("is_first"),
    )


def repeated_spans(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, removed): where runs of `least` words and more repeat in the corpus.

    See repeats for the relation. k-mers of `least` words are edges between (k - 1)-grams. First, winnowed short grams
    find the stretches that can hold a repeated k-mer (every such k-mer lies in one); their edges make up the graph.
    Nonbranching paths compact to single passages; source coordinates are joined to each path's first place, where
    the words themselves are compared, and the verified passages of a document are merged.

    Documents under `least` words (null and empty ones too) have no row. Rows without doc_id take no part. Repeated
    rows of one doc_id count once; other texts under one doc_id count as further places of that document. Of equal runs
    the one with the least (doc_id, position) is first. Runs may overlap themselves. An empty table gives no row. Other
    columns are not read.
    """
    texts = corpus(docs)
    return spans(verified(texts, unitig_visits(visits(texts, marks(texts, least), least)), least))


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs without every repeated run but its first occurrence; see repeats.cut."""
    return cut(docs, repeated_spans(docs, least))
