"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import release, settle

BITS = 26
BINS = 64
BLOCK = 4096
#: One of so many vectors is a query: those whose id it divides.
EVERY = 20
KEY = ["dim", "b"]


def quantised(table: DataFrame) -> DataFrame:
    """(vec_id, v) with v the unit vector in steps of 2**-BITS, so that sums of products are exact in doubles in any order."""

    def run(batches):
        for batch in batches:
            col = batch.column("embedding")
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
            x = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            first = np.cumsum(size) - size
            some = np.flatnonzero(size)
            norm = np.zeros(len(size))
            with np.errstate(all="ignore"):
                if len(some):
                    norm[some] = np.sqrt(np.add.reduceat(x * x, first[some]))
                ok = np.isfinite(norm) & (norm > 0)
                v = np.rint(x / np.repeat(norm, size) * (1 << BITS))
            v = v[np.repeat(ok, size)].astype(np.int32)
            off = np.concatenate([[0], np.cumsum(size[ok])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), pa.ListArray.from_arrays(pa.array(off), pa.array(v))], ["vec_id", "v"])

    read = table.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return read.mapInArrow(run, "vec_id bigint, v array<int>").groupBy("vec_id").agg(F.min("v").alias("v"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, b, ids, v): vectors (vec_id, v, dim) of one dimension, about size of them, by ascending id, as packed numbers. A settled table."""
    count = max(1, math.ceil(vectors.count() / size))

    def run(table):
        table = table.sort_by("vec_id")
        v = table.column("v").combine_chunks().flatten().to_numpy()
        ids = table.column("vec_id").to_numpy()
        return pa.table([table.column("dim")[:1], table.column("b")[:1], pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["dim", "b", "ids", "v"])

    return settle(
        vectors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(count))).groupBy(*KEY).applyInArrow(run, "dim int, b bigint, ids binary, v binary")
    )


def _numbers(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, kind)


def _scores(row: dict, rows: np.ndarray) -> np.ndarray:
    """Exact scores of the given rows of query block x against block y; a vector's own is -inf."""
    d = row["dim"]
    x, y = (_numbers(row[c], np.int32).reshape(-1, d).astype(np.float64) for c in ("xv", "yv"))
    s = x[rows] @ y.T
    ids, yids = _numbers(row["xids"], np.int64)[rows], _numbers(row["yids"], np.int64)  # both ascend
    own = np.minimum(np.searchsorted(yids, ids), len(yids) - 1)
    same = yids[own] == ids
    s[same, own[same]] = -np.inf
    return s


def _pairs(asked: DataFrame, made: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each query block (ascending row numbers and their lower bounds) beside every block of its dimension."""
    spark = made.sparkSession
    n = max(2, math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))
    at = bounds.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "lo"))).alias("at"))
    x = asked.join(at, KEY).select(*KEY, F.col("ids").alias("xids"), F.col("v").alias("xv"), "at").repartition(n, *KEY)
    y = made.select(F.col("dim").alias("ydim"), F.col("b").alias("yb"), F.col("ids").alias("yids"), F.col("v").alias("yv")).repartition(n, "ydim", "yb")
    return x.join(y, F.col("dim") - F.col("ydim") == 0)  # no equi-key: one dimension would be one partition


def _at(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.array([a["i"] for a in row["at"]], np.int64), np.array([a["lo"] for a in row["at"]], np.float64)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def histogram(asked: DataFrame, made: DataFrame, bounds: DataFrame, width: int, k: int) -> DataFrame:
    """(dim, b, i, bin, n): how many scores of each query lie in each of the BINS equal parts of [lo, lo + width).

    A block leaves out parts below those in which its own k best lie: they can't hold the kth of all.
    """

    def run(batches):
        for row in _rows(batches):
            rows, lo = _at(row)
            s = _scores(row, rows)
            s -= lo[:, None]
            s *= BINS / width
            inside = (s >= 0) & (s < BINS)
            if inside.mean() > 0.3:
                s[~inside] = BINS
                cell = s.astype(np.int32)
                cell += np.arange(len(rows), dtype=np.int32)[:, None] * (BINS + 1)
                n = np.bincount(cell.ravel(), minlength=len(rows) * (BINS + 1)).reshape(-1, BINS + 1)[:, :BINS]
            else:
                i, j = np.nonzero(inside)
                n = np.bincount(i * BINS + s[i, j].astype(np.int64), minlength=len(rows) * BINS).reshape(-1, BINS)
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            i, j = np.nonzero((n > 0) & (above < k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), row["dim"], np.int32)), pa.array(np.full(len(i), row["b"])), pa.array(rows[i]), pa.array(j), pa.array(n[i, j].astype(np.int64))],
                [*KEY, "i", "bin", "n"],
            )

    return _pairs(asked, made, bounds).mapInArrow(run, "dim int, b bigint, i bigint, bin bigint, n bigint").groupBy(*KEY, "i", "bin").agg(F.sum("n").alias("n"))


def candidates(asked: DataFrame, made: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """(query_id, neighbor_id, s): scores of at least lo, of each block the k best (ties: the least ids)."""

    def run(batches):
        for row in _rows(batches):
            rows, lo = _at(row)
            s = _scores(row, rows)
            i, j = np.nonzero(s >= lo[:, None])
            value = s[i, j]
            keep = np.isfinite(value)
            i, j, value = i[keep], j[keep], value[keep]
            o = np.lexsort((j, -value, i))  # ids ascend within a block
            i, j, value = i[o], j[o], value[o]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            best = rank < k
            xids, yids = _numbers(row["xids"], np.int64), _numbers(row["yids"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(xids[rows[i[best]]]), pa.array(yids[j[best]]), pa.array(value[best].astype(np.int64))], ["query_id", "neighbor_id", "s"]
            )

    return _pairs(asked, made, bounds).mapInArrow(run, "query_id bigint, neighbor_id bigint, s bigint")


def neighbours(vectors: DataFrame, k: int = 10, enough: int = 4, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """(query_id, rank, neighbor_id, score): the k vectors of highest cosine, of all vectors but itself, for every one whose id `every` divides.

    Exact: unit vectors are rounded to steps of 2**-26, where dot products have no rounding error. All pairs of a query and a vector are scored,
    block by block, and only counted: a histogram of BINS parts by query, summed over all blocks, shows in which part
    the kth score lies; that part is divided again until no more than enough * k scores lie at or above its lower
    edge, or it is one step wide. Then the scores from there on are gathered and ranked, ties by ascending neighbor_id.

    Queries are gathered into blocks of their own, so there are as few pairs of blocks as for that many rows.

    Rows with a null vec_id, or a vector that is null, empty, all zeros or holds a null, NaN or infinity, are neither queries nor
    neighbours. Vectors are compared with those of their own length. Repeated rows of one vec_id count once, with its
    least vector. A query with fewer than k others has them all. An empty table gives no row. Only vec_id and embedding are read.
    """
    units = settle(quantised(vectors).withColumn("dim", F.size("v")))
    made, asked = blocks(units, block), blocks(units.where(F.col("vec_id") % every == 0), max(1, block // 8))
    release(units)
    spark = made.sparkSession
    width = 1 << (2 * BITS + 2)
    queries = asked.select(*KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.octet_length("ids") / 8 - 1).cast("bigint"))).alias("i"))
    live = settle(queries.select(*KEY, "i", F.lit(-(width // 2)).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("above")))
    done = spark.createDataFrame([], "dim int, b bigint, i bigint, lo bigint")
    while not live.isEmpty():
        part = width // BINS
        n = histogram(asked, made, live, width, k)
        cum = F.sum("n").over(Window.partitionBy(*KEY, "i").orderBy(F.col("bin").desc()))
        hit = (
            n.withColumn("cum", cum)
            .join(live.withColumnRenamed("lo", "was"), [*KEY, "i"])
            .where((F.col("above") + F.col("cum") >= k) & (F.col("above") + F.col("cum") - F.col("n") < k))
            .select(*KEY, "i", (F.col("was") + F.col("bin") * F.lit(part)).alias("lo"), (F.col("above") + F.col("cum") - F.col("n")).alias("above"), (F.col("above") + F.col("cum")).alias("have"))
        )
        hit = settle(hit)
        few = live.join(hit, [*KEY, "i"], "left_anti").select(*KEY, "i", "lo")  # fewer than k others
        ready = (F.col("have") <= enough * k) | F.lit(part <= 1)
        done = done.union(few).union(hit.where(ready).select(*KEY, "i", "lo"))
        live, width = hit.where(~ready).select(*KEY, "i", "lo", "above"), part
    order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "neighbor_id")
    return (
        candidates(asked, made, settle(done), k)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "neighbor_id", (F.col("s") / F.lit(float(1 << (2 * BITS)))).alias("score"))
    )


def oracle(k: int = 10) -> str:
    step = 1 << BITS
    return f"""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_sum(list_transform(e, lambda y: y * y))) * {step})) AS q FROM u),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_dot_product(a.q, b.q) / {step * step}::DOUBLE AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM s) WHERE rank <= {k}"""
