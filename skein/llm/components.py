"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component.

    Large-star and small-star rounds (Kiveris et al. 2014): every round is two grouped minima and joins over the edge
    list, whose size never grows; the number of rounds grows as the squared logarithm of the component size at most, and it goes on until nothing changes.
    Nodes that have no edge are absent. Self-loops and repeated edges are allowed; an empty table gives none.
    """
    now = settle(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        # large star: each node's larger neighbours are tied to its least neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = settle(small.where(F.col("a") != F.col("b")).distinct())
        same = now.exceptAll(new).isEmpty() and new.exceptAll(now).isEmpty()
        release(now)
        now = new
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
