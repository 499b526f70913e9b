"""Ranked free-text queries: BM25 and the minimum window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import bm25, idf, min_window, score
from .index import Index
from .spelling import correct


def query_terms(queries: DataFrame, index: Index, spell: bool = True, compat: bool = False) -> DataFrame:
    """(query_id, i, term, n_tokens) from (query_id, text): analysed, corrected tokens, numbered anew; duplicates stay.

    Tokens that can't be corrected are dropped.
    """
    raw = queries.select("query_id", F.posexplode(index.analyzer.terms(F.col("text"))).alias("at", "word"))
    if spell:
        fixed = correct(raw, index.vocab, index.trigrams, compat)
    else:
        fixed = raw.select("word").distinct().join(index.vocab.select(F.col("term").alias("word")), "word", "left_semi").select("word", F.col("word").alias("corrected"))
    kept = raw.join(fixed.where("corrected is not null"), "word")
    by = Window.partitionBy("query_id")
    return kept.select(
        "query_id", (F.row_number().over(by.orderBy("at")) - 1).alias("i"), F.col("corrected").alias("term"), F.count("*").over(by).alias("n_tokens")
    )


#: Distinct query terms up to which they are looked up one by one in the stored postings.
LOOKED_UP = 1000


def resolved(terms: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """Query terms as a local table, and the distinct ones to look up; as they are, and None, if there are more than LOOKED_UP rows."""
    rows = terms.limit(LOOKED_UP + 1).collect()
    if len(rows) > LOOKED_UP:
        return terms, None
    return terms.sparkSession.createDataFrame(rows, terms.schema), sorted({r.term for r in rows})


def matches(terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, n_tokens, length, bm, occurrences) of every document that holds a token of the query.

    The terms of a few queries are known before the postings are read, so that no others are read or made (see postings_of).
    """
    terms, looked_up = resolved(terms)
    postings = index.postings if looked_up is None else index.postings_of(looked_up)
    weighed = terms.join(index.vocab.select("term", "df"), "term").crossJoin(F.broadcast(index.stats))  # one row
    weighed = weighed.select("query_id", "i", "term", "n_tokens", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    hit = postings.join(weighed, "term").join(index.docs.select("doc_id", "length"), "doc_id")
    one = bm25(F.col("idf"), F.col("tf"), F.col("length"), F.col("avgdl"))
    placed = F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("i").alias("i")))
    return (
        hit.select("query_id", "doc_id", "n_tokens", "length", one.alias("bm"), placed.alias("occ"))
        .groupBy("query_id", "doc_id")
        .agg(F.first("n_tokens").alias("n_tokens"), F.first("length").alias("length"), F.sum("bm").alias("bm"), F.array_sort(F.flatten(F.collect_list("occ"))).alias("occurrences"))
    )


def scored(found: DataFrame) -> DataFrame:
    """(query_id, doc_id, window, score) of matches."""
    window = found.withColumn("window", min_window(F.col("occurrences"), F.col("n_tokens")))
    return window.select("query_id", "doc_id", "window", score(F.col("window"), F.col("n_tokens"), F.col("bm"), F.col("length")).alias("score"))


def asked(text: str, index: Index, spell: bool = True, compat: bool = False) -> DataFrame:
    """The query terms of one query."""
    queries = index.docs.sparkSession.createDataFrame([(0, text)], "query_id bigint, text string")
    return resolved(query_terms(queries, index, spell, compat))[0]


def free_query(text: str, index: Index, k: int = 100, spell: bool = True, compat: bool = False) -> DataFrame:
    """(doc_id, path, score): the k best documents of one query, ties by doc_id."""
    return best_of(asked(text, index, spell, compat), index, k)


def best_of(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """(doc_id, path, score): the k best documents for the query terms of one query, ties by doc_id."""
    found = scored(matches(terms, index))
    best = found.select("doc_id", "score").orderBy(F.col("score").desc(), "doc_id").limit(k)
    return best.join(index.docs.select("doc_id", "path"), "doc_id").select("doc_id", "path", "score").orderBy(F.col("score").desc(), "doc_id")


def free_query_batch(queries: DataFrame, index: Index, k: int = 100, spell: bool = True, compat: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (query_id, text), ties by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    found = scored(matches(query_terms(queries, index, spell, compat), index))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
