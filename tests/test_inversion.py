"""Texts to postings in slices: repeated ids, what is shuffled, and how often texts are read."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein import queries
from skein.functions import analysis, codes
from skein.functions.analysis import Analyzer, cut, n_tokens, tokens
from skein.functions.stemmer import stem
from skein.operators import index
from skein.operators.index import build
from tests.oracle import same

PLAIN = Analyzer(stem=False)
TEXTS = ["The of; the-THE with of", "", None, "les eaux 42x", "été the é9 ☃of", "KK ", "with, with of the " * 30, "thier whcih x"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Documents of which some share an id, in no order of ids."""
    rng = random.Random(2)
    words = "the of with les eaux der und thier a1 Zz teh".split()
    rows = [(i % 37 * 3 - 6, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in rng.sample(range(45), 45)] + [(None, "the")]
    path = tmp_path_factory.mktemp("repeated")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(params=[1000, 2])
def limit(request, monkeypatch):
    """Ids that are told apart; beyond, all rows are grouped."""
    monkeypatch.setattr(index, "REPEATED", request.param)


@pytest.mark.parametrize("name", ["inverted_index", "term_ids", "postings_gaps", "term_offsets", "bm25_scores", "doc_frequency", "stored_tables", "boolean_nested"])
def test_documents_that_share_an_id(spark, repeated, limit, name, monkeypatch, tmp_path):
    sql = queries.oracle_sql()[name]
    read = f"'{repeated}/documents.parquet/*.parquet'"
    (tmp_path / "empty").mkdir()
    same(queries.QUERIES[name](spark, repeated), sql.replace("FROM documents", f"FROM {read}"), str(tmp_path / "empty"))


def test_tokens_of_slices_are_those_of_the_column(spark, monkeypatch):
    monkeypatch.setattr(analysis, "SLICE", 8)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    want = [r.t for r in df.select(tokens(F.col("text")).alias("t")).collect()]
    flat, first = cut(pa.array(TEXTS, pa.string()))
    flat = flat.to_pylist()
    assert [flat[a:b] for a, b in zip(first, first[1:])] == want
    assert [r.n for r in df.select(n_tokens(F.col("text")).alias("n")).collect()] == [len(t) for t in want]


def test_stemmed_postings(spark):
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(["falling falls", "Fall skies", "sky", None])], "doc_id bigint, path string, text string")
    assert {(r.term, r.doc_id, tuple(r.positions)) for r in build(docs).postings.collect()} == {("fall", 0, (0, 1)), ("fall", 1, (0,)), ("sky", 1, (1,)), ("sky", 2, (0,))}
    assert {r.term: r.df for r in build(docs).vocab.collect()} == {stem("falls"): 2, "sky": 2}


def test_code_lengths_outside_spark(spark):
    n = np.array([0, 1, 2, 6, 126, 127, 2**31 - 1, 2**32, 2**53, 2**62, 2**63 - 2, -1, -5])
    found = spark.createDataFrame([(int(x),) for x in n], "n bigint").select(codes.gamma_bits(F.col("n")).alias("g"), codes.vbyte_bits(F.col("n")).alias("v")).collect()
    assert [r.g for r in found] == codes.gamma_sizes(n).tolist() and [r.v for r in found] == codes.vbyte_sizes(n).tolist()


def test_postings_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame([(0, "0", "a b a")], "doc_id bigint, path string, text string")
    made = build(docs, PLAIN)
    assert "Exchange" not in plan(made.postings) and "Generate" not in plan(made.postings)
    assert [tuple(r) for r in made.postings_of(["a", "c"]).collect()] == [("a", 0, 2, [0, 2])]
    assert "MapInArrow" not in plan(made.vocab)  # numbers and group totals read the settled frequencies


@pytest.mark.parametrize("name, most", [("term_ids", 1), ("term_offsets", 1), ("bm25_scores", 2), ("trigram_index", 1), ("free_query_topk", 3), ("spell_correct", 1)])
def test_how_often_the_texts_are_read(spark, monkeypatch, name, most):
    """Besides the lengths of documents and the query's own postings, texts are cut once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, str(i), "the of with " + t) for i, t in enumerate("abcdef")], "doc_id bigint, path string, text string")
    monkeypatch.setattr(queries, "_docs", lambda *_: docs.mapInArrow(count, docs.schema))
    queries.QUERIES[name](spark, "").collect()
    assert seen.value <= (most + 1) * 6  # and once the ids alone
