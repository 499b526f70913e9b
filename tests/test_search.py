import pytest

from skein.cli import main
from skein.functions.analysis import Analyzer
from skein.operators import boolean, spelling
from skein.operators.index import build, store
from skein.plans.engine import CACHED, Engine
from skein.sources.ingest import from_directory, from_table

DOCS = [(0, "1.txt", "hello world"), (1, "2.txt", "hello man"), (2, "3.txt", "man world")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, path string, text string")


@pytest.fixture(scope="module")
def engine(spark, docs, tmp_path_factory):
    return Engine.build(docs, str(tmp_path_factory.mktemp("index")))


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.mark.parametrize(
    "infix, postfix",
    [
        ("a AND (b OR NOT c)", "a b c NOT OR AND"), ("a AND b OR NOT c", "a b AND c NOT OR"), ("NOT (a AND b) OR NOT (c OR d)", "a b AND NOT c d OR NOT OR"),
        ("a AND b AND c OR d OR e", "a b c AND AND d e OR OR"), ("a AND (b OR c)", "a b c OR AND"),
    ],
)
def test_postfix(infix, postfix):
    assert " ".join(boolean.postfix(infix)) == postfix


@pytest.mark.parametrize("bad", ["", "a b", "a AND", "(a", "a)", "()", "AND a", "NOT", "a NOT b", "a (b)"])
def test_bad_queries(bad):
    with pytest.raises(boolean.QueryError):
        boolean.postfix(bad)


def test_set_operators(spark):
    s = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id bigint")
    assert ids(boolean.unite(s(1, 3, 5, 7, 9), s(2, 4, 6, 8, 10))) == list(range(1, 11))
    assert ids(boolean.intersect(s(1, 3, 5, 7, 10), s(2, 3, 6, 7, 10))) == [3, 7, 10]
    assert ids(boolean.intersect(s(1, 2, 3), s())) == [] == ids(boolean.unite(s(), s()))
    assert ids(boolean.complement(s(2, 4, 6, 8), s(*range(10)))) == [0, 1, 3, 5, 7, 9]
    assert ids(boolean.complement(s(0, 1, 2), s(*range(3)))) == [] and ids(boolean.complement(s(), s(*range(10)))) == list(range(10))


def test_boolean_queries(engine):
    assert ids(engine.boolean_query("hello AND NOT world")) == [1]
    assert ids(engine.boolean_query("NOT (hello AND world)")) == [1, 2] == ids(engine.boolean_query("NOT hello OR NOT world"))
    assert ids(engine.boolean_query("NOT x")) == [0, 1, 2] and ids(engine.boolean_query("hello AND x")) == []
    assert ids(engine.boolean_query("wrld")) == [0, 2]
    assert ids(engine.boolean_query("HELLO", analyze_operands=True)) == [0, 1]


def test_free_queries(engine):
    found = lambda q: [(r.doc_id, round(r.score, 9)) for r in engine.free_query(q).collect()]
    assert found("hello") == [(0, 3.235001815), (1, 3.235001815)]
    both = engine.free_query("hello world").collect()
    assert [(r.doc_id, r.path) for r in both] == [(0, "1.txt"), (1, "2.txt"), (2, "3.txt")]
    assert both[0].score == pytest.approx(3.470003629) and both[1].score == pytest.approx(0.235001816)
    assert found("x") == [] == found("")
    assert engine.free_query("hello", k=1).count() == 1


def test_answers_are_kept(engine):
    first = engine.search("hell")
    assert first.query == ["hello"] and [d.doc_id for d in first.documents] == [0, 1]
    assert engine.search("hell") is first
    assert engine.search("b: hello AND NOT world").query == ["hello", "world", "NOT", "AND"]
    for i in range(CACHED):
        engine._answers[f"q{i}"] = first
    assert engine.search("b: man") and len(engine._answers) == CACHED
    shown = engine.with_content(engine.free_query("hello")).collect()
    assert {r.content for r in shown} == {"hello world", "hello man"} == {r.snippet for r in shown}


def test_spelling(spark):
    vocab = spark.createDataFrame([(0, "hello", 1), (1, "world", 2)], "term_id bigint, term string, df bigint")
    index = spark.createDataFrame([("hel", "hello"), ("ell", "hello"), ("llo", "hello"), ("wor", "world"), ("orl", "world"), ("rld", "world")], "trigram string, term string")
    words = spark.createDataFrame([("hell",), ("wrld",), ("he",), ("x",), ("world",), ("wrld",)], "word string")
    want = {"hell": "hello", "wrld": "world", "he": None, "x": None, "world": "world"}
    for compat in (False, True):
        assert {r.word: r.corrected for r in spelling.correct(words, vocab, index, compat).collect()} == want


def test_pruning_and_tables(spark, docs):
    made = build(docs, Analyzer(stem=False), max_p=0.67, min_f=1)
    assert {r.term: r.df for r in made.vocab.collect()} == {"hello": 2, "man": 2, "world": 2}
    assert build(docs, Analyzer(stem=False), max_p=0.5).vocab.count() == 0 == build(docs, min_f=2).postings.count()
    assert {r.doc_id: r.length for r in made.docs.collect()} == {0: 2, 1: 2, 2: 2}


def test_an_empty_corpus(spark, docs, tmp_path):
    engine = Engine.build(docs.limit(0), str(tmp_path / "i"))
    assert engine.search("hello").documents == [] == engine.search("b: NOT hello").documents


def test_directory(spark, tmp_path):
    for path, data in {"a/1.txt": b"hello world", "a-b/1.txt": b"man", "2.txt": b"hello", ".h/3.txt": b"hidden", "a/.4": b"hidden", "bad.txt": b"\xff\xfe"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    found = from_directory(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.path, r.text) for r in found] == [(0, "2.txt", "hello"), (1, "a/1.txt", "hello world"), (2, "a-b/1.txt", "man")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "1.txt").write_text("hello world")
    assert main(["build", str(tmp_path), "--min-f", "0"], spark, ["hello", "", "b: (", "b: NOT hello"]) == 0
    said = capsys.readouterr().out
    assert "hello: 1 documents" in said and "1.txt" in said and "? " in said
    assert main(["load", str(tmp_path)], spark, ["world"]) == 0


def test_table_rows_without_an_id_are_left_out(spark):
    df = spark.createDataFrame([(None, "a", 1), (3, None, 2)], "doc_id bigint, text string, term int")
    made = build(from_table(df), Analyzer(stem=False))
    assert made.docs.collect()[0].asDict() == {"doc_id": 3, "path": "3", "length": 0} and made.vocab.count() == 0


def test_the_terms_of_a_free_query_reach_the_scan(engine):
    assert "In(term, [hello,world])" in engine.free_query("hello world")._jdf.queryExecution().executedPlan().toString()


def test_storing_cuts_the_corpus_into_terms_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(DOCS, "doc_id bigint, path string, text string")
    store(docs.mapInArrow(count, docs.schema), str(tmp_path / "i"), Analyzer(stem=False))
    assert seen.value <= 2 * len(DOCS)  # lengths, and postings
