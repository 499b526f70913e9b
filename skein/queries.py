"""The registered queries over the table documents, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.analysis import Analyzer, snippet, tokens
from .functions.codes import gamma_bits, gamma_code, gamma_value, text_code, text_value, vbyte_bits, vbyte_code, vbyte_value
from .functions.scoring import bm25, idf
from .operators import boolean, index, inversion, ranking, spelling
from .plans.engine import Engine
from .sources.ingest import from_table
from .sources.tables import load, settle, shared_dir

PLAIN = Analyzer(stem=False)
MAX_P, MIN_F, K = 0.5, 1, 10
MISSPELLED = ("teh", "thier", "whcih", "x", "the", "erblesst", "eauxs", "ndthe", "zzzzqq")
QUERY = "the of with"
BATCH = {1: "the of with", 2: "of the that of", 3: "les eaux", 4: "thier whcih", 5: "with", 6: "que de la tion", 7: "zz1qq the", 8: "und der"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _index(spark: SparkSession, sf_dir: str, analyzer: Analyzer = PLAIN) -> index.Built:
    return index.build(_docs(spark, sf_dir), analyzer)


def _served(spark: SparkSession, sf_dir: str, analyzer: Analyzer = PLAIN) -> index.Built:
    """The index of a query that reads several of its tables: the small ones written and read back, postings of the query's terms alone."""
    return _index(spark, sf_dir, analyzer).served()


def _few(spark: SparkSession, sf_dir: str, words: list[str]) -> DataFrame:
    """Postings of some terms only."""
    return _index(spark, sf_dir).postings_of(words)


def _terms(spark: SparkSession, rows: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(rows.items()), "query_id bigint, text string")


def tokenize_positions(spark, sf_dir):
    return PLAIN.positions(_docs(spark, sf_dir)).select("doc_id", "pos", "term")


def doc_lengths(spark, sf_dir):
    return index.lengths(_docs(spark, sf_dir), PLAIN).select("doc_id", "length")


def corpus_stats(spark, sf_dir):
    return index.statistics(index.lengths(_docs(spark, sf_dir), PLAIN)).select("n", F.round("avgdl", 6).alias("avgdl"))


def inverted_index(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def doc_frequency(spark, sf_dir):
    return _index(spark, sf_dir).frequencies.select("term", "df")


def vocab_pruned(spark, sf_dir):
    return index.build(_docs(spark, sf_dir), PLAIN, MAX_P, MIN_F).frequencies.select("term", "df")


def term_ids(spark, sf_dir):
    return _index(spark, sf_dir).vocab


def postings_gaps(spark, sf_dir):
    return inversion.doc_gaps(_index(spark, sf_dir).lists("docs"))


def gamma_code_bits(spark, sf_dir):
    return inversion.gap_bits(_index(spark, sf_dir).lists("docs", "rest")).select("term", "bits")


def vbyte_code_bits(spark, sf_dir):
    return _index(spark, sf_dir).frequencies.select("term", vbyte_bits(F.col("df")).alias("bits"))


def term_offsets(spark, sf_dir):
    """Length of each bit-packed list and where it begins: vbyte count, and by posting gamma gap, gamma tf, vbyte count and gamma position gaps."""
    bits = inversion.gap_bits(_index(spark, sf_dir).lists("docs", "rest")).select("term", (F.col("bits") + F.col("rest") + vbyte_bits(F.col("n"))).alias("bits"))
    return index.running(settle(bits), "term", F.col("bits"), "bit_offset").select("term", "bits", "bit_offset")


def front_coding(spark, sf_dir):
    return index.front_coded(settle(_index(spark, sf_dir).frequencies))


def _boolean(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        tokens_ = boolean.postfix(query)
        docs = _docs(spark, sf_dir)
        return boolean.select(_few(spark, sf_dir, boolean.operands(tokens_)), docs, tokens_)

    return run


def boolean_sets(spark, sf_dir):
    """The set operators one by one: ((the AND of) OR les) and what is not in it."""
    few = _few(spark, sf_dir, ["the", "of", "les"])
    of = lambda t: few.where(F.col("term") == t).select("doc_id")
    some = boolean.unite(boolean.intersect(of("the"), of("of")), of("les"))
    rest = boolean.complement(some, _docs(spark, sf_dir))
    return some.withColumn("inside", F.lit(True)).union(rest.withColumn("inside", F.lit(False)))


def trigram_index(spark, sf_dir):
    return _index(spark, sf_dir).trigrams


def edit_distance(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in MISSPELLED], "word string")
    vocabulary = _index(spark, sf_dir).frequencies.select("term")
    return vocabulary.crossJoin(F.broadcast(words)).select("word", "term", F.levenshtein("word", "term").alias("distance"))


def spell_correct(spark, sf_dir):
    made = _index(spark, sf_dir).served(docs=False)
    return spelling.correct(spark.createDataFrame([(w,) for w in MISSPELLED], "word string"), made.vocab, made.trigrams)


def idf_weights(spark, sf_dir):
    made = _index(spark, sf_dir)
    return made.frequencies.crossJoin(F.broadcast(made.stats)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 9).alias("idf"))


def bm25_scores(spark, sf_dir):
    """BM25 of every posting of the corpus."""
    made = _index(spark, sf_dir)
    counted = made.lists("docs", "tfs", "lengths").withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    each = F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))
    both = counted.select("term", "df", F.inline(each)).crossJoin(F.broadcast(made.stats))
    weight = bm25(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("length"), F.col("avgdl"))
    return both.select("term", "doc_id", F.round(weight, 6).alias("bm25"))


def _found(spark, sf_dir):
    made = _served(spark, sf_dir)
    return ranking.scored(ranking.matches(ranking.query_terms(_terms(spark, {0: QUERY}), made, spell=False), made))


def min_window(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "window")


def free_query_topk(spark, sf_dir):
    found = ranking.free_query(QUERY, _served(spark, sf_dir), K)
    return found.select("doc_id", F.round("score", 6).alias("score"))


def free_query_batch(spark, sf_dir):
    best = ranking.free_query_batch(_terms(spark, BATCH), _served(spark, sf_dir), K)
    return best.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def free_query_stemmed(spark, sf_dir):
    best = ranking.free_query_batch(_terms(spark, BATCH), _served(spark, sf_dir, Analyzer()), K)
    return best.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def stemmed_vocab(spark, sf_dir):
    return _index(spark, sf_dir, Analyzer()).vocab


def snippets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", snippet(F.col("text")).alias("snippet"))


def hits_with_content(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    hits = boolean.select(_few(spark, sf_dir, ["the", "les"]), docs, boolean.postfix("the AND NOT les"))
    return hits.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id", "left").withColumn("n_tokens", F.size(tokens(F.col("content"))))


def compat_df_misaligned(spark, sf_dir):
    return index.build(_docs(spark, sf_dir), PLAIN, compat=True).vocab.select("term", "df")


def _engine(spark, sf_dir) -> Engine:
    base = shared_dir(spark)
    index.store(_docs(spark, sf_dir), base, PLAIN)
    return Engine(index.Index(**load(spark, base), analyzer=PLAIN), _docs(spark, sf_dir))


def stored_free_query(spark, sf_dir):
    """A free query of an index that was written and loaded, with paths and the text of each hit."""
    engine = _engine(spark, sf_dir)
    hits = engine.with_content(engine.free_query(QUERY, K))
    return hits.select("doc_id", "path", F.round("score", 6).alias("score"), F.octet_length("content").alias("n_bytes"))


def stored_boolean(spark, sf_dir):
    """A boolean query of an index that was written and loaded, one operand misspelled."""
    return _engine(spark, sf_dir).boolean_query("(the AND NOT of) OR thier").select("doc_id", "path", "score")


def stored_tables(spark, sf_dir):
    """Rows and sums of each table of an index that was written and loaded."""
    made = index.Index(**load(spark, _engine_base(spark, sf_dir)), analyzer=PLAIN)
    count = lambda name, df, total: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(total).cast("bigint").alias("total"))
    return (
        count("docs", made.docs, F.col("length")).union(count("postings", made.postings, F.col("tf") + F.size("positions"))).union(count("vocab", made.vocab, F.col("df") + F.col("term_id")))
        .union(count("trigrams", made.trigrams, F.length("term"))).union(count("stats", made.stats, F.col("n")))
    )


def _engine_base(spark, sf_dir) -> str:
    base = shared_dir(spark)
    index.store(_docs(spark, sf_dir), base, PLAIN)
    return base


def code_round_trip(spark, sf_dir):
    """Frequencies and terms through their bit codes and back."""
    coded = _index(spark, sf_dir).frequencies.select("term", gamma_code(F.col("df")).alias("gamma"), vbyte_code(F.col("df")).alias("vbyte"), text_code(F.col("term")).alias("text"))
    return coded.select(
        "term", F.length("gamma").alias("gamma_bits"), F.length("vbyte").alias("vbyte_bits"), F.length("text").alias("text_bits"),
        gamma_value(F.col("gamma")).alias("from_gamma"), vbyte_value(F.col("vbyte")).alias("from_vbyte"), text_value(F.col("text")).alias("from_text"),
    )


BOOLEAN = {
    "boolean_and": "the AND of", "boolean_or": "les OR der", "boolean_not": "NOT the", "boolean_nested": "(the AND NOT of) OR NOT (in OR en)",
    "boolean_unknown_term": "the AND NOT qqqzzz",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_positions, doc_lengths, corpus_stats, inverted_index, doc_frequency, vocab_pruned, term_ids, postings_gaps, gamma_code_bits,
        vbyte_code_bits, term_offsets, front_coding, boolean_sets, trigram_index, edit_distance, spell_correct, idf_weights, bm25_scores,
        min_window, free_query_topk, free_query_batch, free_query_stemmed, stemmed_vocab, snippets, hits_with_content, compat_df_misaligned,
        stored_free_query, stored_boolean, stored_tables, code_round_trip,
    )
} | {name: _boolean(q) for name, q in BOOLEAN.items()}


# SQL ------------------------------------------------------------------------------------------------------------------

_WS = "list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))"
_TOK = f"""
d AS (SELECT doc_id, text, {_WS} AS ws FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws)))::INTEGER AS pos FROM d)"""
_POST = f"""{_TOK},
p AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM t GROUP BY term, doc_id),
v AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d)"""
_GAPS = f"{_POST},\ng AS (SELECT term, doc_id, tf, positions, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM p)"


def _bits(n: str) -> str:
    return f"(len(bin({n} + 1)))"


def _gamma(n: str) -> str:
    return f"(2 * ({_bits(n)} - 1) + 1)"


def _vbyte(n: str) -> str:
    return f"(8 * ((({_bits(n)}) + 6) // 7))"


_IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE)"
_BM25 = f"{_IDF} * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))"


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM t WHERE term = '{term}')"


def _where(condition: str) -> str:
    return f"WITH {_TOK} SELECT doc_id FROM d WHERE {condition}"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


def _correct(words: str) -> str:
    """CTE c (word, corrected), for the relation words (word)."""
    tri = "unnest(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i::INTEGER, 3)))"
    return f"""
u AS (SELECT DISTINCT word FROM {words}),
qt AS (SELECT word, {tri.format("word")} AS tri, unnest(range(greatest(length(word) - 2, 0))) AS spot FROM u WHERE length(word) >= 3),
vt AS (SELECT DISTINCT term, {tri.format("term")} AS tri FROM v WHERE length(term) >= 3),
cand AS (SELECT word, term, min(spot) AS spot FROM qt JOIN vt USING (tri) GROUP BY word, term),
best AS (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), df DESC, spot, term) AS rn FROM cand JOIN v USING (term)),
c AS (SELECT u.word, coalesce(v.term, best.term) AS corrected FROM u LEFT JOIN v ON v.term = u.word LEFT JOIN best ON best.word = u.word AND rn = 1)"""


def _ranked(rows: dict[int, str], spell: bool) -> str:
    """CTE sc (query_id, doc_id, win, score)."""
    pairs = _values([(q, i, w) for q, text in rows.items() for i, w in enumerate(text.split())])
    fixed = _correct("q0") if spell else "\nc AS (SELECT word, term AS corrected FROM (SELECT DISTINCT word FROM q0) LEFT JOIN v ON term = word)"
    return f"""{_POST},
q0 AS (SELECT * FROM (VALUES {pairs}) AS x(query_id, spot, word)),{fixed},
q AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot) - 1 AS i, corrected AS term, count(*) OVER (PARTITION BY query_id) AS k
      FROM q0 JOIN c USING (word) WHERE corrected IS NOT NULL),
len AS (SELECT doc_id, len(ws) AS length FROM d),
b AS (SELECT query_id, doc_id, any_value(k) AS k, any_value(length) AS length, count(DISTINCT i) AS have, sum({_BM25}) AS bm
      FROM q JOIN v USING (term) JOIN p USING (term) JOIN len USING (doc_id) CROSS JOIN s GROUP BY query_id, doc_id),
o AS (SELECT DISTINCT query_id, i, doc_id, pos FROM q JOIN t USING (term)),
ends AS (SELECT DISTINCT query_id, doc_id, pos AS stop FROM o),
near AS (SELECT e.query_id, e.doc_id, stop, i, max(pos) AS pos FROM ends e JOIN o ON o.query_id = e.query_id AND o.doc_id = e.doc_id AND pos <= stop
         GROUP BY e.query_id, e.doc_id, stop, i),
win AS (SELECT query_id, doc_id, stop - min(pos) + 1 AS w, count(*) AS have FROM near GROUP BY query_id, doc_id, stop),
sc AS (SELECT b.query_id, b.doc_id, coalesce(min(w), 4294967295)::BIGINT AS win,
       3.0::DOUBLE * any_value(k) / coalesce(min(w), 4294967295) + any_value(bm) / any_value(length) AS score
       FROM b LEFT JOIN win ON win.query_id = b.query_id AND win.doc_id = b.doc_id AND win.have = k GROUP BY b.query_id, b.doc_id)"""


def oracle_sql() -> dict[str, str]:
    words = _values([(w,) for w in MISSPELLED])
    prefix = "coalesce(list_max(list_filter(range(1, least(length(term), length(prev)) + 1), lambda i: left(term, i::INTEGER) = left(prev, i::INTEGER))), 0)::INTEGER"
    inner = f"list_sum(list_transform(range(1, len(positions) + 1), lambda i: {_gamma('(positions[i] - coalesce(positions[nullif(i - 1, 0)], 0))')}))"
    found = {
        "tokenize_positions": f"WITH {_TOK} SELECT doc_id, pos, term FROM t",
        "doc_lengths": f"WITH {_TOK} SELECT doc_id, len(ws)::INTEGER AS length FROM d",
        "corpus_stats": f"WITH {_POST} SELECT n, round(avgdl, 6) AS avgdl FROM s",
        "inverted_index": f"WITH {_POST} SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM p",
        "doc_frequency": f"WITH {_POST} SELECT term, df FROM v",
        "vocab_pruned": f"WITH {_POST} SELECT term, df FROM v CROSS JOIN s WHERE df > {MIN_F} AND df <= floor(n * {MAX_P}::DOUBLE)",
        "term_ids": f"WITH {_POST} SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df FROM v",
        "postings_gaps": f"WITH {_GAPS} SELECT term, doc_id, gap FROM g",
        "gamma_code_bits": f"WITH {_GAPS} SELECT term, sum({_gamma('gap')})::BIGINT AS bits FROM g GROUP BY term",
        "vbyte_code_bits": f"WITH {_POST} SELECT term, {_vbyte('df')}::INTEGER AS bits FROM v",
        "term_offsets": f"""WITH {_GAPS}, l AS (SELECT term, (sum({_gamma("gap")} + {_gamma("tf")} + {_vbyte("tf")} + {inner}) + {_vbyte("count(*)")})::BIGINT AS bits FROM g GROUP BY term)
SELECT term, bits, (sum(bits) OVER (ORDER BY term) - bits)::BIGINT AS bit_offset FROM l""",
        "front_coding": f"""WITH {_POST}, o AS (SELECT term, lag(term, 1, '') OVER (ORDER BY term) AS prev FROM v), k AS (SELECT term, {prefix} AS prefix_len FROM o)
SELECT term, prefix_len, substring(term, prefix_len + 1) AS suffix FROM k""",
        "boolean_and": _where(f"{_has('the')} AND {_has('of')}"),
        "boolean_or": _where(f"{_has('les')} OR {_has('der')}"),
        "boolean_not": _where(f"NOT {_has('the')}"),
        "boolean_nested": _where(f"({_has('the')} AND NOT {_has('of')}) OR NOT ({_has('in')} OR {_has('en')})"),
        "boolean_unknown_term": _where(f"{_has('the')} AND NOT {_has('qqqzzz')}"),
        "boolean_sets": f"WITH {_TOK} SELECT doc_id, ({_has('the')} AND {_has('of')}) OR {_has('les')} AS inside FROM d",
        "trigram_index": f"WITH {_POST} SELECT DISTINCT unnest(list_transform(range(1, length(term) - 1), lambda i: substring(term, i::INTEGER, 3))) AS trigram, term FROM v WHERE length(term) >= 3",
        "edit_distance": f"WITH {_POST} SELECT word, term, levenshtein(word, term)::INTEGER AS distance FROM v CROSS JOIN (VALUES {words}) AS x(word)",
        "spell_correct": f"WITH {_POST}, m AS (SELECT * FROM (VALUES {words}) AS x(word)),{_correct('m')} SELECT word, corrected FROM c",
        "idf_weights": f"WITH {_POST} SELECT term, df, round({_IDF}, 9) AS idf FROM v CROSS JOIN s",
        "bm25_scores": f"WITH {_POST}, len AS (SELECT doc_id, len(ws) AS length FROM d) SELECT term, doc_id, round({_BM25}, 6) AS bm25 FROM p JOIN v USING (term) JOIN len USING (doc_id) CROSS JOIN s",
        "min_window": f"WITH {_ranked({0: QUERY}, False)} SELECT doc_id, win AS window FROM sc",
        "free_query_topk": f"WITH {_ranked({0: QUERY}, True)} SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT {K}",
        "free_query_batch": f"""WITH {_ranked(BATCH, True)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {K}""",
        "stored_free_query": f"""WITH {_ranked({0: QUERY}, True)} SELECT doc_id, doc_id::VARCHAR AS path, round(sc.score, 6) AS score, strlen(text)::INTEGER AS n_bytes
FROM sc JOIN (SELECT doc_id, text FROM d) USING (doc_id) ORDER BY sc.score DESC, doc_id LIMIT {K}""",
        "stored_boolean": f"""WITH {_POST}, m AS (SELECT 'thier' AS word),{_correct("m")}
SELECT doc_id, doc_id::VARCHAR AS path, 1.0::DOUBLE AS score FROM d WHERE ({_has("the")} AND NOT {_has("of")}) OR doc_id IN (SELECT doc_id FROM t JOIN c ON term = corrected)""",
        "stored_tables": f"""WITH {_POST}, i AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM v),
g AS (SELECT DISTINCT unnest(list_transform(range(1, length(term) - 1), lambda i: substring(term, i::INTEGER, 3))) AS trigram, term FROM v WHERE length(term) >= 3)
SELECT 'docs' AS name, count(*) AS n, sum(len(ws))::BIGINT AS total FROM d UNION ALL SELECT 'postings', count(*), sum(tf + len(positions))::BIGINT FROM p
UNION ALL SELECT 'vocab', count(*), sum(df + term_id)::BIGINT FROM i UNION ALL SELECT 'trigrams', count(*), sum(length(term))::BIGINT FROM g UNION ALL SELECT 'stats', 1, n FROM s""",
        "code_round_trip": f"""WITH {_POST} SELECT term, {_gamma("df")}::INTEGER AS gamma_bits, {_vbyte("df")}::INTEGER AS vbyte_bits,
({_vbyte("strlen(term)")} + 8 * strlen(term))::INTEGER AS text_bits, df AS from_gamma, df AS from_vbyte, term AS from_text FROM v""",
        "snippets": """SELECT doc_id, CASE WHEN strlen(text) > 150 THEN left(text, list_max(list_filter(range(1, 151), lambda i: strlen(left(text, i)) <= 150))) || '...' ELSE text END AS snippet
FROM documents WHERE doc_id IS NOT NULL""",
        "hits_with_content": f"WITH {_TOK} SELECT doc_id, text AS content, len(ws)::INTEGER AS n_tokens FROM d WHERE {_has('the')} AND NOT {_has('les')}",
        "compat_df_misaligned": f"""WITH {_POST}, f AS (SELECT term, df, row_number() OVER (ORDER BY d0, p0) AS i FROM (
  SELECT term, min(doc_id) AS d0, arg_min(pos, doc_id * 10000000 + pos) AS p0 FROM t GROUP BY term) JOIN v USING (term)),
a AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM v)
SELECT a.term, f.df FROM a JOIN f USING (i)""",
    }
    return found
