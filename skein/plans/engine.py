"""The search engine: an index, and queries over it."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, snippet
from ..operators import boolean, ranking, spelling
from ..operators.index import Index, store

BOOLEAN_PREFIX = "b: "
CACHED = 10
MOST_HITS = 100


@dataclass
class Answer:
    """The tokens of a query, its hits (doc_id, path, score) in order, and how long it took."""

    query: list[str]
    documents: list[Row]
    time_ms: int


class Engine:
    """Boolean and free-text search over an Index."""

    def __init__(self, index: Index, source: DataFrame | None = None, compat: bool = False):
        self.index, self.source, self.compat = index, source, compat
        self._answers: OrderedDict[str, Answer] = OrderedDict()
        # read once for all queries; what doesn't fit the executors' memory is read again from their disks
        self._kept = [t.persist(StorageLevel.MEMORY_AND_DISK) for t in (index.vocab, index.docs, index.stats)]

    def close(self) -> None:
        """Give back the memory of the tables that are kept."""
        for table in self._kept:
            table.unpersist()

    @classmethod
    def build(cls, docs: DataFrame, base: str, analyzer: Analyzer | None = None, max_p: float = 1.0, min_f: int = 0) -> Engine:
        """Index (doc_id, path, text), store the index under base and serve from there."""
        analyzer = analyzer or Analyzer()
        store(docs, base, analyzer, max_p, min_f)
        return cls.load(docs.sparkSession, base, docs, analyzer)

    @classmethod
    def load(cls, spark: SparkSession, base: str, source: DataFrame | None = None, analyzer: Analyzer | None = None) -> Engine:
        return cls(Index.load(spark, base, analyzer), source)

    def correction(self, words: list[str]) -> dict[str, str | None]:
        spark = self.index.docs.sparkSession
        asked = spark.createDataFrame([(w,) for w in words], "word string")
        return {r.word: r.corrected for r in spelling.correct(asked, self.index.vocab, self.index.trigrams, self.compat).collect()}

    def boolean_query(self, query: str, analyze_operands: bool = False) -> DataFrame:
        """(doc_id, path, score) of every document that satisfies the query, by doc_id; score is 1.

        Operands are spelling-corrected but taken as they stand; with analyze_operands they are lower-cased and stemmed first.
        """
        tokens = boolean.postfix(query)
        words = boolean.operands(tokens)
        stems = {w: w for w in words}
        if analyze_operands:
            spark = self.index.docs.sparkSession
            made = spark.createDataFrame([(w,) for w in words], "word string").select("word", self.index.analyzer.terms(F.col("word"))[0].alias("term"))
            stems = {r.word: r.term for r in made.collect()}
        fixed = self.correction([s for s in stems.values() if s is not None])
        terms = {w: fixed.get(stems[w]) for w in words}
        hits = boolean.select(self.index.postings, self.index.docs, tokens, terms)
        return hits.join(self.index.docs.select("doc_id", "path"), "doc_id").select("doc_id", "path", F.lit(1.0).alias("score")).orderBy("doc_id")

    def free_query(self, query: str, k: int = MOST_HITS) -> DataFrame:
        return ranking.free_query(query, self.index, k, compat=self.compat)

    def tokens(self, query: str) -> list[str]:
        """The corrected terms of a free query, in order."""
        asked = self.index.docs.sparkSession.createDataFrame([(0, query)], "query_id bigint, text string")
        return [r.term for r in ranking.query_terms(asked, self.index, compat=self.compat).orderBy("i").collect()]

    def search(self, query: str) -> Answer:
        """The answer to a query; one that begins with 'b: ' is boolean. The last CACHED answers are kept, times included."""
        if query in self._answers:
            self._answers.move_to_end(query)
            return self._answers[query]
        start = time.perf_counter()
        if query.startswith(BOOLEAN_PREFIX):
            text = query[len(BOOLEAN_PREFIX) :]
            tokens, found = boolean.postfix(text), self.boolean_query(text)
        else:
            terms = ranking.asked(query, self.index, compat=self.compat)
            tokens, found = [r.term for r in terms.orderBy("i").collect()], ranking.best_of(terms, self.index, MOST_HITS)
        documents = found.collect()
        answer = Answer(tokens, documents, round(1000 * (time.perf_counter() - start)))
        self._answers[query] = answer
        while len(self._answers) > CACHED:
            self._answers.popitem(last=False)
        return answer

    def with_content(self, hits: DataFrame) -> DataFrame:
        """The hits with the text and the snippet of each; a document that the source lacks has nulls."""
        if self.source is None:
            raise ValueError("the engine was loaded without its source")
        return hits.join(self.source.select("doc_id", F.col("text").alias("content")), "doc_id", "left").withColumn("snippet", snippet(F.col("content")))
