import pytest

import __spark_entry__
from skein import queries
from tests.oracle import SMALL, same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), SQL[name])


def test_the_entry_runs(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc_id", "score"] and found.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stemmed_vocabulary_is_smaller(spark):
    assert 0 < queries.stemmed_vocab(spark, SMALL).count() < queries.term_ids(spark, SMALL).count()
    assert queries.free_query_stemmed(spark, SMALL).where("rank = 1").count() >= 6
