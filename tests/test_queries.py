"""Every core query against its SQL on the smallest tables, and the entry file's contract."""

import pytest
from oracle import same

import __spark_entry__ as entry
from partita.plans import array_queries, corpus_queries, extra_queries, join_queries, label_queries, model_queries, problems, score_queries, sequence_queries

MODULES = (array_queries, corpus_queries, extra_queries, join_queries, label_queries, model_queries, problems, score_queries, sequence_queries)
CORE = {k: (m.QUERIES[k], m.SQL.get(k)) for m in MODULES for k in m.QUERIES}


@pytest.mark.parametrize("name", sorted(k for k, (_, s) in CORE.items() if s))
def test_query_equals_sql(spark, sf, name):
    f, sql = CORE[name]
    same(f(spark, sf), sql, sf)


@pytest.mark.parametrize("name", sorted(k for k, (_, s) in CORE.items() if not s))
def test_query_has_rows(spark, sf, name):
    assert CORE[name][0](spark, sf).count() > 0


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
