import os

import pytest

import __spark_entry__ as entry
from textquarry.plans import queries as plan_queries
from textquarry.plans import sql as plan_sql

SMALL = "/root/testdata/sf0.001"


def test_names():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(plan_queries.queries()) >= 50
    without = {"stemmed_vocabulary", "loaded_corpus", "lsa_singular_values", "lsa_search", "topic_terms", "discriminants", "word_vector_documents", "cnn_documents", "labelled_evaluation"}
    assert set(plan_queries.queries()) - set(plan_sql.oracle_sql()) == without


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "doc_id", "cosine", "rank"] and rows.count() > 0


def test_stemmed_vocabulary_reads_texts(spark, tmp_path):
    rows = [(1, "Дом", "Река"), (2, None, "Река"), (3, "Дом", None)]
    spark.createDataFrame(rows, "row_id long, title string, text string").write.parquet(f"{tmp_path}/lenta.parquet")
    assert sorted(r["n"] for r in plan_queries.stemmed_vocabulary(spark, str(tmp_path)).collect()) == [2, 2]
