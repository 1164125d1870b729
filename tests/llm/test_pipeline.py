"""The pipeline and the registered queries over the driver's smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoprank.llm import contamination, ngram_join, pii, queries
from tests.llm.common import AWKWARD, documents
from tests.llm.test_ngram_join import brute as brute_groups

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def test_all_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@needs_tables
def test_run_equals_the_stages_by_hand(spark):
    docs = queries.table(spark, DIR, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    group = {i: c for i, _, c in brute_groups(rows)}
    clean = {r["doc_id"] for r in contamination.find_matches(docs, queries.table(spark, DIR, "benchmark")).where("not contaminated").collect()}
    want = {i for i in group if group[i] == i and i in clean}            # no text of these tables is without language
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    from shoprank.llm.pieces import coder
    encode = coder(queries.piece_model())
    for r in got[:60]:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == encode(text[r["doc_id"]]) and len(r["ids"]) == r["n_tokens"]


def test_stages_keep_columns_and_take_awkward_rows(spark):
    docs = documents(spark, [(i, t, "en") for i, t in AWKWARD])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, DIR).columns == docs.columns, name
    assert stage(spark, docs, DIR).count() == len(AWKWARD)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(AWKWARD)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    answer = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in answer.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r)) for r in answer.fetchall())


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_give_a_row_for_each_document(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = df.select("doc_id").distinct().count() if "doc_id" in df.columns else df.count()
    assert rows == (queries.table(spark, DIR, "documents").count() if "doc_id" in df.columns else rows) > 0
    assert not [f.name for f in df.schema if f.dataType.typeName() == "void"] and df.where(F.lit(True)).columns == df.columns
