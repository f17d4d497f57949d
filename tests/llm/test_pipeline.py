"""The corpus pipeline, and the queries' SQL, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from loomtide.llm import queries

SQL = queries.oracle_sql()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert ids <= set(every)
    texts = [every[i] for i in ids]
    assert len(set(texts)) == len(texts)
    assert {every[i] for i in every if any(c.isalpha() for c in every[i])} >= set(texts)
    assert out.agg({"length": "max"}).first()[0] <= 2048


def test_stage_names_and_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), sf)
        assert empty.columns == corpus_pipeline.COLUMNS and empty.count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))
