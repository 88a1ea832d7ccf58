"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

import re

import duckdb
import pytest

import corpus_pipeline
from scriptorium.llm import bpe, queries, quality
from tests.llm.test_operators import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    made = queries.queries()[name](spark, SF)
    names = sorted(made.columns)
    told = con.sql(queries.oracle_sql()[name])
    at = [told.columns.index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in made.collect()) == sorted(tuple(r[i] for i in at) for r in told.fetchall())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    first, good, single, hidden, mixed, encoded = seen
    assert all(set(x.columns) == set(docs.columns) for x in seen[1:-1])
    kept = {r.doc_id for r in quality.measures(first).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    groups = components([(r.doc_id, r.text) for r in good.collect()], 80)
    assert {r.doc_id for r in single.collect()} == {root for _, root in groups.values()}
    assert {r.doc_id for r in hidden.collect()} == {r.doc_id for r in single.collect()}
    assert not any(re.search(r"password=\w{8}|AKIA[A-Z0-9]{12}", r.text) for r in hidden.collect())
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in hidden.collect()}
    own = bpe.encoder(*bpe.public_vocabulary())
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert encoded.count() == mixed.count()
    assert all(own.decode(bytes(r.ids)) == text[r.doc_id].encode() for r in encoded.collect())
