"""The corpus pipeline against its stages' brute-force results, and the SQL of the queries that have one."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oddsforge.llm import queries

from .test_native import brute_leaks, brute_lines
from .test_search import brute_groups

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {i for i, t in rows if any(c.isalpha() for c in t or "")} - set(left) == set()

    lines = brute_lines(sorted(left.items()))
    got = corpus_pipeline.dedup_lines(spark, kept, SF)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {i: t for i, _, _, t in lines}

    groups = brute_groups(sorted(texts.items()), 5)
    near = corpus_pipeline.dedup_near(spark, got, SF)
    assert near.columns == docs.columns
    left = {r["doc_id"] for r in near.collect()}
    assert left == {i for i, _, _, keep in groups if keep}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute_leaks([(i, texts[i]) for i in left], items)}
    clean = corpus_pipeline.decontaminate_benchmark(spark, near, SF)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == left - bad

    out = corpus_pipeline.encode(spark, clean, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(left - bad)


def test_stages_on_nulls_and_nothing(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "some words here"), (3, "some words there"), (3, "some words there")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), SF).count() == 0, name
