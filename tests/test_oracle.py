"""Every registered query against its DuckDB oracle on sf0.001 (the driver uses sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from oddsforge.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
FAST = ["s1_load_users", "s3_load_bets", "f20_user_behaviour_rfm", "w2_empty_window_fallback", "u1_w1_combined_dedup",
        "f12_composite_ratings", "f13_w6_rating_matrix", "q6_table_profile", "e3_e4_auc_average_precision",
        "e6_e8_ranking_metrics", "m19_ucb_scores", "f1_impute_smart", "f4_u5_label_encode",
        "f5_document_tfidf", "f16_a7_a8_market_features", "j6_strict_hierarchy", "e13_compare_models"]


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        return ("~nan",) if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_declared():
    from oddsforge.plans.registry import ORACLE, QUERIES, ROWS_ONLY

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE) == set(ROWS_ONLY) and all(ROWS_ONLY.values())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "user_segment" in df.columns
