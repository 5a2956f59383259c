"""The registered training-data queries against their SQL, and which of them have none."""

import duckdb
import pytest

from oddsforge.llm.queries import ORACLE, QUERIES, ROWS_ONLY

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql_or_a_reason():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == set(ROWS_ONLY) and all(ROWS_ONLY.values())


@pytest.mark.parametrize("name", ["op12_phrase_collocations", "op13_filter_interaction_audit"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(map(tuple, cur.fetchall()))
