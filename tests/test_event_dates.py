"""First ship dates of the events: one aggregate by part, with the same rows as over the written line catalogue."""

import datetime as dt


def test_event_dates_without_the_line_catalogue(spark, tmp_path):
    from oddsforge.sources import testmap as tm

    d = lambda n: dt.datetime(1999, 1, n)
    spark.createDataFrame([(1, 1, 1, d(5)), (1, 2, 1, d(3)), (1, 2, 1, None), (2, 1, 1, None), (None, 1, 1, d(1)), (4, 1, 1, d(9))],
                          "l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "b", "t", "n", 1.0) for k in (1, 1, 2, 3, None)],
                          "p_partkey long, p_brand string, p_type string, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = tm.raw_events(spark, str(tmp_path))
    assert "l_suppkey" not in rows._jdf.queryExecution().executedPlan().toString()
    over_lines = tm.raw_events(spark, str(tmp_path), tm.line_catalogue(spark, str(tmp_path)))
    got, want = (sorted((tuple(r) for r in x.collect()), key=str) for x in (rows, over_lines))
    assert got == want and [r[5] for r in got if r[0] == 1] == [d(3), d(3)]
