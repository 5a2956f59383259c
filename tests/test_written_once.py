"""Steps that were moved or computed several times: their plans, and their results on rows with repeated and null keys."""

import time

from pyspark.sql import functions as F


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_profiles_move_no_wide_sums(spark):
    from oddsforge.models import content as CT

    items = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0]), (None, [9.0, 9.0])], "item_id long, embedding array<double>")
    ratings = spark.createDataFrame([(10, 1, 0.5), (10, 1, 0.5), (10, 2, 3.0), (20, 9, 4.0), (30, None, 1.0)],
                                    "user_id long, item_id long, rating double")
    prof = CT.user_profiles(ratings, items)
    assert {(r.user_id, r.dim): r.value for r in prof.collect()} == {
        (10, 0): 2.5, (10, 1): 4.5, (20, 0): 0.0, (20, 1): 0.0, (30, 0): 0.0, (30, 1): 0.0}
    lines = plan(CT.user_profiles(ratings, items))
    moved = [b for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning(user_id" in a]
    assert moved and not any("partial_sum((w" in x for x in moved)


def test_large_item_tables_are_joined_by_item(spark, monkeypatch):
    from oddsforge.models import content as CT

    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "item_id long, embedding array<double>")
    ratings = spark.createDataFrame([(u, (u * 7 + k) % 45, 1.0 + k) for u in range(30) for k in range(5)], "user_id long, item_id long, rating double")

    def both():
        prof = CT.user_profiles(ratings, items)
        pairs = CT.training_pairs(ratings.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating")), prof, items)
        return [sorted((tuple(r) for r in x.collect()), key=str) for x in (prof, pairs)]

    small = both()
    monkeypatch.setattr(CT, "ITEM_VALUES", 10)
    assert both() == small and len(small[1]) == 135


def test_training_pairs_are_not_computed_by_each_read(spark):
    from oddsforge.models import content as CT

    items = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0])], "item_id long, embedding array<double>")
    ratings = spark.createDataFrame([(10, 1, 1.0), (10, 2, 3.0), (20, 2, 4.0)], "user_id long, item_id long, rating double")
    pairs = CT.training_pairs(ratings.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating")), CT.user_profiles(ratings, items), items)
    assert not any("Aggregate" in x for x in plan(pairs))
    assert sorted((r.user_id, r.item_id, r.rating, len(r.features)) for r in pairs.collect()) == [(10, 1, 1.0, 6), (10, 2, 3.0, 6), (20, 2, 4.0, 6)]


def _folders(spark):
    import glob
    import os

    from oddsforge.session import checkpoint_dir

    return set(glob.glob(os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables", "*")))


def test_a_written_table_leaves_no_shuffle_files(spark):
    from oddsforge import session

    before, blocks = spark.conf.get(session.SHUFFLE_CLEANUP), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in blocks.getAllFiles().mkString("|").split("|") if "shuffle_" in x}
    old = shuffles()
    table = session.cut_lineage(spark.range(1000).repartition(7).groupBy((F.col("id") % 13).alias("k")).count())
    for _ in range(100):
        if shuffles() <= old:
            break
        time.sleep(0.1)
    assert shuffles() <= old
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == before and table.agg(F.sum("count")).first()[0] == 1000


def test_released_tables_are_deleted(spark):
    from oddsforge import session

    old = _folders(spark)
    table = session.cut_lineage(spark.range(10))
    assert len(_folders(spark) - old) == 1
    session.release(table, None, spark.range(1))
    assert not _folders(spark) - old


def _repeated(spark):
    from oddsforge.operators import hierarchy as H

    ev = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "event_id long, sport string")
    mk = spark.createDataFrame([(10, 1, "win"), (10, 2, "draw"), (20, 2, "win")], "market_id long, event_id long, market_name string")
    oc = spark.createDataFrame([(100, 10, "x"), (102, 20, "y")], "outcome_id long, market_id long, outcome_name string")
    bets = spark.createDataFrame([(1, 7, 1, 500, 5.0, 2.0, "win", "x"), (1, 8, 2, 501, 6.0, 2.0, "win", "q"), (2, 7, 2, 502, 1.0, 3.0, "win", "none"),
                                  (None, 9, 2, 504, 2.0, 2.0, "win", "y"), (5, None, 2, 505, 2.0, 2.0, None, "y"), (6, 8, 2, 505, 2.0, 2.0, "win", "y")],
                                 "bet_id long, user_id long, event_id long, outcome_id long, bet_amount double, odds_used double, market string, outcome_label string")
    us = spark.createDataFrame([(7, "FR"), (7, "IT"), (7, "IT"), (8, "DE"), (None, "XX"), (None, "YY")], "user_id long, user_country string")
    odds = spark.createDataFrame([(100, 1.5), (502, 2.5)], "outcome_id long, odds_value double").selectExpr("*", "timestamp_ntz'2001-01-01' as timestamp")
    return lambda **k: H.build_hierarchy(ev, mk, oc, bets, us, odds, "2001-12-01 00:00:00", **k)


def test_rows_of_repeated_users_without_user_columns(spark):
    build, key = _repeated(spark), lambda r: str(tuple(r))
    full = build()
    for cols in (["bet_id", "user_id", "event_id", "bet_amount"], ["bet_id", "user_id", "market_name", "total_volume", "market_volume"], ["bet_id", "user_country"]):
        few = build(columns=cols).select(*cols)
        want = full.select(*cols)
        assert sorted(few.collect(), key=key) == sorted(want.collect(), key=key) and few.filter("bet_id = 2").count() == 3, cols


def test_hierarchy_keeps_only_the_tables_that_it_reads(spark, monkeypatch):
    from oddsforge import session

    wrote, write = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df, *a: wrote.append(1) or write(df, *a))
    old = _folders(spark)
    full = _repeated(spark)()
    kept = _folders(spark) - old
    assert len(wrote) > len(kept)
    assert all(any(k in f for f in full.inputFiles()) for k in kept)
    assert full.count() == full.count() > 0


def test_ngram_join_keeps_no_table_of_keys(spark):
    from oddsforge.llm.ngram_join import similar_documents

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 3 :])) for i in range(6)] + [(6, None), (7, "a b")], "doc_id long, text string")
    old = _folders(spark)
    got = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7}
    kept = [spark.read.parquet(x).columns for x in _folders(spark) - old]
    assert kept and not any("keys" in c for c in kept)
