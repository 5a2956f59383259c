"""Hand-made micro tables for the rules of SURVEY §1.3 / §0.1 and the scale helpers."""

import datetime as dt
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsforge.functions.expressions import floor_days_between, lit_ts, weekday_mon0
from oddsforge.operators import behaviour as B
from oddsforge.operators import evaluation as E
from oddsforge.operators.binning import quantile_bins
from oddsforge.operators.ids import dense_index
from oddsforge.operators.joins import catalogue_left_join, first_per_key
from oddsforge.operators.ranking import prefix_sums, top_n


def test_safe_qcut_branches(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 1, 1, 1, 2, 3, 10])], "id int, x double")
    const = spark.createDataFrame([(i, 5.0) for i in range(5)], "id int, x double")
    q = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, x double")
    # duplicate quantile edges -> equal-width bins over [1, 10]
    b = quantile_bins(df, {"b": ("x", 0.0, False)})["b"]
    assert [r.b for r in df.orderBy("id").select(b.alias("b")).collect()] == [1] * 7 + [1, 2, 5]
    # constant -> all 1, reverse not applied
    b = quantile_bins(const, {"b": ("x", 0.0, True)})["b"]
    assert {r.b for r in const.select(b.alias("b")).collect()} == {1}
    # distinct edges -> quintiles, right-closed; reversed
    b = quantile_bins(q, {"b": ("x", 0.0, False)})["b"]
    assert [r.b for r in q.orderBy("id").select(b.alias("b")).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    b = quantile_bins(q, {"b": ("x", 0.0, True)})["b"]
    assert [r.b for r in q.orderBy("id").select(b.alias("b")).collect()] == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]


def test_rfm_segment_precedence(spark):
    df = spark.createDataFrame([("512",), ("214",), ("555",), ("999",), (None,)], "s string")
    got = [r.seg for r in df.select(B.rfm_segment(F.col("s")).alias("seg")).collect()]
    assert got == ["Potential Loyalists", "New Customers", "Champions", "Lost", "Unknown"]


def test_floor_days_and_weekday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 1, 0))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(floor_days_between("a", "b").alias("d"), weekday_mon0("a").alias("w")).collect()[0]
    assert r.d == -1 and r.w == 0     # -6h floors to -1 day; 2024-01-01 is a Monday


def test_first_per_key_null_group_and_order(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (None, 2, "x"), (None, 1, "y")], "k int, o int, v string")
    got = sorted(first_per_key(df, "k", ["o"]).collect(), key=lambda r: (r.k is None, r.k))
    assert [(r.k, r.o, r.v) for r in got] == [(1, 0, "a"), (None, 1, "y")]


def test_catalogue_left_join_equals_left_join(spark):
    cat = spark.createDataFrame([(1, "e1"), (2, "e2"), (None, "e0")], "event_id int, name string")
    facts = spark.createDataFrame([(1, 10.0), (1, 11.0), (3, 5.0)], "event_id int, amount double")
    got = sorted(map(tuple, catalogue_left_join(cat, facts, ["event_id"]).collect()), key=repr)
    ref = sorted(map(tuple, cat.join(facts, "event_id", "left").select("event_id", "name", "amount").collect()), key=repr)
    assert got == ref


def test_dense_index_matches_dense_rank(spark):
    df = spark.range(0, 500).select(((F.col("id") * 7919) % 313).alias("k"))
    got = {r.k: r.idx for r in dense_index(df, "k").collect()}
    keys = sorted(set(r.k for r in df.collect()))
    assert got == {k: i for i, k in enumerate(keys)}
    s = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    assert {r.k: r.idx for r in dense_index(s, "k").collect()} == {"a": 0, "b": 1, "c": 2}


def test_prefix_sums_match_window(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("s"), (F.col("id") % 7).alias("v"))
    got = {r.s: r.cum_v for r in prefix_sums(df, "s", ["v"], inclusive=False).collect()}
    ref = {r.s: r.c for r in df.select("s", F.coalesce(F.sum("v").over(
        Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c")).collect()}
    assert got == ref


def test_top_n_matches_single_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("u"), F.col("id").alias("item"),
                                     ((F.col("id") * 37) % 101).cast("double").alias("score"))
    got = sorted((r.u, r.item, r["rank"]) for r in top_n(df, "u", "score", 5, tie="item").collect())
    w = Window.partitionBy("u").orderBy(F.col("score").desc(), F.col("item"))
    ref = sorted((r.u, r.item, r.r) for r in df.withColumn("r", F.row_number().over(w)).filter("r <= 5").collect())
    assert got == ref


def test_auc_ap_against_brute_force(spark):
    rows = [(float(r), float(p)) for r, p in [(1, .1), (2, .4), (3, .35), (4, .8), (5, .8), (1, .8), (4, .2), (5, .9)]]
    df = spark.createDataFrame(rows, "rating double, prediction double")
    got = E.auc_ap(df).collect()[0]
    med = sorted(r for r, _ in rows)
    med = (med[3] + med[4]) / 2
    lab = [(1 if r > med else 0, p) for r, p in rows]
    pos = [p for y, p in lab if y == 1]
    neg = [p for y, p in lab if y == 0]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in sorted({p for _, p in lab}, reverse=True):
        tp = sum(1 for y, p in lab if p >= s and y == 1)
        fp = sum(1 for y, p in lab if p >= s and y == 0)
        new = sum(1 for y, p in lab if p == s and y == 1)
        ap += new / len(pos) * tp / (tp + fp)
    assert math.isclose(got.auc, auc) and math.isclose(got.avg_precision, ap)


def test_window_fallback_is_global(spark):
    log = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 10.0, 2.0, 1, "a", "m", 0), (2, None, 5.0, 1.5, 0, "b", "m", 1)],
        "user_id long, bet_timestamp timestamp_ntz, bet_amount double, odds_used double, outcome int, "
        "sport string, market_name string, is_live_bet int")
    out = B.user_window_stats(log, "2024-03-01 00:00:00", windows=(7,)).collect()
    assert [(r.user_id, r.bet_count_7d) for r in out] == [(1, 1)]   # empty window -> all dated rows


def test_stream_equals_batch(spark, tmp_path):
    from oddsforge.models import bandit as BD
    from oddsforge.sources import testmap as tm
    from oddsforge.streaming import rewards as ST

    d = "/root/testdata/sf0.001"
    s = {r.action: (r.n, r.reward_sum) for r in ST.run_arm_updates(spark, f"{d}/events.parquet", str(tmp_path)).collect()}
    r = tm.bandit_rewards(spark, d)
    b = {x.action: (x.n, x.reward_sum) for x in BD.update_arms(BD.init_arms(r), r).collect()}
    assert s == b


def test_lit_ts_roundtrip(spark):
    assert spark.range(1).select(lit_ts("2024-01-31 00:00:00").alias("t")).collect()[0].t == dt.datetime(2024, 1, 31)


def test_leaderboard_and_best_models(spark):
    rows = [("a", "auc", 0.7), ("a", "precision_at_5", 0.2), ("a", "diversity", 0.5), ("a", "coverage", 0.1),
            ("a", "mse", 1.0), ("b", "auc", 0.6), ("b", "precision_at_5", 0.5), ("b", "diversity", 0.5),
            ("b", "coverage", 0.3), ("b", "mse", 0.5)]
    m = spark.createDataFrame(rows, "model string, metric string, value double")
    lb = E.compare_models(m).collect()
    assert [r.model for r in lb] == ["b", "a"]
    assert math.isclose(lb[0].composite_score, 0.4 * 0.6 + 0.3 * 0.5 + 0.2 * 0.5 + 0.1 * 0.3)
    best = {r.metric: r.best_model for r in E.best_models(m).collect()}
    assert best == {"auc": "a", "precision_at_5": "b", "mse": "b"}


def test_stratified_split_exact_counts(spark):
    from oddsforge.sources.sinks import stratified_split

    df = spark.range(0, 1003).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = stratified_split(df, "y", ["k"]).collect()
    assert len(out) == 1003 and len({r.k for r in out}) == 1003
    for y in (0, 1):
        n = sum(1 for r in out if r.y == y)
        t = sum(1 for r in out if r.y == y and r.split == "test")
        v = sum(1 for r in out if r.y == y and r.split == "val")
        assert t == round(0.2 * n) and v == round(0.25 * (n - t))


def test_dense_index_many_string_keys(spark):
    df = spark.range(0, 3000).select(F.format_string("k%05d", (F.col("id") * 7919) % 1009).alias("k"))
    got = {r.k: r.idx for r in dense_index(df, "k").collect()}
    keys = sorted(got)
    assert got == {k: i for i, k in enumerate(keys)} and len(keys) == 1009


def test_content_recommendations_match_brute_force(spark):
    from pyspark.ml.functions import array_to_vector
    from oddsforge.models import content as CT
    from oddsforge.sources.tables import read_table

    d = "/root/testdata/sf0.001"
    emb = read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id")
    n_vec = emb.count()
    ratings = read_table(spark, d, "events").select("user_id", (F.col("event_id") % n_vec).alias("item_id"),
                                                    (F.col("value") / 100.0).alias("rating"))
    prof = CT.user_profiles(ratings, emb)
    pairs = CT.training_pairs(ratings.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating")), prof, emb)
    model = CT.fit_scorer(pairs)
    got = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in CT.recommend_all(model, prof, emb, 5, block=40).collect()}
    # brute force: every user × every item through the fitted model (fixture only)
    product = F.zip_with("profile", "v", lambda p, x: p * x)
    allp = (CT.profile_arrays(prof).crossJoin(emb.select("item_id", F.col("embedding").cast("array<double>").alias("v")))
            .select("user_id", "item_id", array_to_vector(F.concat("profile", "v", product)).alias("features")))
    scored = {(r.user_id, r.item_id): r.prediction for r in model.transform(allp).collect()}
    w = Window.partitionBy("user_id").orderBy(F.col("prediction").desc(), F.col("item_id"))
    ref = {(r.user_id, r.r): r.prediction for r in model.transform(allp).withColumn("r", F.row_number().over(w))
           .filter("r <= 5").collect()}
    assert got.keys() == ref.keys()
    for (user, rank), (item, score) in got.items():
        assert abs(score - ref[user, rank]) < 1e-9 and abs(score - scored[user, item]) < 1e-9
    lists = {}
    for (user, rank), (item, _) in sorted(got.items()):
        lists.setdefault(user, []).append(item)
    assert len(set(map(tuple, lists.values()))) > 1       # users get lists of their own


def test_user_without_known_items_has_a_zero_profile(spark):
    from oddsforge.models import content as CT

    items = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0])], "item_id long, embedding array<double>")
    ratings = spark.createDataFrame([(10, 1, 1.0), (10, 2, 3.0), (10, 9, 5.0), (20, 9, 4.0)], "user_id long, item_id long, rating double")
    got = {r.user_id: r.profile for r in CT.profile_arrays(CT.user_profiles(ratings, items)).collect()}
    assert got == {10: [2.5, 4.5], 20: [0.0, 0.0]}


def test_exact_quantiles(spark):
    import numpy as np

    from oddsforge.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(float(v), None, 7.0) for v in x] + [(None, None, None)], "a double, b double, c double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {c: F.col(c) for c in "abc"}, probs)
    assert np.allclose(got["a"], np.quantile(x, probs)) and got["b"] == [None] * 5 and got["c"] == [7.0] * 5


def test_combined_view_equals_the_two_views(spark):
    from oddsforge.operators import hierarchy as H

    ev = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "event_id long, sport string")
    mk = spark.createDataFrame([(10, 1, "win"), (11, 1, "win"), (20, 2, "win")], "market_id long, event_id long, market_name string")
    oc = spark.createDataFrame([(100, 10, "x"), (101, 11, "x"), (102, 20, "y")], "outcome_id long, market_id long, outcome_name string")
    bets = spark.createDataFrame([(1, 7, 1, 500, 5.0, "win", "x"), (1, 8, 2, 501, 6.0, "win", "q"), (2, 7, 2, 502, 1.0, "win", "none"), (3, 9, 9, 503, 2.0, "win", "x"),
                                  (4, 9, 1, 504, 2.0, "lose", "x")],
                                 "bet_id long, user_id long, event_id long, outcome_id long, bet_amount double, market string, outcome_label string")
    us = spark.createDataFrame([(7, "FR"), (8, "DE")], "user_id long, user_country string")
    cat = H.events_markets_outcomes(ev, mk, oc)
    two = H.combine_views(H.with_users(H.classic_view(cat, bets), us), H.with_users(H.direct_view(ev, bets), us))
    one = H.combined_view(ev, mk, oc, bets, us)
    cols = sorted(two.columns)
    assert sorted(one.columns) == cols
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert rows(one) == rows(two)


def test_fill_in_order(spark):
    from oddsforge.operators.prep import fill_in_order

    rows = [(i, None if i % 7 else float(i)) for i in range(3, 400)]
    df = spark.createDataFrame(rows, "i long, x double").repartition(9)
    got = {r.i: r.x for r in fill_in_order(df, ["x"], ["i"]).collect()}
    assert got == {i: float(max(i - i % 7, 7)) for i in range(3, 400)}


def test_checkpoint_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from oddsforge.session import checkpoint_dir

    undefined = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k, d: None),
                         _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)))
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))


def test_entry_needs_no_jar_and_no_session():
    import os
    import subprocess
    import sys

    code = ("import glob; glob.glob = lambda *a, **k: []\n"
            "import __spark_entry__ as e; from pyspark.sql import SparkSession\n"
            "assert e.queries() and e.oracle_sql() and SparkSession.getActiveSession() is None")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_old_events_leave_the_s2_query_alone(spark, monkeypatch):
    from oddsforge.plans import domain as D
    from oddsforge.sources import testmap as tm
    rows = [(1, "s", dt.datetime(1950, 1, 1), "finished"), (2, "s", dt.datetime.fromisoformat(str(tm.BETS_AS_OF)), "live"), (3, "s", dt.datetime(1950, 1, 1), "void")]
    raw = spark.createDataFrame(rows, "event_id long, sport string, event_start_time timestamp, event_status string")
    monkeypatch.setattr(tm, "raw_events", lambda *_: raw)
    assert sorted(r["event_id"] for r in D.events(spark, "").collect()) == [1, 2]
    assert [r["event_id"] for r in D.recent_events(spark, "").collect()] == [2]


def _small_hierarchy(spark):
    ev = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "event_id long, sport string")
    mk = spark.createDataFrame([(10, 1, "Win "), (10, 2, "Draw"), (20, 2, "win")], "market_id long, event_id long, market_name string")
    oc = spark.createDataFrame([(100, 10, "x"), (102, 20, "y")], "outcome_id long, market_id long, outcome_name string")
    bets = spark.createDataFrame([(1, 7, 1, 500, 5.0, 2.0, "win", "x"), (1, 8, 2, 501, 6.0, 2.0, "win", "q"), (2, 7, 2, 502, 1.0, 3.0, "win", "none"),
                                  (3, 9, 9, 503, 2.0, 2.0, "win", "x"), (None, 9, 2, 504, 2.0, 2.0, "win", "y"), (5, None, 2, 505, 2.0, 2.0, None, "y")],
                                 "bet_id long, user_id long, event_id long, outcome_id long, bet_amount double, odds_used double, market string, outcome_label string")
    us = spark.createDataFrame([(7, "FR"), (8, "DE")], "user_id long, user_country string")
    odds = spark.createDataFrame([(100, 1.5), (502, 2.5)], "outcome_id long, odds_value double").selectExpr("*", "timestamp_ntz'2001-01-01' as timestamp")
    return ev, mk, oc, bets, us, odds


def test_hierarchy_writes_no_event_columns(spark, monkeypatch):
    from oddsforge import session
    from oddsforge.operators import hierarchy as H

    written, write = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df, *a: written.extend(df.columns) or write(df, *a))
    full = H.build_hierarchy(*_small_hierarchy(spark), "2001-12-01 00:00:00")
    assert {r["bet_id"]: r["sport"] for r in full.collect()} == {1: "a", 2: "b", 5: "b", None: "b"}
    assert written and "sport" not in written


def test_hierarchy_equals_the_two_views_step_by_step(spark):
    from oddsforge.operators import hierarchy as H

    ev, mk, oc, bets, us, odds = _small_hierarchy(spark)
    mk, oc, bt = (H.clean_text_keys(t, H.TEXT_KEYS[k]) for k, t in (("markets", mk), ("outcomes", oc), ("bets", bets)))
    cat = H.events_markets_outcomes(ev, mk, oc)
    two = H.combine_views(H.with_users(H.classic_view(cat, bt), us), H.with_users(H.direct_view(ev, bt), us))
    want = H.with_hierarchy_aggregates(H.with_odds(H.temporal_features(two, "2001-12-01 00:00:00"), odds))
    got = H.build_hierarchy(ev, mk, oc, bt, us, odds, "2001-12-01 00:00:00")
    rows = lambda df: sorted(map(tuple, df.select(*sorted(want.columns)).collect()), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_catalogue_left_join_runs_the_matched_join_once(spark):
    from oddsforge.operators.joins import catalogue_left_join

    cat = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, x string")
    facts = spark.createDataFrame([(1, 5), (1, 6), (9, 7), (None, 8)], "k long, y long")
    got = catalogue_left_join(cat, facts, ["k"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", 5), (1, "a", 6), (2, "b", None), (None, "c", None)], key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Join LeftAnti") == 1


def test_hierarchy_moves_rows_once_for_events_and_markets(spark):
    from oddsforge.operators import hierarchy as H

    ev, mk, oc, bt, us, odds = _small_hierarchy(spark)
    full = H.build_hierarchy(ev, mk, oc, bt, us, odds, "2001-12-01 00:00:00")
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan                       # no aggregate moves copies of every row
    moved = [line for line in plan.split("\n") if "RepartitionByExpression [event_id" in line]
    assert any("Union" in plan.split("\n")[i + 1] for i, line in enumerate(plan.split("\n")) if line in moved)
    cols = ["user_id", "event_id", "bet_amount", "market_name", "sport", "user_country", "market_volume", "num_outcomes"]
    few = H.build_hierarchy(ev, mk, oc, bt, us, odds, "2001-12-01 00:00:00", columns=cols).select(*cols)
    key = lambda r: str(tuple(r))
    assert sorted(few.collect(), key=key) == sorted(full.select(*cols).collect(), key=key)
