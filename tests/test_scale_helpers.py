"""Operators that spread hot keys or count instead of pairing, against brute force."""

import datetime as dt
import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsforge.operators import evaluation as E
from oddsforge.operators import hierarchy as H
from oddsforge.operators import prep as PR
from oddsforge.operators import training as TR
from oddsforge.sources import sinks as SK


def test_forward_fill_of_a_hot_key(spark):
    """Half of all rows in one key: equal to one window, and no task gets more than twice its share."""
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, None, *range(20, 40)]) if i % 2 else 7, i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i) if rng.random() < 0.02 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, o int, t timestamp").repartition(5)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.k, r.o): r.t for r in df.withColumn("t", F.last("t", ignorenulls=True).over(w)).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = PR.forward_fill(df, "t", ["k"], ["o"], shares=16)
        assert out.columns == df.columns
        assert {(r.k, r.o): r.t for r in out.collect()} == want
        laid = df.repartitionByRange(16 * 8, "k", "o").withColumn("part", F.spark_partition_id())
        tasks = laid.repartition(8, "part", "k").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) <= 2 * 6000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert PR.forward_fill(df.limit(0), "t", ["k"], ["o"]).count() == 0


def test_bounded_sample_is_the_first_by_hash(spark):
    rows = [(i % 900, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b int")
    for n, border in ((1000, 10_000), (1000, 1), (1, 1), (4999, 5)):
        got = sorted(map(tuple, SK.bounded_sample(df, ["a", "b"], n, border=border).collect()))
        want = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|{r[1]}|42".encode()).hexdigest(), r))[:n]
        assert got == sorted(want)
    assert SK.bounded_sample(df, ["a", "b"], 5000).count() == 5000 and SK.bounded_sample(df.limit(0), ["a"], 5).count() == 0


def test_split_keeps_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id long, label int")
    out = SK.stratified_split(df, "label", ["id"]).collect()
    assert sorted(r["id"] for r in out) == list(range(50))
    for label in (None, 0, 1):
        own = [r for r in out if r["label"] == label]
        test = sum(r["split"] == "test" for r in own)
        assert test == round(0.2 * len(own)) and sum(r["split"] == "val" for r in own) == round(0.25 * (len(own) - test))


def test_latest_features_of_one_time(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 5, t), (1, 9, t), (1, 7, t - dt.timedelta(days=1)), (2, None, t)], "user_id int, x int, feature_timestamp timestamp_ntz")
    got = {r["user_id"]: r["x"] for r in SK.latest_features(df, ["user_id"], "2024-01-02 00:00:00", 30).collect()}
    assert got == {1: 9, 2: None}


def test_list_distance_over_all_users(spark):
    rng = random.Random(2)
    rows = []
    for user in range(90):
        size = rng.choice([1, 3, 5, 5, 6])
        items = set(rng.sample(range(12), size)) | ({99} if user % 3 == 0 else set())
        rows += [(user, i) for i in (items if user % 10 else {1, 2, 3})]
    recs = spark.createDataFrame(rows + rows[:20], "user_id int, item_id int")
    lists = {}
    for u, i in rows:
        lists.setdefault(u, set()).add(i)
    want = np.mean([1 - len(a & b) / len(a | b) for a, b in itertools.combinations(lists.values(), 2)])
    distance, users = E.mean_list_distance(recs, "user_id", "item_id")
    assert users == 90 and abs(distance - want) < 1e-12
    assert E.mean_list_distance(recs.filter("user_id = 1"), "user_id", "item_id") == (0.0, 1)
    assert E.mean_list_distance(recs.limit(0), "user_id", "item_id") == (0.0, 0)
    row = E.diversity_metrics(recs, recs).first()
    assert abs(row["inter_user_diversity"] - want) < 1e-9 and row["n_users_compared"] == 90


def test_preparation_from_one_count_table(spark):
    """The chain fitted on counted values gives what its steps give one after the other."""
    rng = np.random.default_rng(3)
    inf = float("inf")
    rows = []
    for i in range(400):
        rows.append((i, None if i % 6 == 0 else float(rng.normal()) * 10, inf if i % 9 == 0 else -inf if i % 50 == 0 else float(rng.integers(0, 5)), 4.0, None,
                     None if i % 3 else inf, float("nan") if i % 8 == 0 else float(i)))
    cols = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, f double")
    for clip in (False, True):
        step = PR.impute(df, "smart", numeric=cols, categorical=[])
        step = step.select("id", *[F.when(F.abs(F.col(c)) == inf, F.lit(None)).otherwise(F.col(c)).alias(c) for c in cols])
        step = PR.impute(step, "smart", numeric=cols, categorical=[])
        step = PR.clip_outliers_iqr(step, cols) if clip else step
        want = {r["id"]: r for r in PR.replace_nonfinite(PR.robust_scale(step, cols), cols, nan=0.0, pos=1.0, neg=-1.0).collect()}
        maps = TR.fit_preparation(df, cols, clip)
        got = TR.apply_preparation(df, maps).collect()
        assert all(abs(r[c] - want[r["id"]][c]) < 1e-9 for r in got for c in cols)


def test_event_vectors_are_sparse(spark):
    from oddsforge.operators.events import event_vectors

    long = spark.createDataFrame([(1, "a", 2.0), (1, "c", 0.0), (1, "d", -1.0), (2, "b", 3.0), (3, "c", 0.0)], "event_id long, feature string, value double")
    got = {r["event_id"]: r["features"] for r in event_vectors(long).collect()}
    assert {k: (v.size, list(v.indices), list(v.values)) for k, v in got.items()} == {1: (4, [0, 3], [2.0, -1.0]), 2: (4, [1], [3.0]), 3: (4, [], [])}


def test_repeated_catalogue_rows_give_one_defined_row(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, None, 1), (2, "x", 0)], "event_id int, sport string, n int").repartition(4)
    assert sorted(map(tuple, H.first_payload(df, ["event_id"]).collect())) == [(1, None, 1), (2, "x", 0)]


def test_quantiles_of_few_values_equal_those_by_buckets(spark, monkeypatch):
    from oddsforge.operators import quantiles as QT

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i)) for i, v in enumerate(np.round(rng.normal(size=2000), 2))] + [(float("nan"), None)], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    direct = QT.exact_quantiles(df, {c: F.col(c) for c in "ab"}, probs)
    monkeypatch.setattr(QT, "FEW", 10)
    assert str(QT.exact_quantiles(df, {c: F.col(c) for c in "ab"}, probs)) == str(direct)
