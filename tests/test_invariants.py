"""Invariants for the rows-only operators and a plan guard (§5.5)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_ratings_in_range_and_dense_indices(spark):
    coo = entry.queries()["f13_w6_rating_matrix"](spark, SF)
    r = coo.agg(F.min("rating"), F.max("rating"), F.max("user_idx"), F.countDistinct("user_id"),
                F.max("event_idx"), F.countDistinct("event_id")).collect()[0]
    assert 0.0 <= r[0] <= r[1] <= 5.0
    assert r[2] == r[3] - 1 and r[4] == r[5] - 1


def test_top_n_lists_are_bounded_sorted_unique(spark):
    recs = entry.queries()["w8_top_n_recommendations"](spark, SF).collect()
    by_user = {}
    for x in recs:
        by_user.setdefault(x.user_id, []).append(x)
    for rows in by_user.values():
        ranks = sorted(r["rank"] for r in rows)
        assert ranks == list(range(1, len(rows) + 1)) and len(rows) <= 20
        assert len({r.item_id for r in rows}) == len(rows)


def test_ndcg_and_precision_bounds(spark):
    m = entry.queries()["e6_e8_ranking_metrics"](spark, SF).collect()
    assert {r.k for r in m} == {5, 10, 20}
    for r in m:
        assert 0.0 <= r.ndcg <= 1.0 and 0.0 <= r.precision <= 1.0 and 0.0 <= r.recall <= 1.0


def test_als_beats_global_mean_on_training(spark):
    from oddsforge.models import mf as MF
    coo = entry.queries()["f13_w6_rating_matrix"](spark, SF)
    ratings = coo.select("user_idx", F.col("event_idx").alias("item_idx"), "rating")
    model = MF.fit(ratings, rank=8, max_iter=10)
    pred = MF.predict(model, ratings)
    rmse_model = pred.agg(F.sqrt(F.avg((F.col("score") - F.col("rating")) ** 2))).collect()[0][0]
    mean = ratings.agg(F.avg("rating")).collect()[0][0]
    rmse_mean = ratings.agg(F.sqrt(F.avg((F.col("rating") - F.lit(mean)) ** 2))).collect()[0][0]
    assert rmse_model < rmse_mean


def test_bandit_selects_exactly_one_arm(spark):
    rows = entry.queries()["m19_ucb_scores"](spark, SF).collect()
    assert sum(r.selected for r in rows) == 1


@pytest.mark.parametrize("name", ["f20_user_behaviour_rfm", "f21_hierarchy", "f13_w6_rating_matrix",
                                  "e3_e4_auc_average_precision", "e6_e8_ranking_metrics", "f5_document_tfidf",
                                  "m12_hybrid_recommendations", "f17_training_set"])
def test_no_python_udf_in_plans(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
