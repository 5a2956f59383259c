"""Ratios whose divisor is zero: infinite as floating point (and DuckDB) defines it, not an error."""

import math

from pyspark.sql import functions as F


def test_ratio_to_deposits_of_minus_one(spark):
    from oddsforge.operators import prep as PR

    rows = spark.createDataFrame([(1, 5.0, -1.0, 2.0), (2, -5.0, -1.0, 2.0), (3, 0.0, -1.0, 2.0), (4, None, -1.0, 2.0), (5, 5.0, None, 2.0), (6, 6.0, 2.0, 2.0)],
                                 "id int, bet_amount double, total_deposits double, odds_used double")
    got = {r["id"]: r["bet_ratio"] for r in PR.derived_ratios(rows).collect()}
    assert got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3])
    assert got[4] is None and got[5] is None and got[6] == 2.0


def test_experience_and_stake_trend_by_zero(spark):
    from oddsforge.operators import behaviour as B
    from oddsforge.operators import prep as PR

    rows = spark.createDataFrame([(1, 10, -1.0 / 365.0), (2, 10, 1.0)], "id int, days_since_registration int, age double")
    assert {r["id"]: r["experience_ratio"] for r in PR.derived_ratios(rows).collect()} == {1: math.inf, 2: 10 / 366.0}
    users = spark.createDataFrame([(1, 3.0, -1.0), (2, 3.0, 2.0)], "user_id int, avg_stake_7d double, avg_stake_30d double")
    assert {r["user_id"]: r["stake_trend"] for r in B.add_trends(users).collect()} == {1: math.inf, 2: 1.0}


def test_training_set_with_an_endless_ratio(spark):
    """The endless ratio is a missing value of the fit: the median of the others takes its place."""
    from oddsforge.operators import training as TR

    rows = spark.createDataFrame([(i, i, 1, i, float(i), d, 2.0, "won" if i % 2 else "lost", i % 2) for i, d in ((1, -1.0), (2, 0.0), (3, 1.0), (4, 3.0))],
                                 "bet_id int, user_id int, event_id int, outcome_id int, bet_amount double, total_deposits double, odds_used double, bet_result string, outcome int")
    for outliers in (None, "iqr"):
        got = {r["bet_id"]: r["bet_ratio"] for r in TR.training_set(rows, None, None, outliers=outliers).collect()}
        assert len(got) == 4 and all(map(math.isfinite, got.values())) and got[1] == got[3]       # ratios 2, 1.5, 1: median 1.5
