"""P5, P6, A9, A10, A11, F10, F12, F13 — interactions to composite user–event ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsforge.config import RATING_WEIGHTS
from oddsforge.functions.expressions import exact_avg, exact_sum
from oddsforge.operators.ids import dense_index

# Per-column defaults of the numeric clean.
CLEAN_DEFAULTS = {"bet_amount": 0.0, "odds_used": 1.0, "outcome": 0, "bet_timing_hours_before": 24.0}


def clean_types(df: DataFrame) -> DataFrame:
    """P5: numeric coercion with defaults, live flag -> boolean, integer outcome."""
    sel = {c: F.col(c) for c in df.columns}
    for c, default in CLEAN_DEFAULTS.items():
        v = F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
        sel[c] = F.coalesce(v, F.lit(float(default)))
    sel["outcome"] = sel["outcome"].cast("int")
    live = F.col("is_live_bet").try_cast("double") if "is_live_bet" in df.columns else F.lit(None)
    sel["is_live_bet"] = F.coalesce(live, F.lit(0.0)) != 0
    return df.select(*[e.alias(c) for c, e in sel.items()])


def valid_interactions(hierarchy: DataFrame) -> DataFrame:
    """Non-null amount/user/event, cleaned, amount > 0."""
    df = hierarchy.filter(F.col("bet_amount").isNotNull() & F.col("user_id").isNotNull()
                          & F.col("event_id").isNotNull())
    return clean_types(df).filter(F.col("bet_amount") > 0)


def user_event_stats(interactions: DataFrame) -> DataFrame:
    """Per (user, event) statistics; NULLs -> 0."""
    a, o = F.col("bet_amount"), F.col("odds_used")
    g = interactions.groupBy("user_id", "event_id").agg(
        F.count(a).alias("bet_frequency"), exact_sum(a).alias("total_stake"), exact_avg(a).alias("avg_stake"),
        exact_avg(o).alias("avg_odds"), F.stddev_samp(o).alias("odds_std"),
        F.sum("outcome").cast("long").alias("wins"), F.count("outcome").alias("total_bets"),
        (F.sum(F.col("is_live_bet").cast("long")) / F.count("is_live_bet")).alias("live_bet_ratio"),
        exact_avg("bet_timing_hours_before").alias("avg_timing"))
    return g.fillna(0)


def _scale_stats(stats: DataFrame) -> dict:
    row = stats.agg(F.count(F.lit(1)).alias("n"),
                    F.min("bet_frequency").alias("fmin"), F.max("bet_frequency").alias("fmax"),
                    F.stddev_samp("bet_frequency").alias("fstd"),
                    F.min("total_stake").alias("mmin"), F.max("total_stake").alias("mmax"),
                    F.stddev_samp("total_stake").alias("mstd")).collect()[0]
    return row.asDict()


def min_max_guarded(c: str, n: int, mn, mx, std) -> F.Column:
    """(x - min)/(max - min); constant column, one row or zero std -> 1.0."""
    if n <= 1 or std is None or not std > 0:
        return F.lit(1.0)
    return (F.col(c).cast("double") - F.lit(float(mn))) / F.lit(float(mx) - float(mn))


def _clean_score(e):
    return F.when(e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))), F.lit(0.0)).otherwise(e)


def composite_scores(stats: DataFrame, weights=RATING_WEIGHTS) -> DataFrame:
    """weighted 0–5 rating from frequency, money, success, engagement, timing.

    One small statistic read (count, min, max, std of two columns) steers the
    min–max guard; rows stay on the executors.
    """
    s = _scale_stats(stats)
    n = int(s["n"])
    freq = min_max_guarded("bet_frequency", n, s["fmin"], s["fmax"], s["fstd"])
    mon = min_max_guarded("total_stake", n, s["mmin"], s["mmax"], s["mstd"])
    succ = F.when(F.col("total_bets") > 0, F.col("wins").cast("double") / F.col("total_bets").cast("double")) \
        .otherwise(F.lit(0.0))
    eng = F.col("live_bet_ratio").cast("double")
    timing = F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("avg_timing").cast("double")))
    scored = stats.select("*", _clean_score(freq).alias("frequency_score"), _clean_score(mon).alias("monetary_score"),
                          _clean_score(succ).alias("success_score"), _clean_score(eng).alias("engagement_score"),
                          _clean_score(timing).alias("timing_score"))
    w = weights
    raw = ((F.lit(w["frequency"]) * F.col("frequency_score") + F.lit(w["monetary"]) * F.col("monetary_score")
            + F.lit(w["success"]) * F.col("success_score") + F.lit(w["engagement"]) * F.col("engagement_score")
            + F.lit(w["timing"]) * F.col("timing_score")) * F.lit(5.0))
    return scored.withColumn("composite_rating", F.least(F.greatest(raw, F.lit(0.0)), F.lit(5.0)))


def simple_interaction_scores(hierarchy: DataFrame) -> DataFrame:
    """A10: (0.4 frequency' + 0.3 amount' + 0.3 success) × 5, ' = min–max scaled
    (a constant column scales to 0); success = mean outcome, NULL -> 0."""
    rows = hierarchy.filter(F.col("bet_amount").isNotNull() & (F.col("bet_amount") > 0)
                            & F.col("user_id").isNotNull() & F.col("event_id").isNotNull())
    g = rows.groupBy("user_id", "event_id").agg(
        F.count("bet_amount").alias("frequency"), exact_sum("bet_amount").alias("total_amount"),
        (F.sum("outcome") / F.count("outcome")).alias("success_rate"), F.sum("outcome").cast("long").alias("wins"))
    st = g.agg(F.min("frequency").alias("fmin"), F.max("frequency").alias("fmax"),
               F.min("total_amount").alias("amin"), F.max("total_amount").alias("amax")).collect()[0]

    def mm(c, lo, hi):
        if lo is None or hi is None or hi == lo:
            return F.lit(0.0)
        return (F.col(c).cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))

    return g.withColumn("interaction_score",
                        (F.lit(0.4) * mm("frequency", st["fmin"], st["fmax"])
                         + F.lit(0.3) * mm("total_amount", st["amin"], st["amax"])
                         + F.lit(0.3) * F.coalesce(F.col("success_rate"), F.lit(0.0))) * F.lit(5.0))


def rating_matrix(scored: DataFrame) -> DataFrame:
    """W6 + F13: coordinate-form rating matrix with dense sorted user/event indices."""
    ui = dense_index(scored, "user_id", "user_idx")
    ei = dense_index(scored, "event_id", "event_idx")
    return (scored.select("user_id", "event_id", F.col("composite_rating").alias("rating"))
            .join(ui, "user_id").join(ei, "event_id")
            .select("user_id", "event_id", "user_idx", "event_idx", "rating"))


def matrix_statistics(coo: DataFrame) -> DataFrame:
    """Shape, nnz, sparsity and rating range of the matrix (one aggregate)."""
    g = coo.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_id").alias("n_events"),
                F.count(F.lit(1)).alias("nnz"), F.min("rating").alias("rating_min"),
                F.max("rating").alias("rating_max"), F.avg("rating").alias("rating_mean"))
    return g.withColumn("sparsity", F.lit(1.0) - F.col("nnz") / (F.col("n_users") * F.col("n_events")))

