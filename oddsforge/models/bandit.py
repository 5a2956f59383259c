"""UCB bandit state and scoring as DataFrames (state = one row per arm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NEUTRAL_SCORE = 0.5


def init_arms(actions: DataFrame, col: str = "action") -> DataFrame:
    """Every distinct action with zero pulls and zero reward."""
    return (actions.select(F.col(col).alias("action")).filter(F.col("action").isNotNull()).distinct()
            .select("action", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("reward_sum")))


def reward_totals(rewards: DataFrame) -> DataFrame:
    """Per-action pull count and reward sum (partial aggregate; hot actions are cheap)."""
    return rewards.groupBy("action").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.col("reward").cast("double")).alias("reward_sum"))


def update_arms(arms: DataFrame, rewards: DataFrame) -> DataFrame:
    """M18 (batch form of ``update_reward``): arms ⟗ reward totals; unknown actions join the state."""
    t = reward_totals(rewards).withColumnRenamed("n", "_n").withColumnRenamed("reward_sum", "_s")
    j = arms.join(t, "action", "full_outer")
    return j.select("action", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("n"),
                    (F.coalesce("reward_sum", F.lit(0.0)) + F.coalesce("_s", F.lit(0.0))).alias("reward_sum"))


def mean_reward(state: DataFrame) -> DataFrame:
    return state.withColumn("mean_reward", F.when(F.col("n") > 0, F.col("reward_sum") / F.col("n"))
                            .otherwise(F.lit(NEUTRAL_SCORE)))


def ucb_scores(state: DataFrame, alpha: float = 1.0) -> DataFrame:
    """UCB score per arm and the chosen arm.

    Untested arms are chosen first (smallest action among them); otherwise the
    arm with the highest mean + α·sqrt(2 ln T / n), ties -> smallest action.
    T (total pulls) is one small aggregate read.
    """
    total = state.agg(F.sum("n")).collect()[0][0] or 0
    n = F.col("n")
    mean = F.col("reward_sum") / n
    score = (mean + F.lit(alpha) * F.sqrt(F.lit(2.0) * F.log(F.lit(float(total))) / n)) if total > 0 else mean
    scored = state.withColumn("ucb_score", F.when(n > 0, score))
    untested = scored.filter(n == 0).agg(F.min("action").alias("_u"))
    top = scored.filter(n > 0).agg(F.max("ucb_score").alias("_m"))
    best = scored.filter((n > 0)).join(F.broadcast(top.select("_m")), F.col("ucb_score") == F.col("_m")) \
        .agg(F.min("action").alias("_b"))
    pick = (untested.select(F.col("_u").alias("chosen"), F.lit(0).alias("_p"))
            .unionByName(best.select(F.col("_b").alias("chosen"), F.lit(1).alias("_p")))
            .filter(F.col("chosen").isNotNull())
            .agg(F.min_by("chosen", "_p").alias("chosen")))
    return (scored.join(F.broadcast(pick), F.col("action") == F.col("chosen"), "left")
            .select("action", "n", "reward_sum", "ucb_score",
                    F.col("chosen").isNotNull().cast("int").alias("selected")))


def choose_available(state: DataFrame, decisions: DataFrame, alpha: float = 1.0, decision: str = "decision_id",
                     actions: str = "actions") -> DataFrame:
    """M19 (choice): one action per decision out of its own list of available actions.

    The first arm of the list that is untested (or unknown) is taken; without one, the arm of the largest mean +
    α·sqrt(2 ln T / n), ties to the first in the list; T counts the pulls of all arms. A decision with no
    available action has none (NULL). Each decision is exploded into its own actions, joined with the arms' state and
    reduced by one partial aggregate, so neither the arms nor the decisions are held anywhere whole.
    """
    pulls = state.agg(F.sum("n")).collect()[0][0] or 0
    arms = state.select(F.col("action").alias("_arm"), "n", "reward_sum")
    offered = decisions.select(decision, F.posexplode_outer(actions).alias("_at", "_action"))
    seen = offered.join(arms, F.col("_action") == F.col("_arm"), "left")
    tested = F.coalesce(F.col("n"), F.lit(0)) > 0
    mean = F.col("reward_sum") / F.col("n")
    score = mean + F.lit(alpha) * F.sqrt(F.lit(2.0) * F.log(F.lit(float(pulls))) / F.col("n")) if pulls > 0 else mean
    order = F.struct(tested.cast("int").alias("tested"), F.when(tested, -score).alias("loss"), F.col("_at").alias("at"),
                     F.col("_action").alias("action"), F.when(tested, score).alias("score"))
    best = seen.groupBy(decision).agg(F.min(F.when(F.col("_action").isNotNull(), order)).alias("_b"))
    return best.select(decision, F.col("_b.action").alias("action"), F.col("_b.score").alias("ucb_score"))


def predict_pairs(state: DataFrame, pairs: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Mean reward of the arm, 0.5 when unknown or untested."""
    s = state.select(F.col("action").alias(item_col), "n", "reward_sum")
    return (pairs.join(s, item_col, "left")
            .withColumn("prediction", F.when(F.col("n") > 0, F.col("reward_sum") / F.col("n"))
                        .otherwise(F.lit(NEUTRAL_SCORE))).drop("n", "reward_sum"))


def recommend_arms(state: DataFrame, n: int = 10) -> DataFrame:
    """Top-n arms by mean reward (untested 0.5), ties -> smaller action (a top-k report)."""
    return (mean_reward(state).orderBy(F.col("mean_reward").desc(), F.col("action").asc()).limit(n)
            .select("action", F.col("mean_reward").alias("score")))


def exploration_rate(total_updates, epsilon0: float = 0.1, decay: float = 0.99, every: int = 100):
    """ε after ``total_updates`` updates = ε0 · decay^⌊n / every⌋ (closed form, no custom state)."""
    return F.lit(epsilon0) * F.pow(F.lit(decay), F.floor(total_updates / F.lit(every)))
