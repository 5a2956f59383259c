"""Driver tables -> domain tables (users, events, markets, outcomes, bets, odds, logs).

The mapping is fixed (see FIXTURES.md §3) and mirrored one-to-one by the DuckDB
oracle in ``oddsforge.plans.oracle``. Everything is a lazy join/aggregate over the
given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsforge.functions.expressions import lit_ts
from oddsforge.sources.tables import read_table

# Fixed values of the mapping.
BETS_AS_OF = "2001-12-01 00:00:00"
LOG_AS_OF = "2024-01-31 00:00:00"
LOG_AS_OF_EMPTY = "2024-03-31 00:00:00"
BETS_DAYS_BACK = 2000
EVENTS_DAYS_BACK = 3650
MARKET_KEY_FACTOR = 10000
OUTCOME_KEY_FACTOR = 10
BET_KEY_FACTOR = 10


def raw_users(spark: SparkSession, d: str) -> DataFrame:
    """customer ⋈ nation ⟕ first order date -> user summary table."""
    c = read_table(spark, d, "customer")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    first = (read_table(spark, d, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("registration_date")))
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")   # nation: 25 rows
            .join(first, c.c_custkey == first.o_custkey, "left")
            .select(F.col("c_custkey").alias("user_id"),
                    "registration_date",
                    F.col("n_name").alias("country"),
                    F.col("c_acctbal").alias("total_deposits"),
                    (F.col("c_mktsegment") == "BUILDING").cast("int").alias("vip_status")))


def line_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """One aggregate over lineitem shared by events, markets and outcomes: (part, supplier, line number) -> first ship
    date. The catalogue tables take it as ``lines``; a caller that needs several of them writes it once
    (:func:`oddsforge.session.cut_lineage`) and so reads the fact table once for all."""
    return (read_table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_linenumber")
            .agg(F.min("l_shipdate").alias("first_ship")))


def raw_events(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """part ⟕ first ship date -> event summary table."""
    p = read_table(spark, d, "part")
    # without the written lines a part's first date comes from the fact table in one partial aggregate
    dates = read_table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "first_ship") if lines is None else lines
    start = (dates.groupBy("l_partkey")
             .agg(F.min("first_ship").alias("event_start_time")))
    return (p.join(start, p.p_partkey == start.l_partkey, "left")
            .select(F.col("p_partkey").alias("event_id"),
                    F.col("p_brand").alias("sport"),
                    F.col("p_type").alias("competition"),
                    F.col("p_name").alias("teams"),
                    F.col("p_retailprice").alias("popularity_index"),
                    "event_start_time",
                    F.when(F.col("event_start_time") < lit_ts(BETS_AS_OF), F.lit("finished"))
                    .when(F.col("event_start_time").isNotNull(), F.lit("scheduled"))
                    .alias("event_status")))


def _market_id(partkey="l_partkey", suppkey="l_suppkey"):
    return F.col(partkey) * F.lit(MARKET_KEY_FACTOR) + F.col(suppkey)


def raw_markets_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (part, supplier, line) -> market/outcome catalogue rows."""
    li = line_catalogue(spark, d).select("l_partkey", "l_suppkey", "l_linenumber")
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    return (li.join(s, li.l_suppkey == s.s_suppkey, "left")
            .select(_market_id().alias("market_id"),
                    F.col("l_partkey").alias("event_id"),
                    F.col("s_name").alias("market_name"),
                    (_market_id() * F.lit(OUTCOME_KEY_FACTOR) + F.col("l_linenumber")).alias("outcome_id"),
                    F.col("l_linenumber").cast("string").alias("outcome_name")))


def raw_markets(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    li = (line_catalogue(spark, d) if lines is None else lines).select("l_partkey", "l_suppkey").distinct()
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    return (li.join(s, li.l_suppkey == s.s_suppkey, "left")
            .select(_market_id().alias("market_id"), F.col("l_partkey").alias("event_id"),
                    F.col("s_name").alias("market_name")))


def raw_outcomes(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    li = (line_catalogue(spark, d) if lines is None else lines).select("l_partkey", "l_suppkey", "l_linenumber")
    return li.select((_market_id() * F.lit(OUTCOME_KEY_FACTOR) + F.col("l_linenumber")).alias("outcome_id"),
                     _market_id().alias("market_id"),
                     F.col("l_linenumber").cast("string").alias("outcome_name"))


def raw_bets(spark: SparkSession, d: str) -> DataFrame:
    """lineitem ⋈ orders ⟕ supplier -> bet summary table (bet ids are not unique)."""
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .join(s, li.l_suppkey == s.s_suppkey, "left")
            .select((F.col("l_orderkey") * F.lit(BET_KEY_FACTOR) + F.col("l_linenumber")).alias("bet_id"),
                    F.col("o_custkey").alias("user_id"),
                    F.col("l_partkey").alias("event_id"),
                    (_market_id() * F.lit(OUTCOME_KEY_FACTOR) + F.col("l_linenumber")).alias("outcome_id"),
                    F.col("l_extendedprice").alias("bet_amount"),
                    (F.lit(1.0) + F.lit(40.0) * F.col("l_discount")).alias("odds"),
                    F.col("o_orderdate").alias("bet_timestamp"),
                    F.col("l_shipdate").alias("settlement_timestamp"),
                    F.col("l_linenumber").cast("string").alias("outcome"),
                    F.col("s_name").alias("market"),
                    F.when(F.col("l_returnflag") == "R", F.lit("won"))
                    .when(F.col("l_returnflag") == "A", F.lit("lost"))
                    .otherwise(F.lit("pending")).alias("bet_result")))


def raw_odds_history(spark: SparkSession, d: str) -> DataFrame:
    """events -> odds updates (outcome_id = user_id, odds = value, timestamp = ts)."""
    e = read_table(spark, d, "events")
    return e.select(F.col("user_id").alias("outcome_id"), F.col("event_id"),
                    F.col("value").alias("odds_value"), F.col("ts").alias("timestamp"))


def behaviour_log(spark: SparkSession, d: str) -> DataFrame:
    """events -> interaction log with the columns the behavioural features need."""
    e = read_table(spark, d, "events")
    m = F.col("event_id") % F.lit(3)
    return e.select(
        "user_id",
        F.col("event_id").alias("bet_id"),
        F.col("ts").alias("bet_timestamp"),
        F.col("value").alias("bet_amount"),
        F.col("event_type").alias("sport"),
        F.col("props").alias("market_name"),
        (F.lit(1.0) + (F.col("event_id") % F.lit(40)).cast("double") / F.lit(10.0)).alias("odds_used"),
        F.when(m == 2, F.lit(None).cast("int")).otherwise(m.cast("int")).alias("outcome"),
        (F.col("event_id") % F.lit(2)).cast("int").alias("is_live_bet"))


def bandit_rewards(spark: SparkSession, d: str) -> DataFrame:
    """events -> (action, reward, ts) reward stream rows."""
    e = read_table(spark, d, "events")
    return e.select(F.col("event_type").alias("action"),
                    (F.col("value") > F.lit(50.0)).cast("int").alias("reward"),
                    F.col("ts"), F.col("user_id"), F.col("event_id"))


def labelled_scores(spark: SparkSession, d: str) -> DataFrame:
    """lineitem -> (true rating, predicted score) pairs for the prediction metrics."""
    li = read_table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * F.lit(BET_KEY_FACTOR) + F.col("l_linenumber")).alias("pair_id"),
                     (F.col("l_quantity") / F.lit(10.0)).alias("rating"),
                     (F.col("l_extendedprice") / F.lit(20000.0)).alias("prediction"))
