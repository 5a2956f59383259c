"""Domain-table loaders with the reference loaders' projection/filter semantics.

Each loader takes the raw source table (parquet or JDBC DataFrame) and returns a
lazy plan; filters and projections reach the scan through Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsforge.functions.expressions import days_ago, lit_ts

EVENT_STATUSES = ("scheduled", "live", "finished")   # fixed values
BET_RESULTS = ("won", "lost", "pending")               # fixed values
FIXED_BET_START = "2020-01-01 00:00:00"                # fixed value used when days_back is None


def _limit(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit else df


def load_users(raw_users: DataFrame, as_of: str, limit: int | None = None,
               active_only: bool = False) -> DataFrame:
    """User summary + ``days_since_registration`` (whole calendar days)."""
    df = raw_users
    if active_only and "status" in df.columns:
        df = df.filter(F.col("status") == "active")
    cols = [F.col("user_id")]
    for c in ("registration_date", "age", "total_deposits", "total_withdrawals", "vip_status",
              "last_login_date"):
        if c in df.columns:
            cols.append(F.col(c))
    if "country" in df.columns:
        cols.append(F.col("country").alias("user_country"))        # D10
    cols.append(F.datediff(F.to_date(lit_ts(as_of)), F.to_date("registration_date"))
                .alias("days_since_registration"))
    return _limit(df.select(*cols), limit)


def load_events(raw_events: DataFrame, as_of: str, days_back: int = 2,
                limit: int | None = None, all_history: bool = False) -> DataFrame:
    """Events with ``hours_until_event`` (whole hours) in a look-back range; ``all_history`` sets no bound."""
    start = F.col("event_start_time")
    now = lit_ts(as_of)
    cols = [F.col(c) for c in ("event_id", "sport", "competition") if c in raw_events.columns]
    if {"home_team", "away_team"} <= set(raw_events.columns):
        cols += [F.col("home_team"), F.col("away_team"),
                 F.concat(F.col("home_team"), F.lit(" vs "), F.col("away_team")).alias("teams")]
    elif "teams" in raw_events.columns:
        cols.append(F.col("teams"))
    cols += [F.col(c) for c in ("popularity_index", "venue") if c in raw_events.columns]
    if "country" in raw_events.columns:
        cols.append(F.col("country").alias("event_country"))       # D10
    cols += [start, F.col("event_status"),
             F.when(start > now, F.timestamp_diff("HOUR", now, start)).otherwise(F.lit(0))
             .cast("long").alias("hours_until_event")]
    recent = F.lit(True) if all_history else start >= days_ago(as_of, days_back)
    df = raw_events.filter(recent & F.col("event_status").isin(*EVENT_STATUSES))
    return _limit(df.select(*cols), limit)


def load_bets(raw_bets: DataFrame, raw_events: DataFrame, as_of: str,
              days_back: int | None = 365, limit: int | None = None, all_history: bool = False,
              known_only: bool = False) -> DataFrame:
    """S3: bets ⟕ events; result text -> 1/0/NULL; live flag from whole minutes.

    ``outcome_label`` keeps the text label and ``outcome`` the 0/1/NULL value (D3);
    ``days_back=None`` uses the fixed start date (D13), ``all_history`` no bound at all.
    ``known_only`` keeps the bets whose event S2 loads, in the same join.
    """
    b = raw_bets.alias("b")
    if known_only:
        raw_events = raw_events.filter(F.col("event_status").isin(*EVENT_STATUSES))
    e = raw_events.select("event_id", F.col("event_start_time").alias("_e_start")).alias("e")
    since = lit_ts(FIXED_BET_START) if days_back is None else days_ago(as_of, days_back)
    res = F.col("b.bet_result")
    live = (F.col("_e_start").isNotNull()
            & (F.timestamp_diff("MINUTE", F.col("b.bet_timestamp"), F.col("_e_start")) <= 0))
    recent = F.lit(True) if all_history else F.col("bet_timestamp") >= since
    df = (b.filter(recent & F.col("bet_result").isin(*BET_RESULTS))
          .join(e, F.col("b.event_id") == F.col("e.event_id"), "inner" if known_only else "left")
          .select(F.col("b.bet_id"), F.col("b.user_id"), F.col("b.event_id"), F.col("b.outcome_id"),
                  F.col("b.bet_amount"), F.col("b.odds").alias("odds_used"), F.col("b.bet_timestamp"),
                  F.col("b.settlement_timestamp"), F.col("b.outcome").alias("outcome_label"),
                  F.col("b.market"), res,
                  F.when(res == "won", F.lit(1)).when(res == "lost", F.lit(0))
                  .otherwise(F.lit(None).cast("int")).alias("outcome"),
                  F.when(live, F.lit(1)).otherwise(F.lit(0)).alias("is_live_bet")))
    return _limit(df, limit)


def load_markets(raw_markets: DataFrame, limit: int | None = None,
                 market_type: str | None = None, status: str | None = None) -> DataFrame:
    """Market catalogue (variant filters on type / status when present)."""
    df = raw_markets
    if market_type is not None and "market_type" in df.columns:
        df = df.filter(F.col("market_type") == market_type)
    if status is not None and "market_status" in df.columns:
        df = df.filter(F.col("market_status") == status)
    return _limit(df.select("market_id", "event_id", "market_name"), limit)


def load_outcomes(raw_outcomes: DataFrame, limit: int | None = None,
                  status: str | None = None) -> DataFrame:
    """Outcome catalogue."""
    df = raw_outcomes
    if status is not None and "outcome_status" in df.columns:
        df = df.filter(F.col("outcome_status") == status)
    return _limit(df.select("outcome_id", "market_id", "outcome_name"), limit)


def load_odds_history(raw_odds: DataFrame, as_of: str | None = None, days_back: int | None = 30,
                      limit: int | None = None) -> DataFrame:
    """Odds updates ordered by (outcome, time); honours ``days_back``.

    The sort is a range-partitioned distributed sort, not a single task.
    """
    df = raw_odds
    if as_of is not None and days_back is not None:
        df = df.filter(F.col("timestamp") >= days_ago(as_of, days_back))
    df = df.select("outcome_id", "event_id", "odds_value", "timestamp").orderBy("outcome_id", "timestamp")
    return _limit(df, limit)


TABLE_SCHEMAS = {
    "users": T.StructType([T.StructField("user_id", T.LongType())]),
    "events": T.StructType([T.StructField("event_id", T.LongType())]),
    "bets": T.StructType([T.StructField("bet_id", T.LongType()), T.StructField("user_id", T.LongType()),
                          T.StructField("event_id", T.LongType()), T.StructField("bet_amount", T.DoubleType())]),
    "markets": T.StructType([T.StructField("market_id", T.LongType()), T.StructField("event_id", T.LongType())]),
    "outcomes": T.StructType([T.StructField("outcome_id", T.LongType()), T.StructField("market_id", T.LongType())]),
    "odds_history": T.StructType([T.StructField("outcome_id", T.LongType()),
                                  T.StructField("odds_value", T.DoubleType()),
                                  T.StructField("timestamp", T.TimestampNTZType())]),
}


def load_all(spark: SparkSession, loaders: dict, options: dict | None = None,
             empty_on_error: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Build every table plan. Returns the tables and, for those that failed, the reasons.

    ``loaders`` maps a table name to a zero-argument-plus-options callable. With ``empty_on_error`` (as in the
    reference) a failed table becomes a typed empty one; otherwise the first error is raised.
    """
    tables, reasons = {}, {}
    options = options or {}
    for name, fn in loaders.items():
        try:
            df = fn(**options.get(name, {}))
            df.schema  # resolve the plan now so a missing table/column is caught here
            tables[name] = df
        except Exception as e:
            if not empty_on_error:
                raise
            reasons[name] = f"{type(e).__name__}: {e}"
            tables[name] = spark.createDataFrame([], TABLE_SCHEMAS.get(name, T.StructType([])))
    return tables, reasons


def execute_query(spark: SparkSession, query: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Parameterised SQL — named ``:param`` markers bound by Spark (never string-formatted);
    ``{name}`` placeholders refer to DataFrames passed as keyword arguments."""
    return spark.sql(query, args=args or {}, **tables)


def table_info(df: DataFrame) -> DataFrame:
    """Column metadata (name, type, nullable, position) of a table, and how many values each column holds, from
    one aggregate over the table."""
    wide = df.agg(*[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    each = [F.struct(F.lit(i).alias("ordinal_position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.lit(f.nullable).alias("is_nullable"), F.col(f"_{i}").alias("n_values")) for i, f in enumerate(df.schema.fields)]
    return wide.select(F.inline(F.array(*each)))
