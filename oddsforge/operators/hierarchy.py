"""P1, P2–P4, J1–J9, U1, W1, A1–A3, F21 — the event → market → outcome → bet → user view."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsforge.functions.expressions import (clean_key_text, cyclic_cos, cyclic_sin, exact_avg,
                                             exact_sum, floor_days_between, hours_between, lit_ts,
                                             null_safe_flag, weekday_mon0)
from oddsforge.operators.joins import broadcast_if_small, catalogue_left_join, first_per_key

# Order in which the first row of a bet id is taken.
VIEW_ORDER = ("event_id", "market_id", "outcome_id", "bet_outcome_id", "user_id", "bet_timestamp", "bet_amount", "odds_used",
              "settlement_timestamp", "market", "outcome_label", "bet_result")
TEXT_KEYS = {"markets": ["market_name"], "outcomes": ["outcome_name"], "bets": ["market", "outcome_label"]}


def clean_text_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Trim + lower the join-key text columns that exist."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, clean_key_text(c))
    return df


def events_markets_outcomes(events: DataFrame, markets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """J1 + J2: events ⟕ markets on event_id ⟕ outcomes on market_id (skipped without the key).

    All three are catalogue tables (one row per event / market / outcome), so
    plain left joins are used; the skew-safe form is kept for the bet joins. Markets meet their outcomes first, narrow, and
    the events last, which gives the same rows: an outcome joins on the market's own id.
    """
    if "market_id" not in events.columns and {"market_id", "event_id"} <= set(markets.columns) and "market_id" in outcomes.columns:
        m = markets.drop(*[c for c in markets.columns if c in events.columns and c != "event_id"])
        o = outcomes.drop(*[c for c in outcomes.columns if c != "market_id" and (c in events.columns or c in m.columns)])
        mo = m.join(o, "market_id", "left").select(*m.columns, *[c for c in o.columns if c != "market_id"])
        return events.join(mo, "event_id", "left").select(*events.columns, *[c for c in mo.columns if c != "event_id"])
    em = events.join(markets.drop(*[c for c in markets.columns if c in events.columns and c != "event_id"]),
                     "event_id", "left")
    if "market_id" in em.columns and "market_id" in outcomes.columns:
        em = em.join(outcomes.drop(*[c for c in outcomes.columns if c in em.columns and c != "market_id"]),
                     "market_id", "left")
    return em.select(*events.columns, *[c for c in em.columns if c not in events.columns])


def _bets_for_join(bets: DataFrame) -> DataFrame:
    """P15 + D21: a bare ``id`` is the bet id; the bet's own outcome id gets a name of its own."""
    if "bet_id" not in bets.columns and "id" in bets.columns:
        bets = bets.withColumnRenamed("id", "bet_id")
    return bets.withColumnRenamed("outcome_id", "bet_outcome_id")   # D21


def classic_view(catalogue: DataFrame, bets: DataFrame) -> DataFrame:
    """Catalogue ⟕ bets on (event_id, market name, outcome name)."""
    b = _bets_for_join(bets)
    needed = {"event_id", "market", "outcome_label"}
    if not needed <= set(b.columns):
        return catalogue
    return catalogue_left_join(catalogue, b, ["event_id", "market_name", "outcome_name"],
                               ["event_id", "market", "outcome_label"])


def direct_view(events: DataFrame, bets: DataFrame) -> DataFrame:
    """Events ⟕ bets on event_id."""
    return catalogue_left_join(events, _bets_for_join(bets), ["event_id"])


def with_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """⟕ users on user_id. The view (large) is the preserved side, so AQE
    can split a hot user; the users table is broadcast by AQE only when its
    runtime size is under the broadcast threshold."""
    if "user_id" not in df.columns or "user_id" not in users.columns:
        return df
    u = users.drop(*[c for c in users.columns if c in df.columns and c != "user_id"])
    return df.join(u, "user_id", "left")


def view_with_users(view, bets: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of ``with_users(view(bets), users)``, the users joined to the bets first: these are narrower than the view, and a
    catalogue row that no bet met has no user in either order. The bets with their users are written, so the files of that
    move go before the view's own."""
    from oddsforge.session import cut_lineage

    cols = view(bets).columns
    new = [c for c in users.columns if c not in cols]
    if "user_id" not in bets.columns or "user_id" not in users.columns or set(new) & set(bets.columns):
        return with_users(view(bets), users)
    joined = cut_lineage(bets.join(users.select("user_id", *new), "user_id", "left"))
    return view(joined).select("user_id", *[c for c in cols if c != "user_id"], *new)


def combine_views(classic: DataFrame, direct: DataFrame) -> DataFrame:
    """U1 + W1: union (classic first) and keep the first row per bet_id."""
    both = (classic.withColumn("_view", F.lit(0))
            .unionByName(direct.withColumn("_view", F.lit(1)), allowMissingColumns=True))
    order = ["_view"] + [c for c in VIEW_ORDER if c in both.columns]
    kept = first_per_key(both, "bet_id", order).drop("_view")
    if "bet_outcome_id" in kept.columns and "outcome_id" in kept.columns:
        kept = kept.withColumn("outcome_id", F.coalesce("outcome_id", "bet_outcome_id"))
    return kept


def first_payload(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: of several, the smallest, column by column (NULLs first)."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def bet_rows(events: DataFrame, markets: DataFrame, outcomes: DataFrame, bets: DataFrame, known: bool = False,
             columns: set[str] | None = None) -> DataFrame:
    """The rows of :func:`combine_views` without the event and user columns: bet columns, catalogue ids and market / outcome columns.

    A bet's first row is its first catalogue match (classic view) or, without one, its bare event (direct
    view). So bets are matched against the first (market, outcome) of each catalogue key and deduplicated
    narrow; a matched bet's market and outcome names are its own. The views' unmatched rows have no bet id;
    of all such rows one stays, the first in the same order. One full join by event gives both the bets' matches and the
    catalogue rows that no bet names. ``known``: every bet's event is among ``events`` already. ``columns``: of the rest none
    is returned. The names are left to :func:`with_names`, which follows the last join.

    Each step is written, and its input deleted, before the next one moves the bets again.
    """
    from oddsforge.session import cut_lineage, release

    b = _bets_for_join(bets)
    b = b.drop(*[c for c in b.columns if c in events.columns and c != "event_id"])     # the catalogue's column counts
    catalogue = events_markets_outcomes(events.select("event_id"), markets, outcomes)
    taken = {"event_id", "market_id", "outcome_id", *events.columns, *b.columns}
    extra = [c for c in catalogue.columns if c not in taken]
    names = own_names(extra)
    more = [c for c in extra if c not in names]
    ids = ["market_id", "outcome_id", *more]
    first = (catalogue.select(F.col("event_id").alias("_e"), F.col("market_name").alias("_mn"), F.col("outcome_name").alias("_on"),
                              F.struct(*ids).alias("_id"))
             .groupBy("_e", "_mn", "_on").agg(F.min("_id").alias("_id")))
    first = cut_lineage(first)      # its moves are over, and their files gone, before the bets move
    key = (F.col("event_id") == F.col("_e")) & (F.col("market") == F.col("_mn")) & (F.col("outcome_label") == F.col("_on"))
    asking = b if known else b.join(events.select("event_id").distinct(), "event_id", "left_semi")
    # the catalogue, with one row a key, is the hashed side
    met = asking.withColumn("_bet", F.lit(1)).join(first.hint("shuffle_hash"), key, "full_outer")
    spare = {c: F.when(F.col("_bet").isNull(), F.col(k)) for c, k in (("event_id", "_e"), ("market_name", "_mn"), ("outcome_name", "_on"))}
    met = cut_lineage(met.select("_bet", F.coalesce("event_id", spare["event_id"]).alias("event_id"), *[c for c in b.columns if c != "event_id"],
                                 *[F.col(f"_id.{c}").alias(c) for c in ids], *[spare[c].alias(c) for c in names],
                                 F.when(F.col("_id").isNull(), 1).otherwise(0).alias("_view")))
    release(first)
    matched, idle = met.filter("_bet is not null").drop("_bet"), met.filter("_bet is null")
    order = ["_view"] + [c for c in VIEW_ORDER if c in matched.columns]
    kept = first_per_key(matched.filter(F.col("bet_id").isNotNull()), "bet_id", order)
    # rows without a bet id: bets that lack one, catalogue rows and events that no bet met; one row of each kind at most
    own = ["event_id", "market_id", "outcome_id", *names, *more]
    idle = idle.agg(F.min(F.struct(*own)).alias("r")).filter("r is not null").select(F.lit(0).alias("_view"), "r.*")
    bare = events.select("event_id").join(matched.select(F.col("event_id").alias("_e")).distinct(), F.col("event_id") == F.col("_e"), "left_anti")
    bare = bare.agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(1).alias("_view"), "event_id")
    loose = (matched.filter(F.col("bet_id").isNull()).unionByName(idle, allowMissingColumns=True)
             .unionByName(bare, allowMissingColumns=True))
    rows = kept.unionByName(first_per_key(loose, "bet_id", order))
    head = ["outcome_id", "market_id", "event_id"]
    rows = rows.withColumn("outcome_id", F.coalesce("outcome_id", "bet_outcome_id"))
    out = [*head, *[c for c in b.columns if c not in head], *extra, "_view"]
    rows = cut_lineage(rows.select(*[c for c in out if columns is None or c in columns]))
    release(met)
    return rows


def own_names(extra: list[str]) -> dict[str, str]:
    """The market and outcome names of a matched bet's row and the columns of its own that hold them."""
    return {c: own for c, own in (("market_name", "market"), ("outcome_name", "outcome_label")) if c in extra}


def with_names(rows: DataFrame) -> DataFrame:
    """The market and outcome names of the rows that met the catalogue, from their own columns: not carried through the joins."""
    names = own_names(rows.columns) if "_view" in rows.columns else {}
    return rows.select(*[F.when(F.col("_view") == 0, F.coalesce(c, names[c])).alias(c) if names.get(c) in rows.columns else F.col(c)
                         for c in rows.columns if c != "_view"])


def _with_own_users(rows: DataFrame, events: DataFrame, users: DataFrame) -> DataFrame:
    """J5 on the narrow rows: a user column that an event column of the same name hides is left out."""
    return with_users(rows, users.drop(*[c for c in users.columns if c in events.columns and c != "user_id"]))


def _repeated_by_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """J5 for a caller that reads no user column: the rows of :func:`with_users` without moving them by user. All that the
    join can do to them is to repeat those of a user id that stands in several rows of ``users``."""
    from oddsforge.session import cut_lineage

    if "user_id" not in rows.columns or "user_id" not in users.columns:
        return rows
    several = cut_lineage(users.filter("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    if several.isEmpty():
        return rows
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long"))))
    return cut_lineage(rows.join(several, "user_id", "left").withColumn("_n", times).select(*rows.columns))


def with_events(rows: DataFrame, events: DataFrame, by_event: DataFrame | None = None) -> DataFrame:
    """⟕ the event columns, which are the widest and so come last; ``by_event`` (A2) is joined to the events first."""
    one = first_payload(events, ["event_id"])
    return rows.join(one if by_event is None else one.join(by_event, "event_id", "left"), "event_id", "left")


def _view_columns(rows: DataFrame, events: DataFrame, users: DataFrame, bets: DataFrame) -> list[str]:
    """Column order of the combined view: ids, bet, event, market, outcome, user."""
    own = [c for c in events.columns if c != "event_id"]
    rows = rows.drop("_view")
    first = [c for c in ("user_id", "outcome_id", "market_id", "event_id") if c in rows.columns]
    bet = [c for c in _bets_for_join(bets).columns if c not in first and c not in own]
    of_user = [c for c in users.columns if c not in first and c not in bet and c not in own]
    market = [c for c in rows.columns if c not in first and c not in bet and c not in own and c not in of_user]
    return first + bet + own + market + of_user


def combined_view(events: DataFrame, markets: DataFrame, outcomes: DataFrame, bets: DataFrame,
                  users: DataFrame, known: bool = False) -> DataFrame:
    """J1–J5 + U1 + W1 in one pass over the bets: the rows of :func:`combine_views` over the two views."""
    rows = _with_own_users(bet_rows(events, markets, outcomes, bets, known), events, users)
    order = _view_columns(rows, events, users, bets)
    return with_names(with_events(rows, events)).select(*order)


def coerce_timestamps(df: DataFrame, cols=("event_start_time", "bet_timestamp", "market_open_time")) -> DataFrame:
    """String timestamps -> timestamp, unparsable -> NULL."""
    for c in cols:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, F.try_to_timestamp(F.col(c)))
    return df


def temporal_features(df: DataFrame, as_of: str) -> DataFrame:
    """P3 + P4: event calendar and bet timing features (one projection)."""
    df = coerce_timestamps(df)
    now = lit_ts(as_of)
    cols = set(df.columns)
    new: dict = {}
    if "event_start_time" in cols:
        st = F.col("event_start_time")
        month, dow, hour = F.month(st), weekday_mon0(st), F.hour(st)
        new.update({
            "days_until_event": floor_days_between(now, st),
            "hours_until_event": hours_between(now, st),
            "event_month": month, "event_day_of_week": dow, "event_hour": hour,
            "is_weekend_event": null_safe_flag(dow >= 5),
            "event_hour_sin": cyclic_sin(hour, 24), "event_hour_cos": cyclic_cos(hour, 24),
            "event_month_sin": cyclic_sin(month, 12), "event_month_cos": cyclic_cos(month, 12),
        })
    if "bet_timestamp" in cols:
        bt = F.col("bet_timestamp")
        bdow = weekday_mon0(bt)
        new.update({"bet_hour": F.hour(bt), "bet_day_of_week": bdow, "is_bet_weekend": null_safe_flag(bdow >= 5)})
        if "event_start_time" in cols:
            timing = hours_between(bt, F.col("event_start_time"))
            new.update({"bet_timing_hours_before": timing, "is_live_bet": null_safe_flag(timing <= 0)})
        else:
            new.update({"bet_timing_hours_before": F.lit(None).cast("double"),
                        "is_live_bet": F.lit(None).cast("int")})
    keep = [F.col(c) if c not in new else new[c].alias(c) for c in df.columns]
    return df.select(*keep, *[e.alias(n) for n, e in new.items() if n not in cols])


def odds_statistics(odds_history: DataFrame, epsilon: float | None = None) -> DataFrame:
    """A1: per-outcome odds statistics (reference volatility/drift rules kept, D15); with ``epsilon`` the
    volatility is std / (mean + epsilon) without the zero rules."""
    v = F.col("odds_value")
    s = (odds_history.filter(F.col("outcome_id").isNotNull()).groupBy("outcome_id")
         .agg(F.min(v).alias("odds_min"), F.max(v).alias("odds_max"), exact_avg(v).alias("odds_mean"),
              F.stddev_samp(v).alias("odds_std"), F.count(v).alias("odds_updates_count"),
              F.min("timestamp").alias("first_odds_time"), F.max("timestamp").alias("last_odds_time")))
    mean, std, mn, mx = F.col("odds_mean"), F.col("odds_std"), F.col("odds_min"), F.col("odds_max")
    if epsilon is not None:
        return s.withColumn("odds_volatility", std / (mean + F.lit(epsilon))).withColumn("odds_range", mx - mn)
    return (s.withColumn("odds_volatility", F.when((mean == 0) | (std == 0), F.lit(0.0)).otherwise(std / mean))
            .withColumn("odds_range", mx - mn)
            .withColumn("odds_drift", F.when(mn == 0, F.lit(0.0)).otherwise((mx - mn) / mn)))


def with_odds(df: DataFrame, odds_history: DataFrame | None) -> DataFrame:
    """⟕ per-outcome odds statistics (D1: actually joined)."""
    if odds_history is None or "outcome_id" not in df.columns:
        return df
    return df.join(broadcast_if_small(odds_statistics(odds_history)), "outcome_id", "left")


def event_aggregates(df: DataFrame) -> DataFrame:
    """A2: per-event market/outcome/bet statistics."""
    a, o = F.col("bet_amount"), F.col("odds_used")
    rows = df.filter(F.col("event_id").isNotNull())

    def by_event(*cols):
        return rows.select("event_id", *cols).repartition("event_id").groupBy("event_id")

    # each part moves the columns it reads, once; one aggregate with two distinct counts would move three copies of every row
    parts = [by_event("market_id").agg(F.count_distinct("market_id").alias("num_markets")),
             by_event("outcome_id").agg(F.count_distinct("outcome_id").alias("num_outcomes")),
             by_event("bet_amount", "odds_used").agg(
                 F.count(a).alias("total_bets"),
                 F.coalesce(exact_sum(a), F.lit(0.0)).alias("total_volume"),
                 exact_avg(a).alias("avg_bet_amount"),
                 exact_avg(o).alias("avg_odds"),
                 F.stddev_samp(o).alias("event_odds_std"))]
    return (reduce(lambda x, y: x.join(y, "event_id"), parts)
            .withColumn("event_popularity", F.col("total_bets"))
            .withColumn("event_liquidity", F.col("total_volume")))


def market_aggregates(df: DataFrame) -> DataFrame:
    """A3: per-market statistics."""
    a, o = F.col("bet_amount"), F.col("odds_used")
    rows = df.filter(F.col("market_id").isNotNull()).select("market_id", "outcome_id", "bet_amount", "odds_used")
    return (rows.repartition("market_id").groupBy("market_id")
            .agg(F.count_distinct("outcome_id").alias("market_num_outcomes"),
                 F.count(a).alias("market_bet_count"),
                 F.coalesce(exact_sum(a), F.lit(0.0)).alias("market_volume"),
                 exact_avg(a).alias("market_avg_bet"),
                 exact_avg(o).alias("market_avg_odds"),
                 F.stddev_samp(o).alias("market_odds_std")))


def with_hierarchy_aggregates(df: DataFrame) -> DataFrame:
    """⟕ event and market aggregates (D1: actually joined)."""
    need = {"event_id", "market_id", "outcome_id", "bet_amount", "odds_used"}
    if not need <= set(df.columns):
        return df
    return (df.join(event_aggregates(df), "event_id", "left")
            .join(market_aggregates(df), "market_id", "left"))


def with_market_aggregates(rows: DataFrame, by_market: DataFrame, own: DataFrame) -> tuple[DataFrame, list[str]]:
    """⟕ market aggregates, on rows laid by event: the aggregates travel, narrow, to every event that their market's rows
    name (``own``: event_id and market_id of the rows), and meet the rows there, so that one move of the rows serves this and the
    event columns. A row that has a market has an event. The event and market ids stay; the added columns' names follow."""
    added = [c for c in by_market.columns if c != "market_id"]
    pairs = own.filter("market_id is not null").repartition("market_id").distinct()
    placed = pairs.join(by_market, "market_id").select("event_id", "market_id", *added, F.lit(1).alias("_placed"))
    both = rows.unionByName(placed, allowMissingColumns=True).repartition("event_id")
    there = Window.partitionBy("event_id", "market_id")
    met = both.select(*rows.columns, *[F.max(c).over(there).alias(c) for c in added], "_placed")
    return met.filter("_placed is null").drop("_placed"), added


def build_hierarchy(events: DataFrame, markets: DataFrame, outcomes: DataFrame, bets: DataFrame,
                    users: DataFrame, odds_history: DataFrame | None, as_of: str, stage: str = "full", known: bool = False,
                    columns: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """F21 over any six tables: P1 → J1…J5 → U1 → W1 ('combined') → P2…P4 ('temporal') → J8 ('odds') → J9 ('full').

    Rows are joined narrow: users and odds statistics first, then by event the market aggregates, the event aggregates and
    the event columns, and the calendar features last, in the same projection. The narrow rows are written before and
    after they meet the users, and the event aggregates, so that each step's shuffle files go before the next one's come; the market aggregates travel to the events their rows name, so the rows are moved once
    for both. ``known``: every bet's event is among ``events`` already. ``columns``: the columns that the caller reads; of
    the rest only what the joins and aggregates need is carried. ``keep`` takes the rows, before the odds and the last joins, and
    returns those that are wanted; aggregates are of all rows (stages 'odds' and 'full')."""
    from oddsforge.session import cut_lineage, release

    markets = clean_text_keys(markets, TEXT_KEYS["markets"])
    outcomes = clean_text_keys(outcomes, TEXT_KEYS["outcomes"])
    bets = clean_text_keys(bets, TEXT_KEYS["bets"])
    if stage == "combined":
        return combined_view(events, markets, outcomes, bets, users, known)
    need = {"event_id", "market_id", "outcome_id", "bet_amount", "odds_used"}
    kept = None if columns is None else {*columns, *need, "_view", "user_id", "bet_timestamp",
                                         *[own for c, own in own_names(["market_name", "outcome_name"]).items() if c in columns]}
    rows = bet_rows(events, markets, outcomes, bets, known, kept)
    of_user = set(users.columns) - set(rows.columns) - set(events.columns)
    if columns is not None and not of_user & set(columns):
        rows = _repeated_by_users(rows, users)
    else:
        before, rows = rows, _with_own_users(rows, events, users)
        if kept is not None:
            rows = rows.select(*[c for c in rows.columns if c in kept])
        rows = cut_lineage(rows)
        release(before)
    order = _view_columns(rows, events, users, bets)
    if stage == "temporal":
        return temporal_features(with_names(with_events(rows, events)).select(*order), as_of)
    by_event, by_market, head = None, None, ["outcome_id"]
    if stage == "full" and need <= set(order):
        by_event, by_market, market_table = event_aggregates(rows), market_aggregates(rows), rows.select("event_id", "market_id")
        if columns is None or set(by_event.columns) & set(columns) - {"event_id"}:
            by_event = cut_lineage(by_event)
        head = ["market_id", "event_id", "outcome_id"]
    if keep is not None:
        rows = keep(rows)
        market_table = rows.select("event_id", "market_id")
    rows = with_odds(rows, odds_history)
    tail = [c for c in rows.columns if c not in order and c != "_view"]          # odds statistics
    if by_event is not None:
        rows, of_market = with_market_aggregates(rows, by_market, market_table)
        tail += [c for c in by_event.columns if c != "event_id"] + of_market
    rows = with_events(rows, events, by_event)
    view = temporal_features(with_names(rows), as_of)
    new = [c for c in view.columns if c not in order and c not in tail]
    return view.select(*[c for c in [*head, *[c for c in order if c not in head], *new, *tail] if c in view.columns])


def strict_hierarchy(events: DataFrame, markets: DataFrame, outcomes: DataFrame, bets: DataFrame,
                     users: DataFrame) -> DataFrame:
    """Events ⋈ markets ⋈ outcomes (inner), ⟕ bets on outcome_id, ⟕ users. The catalogue is read twice and so written."""
    from oddsforge.session import cut_lineage

    m = markets.drop(*[c for c in markets.columns if c in events.columns and c != "event_id"])
    o = outcomes.drop(*[c for c in outcomes.columns if c != "market_id" and c in {*events.columns, *m.columns}])
    if "market_id" in m.columns:      # markets meet their outcomes first, narrow
        mo = m.join(o, "market_id", "inner")
        cat = events.join(mo, "event_id", "inner").select("market_id", "event_id", *[c for c in [*events.columns, *mo.columns] if c not in ("market_id", "event_id")])
    else:
        cat = events.join(m, "event_id", "inner").join(o, "market_id", "inner")
    cat = cut_lineage(cat)
    b = bets.drop(*[c for c in bets.columns if c in cat.columns and c != "outcome_id"])
    return view_with_users(lambda x: catalogue_left_join(cat, x, ["outcome_id"]), b, users)


def live_flag_by_outcome(bets: DataFrame, events: DataFrame, markets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Live flag from the start time of the bet's outcome's event (the correlated
    scalar subquery written as a join to a pre-aggregated outcome -> start table)."""
    start = (outcomes.select("outcome_id", "market_id").join(markets.select("market_id", "event_id"), "market_id")
             .join(events.select("event_id", "event_start_time"), "event_id")
             .groupBy("outcome_id").agg(F.max("event_start_time").alias("_start")))
    live = F.timestamp_diff("MINUTE", F.col("bet_timestamp"), F.col("_start")) <= 0
    return (bets.join(start, "outcome_id", "left")
            .withColumn("is_live_bet", F.when(live, F.lit(1)).otherwise(F.lit(0))).drop("_start"))
