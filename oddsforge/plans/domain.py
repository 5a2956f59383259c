"""Domain tables built from a driver-table folder (loaders applied to the test mapping)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsforge.sources import loaders as L
from oddsforge.sources import testmap as tm


def users(spark: SparkSession, d: str) -> DataFrame:
    return L.load_users(tm.raw_users(spark, d), tm.BETS_AS_OF)


def events(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """All events; a look-back is a parameter of the S2 query only. ``lines``: the written line catalogue."""
    return L.load_events(tm.raw_events(spark, d, lines), tm.BETS_AS_OF, all_history=True)


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return L.load_events(tm.raw_events(spark, d), tm.BETS_AS_OF, days_back=tm.EVENTS_DAYS_BACK)


def bets(spark: SparkSession, d: str, lines: DataFrame | None = None, known_only: bool = False) -> DataFrame:
    """All bets; a look-back is a parameter of the S3 and Q queries only. ``known_only``: those on a loaded event."""
    return L.load_bets(tm.raw_bets(spark, d), tm.raw_events(spark, d, lines), tm.BETS_AS_OF, all_history=True, known_only=known_only)


def recent_bets(spark: SparkSession, d: str) -> DataFrame:
    return L.load_bets(tm.raw_bets(spark, d), tm.raw_events(spark, d), tm.BETS_AS_OF,
                       days_back=tm.BETS_DAYS_BACK)


def markets(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    return L.load_markets(tm.raw_markets(spark, d, lines))


def outcomes(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    return L.load_outcomes(tm.raw_outcomes(spark, d, lines))


def odds_history(spark: SparkSession, d: str) -> DataFrame:
    return L.load_odds_history(tm.raw_odds_history(spark, d))


def behaviour_log(spark: SparkSession, d: str) -> DataFrame:
    return tm.behaviour_log(spark, d)


def hierarchy(spark: SparkSession, d: str, stage: str = "full", columns: list[str] | None = None, lines: DataFrame | None = None,
              keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """F21 and its stages over the mapped tables; with ``columns`` those columns of it, in that order.

    From the combined view on, the fact table is read twice: once for the narrow (part, supplier, line) catalogue, from
    which events, markets, outcomes and the bets' event dates come, and once for the bets. The catalogue, the events and the
    bets are written; bets, events and catalogue meet by event, so the bets move once for both joins. ``lines``: the catalogue
    that the caller has written and keeps. ``keep`` chooses among the deduplicated rows, by their bet columns, those that
    go on to the last joins; the aggregates are of all rows.
    """
    from oddsforge.operators import hierarchy as H
    from oddsforge.session import cut_lineage, release

    given = lines
    if lines is None and stage not in ("catalogue", "direct"):
        lines = cut_lineage(tm.line_catalogue(spark, d))
    ev, mk, oc, us = events(spark, d, lines), markets(spark, d, lines), outcomes(spark, d, lines), users(spark, d)
    if stage in ("catalogue", "classic", "direct"):
        mk, oc = H.clean_text_keys(mk, H.TEXT_KEYS["markets"]), H.clean_text_keys(oc, H.TEXT_KEYS["outcomes"])
        if stage == "catalogue":
            return H.events_markets_outcomes(ev, mk, oc)
        bt = cut_lineage(H.clean_text_keys(bets(spark, d, lines), H.TEXT_KEYS["bets"]))
        if stage == "direct":
            return H.with_users(H.direct_view(ev, bt), us)
        cat = cut_lineage(H.events_markets_outcomes(ev, mk, oc))
        release(lines)      # the catalogue and the bets are written
        return H.view_with_users(lambda b: H.classic_view(cat, b), bt, us)
    ev = cut_lineage(ev)
    raw = cut_lineage(tm.raw_bets(spark, d))
    bt = L.load_bets(raw, ev, tm.BETS_AS_OF, all_history=True, known_only=True)     # no view has a bet on an event that is not loaded
    full = H.build_hierarchy(ev, mk, oc, bt, us, odds_history(spark, d), tm.BETS_AS_OF, stage, known=True, columns=columns, keep=keep)
    release(raw, *([] if given is not None else [lines]))     # the hierarchy's rows are written
    return full if columns is None else full.select(*columns)


def hierarchy_table(spark: SparkSession, d: str, columns: list[str] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """The full hierarchy (or the ``columns`` of it that a caller uses), materialised once with a reliable checkpoint.

    Downstream operators read small statistics (quantiles, min/max, bucket cut
    points) before building their plans; without the cut each read would
    re-run the five-table join. The checkpoint lives in ``spark.checkpoint.dir``
    (a shared folder on a cluster), so it survives executor loss.
    """
    from oddsforge.session import cut_lineage

    return cut_lineage(hierarchy(spark, d, columns=columns, lines=lines))
