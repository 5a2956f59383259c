"""DuckDB SQL oracle: the driver-table -> domain-table mapping and query texts.

Every text is independent ANSI/DuckDB SQL over the pre-registered driver views,
written from the operator semantics (not generated from Spark plans).
"""

from __future__ import annotations

from oddsforge.config import ROLLING_WINDOWS_DAYS
from oddsforge.sources import testmap as tm

BETS_AS_OF = f"TIMESTAMP '{tm.BETS_AS_OF}'"
LOG_AS_OF = f"TIMESTAMP '{tm.LOG_AS_OF}'"

CTE = {}
#: CTEs that several later ones read; evaluated once.
WRITTEN = {"hier_o", "hier", "prep_in", "combined", "ues", "scored"}
CTE["users_raw"] = """
  SELECT c.c_custkey AS user_id, f.registration_date, n.n_name AS country,
         c.c_acctbal AS total_deposits, CAST(c.c_mktsegment = 'BUILDING' AS INTEGER) AS vip_status
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS registration_date FROM orders GROUP BY o_custkey) f
    ON c.c_custkey = f.o_custkey"""
CTE["events_raw"] = f"""
  SELECT p.p_partkey AS event_id, p.p_brand AS sport, p.p_type AS competition, p.p_name AS teams,
         p.p_retailprice AS popularity_index, s.event_start_time,
         CASE WHEN s.event_start_time < {BETS_AS_OF} THEN 'finished'
              WHEN s.event_start_time IS NOT NULL THEN 'scheduled' END AS event_status
  FROM part p
  LEFT JOIN (SELECT l_partkey, MIN(l_shipdate) AS event_start_time FROM lineitem GROUP BY l_partkey) s
    ON p.p_partkey = s.l_partkey"""
CTE["markets_raw"] = """
  SELECT li.l_partkey * 10000 + li.l_suppkey AS market_id, li.l_partkey AS event_id, s.s_name AS market_name
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) li
  LEFT JOIN supplier s ON li.l_suppkey = s.s_suppkey"""
CTE["outcomes_raw"] = """
  SELECT (l_partkey * 10000 + l_suppkey) * 10 + l_linenumber AS outcome_id,
         l_partkey * 10000 + l_suppkey AS market_id, CAST(l_linenumber AS VARCHAR) AS outcome_name
  FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem)"""
CTE["bets_raw"] = """
  SELECT l.l_orderkey * 10 + l.l_linenumber AS bet_id, o.o_custkey AS user_id, l.l_partkey AS event_id,
         (l.l_partkey * 10000 + l.l_suppkey) * 10 + l.l_linenumber AS outcome_id,
         l.l_extendedprice AS bet_amount, 1.0 + 40.0 * l.l_discount AS odds,
         o.o_orderdate AS bet_timestamp, l.l_shipdate AS settlement_timestamp,
         CAST(l.l_linenumber AS VARCHAR) AS outcome, s.s_name AS market,
         CASE WHEN l.l_returnflag = 'R' THEN 'won' WHEN l.l_returnflag = 'A' THEN 'lost' ELSE 'pending' END
           AS bet_result
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey"""
CTE["odds_raw"] = """
  SELECT user_id AS outcome_id, event_id, value AS odds_value, ts AS "timestamp" FROM events"""
CTE["blog"] = """
  SELECT user_id, event_id AS bet_id, ts AS bet_timestamp, value AS bet_amount, event_type AS sport,
         props AS market_name, 1.0 + CAST(event_id % 40 AS DOUBLE) / 10.0 AS odds_used,
         CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(event_id % 3 AS INTEGER) END AS outcome,
         CAST(event_id % 2 AS INTEGER) AS is_live_bet
  FROM events"""

# S1..S3 loaders over the raw tables (parameters of the registered queries)
CTE["users"] = f"""
  SELECT user_id, registration_date, total_deposits, vip_status, country AS user_country,
         date_diff('day', CAST(registration_date AS DATE), CAST({BETS_AS_OF} AS DATE)) AS days_since_registration
  FROM users_raw"""
CTE["events_l"] = f"""
  SELECT event_id, sport, competition, teams, popularity_index, event_start_time, event_status,
         CAST(CASE WHEN event_start_time > {BETS_AS_OF} THEN date_sub('hour', {BETS_AS_OF}, event_start_time)
              ELSE 0 END AS BIGINT) AS hours_until_event
  FROM events_raw WHERE event_status IN ('scheduled', 'live', 'finished')"""
EVENTS_SINCE = f"{BETS_AS_OF} - INTERVAL {tm.EVENTS_DAYS_BACK} DAY"
CTE["bets"] = f"""
  SELECT b.bet_id, b.user_id, b.event_id, b.outcome_id, b.bet_amount, b.odds AS odds_used, b.bet_timestamp,
         b.settlement_timestamp, b.outcome AS outcome_label, b.market, b.bet_result,
         CASE WHEN b.bet_result = 'won' THEN 1 WHEN b.bet_result = 'lost' THEN 0 END AS outcome,
         CASE WHEN e.event_start_time IS NOT NULL
               AND date_sub('minute', b.bet_timestamp, e.event_start_time) <= 0 THEN 1 ELSE 0 END AS is_live_bet
  FROM bets_raw b LEFT JOIN events_raw e ON b.event_id = e.event_id
  WHERE b.bet_result IN ('won', 'lost', 'pending')"""

DEPS = {
    "users": ["users_raw"], "events_l": ["events_raw"], "bets": ["bets_raw", "events_raw"],
}


def xsum(x: str) -> str:
    """Exact (decimal) sum cast back to double — mirrors ``exact_sum``."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,9))) AS DOUBLE)"


def xavg(x: str) -> str:
    return f"({xsum(x)} / COUNT({x}))"


def with_ctes(names: list[str], body: str) -> str:
    """Assemble ``WITH`` over the named CTEs (dependencies first, each once)."""
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in WRITTEN else ''}({CTE[n]})" for n in order) + "\n" + body


def rounded(inner: str, cols6=(), cols2=()) -> str:
    """Round double columns the same way the Spark side does (6 dp, 2 dp for money sums)."""
    def r(c, scale):
        x = f"CAST({c} AS DOUBLE)"
        return (f"CASE WHEN isnan({x}) OR isinf({x}) THEN {x} "
                f"ELSE floor({x} * {scale} + 0.5) / {scale} END AS {c}")

    reps = [r(c, "1000000.0") for c in cols6] + [r(c, "100.0") for c in cols2]
    if not reps:
        return inner
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{inner}\n) _r"


# ---------------------------------------------------------------------------
# RFM segment membership in order, written out apart from the plan's own table.
SEGMENTS = (
    ("Champions", ("555", "554", "544", "545", "454", "455", "445")),
    ("Loyal Customers", ("543", "444", "435", "355", "354", "345", "344", "335")),
    ("Potential Loyalists", ("512", "511", "422", "421", "412", "411", "311")),
    ("New Customers", ("155", "154", "144", "214", "215", "115", "114")),
    ("Promising", ("512", "511", "311", "411")),
    ("Need Attention", ("133", "123", "132", "143", "244")),
    ("About to Sleep", ("214", "215", "115", "114")),
    ("At Risk", ("111", "112", "121", "131", "141", "151")),
)


# ---------------------------------------------------------------------------
# F20 / W2..W5 behavioural features

def _ts_minus(as_of_lit: str, n: int) -> str:
    return f"({as_of_lit} - INTERVAL {n} DAY)"


def behaviour_sql(source_cte: str, as_of_lit: str, windows=ROLLING_WINDOWS_DAYS,
                  rfm: bool = True) -> str:
    w = list(windows)
    wc = ", ".join(f"COUNT(*) FILTER (WHERE bet_timestamp >= {_ts_minus(as_of_lit, n)}) AS w{n}" for n in w)
    flags = ", ".join(
        f"COALESCE(CASE WHEN wc.w{n} > 0 THEN bet_timestamp >= {_ts_minus(as_of_lit, n)} "
        f"ELSE bet_timestamp IS NOT NULL END, FALSE) AS f{n}" for n in w)
    main = []
    for n in w:
        a, o = f"CASE WHEN f{n} THEN bet_amount END", f"CASE WHEN f{n} THEN odds_used END"
        main += [
            f"COUNT(*) FILTER (WHERE f{n}) AS r{n}",
            f"COUNT({a}) AS bet_count_{n}d",
            f"COALESCE({xsum(a)}, 0) AS total_stake_{n}d",
            f"COALESCE({xavg(a)}, 0) AS avg_stake_{n}d",
            f"COALESCE(STDDEV_SAMP({a}), 0) AS stake_std_{n}d",
            f"COALESCE({xavg(o)}, 0) AS avg_odds_{n}d",
            f"COALESCE(STDDEV_SAMP({o}), 0) AS odds_std_{n}d",
            f"COALESCE(MIN({o}), 0) AS min_odds_{n}d",
            f"COALESCE(MAX({o}), 0) AS max_odds_{n}d",
            f"CAST(COALESCE(SUM(CASE WHEN f{n} THEN outcome END), 0) AS DOUBLE) AS total_wins_{n}d",
            f"COUNT(*) FILTER (WHERE f{n} AND outcome = 1) AS wins{n}",
            f"COALESCE(CAST(SUM(CASE WHEN f{n} THEN is_live_bet END) AS DOUBLE) / COUNT(CASE WHEN f{n} THEN is_live_bet END), 0) AS live_bet_rate_{n}d",
        ]
    main += ["MAX(bet_timestamp) AS last_bet", "COUNT(*) AS rows_all"]
    sp1 = ", ".join(f"MAX(CAST(f{n} AS INTEGER)) AS a{n}" for n in w)
    sp2 = ", ".join(f"CAST(SUM(CASE WHEN sport IS NOT NULL THEN a{n} ELSE 0 END) AS BIGINT) AS sports_diversity_{n}d" for n in w)
    mk2 = ", ".join(f"CAST(SUM(CASE WHEN market_name IS NOT NULL THEN a{n} ELSE 0 END) AS BIGINT) AS market_diversity_{n}d" for n in w)
    measures = ["bet_count", "total_stake", "avg_stake", "stake_std", "avg_odds", "odds_std", "min_odds",
                "max_odds", "total_wins", "win_rate", "sports_diversity", "market_diversity", "live_bet_rate"]
    out = []
    for n in w:
        for m in measures:
            if m == "win_rate":
                out.append(f"CASE WHEN r{n} > 0 THEN CAST(wins{n} AS DOUBLE) / r{n} END AS win_rate_{n}d")
            else:
                out.append(f"CASE WHEN r{n} > 0 THEN {m}_{n}d END AS {m}_{n}d")
    present = " OR ".join(f"r{n} > 0" for n in w)
    trends = []
    if 7 in w and 30 in w:
        trends = ["win_rate_7d - win_rate_30d AS win_rate_trend", "avg_stake_7d / (avg_stake_30d + 1.0) AS stake_trend"]
    sql = f"""
src AS (SELECT * FROM {source_cte}),
wc AS (SELECT {wc} FROM src),
fl AS (SELECT src.*, {flags} FROM src, wc WHERE user_id IS NOT NULL),
main AS (SELECT user_id, {', '.join(main)} FROM fl GROUP BY user_id),
sp AS (SELECT user_id, {sp2},
              SUM(CASE WHEN sport IS NOT NULL THEN CAST(c AS DOUBLE) END) AS cn,
              SUM(CASE WHEN sport IS NOT NULL THEN CAST(c AS DOUBLE) * ln(CAST(c AS DOUBLE)) END) AS clogc
       FROM (SELECT user_id, sport, {sp1}, COUNT(*) AS c FROM fl GROUP BY user_id, sport) GROUP BY user_id),
mk AS (SELECT user_id, {mk2}
       FROM (SELECT user_id, market_name, {sp1} FROM fl GROUP BY user_id, market_name) GROUP BY user_id),
uw AS (SELECT main.user_id, {', '.join(out)},
              CASE WHEN rows_all > 1 AND cn > 0 THEN ln(cn) - clogc / cn ELSE 0.0 END AS sports_entropy,
              CAST(floor(date_diff('microsecond', last_bet, {as_of_lit}) / 86400000000.0) AS BIGINT) AS recency_days
       FROM main JOIN sp ON main.user_id = sp.user_id JOIN mk ON main.user_id = mk.user_id
       WHERE {present}),
ut AS (SELECT uw.*{', ' + ', '.join(trends) if trends else ''} FROM uw)"""
    if not rfm:
        return sql + "\nSELECT * FROM ut"
    specs = [("frequency_score", "COALESCE(CAST(bet_count_30d AS DOUBLE), 0.0)", False),
             ("monetary_score", "COALESCE(total_stake_30d, 0.0)", False),
             ("recency_score", "COALESCE(CAST(recency_days AS DOUBLE), 999.0)", True)]
    stats = []
    for name, x, _ in specs:
        stats += [f"MIN({x}) AS {name}_mn", f"MAX({x}) AS {name}_mx",
                  f"quantile_cont({x}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS {name}_q"]
    bins = []
    for name, x, rev in specs:
        q = f"st.{name}_q"
        distinct = " AND ".join(f"{q}[{i}] < {q}[{i + 1}]" for i in range(1, 6))
        edge = lambda j: (f"(CASE WHEN {distinct} THEN {q}[{j + 1}] "
                          f"ELSE {j} * ((st.{name}_mx - st.{name}_mn) / 5) + st.{name}_mn END)")
        b = "1 + " + " + ".join(f"CAST({x} > {edge(j)} AS INTEGER)" for j in range(1, 5))
        if rev:
            b = f"6 - ({b})"
        bins.append(f"CAST(CASE WHEN st.{name}_mn = st.{name}_mx THEN 1 ELSE {b} END AS INTEGER) AS {name}")
    seg = "CASE " + " ".join(
        f"WHEN rfm_score IN ({', '.join(repr(m) for m in members)}) THEN '{name}'"
        for name, members in SEGMENTS
    ) + " ELSE 'Lost' END"
    return sql + f""",
st AS (SELECT {', '.join(stats)} FROM ut),
sc AS (SELECT ut.*, {', '.join(bins)} FROM ut, st),
rf AS (SELECT sc.*, CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR)
                    || CAST(monetary_score AS VARCHAR) AS rfm_score FROM sc)
SELECT rf.*, {seg} AS user_segment FROM rf"""


# ---------------------------------------------------------------------------
# F21 hierarchy

TWO_PI = "6.283185307179586"
CTE["mk"] = "SELECT market_id, event_id, lower(trim(market_name)) AS market_name FROM markets_raw"
CTE["oc"] = "SELECT outcome_id, market_id, lower(trim(outcome_name)) AS outcome_name FROM outcomes_raw"
CTE["bt"] = """
  SELECT bet_id, user_id, event_id, outcome_id AS bet_outcome_id, bet_amount, odds_used, bet_timestamp,
         settlement_timestamp, lower(trim(outcome_label)) AS outcome_label, lower(trim(market)) AS market,
         bet_result, outcome, is_live_bet
  FROM bets"""
BET_COLS = ("bet_id, user_id, bet_outcome_id, bet_amount, odds_used, bet_timestamp, settlement_timestamp, "
            "outcome_label, market, bet_result, outcome, is_live_bet")
USER_COLS = "registration_date, total_deposits, vip_status, user_country, days_since_registration"
CTE["cat"] = """
  SELECT e.*, m.market_id, m.market_name, o.outcome_id, o.outcome_name
  FROM events_l e LEFT JOIN mk m ON e.event_id = m.event_id LEFT JOIN oc o ON m.market_id = o.market_id"""
CTE["classic"] = f"""
  SELECT x.*, {', '.join('u.' + c.strip() for c in USER_COLS.split(','))}
  FROM (SELECT c.*, {', '.join('b.' + c.strip() for c in BET_COLS.split(','))}
        FROM cat c LEFT JOIN bt b
          ON c.event_id = b.event_id AND c.market_name = b.market AND c.outcome_name = b.outcome_label) x
  LEFT JOIN users u ON x.user_id = u.user_id"""
CTE["direct"] = f"""
  SELECT x.*, {', '.join('u.' + c.strip() for c in USER_COLS.split(','))}
  FROM (SELECT e.*, {', '.join('b.' + c.strip() for c in BET_COLS.split(','))}
        FROM events_l e LEFT JOIN bt b ON e.event_id = b.event_id) x
  LEFT JOIN users u ON x.user_id = u.user_id"""
_ORDER = ("_view, event_id, market_id, outcome_id, bet_outcome_id, user_id, bet_timestamp, bet_amount, "
          "odds_used, settlement_timestamp, market, outcome_label, bet_result")
CTE["combined"] = f"""
  SELECT * EXCLUDE (_view, _rn) REPLACE (COALESCE(outcome_id, bet_outcome_id) AS outcome_id)
  FROM (SELECT *, row_number() OVER (PARTITION BY bet_id ORDER BY
               {', '.join(c.strip() + ' ASC NULLS FIRST' for c in _ORDER.split(','))}) AS _rn
        FROM (SELECT *, 0 AS _view FROM classic UNION ALL BY NAME SELECT *, 1 AS _view FROM direct))
  WHERE _rn = 1"""


def temporal_select(src: str, as_of_lit: str) -> str:
    st, bt = "event_start_time", "bet_timestamp"
    return f"""
  SELECT * REPLACE (COALESCE(CAST(bet_timing_hours_before <= 0 AS INTEGER), 0) AS is_live_bet)
  FROM (SELECT * EXCLUDE (hours_until_event_f) REPLACE (hours_until_event_f AS hours_until_event)
  FROM (SELECT s.*,
         CAST(floor(date_diff('microsecond', {as_of_lit}, {st}) / 86400000000.0) AS BIGINT) AS days_until_event,
         date_diff('microsecond', {as_of_lit}, {st}) / 3600000000.0 AS hours_until_event_f,
         month({st}) AS event_month, isodow({st}) - 1 AS event_day_of_week, hour({st}) AS event_hour,
         COALESCE(CAST(isodow({st}) - 1 >= 5 AS INTEGER), 0) AS is_weekend_event,
         sin({TWO_PI} * hour({st}) / 24) AS event_hour_sin, cos({TWO_PI} * hour({st}) / 24) AS event_hour_cos,
         sin({TWO_PI} * month({st}) / 12) AS event_month_sin, cos({TWO_PI} * month({st}) / 12) AS event_month_cos,
         hour({bt}) AS bet_hour, isodow({bt}) - 1 AS bet_day_of_week,
         COALESCE(CAST(isodow({bt}) - 1 >= 5 AS INTEGER), 0) AS is_bet_weekend,
         date_diff('microsecond', {bt}, {st}) / 3600000000.0 AS bet_timing_hours_before
  FROM {src} s))"""


CTE["hier_t"] = temporal_select("combined", BETS_AS_OF)
CTE["odds_stats"] = f"""
  SELECT *, CASE WHEN odds_mean = 0 OR odds_std = 0 THEN 0.0 ELSE odds_std / odds_mean END AS odds_volatility,
         odds_max - odds_min AS odds_range,
         CASE WHEN odds_min = 0 THEN 0.0 ELSE (odds_max - odds_min) / odds_min END AS odds_drift
  FROM (SELECT outcome_id, MIN(odds_value) AS odds_min, MAX(odds_value) AS odds_max,
               {xavg('odds_value')} AS odds_mean, STDDEV_SAMP(odds_value) AS odds_std,
               COUNT(odds_value) AS odds_updates_count, MIN("timestamp") AS first_odds_time,
               MAX("timestamp") AS last_odds_time
        FROM odds_raw WHERE outcome_id IS NOT NULL GROUP BY outcome_id)"""
CTE["hier_o"] = "SELECT * FROM hier_t LEFT JOIN odds_stats USING (outcome_id)"
CTE["event_agg"] = f"""
  SELECT *, total_bets AS event_popularity, total_volume AS event_liquidity
  FROM (SELECT event_id, COUNT(DISTINCT market_id) AS num_markets, COUNT(DISTINCT outcome_id) AS num_outcomes,
               COUNT(bet_amount) AS total_bets, COALESCE({xsum('bet_amount')}, 0) AS total_volume,
               {xavg('bet_amount')} AS avg_bet_amount, {xavg('odds_used')} AS avg_odds,
               STDDEV_SAMP(odds_used) AS event_odds_std
        FROM hier_o WHERE event_id IS NOT NULL GROUP BY event_id)"""
CTE["market_agg"] = f"""
  SELECT market_id, COUNT(DISTINCT outcome_id) AS market_num_outcomes, COUNT(bet_amount) AS market_bet_count,
         COALESCE({xsum('bet_amount')}, 0) AS market_volume, {xavg('bet_amount')} AS market_avg_bet,
         {xavg('odds_used')} AS market_avg_odds, STDDEV_SAMP(odds_used) AS market_odds_std
  FROM hier_o WHERE market_id IS NOT NULL GROUP BY market_id"""
CTE["hier"] = """
  SELECT * FROM hier_o LEFT JOIN event_agg USING (event_id) LEFT JOIN market_agg USING (market_id)"""
DEPS.update({
    "mk": ["markets_raw"], "oc": ["outcomes_raw"], "bt": ["bets"], "cat": ["events_l", "mk", "oc"],
    "classic": ["cat", "bt", "users"], "direct": ["events_l", "bt", "users"],
    "combined": ["classic", "direct"], "hier_t": ["combined"], "odds_stats": ["odds_raw"],
    "hier_o": ["hier_t", "odds_stats"], "event_agg": ["hier_o"], "market_agg": ["hier_o"],
    "hier": ["hier_o", "event_agg", "market_agg"],
})


# ---------------------------------------------------------------------------
# Ratings (P5, P6, A9, A10, F10, F12, W6, F13, A11)

CTE["inter"] = """
  SELECT * FROM (
    SELECT user_id, event_id,
           COALESCE(TRY_CAST(bet_amount AS DOUBLE), 0.0) AS bet_amount,
           COALESCE(TRY_CAST(odds_used AS DOUBLE), 1.0) AS odds_used,
           CAST(COALESCE(TRY_CAST(outcome AS DOUBLE), 0.0) AS INTEGER) AS outcome,
           COALESCE(TRY_CAST(bet_timing_hours_before AS DOUBLE), 24.0) AS bet_timing_hours_before,
           COALESCE(TRY_CAST(is_live_bet AS DOUBLE), 0.0) <> 0 AS is_live_bet
    FROM hier WHERE bet_amount IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL)
  WHERE bet_amount > 0"""
CTE["ues"] = f"""
  SELECT user_id, event_id, COUNT(bet_amount) AS bet_frequency, {xsum('bet_amount')} AS total_stake,
         {xavg('bet_amount')} AS avg_stake, {xavg('odds_used')} AS avg_odds,
         COALESCE(STDDEV_SAMP(odds_used), 0) AS odds_std, CAST(SUM(outcome) AS BIGINT) AS wins,
         COUNT(outcome) AS total_bets,
         CAST(SUM(CAST(is_live_bet AS BIGINT)) AS DOUBLE) / COUNT(is_live_bet) AS live_bet_ratio,
         {xavg('bet_timing_hours_before')} AS avg_timing
  FROM inter GROUP BY user_id, event_id"""


def _clean(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE ({x}) END"


_FREQ = ("CASE WHEN ss.n > 1 AND ss.fstd > 0 THEN (CAST(bet_frequency AS DOUBLE) - ss.fmin) / (ss.fmax - ss.fmin) "
         "ELSE 1.0 END")
_MON = ("CASE WHEN ss.n > 1 AND ss.mstd > 0 THEN (CAST(total_stake AS DOUBLE) - ss.mmin) / (ss.mmax - ss.mmin) "
        "ELSE 1.0 END")
CTE["scored"] = f"""
  SELECT *, least(greatest((0.25 * frequency_score + 0.25 * monetary_score + 0.3 * success_score
                            + 0.1 * engagement_score + 0.1 * timing_score) * 5.0, 0.0), 5.0) AS composite_rating
  FROM (SELECT ues.*, {_clean(_FREQ)} AS frequency_score, {_clean(_MON)} AS monetary_score,
               {_clean('CASE WHEN total_bets > 0 THEN CAST(wins AS DOUBLE) / CAST(total_bets AS DOUBLE) ELSE 0.0 END')}
                 AS success_score,
               {_clean('CAST(live_bet_ratio AS DOUBLE)')} AS engagement_score,
               {_clean('1.0 / (1.0 + abs(CAST(avg_timing AS DOUBLE)))')} AS timing_score
        FROM ues, (SELECT COUNT(*) AS n, MIN(bet_frequency) AS fmin, MAX(bet_frequency) AS fmax,
                          STDDEV_SAMP(bet_frequency) AS fstd, MIN(total_stake) AS mmin, MAX(total_stake) AS mmax,
                          STDDEV_SAMP(total_stake) AS mstd FROM ues) ss)"""
CTE["coo"] = """
  SELECT user_id, event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx,
         dense_rank() OVER (ORDER BY event_id) - 1 AS event_idx, composite_rating AS rating
  FROM scored"""
CTE["simple_scores"] = f"""
  SELECT g.*, (0.4 * CASE WHEN s.fmax = s.fmin THEN 0.0 ELSE (CAST(frequency AS DOUBLE) - s.fmin) / (s.fmax - s.fmin) END
             + 0.3 * CASE WHEN s.amax = s.amin THEN 0.0 ELSE (total_amount - s.amin) / (s.amax - s.amin) END
             + 0.3 * COALESCE(success_rate, 0.0)) * 5.0 AS interaction_score
  FROM (SELECT user_id, event_id, COUNT(bet_amount) AS frequency, {xsum('bet_amount')} AS total_amount,
               CAST(SUM(outcome) AS DOUBLE) / COUNT(outcome) AS success_rate, CAST(SUM(outcome) AS BIGINT) AS wins
        FROM hier WHERE bet_amount IS NOT NULL AND bet_amount > 0 AND user_id IS NOT NULL AND event_id IS NOT NULL
        GROUP BY user_id, event_id) g,
       (SELECT MIN(frequency) AS fmin, MAX(frequency) AS fmax, MIN(total_amount) AS amin, MAX(total_amount) AS amax
        FROM (SELECT COUNT(bet_amount) AS frequency, {xsum('bet_amount')} AS total_amount
              FROM hier WHERE bet_amount IS NOT NULL AND bet_amount > 0 AND user_id IS NOT NULL
                AND event_id IS NOT NULL GROUP BY user_id, event_id)) s"""
DEPS.update({"inter": ["hier"], "ues": ["inter"], "scored": ["ues"], "coo": ["scored"],
             "simple_scores": ["hier"]})

# ---------------------------------------------------------------------------
# Profiling (Q1-Q9)
BET_SINCE = f"({BETS_AS_OF} - INTERVAL {tm.BETS_DAYS_BACK} DAY)"
RECENT_SINCE = f"({BETS_AS_OF} - INTERVAL 365 DAY)"
RAW_BET_COLS = ["bet_id", "user_id", "event_id", "outcome_id", "bet_amount", "odds", "bet_timestamp",
                "settlement_timestamp", "outcome", "market", "bet_result"]


# ---------------------------------------------------------------------------
# Evaluation
CTE["lscores"] = """
  SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_quantity / 10.0 AS rating,
         l_extendedprice / 20000.0 AS prediction FROM lineitem"""
CTE["recs"] = """
  SELECT user_id, event_id AS item_id, rank FROM (
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY timing_score DESC, event_id ASC) AS rank
    FROM scored) WHERE rank <= 20"""
CTE["test_i"] = "SELECT user_id, event_id AS item_id, composite_rating AS rating FROM scored"
DEPS.update({"recs": ["scored"], "test_i": ["scored"]})

AUC_SQL = """
  , d AS (SELECT rating, CASE WHEN prediction IS NULL OR isnan(prediction) THEN 0.5
                              WHEN prediction = 'inf'::DOUBLE THEN 1.0 WHEN prediction = '-inf'::DOUBLE THEN 0.0
                              ELSE prediction END AS prediction FROM lscores),
  t AS (SELECT quantile_cont(rating, 0.5) AS thr FROM d),
  g AS (SELECT prediction AS score, SUM(CASE WHEN rating > thr THEN 1 ELSE 0 END) AS pos,
               SUM(CASE WHEN rating > thr THEN 0 ELSE 1 END) AS neg FROM d, t GROUP BY prediction),
  c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
               SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
               SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g)
  SELECT CASE WHEN SUM(pos) = 0 OR SUM(neg) = 0 THEN 0.5
              ELSE SUM(pos * (neg_below + 0.5 * neg)) / (SUM(pos) * SUM(neg)) END AS auc,
         CASE WHEN SUM(pos) = 0 THEN 0.5
              ELSE COALESCE(SUM(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) END), 0) / SUM(pos) END AS avg_precision
  FROM c"""

RANKING_SQL = """
  , rel AS (SELECT DISTINCT t.user_id, t.item_id FROM test_i t
            JOIN (SELECT user_id, CAST(SUM(CAST(rating AS DECIMAL(38,9))) AS DOUBLE) / COUNT(rating) AS m
                  FROM test_i GROUP BY user_id) mm ON t.user_id = mm.user_id WHERE t.rating > mm.m),
  nrel AS (SELECT user_id, COUNT(*) AS nrel FROM rel GROUP BY user_id),
  ks AS (SELECT unnest([5, 10, 20]) AS k),
  pu AS (SELECT ks.k, r.user_id, COUNT(*) AS len, SUM(CASE WHEN rel.item_id IS NOT NULL THEN 1 ELSE 0 END) AS hits,
                SUM(CASE WHEN rel.item_id IS NOT NULL THEN 1.0 / log2(r.rank + 1) ELSE 0.0 END) AS dcg
         FROM ks JOIN recs r ON r.rank <= ks.k
         LEFT JOIN rel ON r.user_id = rel.user_id AND r.item_id = rel.item_id GROUP BY ks.k, r.user_id),
  pm AS (SELECT pu.k, AVG(CAST(hits AS DOUBLE) / len) AS p, AVG(CAST(hits AS DOUBLE) / nrel) AS r,
                AVG(dcg / (SELECT SUM(1.0 / log2(i + 2)) FROM range(0, least(nrel, pu.k)) t(i))) AS n
         FROM pu JOIN nrel ON pu.user_id = nrel.user_id GROUP BY pu.k)
  SELECT ks.k, COALESCE(p, 0.0) AS precision, COALESCE(r, 0.0) AS recall, COALESCE(n, 0.0) AS ndcg,
         CASE WHEN COALESCE(p, 0.0) + COALESCE(r, 0.0) > 0
              THEN 2.0 * COALESCE(p, 0.0) * COALESCE(r, 0.0) / (COALESCE(p, 0.0) + COALESCE(r, 0.0)) ELSE 0.0 END AS f1
  FROM ks LEFT JOIN pm ON ks.k = pm.k"""

DIVERSITY_SQL = """
  , recs10 AS (SELECT * FROM recs WHERE rank <= 10), pop AS (SELECT item_id, COUNT(*) AS pop FROM test_i GROUP BY item_id),
  su AS (SELECT DISTINCT user_id FROM recs10),
  sets AS (SELECT user_id, list(DISTINCT item_id) AS s FROM recs10 GROUP BY user_id),
  iud AS (SELECT AVG(1.0 - CAST(len(list_intersect(a.s, b.s)) AS DOUBLE)
                     / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE)) AS iud
          FROM sets a JOIN sets b ON a.user_id < b.user_id)
  SELECT CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(DISTINCT item_id) AS DOUBLE) / COUNT(*) ELSE 0.0 END AS diversity,
         CAST(COUNT(DISTINCT item_id) AS DOUBLE) / (SELECT COUNT(DISTINCT item_id) FROM test_i) AS coverage,
         COALESCE((SELECT iud FROM iud), 0.0) AS inter_user_diversity, (SELECT COUNT(*) FROM su) AS n_users_compared,
         greatest(0.0, 1.0 - (SELECT AVG(CAST(COALESCE(p.pop, 0) AS DOUBLE))
                               FROM (SELECT DISTINCT item_id FROM recs10) x LEFT JOIN pop p ON x.item_id = p.item_id)
                              / (SELECT MAX(pop) FROM pop)) AS novelty
  FROM recs10"""
COVERAGE_SQL = """
  , recs10 AS (SELECT * FROM recs WHERE rank <= 10)
  SELECT CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(DISTINCT item_id) AS DOUBLE) / COUNT(*) ELSE 0.0 END AS diversity,
         CAST(COUNT(DISTINCT item_id) AS DOUBLE) / (SELECT COUNT(DISTINCT item_id) FROM test_i) AS coverage
  FROM recs10"""


# ---------------------------------------------------------------------------
# Bandit (M17-M21) and streaming
CTE["rewards"] = "SELECT event_type AS action, CAST(value > 50.0 AS INTEGER) AS reward, user_id FROM events"
CTE["arm_state"] = """
  SELECT a.action, CAST(COALESCE(t.n, 0) AS BIGINT) AS n, COALESCE(t.reward_sum, 0.0) AS reward_sum
  FROM (SELECT DISTINCT action FROM rewards WHERE action IS NOT NULL) a
  FULL OUTER JOIN (SELECT action, COUNT(*) AS n, CAST(SUM(reward) AS DOUBLE) AS reward_sum FROM rewards GROUP BY action) t
    ON a.action = t.action"""
DEPS.update({"arm_state": ["rewards"]})


# ---------------------------------------------------------------------------
# Preparation
PREP_NUM = ["popularity_index", "bet_amount", "odds_used", "odds_mean", "bet_timing_hours_before", "total_deposits"]
PREP_CAT = ["sport", "user_country", "market_name"]
CTE["prep_in"] = (f"SELECT bet_id, event_id, user_id, {', '.join(PREP_NUM + PREP_CAT)}, registration_date, "
                  "bet_timestamp FROM hier")
DEPS.update({"prep_in": ["hier"]})


def mode_sql(c: str, src: str = "prep_in") -> str:
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} ASC LIMIT 1)"


def impute_sql(heavy_share: float | None = None) -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in PREP_NUM)
    if heavy_share is None:
        num = [f"COALESCE(p.{c}, m.{c}, 0) AS {c}" for c in PREP_NUM]
        cat = [f"COALESCE(p.{c}, {mode_sql(c)}, 'Unknown') AS {c}" for c in PREP_CAT]
        keys = ["COALESCE(p.bet_id, 0) AS bet_id", "COALESCE(p.event_id, 0) AS event_id",
                "COALESCE(p.user_id, 0) AS user_id"]
    else:
        num = [f"COALESCE(p.{c}, CASE WHEN s.{c} > {heavy_share} THEN 0 ELSE COALESCE(m.{c}, 0) END) AS {c}"
               for c in PREP_NUM]
        cat = [f"COALESCE(p.{c}, CASE WHEN s.{c} > {heavy_share} THEN 'Unknown' ELSE "
               f"COALESCE({mode_sql(c)}, 'Unknown') END) AS {c}" for c in PREP_CAT]
        keys = ["p.bet_id", "p.event_id", "p.user_id"]
    shares = ", ".join(f"AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in PREP_NUM + PREP_CAT)
    return (f", m AS (SELECT {med} FROM prep_in), s AS (SELECT {shares} FROM prep_in)\n"
            f"SELECT {', '.join(keys + num + cat)}, p.registration_date, p.bet_timestamp FROM prep_in p, m, s")


# ---------------------------------------------------------------------------
# Models with exact oracles (M5 profiles, M11/M12 hybrid given sub-model scores)
CTE["cratings"] = """
  SELECT user_id, event_id % (SELECT COUNT(*) FROM embeddings) AS item_id, value / 100.0 AS rating FROM events"""
CTE["profiles"] = """
  SELECT n.user_id, n.dim, CASE WHEN t.tot > 0 THEN n.num / t.tot ELSE 0.0 END AS value
  FROM (SELECT w.user_id, v.dim, SUM(w.w * v.x) AS num
        FROM (SELECT user_id, item_id, SUM(rating) AS w FROM cratings GROUP BY user_id, item_id) w
        JOIN (SELECT vec_id AS item_id, CAST(unnest(embedding) AS DOUBLE) AS x,
                     generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) v ON w.item_id = v.item_id
        GROUP BY w.user_id, v.dim) n
  JOIN (SELECT user_id, SUM(rating) AS tot FROM cratings GROUP BY user_id) t ON n.user_id = t.user_id"""
CTE["hyb_in"] = """
  SELECT user_id, event_id AS item_id, frequency_score AS s_collaborative, monetary_score AS s_content_based,
         success_score AS s_contextual FROM scored"""
DEPS.update({"profiles": ["cratings"], "hyb_in": ["scored"]})
HYBRID_SCORE_SQL = """
  SELECT user_id, item_id, (0.4 * s_collaborative + 0.3 * s_content_based + 0.3 * s_contextual) / 1.0 AS hybrid_score
  FROM hyb_in"""
HYBRID_LIST_SQL = """
  , l AS (SELECT user_id, item_id, 0.4 * s AS ws FROM (SELECT user_id, item_id, s_collaborative AS s,
            row_number() OVER (PARTITION BY user_id ORDER BY s_collaborative DESC, item_id) AS r FROM hyb_in) WHERE r <= 10
          UNION ALL
          SELECT user_id, item_id, 0.3 * s FROM (SELECT user_id, item_id, s_content_based AS s,
            row_number() OVER (PARTITION BY user_id ORDER BY s_content_based DESC, item_id) AS r FROM hyb_in) WHERE r <= 10
          UNION ALL
          SELECT user_id, item_id, 0.3 * s FROM (SELECT user_id, item_id, s_contextual AS s,
            row_number() OVER (PARTITION BY user_id ORDER BY s_contextual DESC, item_id) AS r FROM hyb_in) WHERE r <= 10),
  a AS (SELECT user_id, item_id, SUM(ws) AS score FROM l GROUP BY user_id, item_id)
  SELECT * FROM (SELECT user_id, item_id, score,
                        row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM a)
  WHERE rank <= 5"""

MKT_SCALED = ["market_popularity", "market_type_encoded", "outcome_type_encoded", "market_bet_count", "market_volume",
              "market_avg_bet", "market_avg_odds", "market_odds_std", "market_win_rate", "market_total_wins"]
CTE["mkt_raw"] = f"""
  SELECT mo.*, p.market_popularity,
         dense_rank() OVER (ORDER BY mo.market_name) - 1 AS market_type_encoded,
         dense_rank() OVER (ORDER BY mo.outcome_name) - 1 AS outcome_type_encoded,
         s.market_bet_count, s.market_volume, s.market_avg_bet, s.market_avg_odds, s.market_odds_std,
         s.market_win_rate, s.market_total_wins
  FROM (SELECT m.market_id, m.event_id, m.market_name, o.outcome_id, o.outcome_name
        FROM markets_raw m JOIN outcomes_raw o ON m.market_id = o.market_id) mo
  LEFT JOIN (SELECT m.market_name, COUNT(*) AS market_popularity
             FROM markets_raw m JOIN outcomes_raw o ON m.market_id = o.market_id GROUP BY m.market_name) p
    ON mo.market_name = p.market_name
  LEFT JOIN (SELECT c.market_id, COUNT(b.bet_amount) AS market_bet_count, {xsum('b.bet_amount')} AS market_volume,
                    {xavg('b.bet_amount')} AS market_avg_bet, {xavg('b.odds_used')} AS market_avg_odds,
                    STDDEV_SAMP(b.odds_used) AS market_odds_std,
                    CAST(SUM(b.outcome) AS DOUBLE) / COUNT(b.outcome) AS market_win_rate,
                    CAST(SUM(b.outcome) AS DOUBLE) AS market_total_wins
             FROM bets b JOIN (SELECT o.outcome_id, o.market_id FROM markets_raw m
                               JOIN outcomes_raw o ON m.market_id = o.market_id) c ON b.outcome_id = c.outcome_id
             GROUP BY c.market_id) s ON mo.market_id = s.market_id"""
DEPS.update({"mkt_raw": ["markets_raw", "outcomes_raw", "bets"]})
_ms = ", ".join(f"CAST(SUM(CAST(COALESCE({c}, 0) AS DECIMAL(38,9))) AS DOUBLE) / COUNT(*) AS m_{c}, "
                f"STDDEV_POP(CAST(COALESCE({c}, 0) AS DOUBLE)) AS s_{c}" for c in MKT_SCALED)
_mx = ", ".join(f"(CAST(COALESCE({c}, 0) AS DOUBLE) - COALESCE(m_{c}, 0.0)) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL "
                f"THEN 1.0 ELSE s_{c} END AS {c}" for c in MKT_SCALED)
MARKET_SQL = f""", st AS (SELECT {_ms} FROM mkt_raw)
SELECT market_id, event_id, market_name, outcome_id, outcome_name, {_mx} FROM mkt_raw, st"""


# ---------------------------------------------------------------------------
# Training sets
_WINDOWED = ["bet_count", "total_stake", "avg_stake", "stake_std", "avg_odds", "odds_std", "min_odds", "max_odds", "total_wins",
             "win_rate", "sports_diversity", "market_diversity", "live_bet_rate"]
_USER_WINDOWS = [f"{m}_{n}d" for n in (7, 30, 90) for m in _WINDOWED]
TRAINING_FEATURES = (["total_deposits", "vip_status", "days_since_registration", *_USER_WINDOWS, "sports_entropy", "user_segment", "sport", "competition",
                      "popularity_index", "days_until_event", "hours_until_event", "event_hour_sin", "event_hour_cos", "event_month_sin",
                      "event_month_cos", "event_hour", "event_day_of_week", "is_weekend_event", "bet_hour", "bet_day_of_week", "is_bet_weekend",
                      "bet_timing_hours_before", "bet_amount", "odds_used", "is_live_bet", "market_type_encoded", "outcome_type_encoded",
                      "market_popularity"])
TRAINING_RATIOS = ["bet_ratio", "implied_probability", "odds_log"]
SIMPLE_TRAINING_FEATURES = [*_USER_WINDOWS, "bet_amount", "odds_used", "is_live_bet", "event_hour", "event_day_of_week", "is_weekend_event",
                            "days_until_event", "sport", "market_name", "user_country"]


def training_sql(clip: bool = False, simple: bool = False) -> str:
    """F17, F18 with the clip, and F18's simplified preset, over the CTEs hier and mkt_raw."""
    texts = ["sport", "market_name", "user_country"] if simple else ["user_segment", "sport", "competition"]
    feats = SIMPLE_TRAINING_FEATURES if simple else TRAINING_FEATURES + TRAINING_RATIOS
    base = [c for c in feats if c not in TRAINING_RATIOS]
    keys = ["bet_id", "user_id", "event_id", "outcome_id"]
    codes = ", ".join(f"""lab_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (
        SELECT COALESCE(CAST({c} AS VARCHAR), 'Unknown') AS v FROM tr UNION SELECT 'Unknown'))""" for c in texts)
    plain = [f"(SELECT code FROM lab_{c} WHERE v = COALESCE(CAST(tr.{c} AS VARCHAR), 'Unknown'))" if c in texts else f"tr.{c}" for c in base]
    ratios = [] if simple else ["tr.bet_amount / (tr.total_deposits + 1.0) AS bet_ratio", "1.0 / least(greatest(tr.odds_used, 1.01), 1000.0) AS implied_probability",
                                "ln(least(greatest(tr.odds_used, 1.01), 1000.0)) AS odds_log"]
    x = ", ".join([f"CAST({e} AS DOUBLE) AS {c}" for e, c in zip(plain, base, strict=True)] + ratios)
    fill = ", ".join(f"COALESCE(x.{c}, {'0' if simple else f'COALESCE(m.{c}, 0)'}) AS {c}" for c in feats)
    low = {c: f"q.{c}_1 - 1.5 * (q.{c}_3 - q.{c}_1)" for c in feats}
    high = {c: f"q.{c}_3 + 1.5 * (q.{c}_3 - q.{c}_1)" for c in feats}
    cut = ", ".join(f"CASE WHEN q.{c}_3 = q.{c}_1 THEN y.{c} ELSE least(greatest(y.{c}, {low[c]}), {high[c]}) END AS {c}" for c in feats) if clip else ", ".join(f"y.{c}" for c in feats)
    quart = lambda t: ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.5) AS {c}_2, quantile_cont({c}, 0.75) AS {c}_3" for c in feats) + f" FROM {t}"
    scaled = ", ".join(f"(z.{c} - s.{c}_2) / CASE WHEN s.{c}_3 = s.{c}_1 THEN 1.0 ELSE s.{c}_3 - s.{c}_1 END AS {c}" for c in feats)
    key = ", ".join(keys)
    market = "" if simple else " LEFT JOIN (SELECT outcome_id, market_type_encoded, outcome_type_encoded, market_popularity FROM mkf) f ON h.outcome_id = f.outcome_id"
    extra = "" if simple else ", f.market_type_encoded, f.outcome_type_encoded, f.market_popularity"
    mkf = "" if simple else f", mkf AS MATERIALIZED (WITH {MARKET_SQL.lstrip(', ')})"
    user = ", ".join(f"b.{c}" for c in [*_USER_WINDOWS, *([] if simple else ["sports_entropy", "user_segment"])])
    return f""", beh AS MATERIALIZED (WITH {behaviour_sql('hier', BETS_AS_OF)}){mkf},
tr AS MATERIALIZED (SELECT h.*, {user}{extra} FROM hier h LEFT JOIN beh b ON h.user_id = b.user_id{market}
       WHERE lower(h.bet_result) IN ('won', 'lost') AND h.outcome IS NOT NULL),
{codes},
x AS MATERIALIZED (SELECT {key}, CAST(tr.outcome AS DOUBLE) AS label, {x} FROM tr),
m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in feats)} FROM x),
y AS MATERIALIZED (SELECT {key}, label, {fill} FROM x, m),
q AS (SELECT {quart('y')}),
z AS MATERIALIZED (SELECT {key}, label, {cut} FROM y, q),
s AS (SELECT {quart('z')})
SELECT {key}, label, {scaled} FROM z, s"""


# ---------------------------------------------------------------------------
# Event content features (F4 event codes, F5 TF-IDF, F6-F8 numeric block)
# The English stop words, written out apart from the plan's own list so
# that a wrong word on one side shows up as a mismatch.
_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now
    i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
"""
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _STOP_WORDS.split()) + "]"
CTE["ev_tfidf"] = f"""
  WITH_INNER ev AS (SELECT event_id, concat_ws(' ', COALESCE(CAST(teams AS VARCHAR), ''),
                                          COALESCE(CAST(competition AS VARCHAR), '')) AS txt FROM events_l)"""
TFIDF_SQL = f"""
  , ev AS (SELECT event_id, concat_ws(' ', COALESCE(CAST(teams AS VARCHAR), ''),
                                      COALESCE(CAST(competition AS VARCHAR), '')) AS txt FROM events_l),
  tok AS (SELECT event_id, list_filter(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                       lambda x: NOT list_contains({_STOP}, x)) AS t FROM ev),
  trm AS (SELECT event_id AS doc_id,
                 unnest(list_concat(t, CASE WHEN len(t) >= 2
                                            THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                                            ELSE [] END)) AS term FROM tok),
  tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM trm GROUP BY doc_id, term),
  st AS (SELECT term, COUNT(*) AS df, SUM(tf) AS cf FROM tf GROUP BY term),
  voc AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
          FROM st, (SELECT COUNT(DISTINCT event_id) AS n FROM events_l) WHERE df >= 2
          ORDER BY cf DESC, term ASC LIMIT 300),
  w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN voc USING (term))
  SELECT doc_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w"""
del CTE["ev_tfidf"]
_EVN = ["popularity_index", "start_hour", "start_dow", "start_month"]
EVENT_NUMERIC_SQL = f"""
  , raw AS (SELECT event_id, COALESCE(popularity_index, (SELECT quantile_cont(popularity_index, 0.5) FROM events_l))
                   AS popularity_index, CAST(hour(event_start_time) AS DOUBLE) AS start_hour,
                   CAST(isodow(event_start_time) - 1 AS DOUBLE) AS start_dow,
                   CAST(month(event_start_time) AS DOUBLE) AS start_month FROM events_l),
  q AS (SELECT {', '.join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _EVN)} FROM raw)
  SELECT event_id, {', '.join(f"({c} - COALESCE(m_{c}, 0.0)) / CASE WHEN b_{c} - a_{c} = 0 OR a_{c} IS NULL THEN 1.0 ELSE b_{c} - a_{c} END AS {c}" for c in _EVN)}
  FROM raw, q"""
EVENT_CODES_SQL = """
  SELECT event_id,
         CAST(dense_rank() OVER (ORDER BY COALESCE(CAST(sport AS VARCHAR), 'nan')) - 1 AS DOUBLE) AS sport_code,
         CAST(dense_rank() OVER (ORDER BY COALESCE(CAST(competition AS VARCHAR), 'nan')) - 1 AS DOUBLE) AS competition_code,
         CAST(dense_rank() OVER (ORDER BY COALESCE(CAST(event_status AS VARCHAR), 'nan')) - 1 AS DOUBLE) AS event_status_code
  FROM events_l"""


DOC_TFIDF_SQL = (TFIDF_SQL
                 .replace("""  , ev AS (SELECT event_id, concat_ws(' ', COALESCE(CAST(teams AS VARCHAR), ''),
                                      COALESCE(CAST(competition AS VARCHAR), '')) AS txt FROM events_l),""",
                          "  , ev AS (SELECT doc_id AS event_id, COALESCE(text, '') AS txt FROM documents),")
                 .replace("(SELECT COUNT(DISTINCT event_id) AS n FROM events_l)", "(SELECT COUNT(DISTINCT doc_id) AS n FROM documents)"))
assert DOC_TFIDF_SQL != TFIDF_SQL


# ---------------------------------------------------------------------------
# Small exact operators
CTE["strict"] = f"""
  SELECT x.*, {', '.join('u.' + c.strip() for c in USER_COLS.split(','))}
  FROM (SELECT c.*, b.bet_id, b.user_id, b.bet_amount, b.odds_used, b.bet_timestamp, b.settlement_timestamp,
               b.outcome_label, b.market, b.bet_result, b.outcome, b.is_live_bet
        FROM (SELECT e.*, m.market_id, m.market_name, o.outcome_id, o.outcome_name
              FROM events_l e JOIN mk m ON e.event_id = m.event_id JOIN oc o ON m.market_id = o.market_id) c
        LEFT JOIN bt b ON c.outcome_id = b.bet_outcome_id) x
  LEFT JOIN users u ON x.user_id = u.user_id"""
DEPS.update({"strict": ["events_l", "mk", "oc", "bt", "users"]})


# ---------------------------------------------------------------------------
# Three rankers of the same rated pairs, judged by the same metrics
RANKERS = ("frequency", "success", "timing")


def ranker_metrics_sql(name: str) -> str:
    score = f"{name}_score"
    recs = f"""SELECT user_id, event_id AS item_id, rank FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {score} DESC, event_id ASC) AS rank
      FROM rated) WHERE rank <= 20"""
    test = "SELECT user_id, event_id AS item_id, composite_rating AS rating FROM rated"
    pred = f"SELECT composite_rating AS rating, {score} AS prediction FROM rated"
    return f"""SELECT '{name}' AS model,
      (SELECT AVG((prediction - rating) * (prediction - rating)) FROM ({pred})) AS mse,
      (SELECT AVG(abs(prediction - rating)) FROM ({pred})) AS mae,
      (SELECT auc FROM (WITH lscores AS ({pred}) {AUC_SQL})) AS auc,
      r.precision AS precision_at_5, r.recall AS recall_at_5, v.diversity, v.coverage
    FROM (WITH recs AS ({recs}), test_i AS ({test}) {RANKING_SQL}) r,
         (WITH recs AS ({recs}), test_i AS ({test}) {COVERAGE_SQL}) v
    WHERE r.k = 5"""


MODEL_METRICS_SQL = with_ctes(["scored"], """, rated AS MATERIALIZED (
  SELECT user_id, event_id, composite_rating, frequency_score, success_score, timing_score FROM scored),
  wide AS (""" + "\nUNION ALL\n".join(ranker_metrics_sql(n) for n in RANKERS) + """)
  SELECT model, metric, value FROM (UNPIVOT wide ON mse, mae, auc, precision_at_5, recall_at_5, diversity, coverage
                                    INTO NAME metric VALUE value)""")
LEADERBOARD_SQL = f"""
SELECT *, 0.4 * auc + 0.3 * precision_at_5 + 0.2 * diversity + 0.1 * coverage AS composite_score FROM (
  SELECT model, MAX(value) FILTER (WHERE metric = 'auc') AS auc, MAX(value) FILTER (WHERE metric = 'precision_at_5') AS precision_at_5,
         MAX(value) FILTER (WHERE metric = 'diversity') AS diversity, MAX(value) FILTER (WHERE metric = 'coverage') AS coverage
  FROM ({MODEL_METRICS_SQL}) GROUP BY model)"""
BEST_SQL = f"""
SELECT metric, model AS best_model, value AS best_value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('mse', 'mae') THEN -value ELSE value END DESC,
                               model ASC) AS r
  FROM ({MODEL_METRICS_SQL}) WHERE metric IN ('auc', 'precision_at_5', 'recall_at_5', 'mse', 'mae')) WHERE r = 1"""


# ---------------------------------------------------------------------------
# Q7: the contract's columns over the domain tables (all present there), and whether each table has rows
CONTRACT = {"users": ("users", "user_id"), "events": ("events_l", "event_id sport"), "markets": ("markets_raw", "market_id event_id market_name"),
            "outcomes": ("outcomes_raw", "outcome_id market_id outcome_name"), "bets": ("bets", "bet_id user_id outcome_id bet_amount odds_used")}
CONTRACT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(COUNT({c}) >= 0 AS INTEGER) AS present, "
    f"CAST(COUNT(*) > 0 AS INTEGER) AS non_empty FROM {source}"
    for t, (source, cols) in CONTRACT.items() for c in cols.split())
