"""Users joined before the views, and rows chosen before the last joins: the same rows with less moved."""

from pyspark.sql import functions as F

from tests.test_operators import _small_hierarchy

AS_OF = "2001-12-01 00:00:00"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_users_come_before_the_catalogue(spark):
    from oddsforge.operators import hierarchy as H

    ev, mk, oc, bets, us, _ = _small_hierarchy(spark)
    us = us.unionByName(us.limit(1))                  # a repeated user repeats its bets
    mk, oc, bt = (H.clean_text_keys(t, H.TEXT_KEYS[k]) for k, t in (("markets", mk), ("outcomes", oc), ("bets", bets)))
    cat = H.events_markets_outcomes(ev, mk, oc)
    for view in (lambda b: H.classic_view(cat, b), lambda b: H.direct_view(ev, b)):
        want, got = H.with_users(view(bt), us), H.view_with_users(view, bt, us)
        assert got.columns == want.columns and rows(got) == rows(want)
    strict = H.strict_hierarchy(ev, mk, oc, bt, us)
    plan = strict._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1              # neither the catalogue nor the users are joined by the reads of the view
    plain = ev.join(mk, "event_id").join(oc, "market_id").join(bt.drop("event_id"), "outcome_id", "left").join(us, "user_id", "left")
    assert sorted(strict.columns) == sorted(plain.columns) and rows(strict) == rows(plain)


def test_rows_chosen_before_the_last_joins(spark):
    from oddsforge.operators import hierarchy as H

    def some(r):
        return r.filter("bet_amount > 1.5")

    ev, mk, oc, bt, us, odds = _small_hierarchy(spark)
    full = H.build_hierarchy(ev, mk, oc, bt, us, odds, AS_OF)
    got = H.build_hierarchy(ev, mk, oc, bt, us, odds, AS_OF, keep=some)
    assert got.columns == full.columns and rows(got) == rows(some(full)) and 0 < got.count() < full.count()
    none = H.build_hierarchy(ev, mk, oc, bt, us, odds, AS_OF, keep=lambda r: r.filter(F.lit(False)))
    assert none.count() == 0
