"""Join helpers that stay skew-safe at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalogue_left_join(catalogue: DataFrame, facts: DataFrame, left_keys: list[str],
                        right_keys: list[str] | None = None) -> DataFrame:
    """``catalogue ⟕ facts`` written as (facts ⋈ catalogue) ∪ (catalogue ▷ facts).

    A plain left join keeps the (small-per-key) catalogue as the preserved side,
    so a hot key in the fact table cannot be split by AQE and the fact side can
    never be the streamed side of a broadcast. Here the fact table drives an
    inner join (splittable, broadcast-able catalogue) and unmatched catalogue
    rows come from an anti join against the *distinct* keys of the facts, a
    partially aggregated set of the key columns alone: the matched join is not
    run a second time for it. NULL keys never match, as in SQL. ``facts`` is
    read twice; one that is dear to compute is written first.
    """
    right_keys = right_keys or left_keys
    fk = [f"__fk{i}" for i in range(len(right_keys))]
    same = {rk for lk, rk in zip(left_keys, right_keys) if lk == rk}
    payload = [c for c in facts.columns if c not in same and c not in catalogue.columns]
    f = facts.select(*[F.col(c) for c in payload],
                     *[F.col(rk).alias(k) for rk, k in zip(right_keys, fk)]).alias("f")
    c = catalogue.alias("c")
    cond = [F.col(f"c.{lk}") == F.col(f"f.{k}") for lk, k in zip(left_keys, fk)]
    out_cols = [F.col(f"c.{x}") for x in catalogue.columns] + [F.col(f"f.{x}") for x in payload]
    matched = f.join(c, cond, "inner").select(*out_cols)
    keys = f.select(*fk).distinct().alias("k")
    anti = [F.col(f"c.{lk}") == F.col(f"k.{k}") for lk, k in zip(left_keys, fk)]
    unmatched = c.join(keys, anti, "left_anti").select(*[F.col(f"c.{x}") for x in catalogue.columns])
    cols = catalogue.columns + payload
    return matched.unionByName(unmatched, allowMissingColumns=True).select(*cols)


def first_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Keep the first row per ``key`` by ``order_cols`` (ascending, NULLs first).

    ``min(struct(order..., payload...))`` is a partial (map-side) aggregate, so
    a key holding a third of all rows is reduced to one row per input partition
    before the shuffle; no window sorts the whole hot group in one task.
    NULL keys form one group, as in pandas ``drop_duplicates``.
    """
    payload = [c for c in df.columns if c not in order_cols and c != key]
    fields = order_cols + payload
    packed = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    agg = df.groupBy(key).agg(F.min(packed).alias("__first"))
    return agg.select(F.col(key), *[F.col(f"__first.f{i}").alias(c) for i, c in enumerate(fields)]) \
        .select(*df.columns)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` written and counted, and hinted for broadcast only up to ``max_rows`` narrow rows: the planner learns its size
    before it moves the other side. Beyond that a shuffle join is planned."""
    from oddsforge.session import cut_lineage

    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= max_rows else df
