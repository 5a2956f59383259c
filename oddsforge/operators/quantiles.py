"""Exact percentiles of many columns without holding a column's values in one task.

Spark's exact ``percentile`` keeps every distinct value of a column in one final buffer. Here the values are
counted per (column, value) — a partial aggregate, so a heavy value is one row — and cut into buckets at
approximate quantiles; bucket totals show which few buckets hold the wanted ranks, and only these are sorted.
The driver sees cut points, bucket totals and the wanted values, or at most FEW counted values: a bounded number of
rows. A value that fills missing ones or replaces others is a further row (c, x, n) of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsforge.session import cut_lineage

BUCKETS = 256
FEW = 20_000        # counted values up to which the driver takes them as they are


def counted_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(c, x, n): how often each value of each named expression occurs (c: its place in ``columns``; x NULL for
    missing values), in one pass over ``df``, written once. Later steps that map values monotonely (fill, clip, scale)
    map this table instead of reading the rows again."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), e.cast("double").alias("x")) for i, e in enumerate(columns.values())])
    return cut_lineage(df.select(F.inline(cells)).groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation percentiles (those of Spark's ``percentile``) of each named expression;
    ``None`` for a column without values. NULLs are left out, NaN counts as the largest value."""
    return counted_quantiles(counted_values(df, columns), list(columns), probs) if columns else {}


def counted_quantiles(counts: DataFrame, names: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """The percentiles from a table of :func:`counted_values` (values may stand in several rows)."""
    counts = counts.filter(F.col("x").isNotNull())
    few = counts.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return _few_quantiles(few, names, probs)
    grid = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = counts.groupBy("c").agg(F.percentile_approx("x", grid, 10_000).alias("cuts"))      # a row per column
    placed = counts.join(F.broadcast(cuts), "c").select(
        "c", "x", "n", F.size(F.filter("cuts", lambda q: q < F.col("x"))).alias("bucket"))
    totals: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("c", "bucket").agg(F.sum("n").alias("n")).collect():               # at most BUCKETS per column
        totals.setdefault(r["c"], []).append((r["bucket"], r["n"]))
    wanted = []
    for c, buckets in totals.items():
        size = sum(n for _, n in buckets)
        ranks = {r for p in probs for r in _ranks(p, size)}
        before = 0
        for b, n in sorted(buckets):
            wanted += [(c, b, r, r - before) for r in ranks if before <= r < before + n]
            before += n
    asked = counts.sparkSession.createDataFrame(wanted, "c int, bucket int, rank long, inside long")
    hold = placed.join(F.broadcast(asked.select("c", "bucket").distinct()), ["c", "bucket"])
    upto = Window.partitionBy("c", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hold = hold.withColumn("upto", F.sum("n").over(upto))
    hit = (hold.join(F.broadcast(asked), ["c", "bucket"])
           .filter((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n"))))
    at = {(r["c"], r["rank"]): r["x"] for r in hit.select("c", "rank", "x").collect()}
    out = {}
    for i, n in enumerate(names):
        size = sum(k for _, k in totals.get(i, []))
        out[n] = [_between(at, i, p, size) if size else None for p in probs]
    return out


def _few_quantiles(rows: list, names: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """The same from at most FEW counted values, without further jobs."""
    values: dict[int, list[tuple[float, int]]] = {}
    for r in rows:
        values.setdefault(r["c"], []).append((r["x"], r["n"]))
    out = {}
    for i, name in enumerate(names):
        own = sorted(values.get(i, []), key=lambda v: (v[0] != v[0], v[0]))   # NaN last
        size = sum(n for _, n in own)
        at = {}
        for r in sorted({r for p in probs for r in _ranks(p, size)}) if size else ():
            before = 0
            for x, n in own:
                if r < before + n:
                    at[i, r] = x
                    break
                before += n
        out[name] = [_between(at, i, p, size) if size else None for p in probs]
    return out


def _ranks(p: float, size: int) -> tuple[int, int]:
    place = p * (size - 1)
    return int(place), min(int(place) + (place > int(place)), size - 1)


def _between(at: dict, c: int, p: float, size: int) -> float:
    low, high = _ranks(p, size)
    share = p * (size - 1) - low
    return at[c, low] if low == high else (1 - share) * at[c, low] + share * at[c, high]
