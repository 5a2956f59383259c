"""Registry of named queries: Spark plan builders + their DuckDB oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsforge.plans.oracle import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROWS_ONLY: dict[str, str] = {}   # query -> why no SQL oracle exists


def arith_round(c, digits: int):
    """``floor(x * 10^d + 0.5) / 10^d`` — the same IEEE operations as the SQL oracle."""
    scale = float(10 ** digits)
    x = c.cast("double")
    return (F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x)
            .otherwise(F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)))


def round_doubles(df: DataFrame, cols2=()) -> DataFrame:
    """Round every double column to 6 dp (2 dp for large money sums) for value comparison."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(arith_round(F.col(f.name), 2 if f.name in cols2 else 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def register(name: str, sql: str | None = None, cols6=(), cols2=(), rows_only: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its oracle SQL text, or with
    ``rows_only`` = the reason no SQL oracle exists (iterative fit, sink, schema)."""
    if (sql is None) == (rows_only is None):
        raise ValueError(f"{name}: give exactly one of an oracle SQL text or a rows-only reason")

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), cols2)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = rounded(sql, cols6, cols2)
        else:
            ROWS_ONLY[name] = rows_only
        return fn

    return deco
