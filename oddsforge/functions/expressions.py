"""Column-expression helpers: every helper returns a JVM-side ``Column``.

They keep per-row logic inside whole-stage codegen (no Python UDFs).
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "lit_ts", "days_ago", "floor_days_between", "hours_between", "weekday_mon0",
    "cyclic_sin", "cyclic_cos", "safe_double", "safe_long", "clean_key_text",
    "null_safe_flag",
    "exact_sum", "exact_avg", "EXACT_DECIMAL",
]

# Sums are accumulated in DECIMAL so they do not depend on partitioning or
# row order (double addition is not associative); results are cast back to double.
EXACT_DECIMAL = "decimal(38,9)"


def exact_sum(c) -> Column:
    """Order-independent sum of a double column (NULL when no non-null input)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(EXACT_DECIMAL)).cast("double")


def exact_avg(c) -> Column:
    """``exact_sum / count`` (NULL when no non-null input)."""
    c = F.col(c) if isinstance(c, str) else c
    return exact_sum(c) / F.count(c)

_MICROS_PER_DAY = 86_400_000_000
_MICROS_PER_HOUR = 3_600_000_000


def lit_ts(value) -> Column:
    """A timestamp literal without time zone (driver tables are TIMESTAMP_NTZ)."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def days_ago(as_of, days: int) -> Column:
    """``as_of - days`` as a timestamp literal."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return lit_ts(as_of - _dt.timedelta(days=days))


def _micros(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.timestamp_diff("MICROSECOND", a, b)


def floor_days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end`` rounded toward -inf (pandas ``.dt.days``)."""
    return F.floor(_micros(start, end) / F.lit(_MICROS_PER_DAY)).cast("long")


def hours_between(start, end) -> Column:
    """Fractional hours from ``start`` to ``end`` (``total_seconds()/3600``)."""
    return _micros(start, end) / F.lit(_MICROS_PER_HOUR)


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(F.col(c) if isinstance(c, str) else c)


def cyclic_sin(c: Column, period: int) -> Column:
    return F.sin(F.lit(2 * math.pi) * c / F.lit(period))


def cyclic_cos(c: Column, period: int) -> Column:
    return F.cos(F.lit(2 * math.pi) * c / F.lit(period))


def safe_double(c) -> Column:
    """Coerce to double; unparsable -> NULL (ANSI-safe)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def safe_long(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("long")


def clean_key_text(c) -> Column:
    """``str(x).strip().lower()`` for join keys (NULL stays NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c.cast("string")))


def null_safe_flag(cond: Column) -> Column:
    """Boolean condition to 0/1 where an unknown (NULL) comparison counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point defines it (by zero: ±inf, NaN for 0 / 0), where Spark's ANSI division raises an error. A zero divisor counts as +0."""
    zero = F.lit(0.0)
    return F.when(b == zero, a * F.lit(float("inf"))).otherwise(a / b)
