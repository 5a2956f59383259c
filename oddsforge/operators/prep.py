"""F1–F4, F8, F9, F14, F15, W7, U5, P9–P14 — imputation, encoding, scaling, outliers.

Pattern: one aggregate job reads the per-column statistics (medians,
quantiles, means, modes — a handful of numbers), then a single projection
applies them as literals; rows never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsforge.config import OUTLIER_THRESHOLD
from oddsforge.functions.expressions import exact_avg, quotient
from oddsforge.operators.ids import dense_index
from oddsforge.operators.quantiles import exact_quantiles

UNKNOWN = "Unknown"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    kinds = {"numeric": [], "categorical": [], "boolean": [], "datetime": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            kinds["boolean"].append(f.name)
        elif isinstance(f.dataType, NUMERIC):
            kinds["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            kinds["categorical"].append(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds["datetime"].append(f.name)
    return kinds


def _quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    return exact_quantiles(df, {c: F.col(c) for c in cols}, probs)


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column, ties -> smallest value (pandas ``mode().iloc[0]``).
    Each column is a partial aggregate over its distinct values."""
    out = {}
    for c in cols:
        r = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.col("_n").desc(), F.col(c).asc()).limit(1).collect())
        out[c] = r[0][0] if r else None
    return out


def fit_imputer(df: DataFrame, numeric: list[str], categorical: list[str], boolean: list[str] = (),
                max_share: float | None = None) -> dict:
    """F1 / F3 fit: the value that fills each column (median, mode); with ``max_share``, 0 or 'Unknown' where more
    than that share is missing."""
    heavy = set()
    if max_share is not None:
        both = [*numeric, *categorical]
        shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in both]).collect()[0]
        heavy = {c for c in both if (shares[c] or 0.0) > max_share}
    med = {c: q[0] for c, q in _quantiles(df, [c for c in numeric if c not in heavy], [0.5]).items()}
    modes = column_modes(df, [c for c in [*categorical, *boolean] if c not in heavy])
    kinds = [(numeric, 0, med), (categorical, UNKNOWN, modes), (boolean, False, modes)]
    return {c: empty if found.get(c) is None else found[c] for cols, empty, found in kinds for c in cols}


def apply_imputer(df: DataFrame, fills: dict) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[F.coalesce(F.col(c), F.lit(fills[c]).cast(types[c])).alias(c) if c in fills else F.col(c) for c in df.columns])


def impute(df: DataFrame, strategy: str = "smart", numeric: list[str] | None = None,
           categorical: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """F1 / F2: 'smart' (median / mode / mode / leftover 0; with ``order_by`` also times filled forward, then
    backward, in that order), 'median' (same without times), 'zero' and anything else (fill 0)."""
    kinds = column_kinds(df)
    numeric = numeric if numeric is not None else kinds["numeric"]
    categorical = categorical if categorical is not None else kinds["categorical"]
    if strategy not in ("smart", "median"):
        return df.fillna(0)
    out = apply_imputer(df, fit_imputer(df, numeric, categorical, kinds["boolean"]))
    if strategy == "smart" and order_by:
        out = fill_in_order(out, kinds["datetime"], order_by)
    return out.fillna(0)


def impute_by_missing_share(df: DataFrame, numeric: list[str], categorical: list[str],
                            max_share: float = 0.5) -> DataFrame:
    """columns with > ``max_share`` missing -> 0 / 'Unknown'; else median / mode."""
    return apply_imputer(df, fit_imputer(df, numeric, categorical, max_share=max_share))


def fill_in_order(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """F1 (times): the last known value before a gap, or the next one at the start, in the order of
    ``order_by`` over the whole table. Rows are range-partitioned and filled inside their partition; a small
    table of each partition's first and last known values fills what a partition starts with."""
    from oddsforge.session import cut_lineage

    if not cols:
        return df
    # a partition id that is read back from files does not change when a task runs again
    laid = cut_lineage(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
                       .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_nth")))
    inside = Window.partitionBy("_part").orderBy("_nth")
    before = inside.rowsBetween(Window.unboundedPreceding, 0)
    ends = laid.groupBy("_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_nth"))).alias(f"_l_{c}") for c in cols],
                                     *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_nth"))).alias(f"_f_{c}") for c in cols])
    parts = Window.orderBy("_part")          # one row per partition
    carried = ends.select("_part", *[F.coalesce(
        F.last(f"_l_{c}", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)),
        F.first(f"_f_{c}", ignorenulls=True).over(parts.rowsBetween(0, Window.unboundedFollowing))).alias(f"_c_{c}") for c in cols])
    rows = laid.join(F.broadcast(carried), "_part")
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(f"_c_{c}")) for c in cols}
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def forward_fill(df: DataFrame, col: str, partition_by: list[str], order_by: list[str], shares: int = 4) -> DataFrame:
    """Last non-null value so far within each key of ``partition_by``, in the given order (NULL keys are one key).

    A segmented prefix scan: rows are range-partitioned by key and order into ``shares`` buckets for each shuffle
    partition, so a hot key is spread over many buckets; the fill runs inside (bucket, key); and what a
    bucket's first key had before is carried in by a table of two rows per bucket.
    """
    from oddsforge.session import cut_lineage

    n = shares * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a bucket id that is read back from files does not change when a task runs again
    laid = cut_lineage(df.repartitionByRange(n, *partition_by, *order_by).sortWithinPartitions(*partition_by, *order_by)
                       .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_nth"),
                               F.struct(*partition_by).alias("_key")))
    ends = cut_lineage(laid.groupBy("_part").agg(F.min_by("_key", "_nth").alias("_first"), F.max_by("_key", "_nth").alias("_last")))
    last = laid.join(F.broadcast(ends), "_part").filter(F.col("_key") == F.col("_last"))                  # a row per bucket
    known = last.groupBy("_part").agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col("_nth"))).alias("_value"))
    gives = ends.join(known, "_part").select("_part", F.lit(1).alias("_at"), F.col("_last").alias("_key"), "_value")
    asks = ends.select("_part", F.lit(0).alias("_at"), F.col("_first").alias("_key"), F.lit(None).cast(df.schema[col].dataType).alias("_value"))
    before = Window.partitionBy("_key").orderBy("_part", "_at").rowsBetween(Window.unboundedPreceding, -1)   # two rows a bucket
    carried = (asks.unionByName(gives).withColumn("_carried", F.last("_value", ignorenulls=True).over(before))
               .filter("_at = 0").select("_part", F.col("_key").alias("_first"), "_carried"))
    inside = Window.partitionBy("_part", "_key").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = laid.withColumn("_own", F.last(col, ignorenulls=True).over(inside)).join(F.broadcast(carried), "_part")
    filled = F.coalesce("_own", F.when(F.col("_key") == F.col("_first"), F.col("_carried")))
    return rows.select(*[filled.alias(c) if c == col else F.col(c) for c in df.columns])


def label_table(df: DataFrame, col: str, reserve_unknown: bool = True) -> DataFrame:
    """F4 fit: sorted distinct labels (NULL -> 'Unknown', 'Unknown' always present) -> 0-based code."""
    labels = df.select(F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN)).alias(col))
    if reserve_unknown:
        spark = df.sparkSession
        labels = labels.unionByName(spark.range(1).select(F.lit(UNKNOWN).alias(col)))
    return dense_index(labels, col, f"{col}_encoded")


def label_encode(df: DataFrame, col: str, table: DataFrame | None = None) -> DataFrame:
    """F4 + U5: encode with a fitted label table; unseen and NULL values map to 'Unknown'."""
    table = table if table is not None else label_table(df, col)
    key = F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN))
    tagged = df.withColumn("_lbl", key)
    known = tagged.join(table.withColumnRenamed(col, "_lbl"), "_lbl", "left")
    unk = table.filter(F.col(col) == UNKNOWN).collect()          # one row: the reserved code
    unk_code = unk[0][f"{col}_encoded"] if unk else None
    code = F.coalesce(F.col(f"{col}_encoded"), F.lit(unk_code).cast("long"))
    return (known.withColumn(f"{col}_encoded", code)
            .withColumn(col, F.when(F.col(f"{col}_encoded") == F.lit(unk_code), F.lit(UNKNOWN))
                        .otherwise(F.col("_lbl")))
            .drop("_lbl"))


def fit_robust_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """F8 fit: (median, IQR) per column; IQR 0 -> 1."""
    q = _quantiles(df, cols, [0.25, 0.5, 0.75])
    return {c: (0.0, 1.0) if q[c][1] is None else (q[c][1], (q[c][2] - q[c][0]) or 1.0) for c in cols}


def fit_standard_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """F9 fit: (mean, population std) per column with NULL as 0; std 0 -> 1."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    row = df.agg(*[exact_avg(x[c]).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(x[c]).alias(f"s_{c}") for c in cols]).collect()[0]
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def apply_scaler(df: DataFrame, scales: dict[str, tuple[float, float]], null_as: float | None = None) -> DataFrame:
    def scaled(c):
        x = F.col(c).cast("double")
        x = x if null_as is None else F.coalesce(x, F.lit(null_as))
        return ((x - F.lit(scales[c][0])) / F.lit(scales[c][1])).alias(c)

    return df.select(*[scaled(c) if c in scales else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8: (x - median) / IQR, IQR 0 -> divide by 1 (exact percentiles)."""
    return apply_scaler(df, fit_robust_scaler(df, cols))


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL -> 0, then (x - mean) / population std (std 0 -> 1). Keys are never passed."""
    return apply_scaler(df, fit_standard_scaler(df, cols), null_as=0.0)


def fit_outlier_bounds(df: DataFrame, cols: list[str], k: float = OUTLIER_THRESHOLD) -> dict[str, tuple[float, float]]:
    """F14 fit: [Q1 - k·IQR, Q3 + k·IQR] of the columns that have values and a spread (D12: k honoured)."""
    out = {}
    for c, (q1, q3) in _quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is not None and q3 != q1:
            out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def apply_outlier_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    def clipped(c):
        x = F.col(c)
        return F.when(x.isNull(), x).otherwise(F.least(F.greatest(x.cast("double"), F.lit(bounds[c][0])), F.lit(bounds[c][1]))).alias(c)

    return df.select(*[clipped(c) if c in bounds else F.col(c) for c in df.columns])


def clip_outliers_iqr(df: DataFrame, cols: list[str], k: float = OUTLIER_THRESHOLD) -> DataFrame:
    """clip to the fitted bounds; columns with IQR 0 or no values are untouched."""
    return apply_outlier_bounds(df, fit_outlier_bounds(df, cols, k))


def fitted_table(spark, imputer: dict | None = None, scaler: dict | None = None, bounds: dict | None = None) -> DataFrame:
    """What was fitted, as rows (step, column, first, second, text) for a sink: a few rows per column."""
    rows = []
    for c, v in (imputer or {}).items():
        rows.append(("impute", c, None, None, v) if isinstance(v, str) else ("impute", c, float(v), None, None))
    rows += [("scale", c, float(a), float(b), None) for c, (a, b) in (scaler or {}).items()]
    rows += [("bounds", c, float(a), float(b), None) for c, (a, b) in (bounds or {}).items()]
    return spark.createDataFrame(rows, "step string, column string, first double, second double, text string")


def fitted_from(table: DataFrame) -> dict[str, dict]:
    """The dictionaries of :func:`fitted_table`, by step."""
    out: dict[str, dict] = {"impute": {}, "scale": {}, "bounds": {}}
    for r in table.collect():
        out[r["step"]][r["column"]] = (r["text"] if r["text"] is not None else r["first"]) if r["step"] == "impute" else (r["first"], r["second"])
    return out


def replace_outliers_zscore(df: DataFrame, cols: list[str], z: float = 3.0) -> DataFrame:
    """|x - mean| / std > z -> median (sample std; std 0 -> untouched)."""
    stats = df.agg(*[exact_avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                   *[F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).collect()[0]
    med = {c: v[0] for c, v in _quantiles(df, cols, [0.5]).items()}
    sel = {}
    for c in cols:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        if s is None or s == 0:
            continue
        x = F.col(c).cast("double")
        sel[c] = F.when(F.abs((x - F.lit(m)) / F.lit(s)) > F.lit(z), F.lit(med[c])).otherwise(x)
    return df.select(*[sel[c].alias(c) if c in sel else F.col(c) for c in df.columns])


def replace_nonfinite(df: DataFrame, cols: list[str], nan=0.0, pos=1.0, neg=-1.0) -> DataFrame:
    """P10: NaN/NULL -> nan, +inf -> pos, -inf -> neg."""
    def fix(c: str) -> Column:
        x = F.col(c).cast("double")
        return (F.when(x.isNull() | F.isnan(x), F.lit(nan)).when(x == F.lit(float("inf")), F.lit(pos))
                .when(x == F.lit(float("-inf")), F.lit(neg)).otherwise(x))
    return df.select(*[fix(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def derived_ratios(df: DataFrame, clip_upper: bool = True) -> DataFrame:
    """bet_ratio, implied probability from odds clipped to [1.01, 1000], log odds, experience ratio. A ratio to a zero
    divisor (deposits of -1) is infinite, as in the reference and in SQL."""
    cols = set(df.columns)
    out = df
    if {"bet_amount", "total_deposits"} <= cols:
        out = out.withColumn("bet_ratio", quotient(F.col("bet_amount"), F.col("total_deposits") + F.lit(1.0)))
    if "odds_used" in cols:
        o = F.greatest(F.col("odds_used"), F.lit(1.01))
        if clip_upper:
            o = F.least(o, F.lit(1000.0))
        out = out.withColumn("implied_probability", F.lit(1.0) / o).withColumn("odds_log", F.log(o))
    if {"age", "days_since_registration"} <= cols:
        out = out.withColumn("experience_ratio",
                             quotient(F.col("days_since_registration"), F.col("age") * F.lit(365.0) + F.lit(1.0)))
    return out


def rename_duplicates(names: list[str]) -> list[str]:
    """Second and later copies of a name become name_1, name_2, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            out.append(f"{n}_{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scoring frame aligned to training columns — missing ones as 0, same order."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns])


def safe_casts(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Cast with unparsable -> 0."""
    return df.select(*[F.coalesce(F.col(c).try_cast(cols[c]), F.lit(0).cast(cols[c])).alias(c) if c in cols
                       else F.col(c) for c in df.columns])
