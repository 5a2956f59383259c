"""Dense, sorted, 0-based id mappings without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from oddsforge.operators.ranking import range_buckets
from oddsforge.session import cut_lineage

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Map each distinct non-null ``col`` value to its 0-based rank in ascending order.

    Distinct keys get a data-derived range bucket; index = (keys in earlier
    buckets) + (row_number inside the bucket). Only the per-bucket counts — one
    row per bucket — are broadcast. Returns ``(col, out)``.
    """
    distinct = df.select(col).filter(F.col(col).isNotNull()).distinct()
    if isinstance(distinct.schema[col].dataType, _NUMERIC):
        keys = range_buckets(cut_lineage(distinct), col)      # read by the cut points, the counts and the mapping
    else:
        # non-numeric keys: range-partition once, store the partition id as a
        # column and write the result (shared checkpoint folder), so every branch
        # reads the same bucket of each key
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = cut_lineage(distinct.repartitionByRange(n, col).withColumn("_bucket", F.spark_partition_id()))
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(col)) - 1
    return (keys.join(F.broadcast(offsets), "_bucket")
            .select(F.col(col), (F.col("_off") + local).cast("long").alias(out)))
