"""W8 top-N per key, deterministic range buckets and distributed prefix sums."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, key: str, score: str, n: int, tie: str, out: str = "rank", salts: int = 16) -> DataFrame:
    """The ``n`` best rows per ``key`` by ``score`` desc then ``tie`` asc, ranked 1..n.

    Two phases: top-n inside (key, salt) sub-groups, then top-n over at most
    ``n * salts`` survivors per key — a key holding a third of all rows is
    sorted in ``salts`` tasks, never in one.
    """
    order = [F.col(score).desc_nulls_last(), F.col(tie).asc()]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(tie)), F.lit(salts)))
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(key).orderBy(*order)
    return stage1.withColumn(out, F.row_number().over(w2)).filter(F.col(out) <= n)


def range_buckets(df: DataFrame, col: str, n: int | None = None, out: str = "_bucket") -> DataFrame:
    """Add a bucket id that is monotone in ``col`` and depends only on the data.

    Cut points are ``n - 1`` approximate quantiles of the column (one small
    read); the JVM ``Bucketizer`` does the binary search per row. Unlike
    ``spark_partition_id`` after a range shuffle, the id is identical in every
    branch and on every re-execution.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(col).cast("double")
    cuts = []
    if n > 1:
        probs = [i / n for i in range(1, n)]
        row = df.agg(F.percentile_approx(x, probs, 10000).alias("q")).collect()[0]
        cuts = sorted(set(v for v in (row["q"] or []) if v is not None))
    splits = [float("-inf")] + cuts + [float("inf")]
    tmp = df.withColumn("_bx", x)
    return (Bucketizer(splits=splits, inputCol="_bx", outputCol=out, handleInvalid="keep")
            .transform(tmp).drop("_bx").withColumn(out, F.col(out).cast("int")))


def prefix_sums(df: DataFrame, order_col: str, cols: list[str], descending: bool = False,
                inclusive: bool = True) -> DataFrame:
    """Running sums of ``cols`` in ``order_col`` order (unique order values expected).

    Per-bucket totals (one row per bucket) give each bucket its offset; the
    running sum inside a bucket is a window over that bucket only.
    """
    b = range_buckets(df, order_col)
    ob = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    tot = b.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wo = Window.orderBy(ob).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in cols])
    frame = (Window.partitionBy("_bucket").orderBy(o)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = b.join(F.broadcast(offs), "_bucket")     # one row per bucket: proven small
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(frame), F.lit(0)))
    return out.drop("_bucket", *[f"_o_{c}" for c in cols])
