"""Operator 3: approximate nearest neighbours on shifted space-filling curves.

Vectors are projected at random to a few dimensions, shifted, and put in the order of their Hilbert keys, once
for each curve. Each projected dimension is scaled by its own quantiles (of a sample, which places rows and drops none),
so a tight group gets as much of the grid as it has rows and a far vector stretches nothing; rows of one cell go
by one more projection, another on each curve. Spark range-partitions each ordering; a vector's rank in it places it in a block of ``block``
ranks. A query looks at the ``window`` share of all ranks around its own on every curve: it is sent to the blocks
its windows touch, reranks their vectors by the exact distance, and the blocks' lists merge into one.

Window widths are a share of the rows, so recall does not fall as the table grows (test: 0.9 or more against brute
force). Equal vectors are indexed once, with their smallest ids, so copies fill no window.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
of another length than the commonest (ties: the longest), nor null ids; of rows that share an id the smallest vector counts;
equal distances go to the smaller id; with fewer candidates than ``k`` all that are found are returned; an empty table gives no
rows. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsforge.llm.common import written

U = np.uint64
DIMS, BITS = 6, 10  # a key has DIMS * BITS bits
KNOTS, SAMPLE = 1024, 20_000  # quantiles of a projected dimension, and about how many vectors they are taken from
FILL = 0.7  # share of the grid's side between the outer quantiles; the rest is room for shifts


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of cell coordinates (J. Skilling's transposed form)."""
    x = [cells[:, i].astype(U) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        q = U(1 << level)
        low = q - U(1)
        for i in range(len(x)):
            turn = (x[i] & q) != 0
            swap = np.where(turn, U(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & U(1 << level)) != 0, flip ^ U((1 << level) - 1), flip)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = key << U(1) | ((v ^ flip) >> U(level)) & U(1)
    return key.astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part, one row per id."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    length = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return ok.filter(F.size("v") == (length["n"] if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, curves: int = 24, window: float = 0.06,
               block: int = 4096, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    w = Window.partitionBy("v").orderBy("vec_id")
    copies = usable(vectors).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1)  # cut before and after the shuffle
    # every query keeps its own row beside its vector's k + 1 smallest ids
    asked = usable(vectors).filter(F.col("vec_id") % every == 0)
    points = written(copies.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    queries = written(asked)
    n = points.count()
    first = points.select(F.size("v").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = min(DIMS, first["d"])
    some = points if n <= SAMPLE else points.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(SAMPLE / n * 1_000_000) + 1)
    sample = np.array([r["v"] for r in some.select("v").collect()])
    if not len(sample):
        sample = np.array([points.first()["v"]])
    centre = np.median(sample, axis=0)
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(first["d"], dims)))[0] for _ in range(curves)]
    shifts = rng.uniform(FILL / 2 - 0.5, 0.5 - FILL / 2, (curves, dims))
    ties = rng.normal(size=(curves, first["d"]))
    at = np.linspace(0, 1, KNOTS)
    knots = [np.quantile((sample - centre) @ t, at, axis=0) for t in turns]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                v = b.column(0)
                x = v.flatten().to_numpy().reshape(b.num_rows, -1) - centre
                for c in range(curves):
                    y = x @ turns[c]
                    y = np.stack([np.interp(y[:, j], knots[c][:, j], at) for j in range(dims)], axis=1)
                    y = (y - 0.5) * FILL + 0.5 + shifts[c]
                    cells = np.clip(y * (1 << BITS), 0, (1 << BITS) - 1).astype(U)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(hilbert_keys(cells, BITS)), pa.array(x @ ties[c]), v, b.column(1)], names=["curve", "key", "tie", "v", "ids"])

    laid = points.mapInArrow(keys, "curve int, key long, tie double, v array<double>, ids array<long>")
    laid = laid.repartitionByRange("curve", "key", "tie", "v").sortWithinPartitions("curve", "key", "tie", "v")
    laid = written(laid.select("curve", "key", "v", "ids", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("nth")))
    # ranks: rows of the partitions before, less those of earlier curves
    parts = laid.groupBy("part", "curve").agg(F.count(F.lit(1)).alias("c"), F.min("nth").alias("from"))  # a row per partition and curve
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("part").alias("_part"), F.col("curve").alias("_curve"), "from", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    ranked = written(laid.join(F.broadcast(offsets), (F.col("part") == F.col("_part")) & (F.col("curve") == F.col("_curve")))
                     .select("curve", (F.col("nth") - F.col("from") + F.col("offset")).alias("place"), "v", "ids"))
    half = max(k + 1, int(np.ceil(n * window / 2)))
    base = ranked.withColumn("block", F.floor(F.col("place") / block)).select(
        "curve", "block", "place", F.lit(None).cast("long").alias("query_id"), "v", "ids")
    asks = ranked.select("curve", "place", "v").join(queries.withColumnRenamed("vec_id", "query_id"), "v")
    last = (n - 1) // block
    reach = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("place") - half) / block)), F.least(F.lit(last).cast("long"), F.floor((F.col("place") + half) / block)))
    asks = asks.select("curve", F.explode(reach).alias("block"), "place", "query_id", "v", F.lit(None).cast("array<long>").alias("ids"))

    def rerank(rows: pd.DataFrame) -> pd.DataFrame:
        here = rows[rows["query_id"].isna()].sort_values("place")
        asking = rows[rows["query_id"].notna()]
        if here.empty or asking.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, places, ids = np.stack(here["v"].to_list()), here["place"].to_numpy(), here["ids"].to_list()
        q_out, v_out, s_out = [], [], []
        for q, place, v in zip(asking["query_id"].astype("int64"), asking["place"], asking["v"], strict=True):
            lo, hi = np.searchsorted(places, [place - half, place + half + 1])
            if lo == hi:
                continue
            dist = np.sqrt(((x[lo:hi] - v) ** 2).sum(axis=1))
            near = np.argpartition(dist, min(k + 1, len(dist)) - 1)[: k + 1] if len(dist) > k + 1 else np.arange(len(dist))
            near = np.flatnonzero(dist <= dist[near].max())  # with all ties
            got = sorted((dist[i], c) for i in near for c in ids[lo + i] if c != q)[:k]
            q_out += [q] * len(got)
            s_out += [g[0] for g in got]
            v_out += [g[1] for g in got]
        return pd.DataFrame({"query_id": np.array(q_out, np.int64), "vec_id": np.array(v_out, np.int64), "score": np.array(s_out, float)})

    found = base.unionByName(asks).groupBy("curve", "block").applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
