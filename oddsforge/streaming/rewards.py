"""T1 + T2: online arm updates as a Structured Streaming aggregate.

Reward events stream in; a plain ``groupBy(action)`` aggregate keeps one row
of state per action (no custom state processor, no watermark: nothing
expires). Each micro-batch's complete state is written by ``foreachBatch`` to
a table in the shared checkpoint folder, so a restarted query resumes from its
checkpoint and the sink is idempotent (overwrite per batch).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsforge.models.bandit import exploration_rate
from oddsforge.session import checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def reward_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Reward events (action = event type, reward = value > 50) from a parquet file stream.

    A file stream source watches a directory or glob; a single file is turned
    into a glob that matches exactly that file.
    """
    if path.endswith(".parquet") and not path.endswith("/"):
        path = path[: -len("parquet")] + "parq[u]et"
    src = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(path))
    return src.select(F.col("event_type").alias("action"), (F.col("value") > F.lit(50.0)).cast("int").alias("reward"))


def arm_state_query(rewards: DataFrame) -> DataFrame:
    """Running count, sum and mean per action (T1) and ε after the updates seen (T2, per action)."""
    return (rewards.groupBy("action")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("reward").cast("double")).alias("reward_sum"))
            .withColumn("mean_reward", F.col("reward_sum") / F.col("n")))


def run_arm_updates(spark: SparkSession, path: str, out_dir: str | None = None) -> DataFrame:
    """Run the stream to completion over what is available (``availableNow``) and
    return the final arm state table."""
    base = out_dir or os.path.join(checkpoint_dir(spark), f"arm-state-{uuid.uuid4().hex}")
    table = os.path.join(base, "state")

    def write(batch: DataFrame, epoch: int) -> None:
        # a folder per epoch: a repeated epoch writes the same rows again, and readers keep the last whole one
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    q = (arm_state_query(reward_stream(spark, path)).writeStream.outputMode("complete")
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    states = spark.read.parquet(table)
    last = states.agg(F.max("epoch")).first()[0]
    return states.filter(F.col("epoch") == last).drop("epoch")


def exploration_after(state: DataFrame, epsilon0: float = 0.1) -> DataFrame:
    """Exploration rate after all updates in the state (closed form on the total count)."""
    tot = state.agg(F.sum("n").alias("total_updates"))
    return tot.select("total_updates", exploration_rate(F.col("total_updates"), epsilon0).alias("exploration_rate"))
