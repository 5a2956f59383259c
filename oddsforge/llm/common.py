"""Helpers that several of the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsforge.session import cut_lineage

#: The white space that the contracts name: space and the control characters 09 to 0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the cluster's shared checkpoint folder: computed once, and it outlives executors."""
    return cut_lineage(df)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is (pure ASCII takes the quick built-in)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by five; they are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` written and counted; hinted for broadcast only up to ``max_rows`` (its rows must be of
    bounded width). Beyond that the planner's shuffle join with skew splitting takes over."""
    df = written(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
