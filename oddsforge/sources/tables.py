"""Readers for the parquet tables and JDBC sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; Catalyst pushes filters / column pruning into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, *, properties: dict,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, is_query: bool = False) -> DataFrame:
    """JDBC source; every connection option is supplied by the caller (no defaults).

    With ``partition_column`` the read is split into ``num_partitions`` parallel
    range scans, so a large table is not pulled through one connection.
    """
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in properties.items():
        reader = reader.option(k, v)
    reader = reader.option("query" if is_query else "dbtable", table_or_query)
    if partition_column is not None:
        if is_query:
            raise ValueError("partitioned JDBC reads need a table, not a query")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 8)))
    return reader.load()
