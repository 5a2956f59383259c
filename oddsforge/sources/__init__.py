"""Sources (driver tables, JDBC, parquet) and sinks."""
