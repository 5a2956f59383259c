"""oddsforge — Spark-native recommendation features, ratings, models and evaluation.

Every public operator is a function ``(DataFrame, params) -> DataFrame`` that
builds a lazy plan; actions only happen in model fits, sinks and the few small
statistic reads (quantile edges, window counts) that steer a plan.
"""

__version__ = "0.1.0"
