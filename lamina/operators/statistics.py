"""Statistics over the run catalog and the counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.expressions import rate
from lamina.schema import LEVEL_BASE, LEVEL_FACTOR


def level_sizes(runs: DataFrame, num_levels: int) -> DataFrame:
    """``level``, ``files`` and ``bytes`` for every level, empty ones included."""
    used = runs.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    levels = runs.sparkSession.range(num_levels).withColumnRenamed("id", "level")
    return levels.join(used, "level", "left").select("level", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "bytes")])


def level_limits(spark, num_levels: int, base: int = LEVEL_BASE) -> DataFrame:
    """``level`` and ``max_bytes``: each level holds ten times the one before it."""
    return spark.range(num_levels).select(F.col("id").alias("level"), (F.lit(base) * F.pow(F.lit(LEVEL_FACTOR), "id")).cast("long").alias("max_bytes"))


def level_overlap(runs: DataFrame) -> DataFrame:
    """``level`` and ``overlaps``: whether two runs of a level share keys; only runs of level 0 may.

    A run is held against the largest key of all runs before it, so a wide run hides nothing behind a narrow one.
    """
    order = Window.partitionBy("level").orderBy("min_key", "max_key").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("__before", F.max("max_key").over(order)).groupBy("level").agg(F.coalesce(F.max(F.col("__before") >= F.col("min_key")), F.lit(False)).alias("overlaps"))


def overlapping_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``run_id`` of two catalogs whose key ranges meet. Catalogs have a row for each run."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col("a.max_key") >= F.col("b.min_key")) & (F.col("a.min_key") <= F.col("b.max_key"))).select(F.col("a.run_id").alias("left_run"), F.col("b.run_id").alias("right_run"))


def write_amplification(counters: DataFrame) -> DataFrame:
    """``write_amp``: bytes of flushes and compactions over bytes of the log; 0 without a log."""
    return counters.select(rate(F.col("flush_bytes") + F.col("compaction_bytes"), F.col("log_bytes")).alias("write_amp"))


def skip_rate(counters: DataFrame) -> DataFrame:
    """``skip_rate``: per cent of the probes of runs that a filter spared."""
    return counters.select((rate(F.col("skips"), F.col("skips") + F.col("opened")) * 100).alias("skip_rate"))


def mean_skip_rate(rates: DataFrame, otherwise: float = 90.0) -> DataFrame:
    """``skip_rate``: the mean of several runs' rates, or a stated figure where there are none."""
    return rates.agg(F.coalesce(F.avg("skip_rate"), F.lit(otherwise)).alias("skip_rate"))
