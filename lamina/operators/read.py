"""Lookups and scans over mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.ordinals import with_ordinals
from lamina.operators.resolve import live


def get(mutations: DataFrame, key: str) -> DataFrame:
    """``key`` and ``value`` of one key: a row, or none if it is absent or deleted. The equality reaches the scan."""
    return live(mutations.where(F.col("key") == key)).select("key", "value")


def multi_get(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``value`` and ``found`` for each requested key.

    The semi join drops other keys before versions are reduced; which side is broadcast, if any, is for Spark to
    say from their sizes. Repeated requests each get a row; a null key is never found.
    """
    asked = keys.select("key")
    wanted = live(mutations.join(asked, "key", "left_semi")).select("key", "value", F.lit(True).alias("found"))
    return asked.join(wanted, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """The requested keys that are absent or deleted. Versions of other keys are dropped before any are reduced."""
    asked = keys.select("key")
    return asked.join(live(mutations.join(asked, "key", "left_semi")).select("key"), "key", "left_anti")


def scan(mutations: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Extension: the visible state for keys from ``low`` to ``high``, both included, in key order."""
    if low is not None:
        mutations = mutations.where(F.col("key") >= low)
    if high is not None:
        mutations = mutations.where(F.col("key") <= high)
    return live(mutations).select("key", "value").orderBy("key")


def sorted_run(entries: DataFrame, key: str = "key") -> DataFrame:
    """All entries of a run, tombstones included, with their position in key order."""
    return with_ordinals(entries, key)
