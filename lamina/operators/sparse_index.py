"""Sparse indexes: every n-th key of a run, and floor lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.ordinals import last_known, with_ordinals
from lamina.schema import INDEX_STEP


def build(entries: DataFrame, key: str = "key", step: int = INDEX_STEP) -> DataFrame:
    """``key`` and ``ordinal`` of each ``step``-th entry in key order, from the first on."""
    rows = with_ordinals(entries.select(F.col(key).alias("key")), "key")
    return rows.where(F.col("ordinal") % step == 0)


def floor_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """``key`` and ``ordinal``, that of the greatest indexed key at or before it, for each probe; before the first it is 0.

    Index and probes are sorted together and the last indexed entry is carried on, which needs no pair of a probe
    and an index entry. Repeated probes each get a row; null probes get 0.
    """
    both = index.select("key", F.col("ordinal"), F.lit(0).alias("probe")).unionByName(probes.select("key", F.lit(None).cast("long").alias("ordinal"), F.lit(1).alias("probe")))
    known = last_known(both, ["key", "probe"], F.col("ordinal"), "at")
    return known.where("probe = 1").select("key", F.coalesce("at", F.lit(0)).cast("long").alias("ordinal"))


def bounds(entries: DataFrame, *run: str) -> DataFrame:
    """Exact ``min_key``, ``max_key`` and ``rows`` of each run."""
    return entries.groupBy(*run).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("rows"))
