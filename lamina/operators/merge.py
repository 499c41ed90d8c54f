"""Merging sorted runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.expressions import entry_bytes
from lamina.functions.ordinals import stretched
from lamina.operators.resolve import newest


def union_all(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def merged_order(mutations: DataFrame) -> DataFrame:
    """All versions, each with its place among its key's, newest first.

    Versions are range-partitioned by all of the order, so a key with very many of them is spread over tasks. A
    stretch ranks its own rows; only its first key can have begun in earlier stretches, and a table with a row
    for each stretch has how many versions of it are there. Versions that are equal in ``ts`` and ``seq`` take
    their places in any order.
    """
    order = ["key", F.desc("ts"), F.desc("seq")]
    rows = stretched(mutations, *order)
    ends = rows.groupBy("__stretch").agg(F.min("key").alias("__first"), F.max("key").alias("__last"))
    tails = rows.join(F.broadcast(ends), "__stretch").where(F.col("key").eqNullSafe(F.col("__last"))).groupBy("__stretch", "__last").agg(F.count("*").alias("__n"))
    earlier, own = tails.select(F.col("__stretch").alias("__before"), "__last", "__n"), ends.select("__stretch", "__first")
    ahead = own.join(earlier, F.col("__first").eqNullSafe(F.col("__last")) & (F.col("__before") < F.col("__stretch"))).groupBy("__stretch", "__first").agg(F.sum("__n").alias("__ahead"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__stretch", "key").orderBy(*order[1:])))
    carried = ahead.select("__stretch", F.col("__first").alias("__key"), "__ahead")
    return ranked.join(
        F.broadcast(carried), (ranked["__stretch"] == carried["__stretch"]) & ranked["key"].eqNullSafe(carried["__key"]), "left"
    ).select(*mutations.columns, (F.col("__rank") + F.coalesce("__ahead", F.lit(0))).cast("long").alias("place"))


def merge(runs: list[DataFrame] | DataFrame, bottom: bool = False) -> DataFrame:
    """The newest version of each key of the runs. In the bottom level nothing older can be below, so tombstones go."""
    entries = newest(runs if isinstance(runs, DataFrame) else union_all(runs))
    return entries.where(~F.col("tombstone")) if bottom else entries


def split(entries: DataFrame, run_bytes: int) -> DataFrame:
    """Add ``piece``: entries in key order, each key once, are cut where their accounted bytes pass a multiple of ``run_bytes``.

    Each range partition sums its own; what the ones before it sum to comes from a table with a row for each.
    """
    rows = stretched(entries.withColumn("__bytes", entry_bytes(tombstone=F.col("tombstone"))), "key")
    sums = rows.groupBy("__stretch").agg(F.sum("__bytes").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    so_far = F.sum("__bytes").over(Window.partitionBy("__stretch").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.withColumn("__sum", so_far).join(F.broadcast(sums.select("__stretch", before.alias("__before"))), "__stretch")
    return cut.withColumn("piece", F.floor((F.col("__sum") + F.col("__before") - 1) / run_bytes).cast("long")).drop("__stretch", "__bytes", "__sum", "__before")
