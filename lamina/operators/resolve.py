"""Newest-wins resolution. One order holds everywhere: the greatest (ts, seq) of a key wins, then a delete, then the greatest value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.expressions import VERSION, version


def newest(mutations: DataFrame, key: str = "key") -> DataFrame:
    """The newest mutation of each key, tombstones included.

    An aggregate and not a window: each task reduces its rows to one per key before they are shuffled, and a key
    with very many versions is no task of its own. A filter on the key is pushed below it; one on the value must
    come after it. The empty string is a key like any other.

    Rows of a key and the version's columns alone are their own order, so that each is held and shuffled once.
    """
    rest = [c for c in mutations.columns if c != key]
    row = F.max(version()) if set(rest) == set(VERSION) else F.max_by(F.struct(*rest), version())
    return mutations.groupBy(key).agg(row.alias("__row")).select(key, "__row.*").select(*mutations.columns)


def live(mutations: DataFrame, key: str = "key") -> DataFrame:
    """The visible state: newest mutations that aren't tombstones. An empty value is visible."""
    return newest(mutations, key).where(~F.col("tombstone"))


def as_of(mutations: DataFrame, ts: int, key: str = "key") -> DataFrame:
    """Extension: the visible state at ``ts``, for as long as compaction has kept the versions."""
    return live(mutations.where(F.col("ts") <= ts), key)


def history(mutations: DataFrame, key: str = "key") -> DataFrame:
    """Extension: how many versions each key has, and the first and last."""
    return mutations.groupBy(key).agg(
        F.count("*").alias("versions"), F.count_if(F.col("tombstone")).alias("tombstones"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def upsert(base: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """The visible state of ``base`` after ``changes``, both mutations."""
    return live(base.unionByName(changes), key)


def tombstones(keys: DataFrame, ts, seq) -> DataFrame:
    """Deletes of ``keys`` (a ``key`` column), blind: a key that was never written is no error."""
    return keys.select("key", F.lit("").alias("value"), F.lit(ts).cast("long").alias("ts"), F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("tombstone"))
