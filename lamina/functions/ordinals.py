"""Positions in a global order without a global task."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that all executors share."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Have checkpoints go to the folder that all executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:  # in one process: a local folder, removed at exit
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = f"/tmp/checkpoints/lamina-{context.applicationId}"
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        context.setCheckpointDir(path)


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stretched(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` range-partitioned by ``order``, with the partition as the column ``__stretch``, frozen by writing it.

    Range bounds are sampled, and another run may draw others; once written, all that follows sees the same ones.
    """
    return materialised(df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("__stretch", F.spark_partition_id()))


def with_ordinals(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Add each row's position from 0 in the order of ``order``: its rank in its stretch plus the rows of earlier ones."""
    rows = stretched(df, *order)
    counts = rows.groupBy("__stretch").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__stretch", before.alias("__before"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("__stretch").orderBy(*order))
    return rows.withColumn("__rank", rank).join(F.broadcast(offsets), "__stretch").withColumn(
        name, (F.col("__before") + F.col("__rank") - 1).cast("long")
    ).drop("__stretch", "__before", "__rank")


def last_known(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row in the order of ``order`` (an as-of join after a union).

    Each stretch is filled on its own; what it starts with is the last value of the stretches before it, from a
    table with a row for each partition.
    """
    rows = stretched(df.withColumn("__value", value), *order)
    within = F.last("__value", ignorenulls=True).over(Window.partitionBy("__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    filled = rows.withColumn("__known", within)
    ends = rows.where(F.col("__value").isNotNull()).groupBy("__stretch").agg(F.max_by("__value", F.struct(*order)).alias("__end"))
    stretches = rows.select("__stretch").distinct().join(ends, "__stretch", "left")
    carried = F.last("__end", ignorenulls=True).over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = stretches.select("__stretch", carried.alias("__start"))
    return filled.join(F.broadcast(starts), "__stretch").withColumn(name, F.coalesce("__known", "__start")).drop("__stretch", "__value", "__known", "__start")
