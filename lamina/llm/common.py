"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Masters that run in one process.
LOCAL = re.compile(r"local(\[.*\])?")
#: Bits of a filter of keys at most (64 MB), and for each key while there are fewer.
MOST_BITS, BITS_PER_KEY = 1 << 29, 16
#: Bits of one value of ``bitmap_construct_agg``.
BITMAP = 1 << 15
#: The word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for clusters that don't have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in root.rglob("*.py"):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode, where it is unset, one that is removed at exit.

    On a cluster without that setting there is no folder that all share, which is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join("/tmp/checkpoints", f"lamina-{spark.sparkContext.applicationId}")
        spark.sparkContext.setCheckpointDir(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """What executors reach a path of the shared folder by, and its name there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_range(files: fs.FileSystem, name: str, offset: int, length: int) -> bytes:
    with files.open_input_file(name) as f:
        return f.read_at(length, offset)


def _remove(path: str) -> None:
    with contextlib.suppress(Exception):  # the process ends; what can't be reached any more stays
        files, name = file_system(path)
        files.delete_dir(name)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for what a query needs only while its application runs; removed at exit."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of ``rows``, so that a Python worker turns no more texts into objects at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def words(text: Column | str) -> Column:
    """Number of words of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def known(column: Column | str) -> Column:
    """A string that is never null and differs for null and every value, to join or group by."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), column.cast("string")))


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later plans know its size, and nothing is run twice."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def split_by(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` cut in two without a shuffle: those whose ``key`` may be in the one column of ``keys``, and those whose key isn't.

    ``key`` and the column are long and well mixed; ``keys`` is a written table. A bitmap of the keys is sent to the tasks, of
    ``BITS_PER_KEY`` bits a key and 64 MB at most, so with very many keys more rows are in the first part than need to be. A null
    key is in the second.
    """
    bits = BITMAP
    while bits < min(keys.count() * BITS_PER_KEY, MOST_BITS):
        bits *= 2
    place = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    maps = keys.select(F.shiftright(place, 15).alias("__bucket"), F.pmod(place, F.lit(BITMAP)).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    held = rows.withColumn("__place", F.pmod(key, F.lit(bits))).withColumn("__bucket", F.shiftright("__place", 15)).join(F.broadcast(maps), "__bucket", "left")
    octet = F.conv(F.hex(F.expr("substring(__map, cast(shiftright(pmod(__place, 32768L), 3) as int) + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.expr("shiftright({0}, cast(pmod(__place, 8L) as int)) & 1".format("__octet")) == 1, F.lit(False))
    out = held.withColumn("__octet", octet).withColumn("__there", there)
    return out.where("__there").select(*rows.columns), out.where("not __there").select(*rows.columns)
