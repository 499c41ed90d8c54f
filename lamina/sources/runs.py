"""Sorted runs as Parquet files with key statistics and Bloom filters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from lamina.functions.expressions import entry_bytes
from lamina.schema import MUTATION
from lamina.sources.files import Files
from lamina.sources.manifest import Run, level_of, moved_to


#: Parquet's default bytes of a row group, each of which has a filter of its own, and the most that one may have.
ROW_GROUP = 128 << 20
MOST_FILTER = 16 << 20
#: A write of more files than these makes them larger instead, up to so many accounted bytes each; beyond, it makes more.
MANY_FILES = 64
LARGE_RUN = 256 << 20


def pieces_of(total_bytes: int, run_bytes: int) -> int:
    """How many files a write has. Each costs a task, renames and a line of the manifest, so their number must not follow a table's size with small runs."""
    return max(1, -(-total_bytes // max(run_bytes, min(-(-total_bytes // MANY_FILES), LARGE_RUN))))


def write(entries: DataFrame, root: str, level: int, first_id: int, run_bytes: int, total_bytes: int, rows: int, reduce: Callable[[DataFrame], DataFrame] | None = None) -> list[Run]:
    """Write entries in key order below ``root``; each file is a run with exact bounds.

    Files are cut by range partitions of about ``run_bytes``, or more (see :func:`pieces_of`). Their bounds are read back, as range bounds are sampled. Filters
    are sized for the keys that a row group has if ``rows`` are dealt evenly, and a quarter more; one that gets more is less sharp.
    ``reduce`` is a reduction by key that is made in the range partitions, so that it needs no shuffle of its own; a key must have few rows then.
    """
    pieces = pieces_of(total_bytes, run_bytes)
    keys = max(64, min(rows // pieces, ROW_GROUP * rows // max(total_bytes, 1)) * 5 // 4)
    folder = f"l{level}-{uuid.uuid4().hex}"
    path = f"{root}/runs/{folder}"
    options = {
        "parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(keys), "parquet.bloom.filter.max.bytes": str(MOST_FILTER),
        "parquet.page.write-checksum.enabled": "true",
    }
    ranged = entries.select(*MUTATION.names).repartitionByRange(pieces, "key")
    (reduce(ranged) if reduce else ranged).sortWithinPartitions("key").write.options(**options).parquet(path)
    found = sorted(described(entries.sparkSession, [path]), key=lambda r: r["low"])
    return [Run(level, first_id + i, f"{folder}/{r['file'].rsplit('/', 1)[1]}", r["low"], r["high"], r["n"], r["size"], r["dead"]) for i, r in enumerate(found)]


def mark_moved(spark: SparkSession, root: str, runs: list[Run]) -> None:
    """Write beside each run's file the level that it is about to be moved to, for a table whose manifest is lost.

    This comes before the commit. If that fails, the run counts as older than it is in such a table, which changes nothing: what moves is
    of the oldest of its level and shares no keys with the next.
    """
    files = Files(spark, root)
    for r in runs:
        folder, name = r.path.split("/")
        files.write(f"{root}/runs/{folder}/_l{r.level}-{name}", "")


def verified(spark: SparkSession) -> DataFrameReader:
    """A reader of runs that holds each page against its checksum, so that a changed byte is an error."""
    return spark.read.schema(MUTATION).option("parquet.page.verify-checksum.enabled", "true")


def described(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Exact bounds, rows, accounted bytes and range of seq of each file in some folders: a row for each file.

    Every row is read and summed. The bounds are the keys at the places of the first, after nulls, and the last row, as a file is in key order: least
    and greatest strings would be found by sorting all rows by file, sums are not.
    """
    rows = verified(spark).parquet(*paths).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    found = [r.asDict() for r in rows.groupBy("file").agg(
        F.count("*").alias("n"), F.sum(entry_bytes(tombstone=F.col("tombstone"))).alias("size"), F.count_if("tombstone").alias("dead"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_if(F.col("key").isNull()).alias("nulls"),
    ).collect()]
    ends = spark.createDataFrame([(r["file"], p) for r in found for p in {r["nulls"], r["n"] - 1}], "file string, place long")  # two rows for each file
    key = {(r["file"], r["place"]): r["key"] for r in rows.select("file", "place", "key").join(F.broadcast(ends), ["file", "place"]).collect()}
    return [r | {"low": key.get((r["file"], r["nulls"])), "high": key.get((r["file"], r["n"] - 1))} for r in found]


def listed(spark: SparkSession, root: str, num_levels: int) -> tuple[list[Run], int]:
    """All whole runs below ``root`` by their folders' names, and the next free seq: what a lost manifest knew.

    A folder without its marker of success was never committed. A file that was moved counts for the level that its marker
    has. Files that a merge has replaced and that are not vacuumed yet are found again; that changes no answer, as the newest version wins wherever it lies, and a merge's
    inputs have the tombstones that its output left out. As they may overlap, all go to level 0, older ones first:
    deeper levels before higher ones, then by seq, so that no tombstone is dropped before what it hides.
    """
    files = Files(spark, root)
    level = {n: level_of(n) for n in files.names(f"{root}/runs") if files.exists(f"{root}/runs/{n}/_SUCCESS")}
    deeper = {f"{n}/{f}": x for n in level for f, x in moved_to(files.names(f"{root}/runs/{n}")).items()}
    if any(x >= num_levels for x in (*level.values(), *deeper.values())):
        raise ValueError(f"the table has more than {num_levels} levels")
    if not level:
        return [], 0
    found = [(*r["file"].rsplit("/", 2)[1:], r) for r in described(spark, [f"{root}/runs/{n}" for n in level])]
    first = {n: min(r["first_seq"] for m, _, r in found if m == n) for n in {n for n, _, _ in found}}
    found.sort(key=lambda x: (-deeper.get(f"{x[0]}/{x[1]}", level[x[0]]), first[x[0]], x[0], x[2]["low"]))
    out = [Run(0, i, f"{n}/{f}", r["low"], r["high"], r["n"], r["size"], r["dead"]) for i, (n, f, r) in enumerate(found)]
    return out, max((r["last_seq"] for _, _, r in found), default=-1) + 1


def read(spark: SparkSession, root: str, runs: list[Run]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], MUTATION)
    return verified(spark).parquet(*[f"{root}/runs/{r.path}" for r in runs])


def may_hold(runs: list[Run], low: str, high: str) -> list[Run]:
    """Runs whose key range meets low..high, from the manifest alone."""
    return [r for r in runs if r.max_key >= low and r.min_key <= high]
