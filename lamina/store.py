"""A table in a folder: log, runs and manifest, behind put, delete, get, flush and maintain."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import merge, read, resolve, statistics
from lamina.plans import compaction
from lamina.schema import MUTATION, Commit, Options
from lamina.sources import runs
from lamina.sources.filters import Filters
from lamina.sources.log import Log, frame_of
from lamina.sources.manifest import Manifest


class Store:
    """One writer, any number of readers.

    A batch is in the log before it is visible; runs are written before the manifest names them; the log is
    trimmed and old runs are deleted only after that. So a crash leaves either the old or the new state, and a
    table can be opened any number of times without a flush.
    """

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        self.manifest, self.log = Manifest(spark, self.root, self.options.num_levels), Log(spark, self.root)
        self.snapshot = self.manifest.load()
        if not self.snapshot.version:
            self._recover()
        self.tail, self.frames = self.log.replay(self.snapshot.last_batch, verify=True)
        self._set_aside()
        self.filters = Filters(spark, self.root)
        self.skips = self.opened = 0
        self.pending: list[tuple] = []  # rows of a group that is not in the log yet
        self.held, self.synced = 0, time.monotonic()

    def _recover(self) -> None:
        """Without a manifest, what the runs' folders have is the table, with whatever the log has; only then may the log begin anywhere."""
        found, seq = runs.listed(self.spark, self.root, self.options.num_levels)
        if found:
            first = self.log.first() or 0
            self.snapshot = self.manifest.commit(self.snapshot, runs=tuple(found), next_seq=seq, next_run=len(found), last_batch=first - 1)

    def _set_aside(self) -> None:
        """Move batches after the valid prefix to the folder ``lost``; their numbers are used again. A torn last batch was never acknowledged."""
        last, to = max(self.frames, default=self.snapshot.last_batch), f"{self.root}/lost/{time.time_ns()}"
        for name in self.log.files.names(self.log.folder):
            if int(name[1:13]) > last:
                self.log.files.move(f"{self.log.folder}/{name}", to)

    @property
    def _next_batch(self) -> int:
        return max(self.frames, default=self.snapshot.last_batch) + 1

    @property
    def _next_seq(self) -> int:
        return max([self.snapshot.next_seq, *(f["seq"] + 1 for f in self.frames.values()), *(r[3] + 1 for r in self.pending[-1:])])

    def put(self, key: str, value: str) -> None:
        self.put_batch([(key, value)])

    def put_batch(self, rows: DataFrame | Iterable[tuple[str, str]], order: str | None = None) -> None:
        """Put ``key``, ``value`` rows. Of a key's rows the later one wins: in a list by place, in a DataFrame by ``order``.

        Rows of a table have no place, so without ``order`` the greatest value of a key and ``ts`` wins. An empty batch does
        nothing. A DataFrame with its own ``ts`` keeps it, so late rows lose to newer ones.
        """
        if isinstance(rows, DataFrame):
            self.sync()
            self._append(self._stamped(rows, order))
        elif rows := list(rows):
            now, seq = time.time_ns(), self._next_seq
            self._hold([(k, v, now + i, seq + i, False) for i, (k, v) in enumerate(rows)])

    def delete(self, key: str) -> None:
        self.delete_keys([key])

    def delete_keys(self, keys: DataFrame | Iterable[str]) -> None:
        if isinstance(keys, DataFrame):
            self.sync()
            self._append(self._stamped(keys.select("key", F.lit("").alias("value"), F.lit(True).alias("tombstone")), None))
        elif keys := list(keys):
            now, seq = time.time_ns(), self._next_seq
            self._hold([(k, "", now + i, seq + i, True) for i, k in enumerate(keys)])

    def _hold(self, rows: list[tuple]) -> None:
        """Append rows at once, or with others of their group. A group is visible to this store and not yet durable."""
        self.pending += rows
        self.held += 1
        how, waited = self.options.commit, time.monotonic() - self.synced
        if how is Commit.EACH or how is Commit.GROUP and self.held >= self.options.group or how is Commit.PERIOD and waited >= self.options.seconds:
            self.sync()

    def sync(self) -> None:
        """Make what is held durable, as one log batch."""
        if self.pending:
            rows = self.spark.createDataFrame(self.pending, MUTATION)
            self.pending, self.held = [], 0
            self._append(rows)
        self.synced = time.monotonic()

    def _stamped(self, rows: DataFrame, order: str | None) -> DataFrame:
        if order is not None:  # the order decides, wherever a row lies
            rows = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), order).alias("r")).select("key", "r.*")
        ts = F.col("ts") if "ts" in rows.columns else F.lit(time.time_ns())
        dead = F.col("tombstone") if "tombstone" in rows.columns else F.lit(False)
        return rows.select("key", "value", ts.cast("long").alias("ts"), F.lit(self._next_seq).cast("long").alias("seq"), dead.alias("tombstone"))

    def streams(self) -> dict[str, int]:
        """The last batch of each stream that is in the table."""
        return self.snapshot.streams | dict(f["source"] for f in self.frames.values() if "source" in f)

    def _append(self, mutations: DataFrame, source: tuple[str, int] | None = None) -> None:
        if source and source[1] <= self.streams().get(source[0], -1):
            return  # in the table already
        if not self.options.use_log:
            mutations = resolve.newest(mutations)
            frame = frame_of(mutations)
            if frame["n"]:
                self._write_runs(mutations, frame["bytes"], frame["n"], frame["seq"] + 1, self.snapshot.last_batch, streams=self.streams() | dict([source] if source else []))
            return
        frame = self.log.append(self._next_batch, mutations, source)
        if not frame["n"]:
            return
        self.frames[self._next_batch] = frame
        self.tail = self.log._read(list(self.frames))
        if sum(f["bytes"] for f in self.frames.values()) >= self.options.flush_bytes:
            self.flush()

    def flush(self) -> None:
        """Make the log's rows a sorted run of level 0. Deletes alone fill it as puts do."""
        self.sync()
        if not any(f["n"] for f in self.frames.values()):
            return
        size, rows = (sum(f[c] for f in self.frames.values()) for c in ("bytes", "n"))
        self._write_runs(resolve.newest(self.tail), size, rows, self._next_seq, max(self.frames), size, self.streams())
        self.log.trim(self.snapshot.last_batch)
        self.frames, self.tail = {}, self.log._read([])
        self.maintain()

    def _write_runs(self, entries: DataFrame, size: int, rows: int, next_seq: int, last_batch: int, logged: int = 0, streams: dict | None = None) -> None:
        new = runs.write(entries, self.root, 0, self.snapshot.next_run, self.options.run_bytes, size, rows)
        self.snapshot = self.manifest.commit(
            self.snapshot, runs=(*self.snapshot.runs, *new), last_batch=last_batch, next_seq=next_seq, next_run=self.snapshot.next_run + len(new),
            counters=self.snapshot.counted(flush_bytes=sum(r.bytes for r in new), log_bytes=logged), streams=self.snapshot.streams if streams is None else streams,
        )

    def maintain(self) -> int:
        """Merge until every level is within its limit; returns the number of merges. Errors are raised."""
        done = 0
        while (plan := compaction.next_merge(self.snapshot, self.options)) is not None:
            self.compact(plan)
            done += 1
        return done

    def compact(self, plan: compaction.Merge) -> None:
        """Merge what shares keys; what shares none with the others goes to the level by the manifest alone, as it was written."""
        inputs, moved = compaction.parts(plan, self.options.run_bytes)
        new = []
        if inputs:
            size, rows = sum(r.bytes for r in inputs), sum(r.rows for r in inputs)
            new = runs.write(  # a run has a key once, so a key has few rows
                runs.read(self.spark, self.root, inputs), self.root, plan.level, self.snapshot.next_run, self.options.run_bytes, size, rows, lambda r: merge.merge(r, plan.bottom)
            )
        moved = [replace(r, level=plan.level) for r in moved]
        gone = set(plan.inputs)
        written = sum(r.bytes for r in new)
        runs.mark_moved(self.spark, self.root, [r for r in moved if r not in gone])
        self.snapshot = self.manifest.commit(
            self.snapshot, runs=(*[r for r in self.snapshot.runs if r not in gone], *moved, *new), next_run=self.snapshot.next_run + max(len(new), 1),
            counters=self.snapshot.counted(compaction_bytes=written),
            compactions=(*self.snapshot.compactions[-99:], {"level": plan.level, "bytes": written, "inputs": len(inputs), "moved": len(moved), "outputs": len(new)}),
        )

    def vacuum(self, grace: float = 0.0) -> list[str]:
        """Delete files of runs that no kept version names, but for folders younger than ``grace`` seconds."""
        return self.manifest.vacuum(self.snapshot, self.root, grace=grace)

    def mutations(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """All stored versions of keys in a range: runs that the manifest says may have them, and the log's tail."""
        ranged = low is not None and high is not None
        return self._opened(runs.may_hold(list(self.snapshot.runs), low, high), True) if ranged else self._opened(list(self.snapshot.runs), False)

    def _opened(self, chosen: list, counted: bool) -> DataFrame:
        if counted:
            self.skips, self.opened = self.skips + len(self.snapshot.runs) - len(chosen), self.opened + len(chosen)
        stored = runs.read(self.spark, self.root, chosen).unionByName(self.tail)
        return stored.unionByName(self.spark.createDataFrame(self.pending, MUTATION)) if self.pending else stored

    def may_contain(self, key: str) -> list:
        """The runs that may have a key, by their bounds and then by their filters. No run that has it is left out.

        At most the runs of level 0 and one of each other level pass the bounds, so the driver reads few filters for a key.
        """
        return self.filters.may_contain(runs.may_hold(list(self.snapshot.runs), key, key), key)

    def memtable(self) -> DataFrame:
        """What no run has yet, in key order: the newest version of each key, tombstones included."""
        held = self.tail.unionByName(self.spark.createDataFrame(self.pending, MUTATION)) if self.pending else self.tail
        return resolve.newest(held).orderBy("key")

    def memtable_size(self) -> tuple[int, int]:
        """Its keys and accounted bytes."""
        frame = frame_of(self.memtable())
        return frame["n"], frame["bytes"]

    def table(self) -> DataFrame:
        """The visible state. Runs of one level below 0 share no keys, so where they are all there is, nothing needs to be resolved."""
        levels = {r.level for r in self.snapshot.runs}
        once = len(levels) == 1 and 0 not in levels and not (self.frames or self.pending)
        return (self.mutations().where(~F.col("tombstone")) if once else resolve.live(self.mutations())).select("key", "value")

    def get(self, key: str) -> str | None:
        """The value of a key, or None; where no run may have it and nothing is unflushed, without a job."""
        chosen = self.may_contain(key)
        versions = self._opened(chosen, True)
        if not (chosen or self.frames or self.pending):
            return None
        row = read.get(versions, key).first()
        return row["value"] if row else None

    def multi_get(self, keys: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
        """``key``, ``value`` and ``found`` of the asked keys; where all are known to be from ``low`` to ``high``, other runs aren't read."""
        return read.multi_get(self.mutations(low, high), keys)

    def scan(self, low: str, high: str) -> DataFrame:
        return read.scan(self.mutations(low, high), low, high)

    def catalog(self) -> DataFrame:
        return self.manifest.catalog(self.snapshot)

    def entries(self, run) -> Iterator:
        """The entries of one run in key order, tombstones included, read a partition ahead and never held whole."""
        return runs.read(self.spark, self.root, [run]).orderBy("key").toLocalIterator(prefetchPartitions=True)

    def has_overlapping_levels(self) -> bool:
        """Whether runs of a level below 0 share keys, which merges never leave."""
        return statistics.level_overlap(self.catalog().where("level > 0")).where("overlaps").count() > 0

    def stats(self) -> dict:
        levels = sorted(tuple(r) for r in statistics.level_sizes(self.catalog(), self.options.num_levels).collect())
        c = self.snapshot.counters
        pending, asked = sum(f["bytes"] for f in self.frames.values()), self.skips + self.opened
        return {
            **c, "log_bytes": c["log_bytes"] + pending, "skips": self.skips, "opened": self.opened, "skip_rate": 100 * self.skips / asked if asked else 0.0, "num_levels": self.options.num_levels,
            "files_per_level": [f for _, f, _ in levels], "level_sizes": [b for _, _, b in levels], "total_bytes": pending + sum(b for _, _, b in levels),
            "write_amp": (c["flush_bytes"] + c["compaction_bytes"]) / c["log_bytes"] if c["log_bytes"] else 0.0,
        }

    def close(self) -> None:
        """Make everything durable; what is in the folder needs no closing."""
        self.sync()
