"""The log of mutations: a Parquet folder for each batch, and a frame that says what it must hold."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lamina.functions.expressions import entry_bytes, entry_crc
from lamina.schema import MUTATION
from lamina.sources.files import Files


def _measured(batch: DataFrame) -> DataFrame:
    """Add what is summed of each entry, as columns that are compiled: what is observed isn't."""
    numbers = F.concat_ws(",", *[F.col(c).cast("string") for c in ("ts", "seq", "tombstone")])
    return batch.select("*", entry_bytes(tombstone=F.col("tombstone")).alias("__bytes"), entry_crc("key", "value", numbers).alias("__crc"))


def _sums() -> list[Column]:
    """Rows, accounted bytes, checksum (the sum of the entries', as rows have no order in a table) and the greatest seq."""
    return [
        F.count("*").alias("n"), F.coalesce(F.sum("__bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("__crc"), F.lit(0)).alias("crc"), F.coalesce(F.max("seq"), F.lit(-1)).alias("seq"),
    ]


def frame_of(batch: DataFrame) -> dict:
    return _measured(batch).agg(*_sums()).first().asDict()


def valid_prefix(frames: DataFrame) -> DataFrame:
    """Frames (``batch_id``, ``ok``) before the first that isn't ok. The bound is one aggregate, not an ordered scan."""
    bad = frames.where(~F.coalesce(F.col("ok"), F.lit(False))).agg(F.min("batch_id").alias("__bad"))
    return frames.join(F.broadcast(bad)).where(F.col("__bad").isNull() | (F.col("batch_id") < F.col("__bad"))).drop("__bad")


class Log:
    """Batch ``i`` is the folder ``b<i>``; it counts once its frame ``b<i>.json`` is there, which is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder, self.files = spark, f"{root}/log", Files(spark, root)

    def append(self, batch_id: int, mutations: DataFrame, source: tuple[str, int] | None = None) -> dict:
        """Write a batch and then its frame; one without rows leaves nothing. ``source`` is a stream's name and the number of its batch."""
        path = f"{self.folder}/b{batch_id:012d}"
        seen = Observation()  # summed while it is written, so a frame says what was meant to be there
        _measured(mutations.select(*MUTATION.names)).observe(seen, *_sums()).select(*MUTATION.names).write.mode("overwrite").parquet(path)
        frame = seen.get
        if not frame["n"]:
            self.files.delete(path)
            return frame
        if source:
            frame |= {"source": list(source)}
        self.files.write(f"{path}.draft", json.dumps(frame))
        if not self.files.move_new(f"{path}.draft", f"{path}.json"):
            raise FileExistsError(f"batch {batch_id} is in the log already")
        return frame

    def frames(self, after: int = -1) -> dict[int, dict]:
        """Frames of the batches that follow ``after`` and each other without a gap."""
        there = {int(n[1:-5]): n for n in self.files.names(self.folder) if n.startswith("b") and n.endswith(".json")}
        out = {}
        for i in sorted(i for i in there if i > after):
            if i - 1 != after and i - 1 not in out:
                break
            try:
                out[i] = json.loads(self.files.read(f"{self.folder}/{there[i]}"))
            except Exception as e:  # a frame that was cut or changed
                if not isinstance(e, ValueError) and "ChecksumException" not in str(e):
                    raise
                break
        return out

    def replay(self, after: int = -1, verify: bool = False) -> tuple[DataFrame, dict[int, dict]]:
        """Mutations of whole, valid batches in order, up to the first that is torn; ``verify`` reads and sums each anew, all in one job."""
        frames = self.frames(after)
        if verify and frames:
            there = set(self.files.names(self.folder))
            found = self._summed([i for i in frames if f"b{i:012d}" in there])
            bad = min((i for i, frame in frames.items() if found.get(i) != {k: v for k, v in frame.items() if k != "source"}), default=None)
            frames = {i: frame for i, frame in frames.items() if bad is None or i < bad}
        return self._read(list(frames)), frames

    def _summed(self, batches: list[int]) -> dict[int, dict]:
        """What the frames of batches should be; one that can't be read has none."""
        if not batches:
            return {}
        try:
            number = F.regexp_extract(F.input_file_name(), r"/b(\d{12})/[^/]*$", 1).cast("long").alias("batch")
            return {r["batch"]: {k: v for k, v in r.asDict().items() if k != "batch"} for r in _measured(self._read(batches).withColumn("batch", number)).groupBy("batch").agg(*_sums()).collect()}
        except Exception as e:
            if "FAILED_READ_FILE" not in str(e):
                raise
            return {} if len(batches) == 1 else {i: frame for b in batches for i, frame in self._summed([b]).items()}

    def _read(self, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*[f"{self.folder}/b{i:012d}" for i in batches])

    def first(self) -> int | None:
        """The lowest batch that has a frame."""
        return min((int(n[1:-5]) for n in self.files.names(self.folder) if n.startswith("b") and n.endswith(".json")), default=None)

    def trim(self, last: int) -> None:
        """Delete batches up to ``last``; only once a committed manifest has their rows in runs."""
        for name in self.files.names(self.folder):
            if int(name[1:13]) <= last:
                self.files.delete(f"{self.folder}/{name}")
