"""The data model: mutations, runs and options."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

#: One mutation. ``ts`` counts nanoseconds, which a timestamp type would cut; ``seq`` breaks ties in order of arrival.
MUTATION = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
    ]
)

#: One sorted run of a level, as the manifest lists it.
RUN = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("min_key", T.StringType()),
        T.StructField("max_key", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)

FORMAT_VERSION = 1
#: Bytes an entry is accounted for beside its key and value, keys between index entries, bits of a
#: Bloom filter for each key, the size of level 0's base, and how much larger each level is.
ENTRY_OVERHEAD = 16
INDEX_STEP = 128
BLOOM_BITS_PER_KEY = 10
LEVEL_BASE = 1 << 20
LEVEL_FACTOR = 10


class Commit(Enum):
    """When a batch of rows is durable: at once; with each ``Options.group`` batches; or with the first batch that comes ``Options.seconds``
    after the last write. What is held is durable at a flush or close in any case.
    """

    EACH = "each"
    GROUP = "group"
    PERIOD = "period"


@dataclass(frozen=True)
class Options:
    """``use_log=False`` writes runs at once, without a log. ``flush_bytes`` and ``run_bytes`` are accounted bytes.
    Writes of many files make runs larger than ``run_bytes``, see ``sources.runs.pieces_of``.

    The defaults are those of a small table. A run is a file and a line of the manifest, so a table of terabytes wants
    ``flush_bytes`` and ``run_bytes`` of a gigabyte or so and a ``level_base`` of many.
    """

    num_levels: int = 7
    flush_bytes: int = 4 << 20
    run_bytes: int = 4 << 20
    level0_runs: int = 8
    level_base: int = LEVEL_BASE
    use_log: bool = True
    commit: Commit = Commit.EACH
    group: int = 100
    seconds: float = 0.1

    def __post_init__(self):
        if self.num_levels < 2:
            raise ValueError("a table needs two levels at least")
        if min(self.flush_bytes, self.run_bytes, self.level0_runs, self.level_base, self.group) < 1:
            raise ValueError("sizes must be positive")
