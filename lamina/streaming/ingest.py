"""Streams into a store, and the latest value per key as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lamina.operators.resolve import newest
from lamina.schema import MUTATION
from lamina.store import Store


def into_store(stream: DataFrame, store: Store, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
    """Append each micro-batch of mutations as one log batch, exactly once.

    Spark may run a micro-batch again after a failure. The log's frame, and the manifest after a flush, have the stream's name
    (by default its checkpoint) and the number of its last batch, and a batch that is there already is not appended again. A batch
    without rows leaves nothing.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        store._append(newest(batch.select(*MUTATION.names)), (name or checkpoint, batch_id))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _version(row: tuple) -> tuple:
    value, ts, seq, dead = row
    return ts, seq, dead, value is not None, value or ""


class _Latest(StatefulProcessor):
    """Keeps a key's newest mutation; a late one with a lower (ts, seq) changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "value string, ts long, seq long, tombstone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.held.get()) if self.held.exists() else None
        for pdf in rows:
            top = pdf.sort_values(["ts", "seq", "tombstone", "value"], na_position="first").iloc[-1]
            new = (None if pd.isna(top["value"]) else str(top["value"]), int(top["ts"]), int(top["seq"]), bool(top["tombstone"]))
            best = new if best is None or _version(new) > _version(best) else best
        if best is not None:
            self.held.update(best)
            yield pd.DataFrame({"key": [key[0]], "value": [best[0]], "ts": [best[1]], "seq": [best[2]], "tombstone": [best[3]]})

    def close(self) -> None:
        pass


def latest(stream: DataFrame) -> DataFrame:
    """Updates of each key's newest mutation. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(_Latest(), MUTATION, "Update", "None")
