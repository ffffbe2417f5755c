"""Continuous ingest of a mutation stream: one sorted tier-0 run a micro-batch, and keyed latest-value state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.compact import compact_all
from ..options import DEFAULT, Options
from ..schemas import ENTRY, MUTATION, VALUE
from ..store import Store


def ingest_runs(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch of mutations as the tier-0 run numbered by its batch id. A replayed batch overwrites its
    own run, so restarts neither lose nor repeat entries; the checkpoint logs a batch before it becomes visible."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.sortWithinPartitions("user_key", batch["seq"].desc()).write.mode("overwrite").parquet(f"{path}/tier=0/file_no={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_store(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch into a store, compacted as its tiers fill. A batch counts once, however often it is sent."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: store.ingest(batch, batch_id) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all runs written so far."""
    return spark.read.schema(ENTRY).option("basePath", path).parquet(f"{path}/tier=*")


def maintain(spark: SparkSession, path: str, oldest: int, o: Options = DEFAULT) -> DataFrame:
    """The runs compacted until no tier is full."""
    return compact_all(runs(spark, path), oldest, o)


class _Latest(StatefulProcessor):
    """Newest version of a key. Deletions stay in the state: without them an older put that comes late would bring the
    key back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", MUTATION.replace("user_key string, ", ""))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.newest.get() if self.newest.exists() else None
        best = held
        for pdf in rows:
            r = pdf.loc[pdf["seq"].idxmax()]
            if best is None or r["seq"] > best[0]:
                best = (int(r["seq"]), int(r["type"]), None if pd.isna(r["value"]) else str(r["value"]))
        if best is not None and best != held:
            self.newest.update(best)
            yield pd.DataFrame({"user_key": [key[0]], "seq": [best[0]], "type": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def latest_state(stream: DataFrame) -> DataFrame:
    """Updates (user_key, seq, type, value) whenever a key's newest version changes; late older versions change nothing.
    Needs the RocksDB state store."""
    return stream.groupBy("user_key").transformWithStateInPandas(statefulProcessor=_Latest(), outputStructType="user_key string, seq bigint, type int, value string", outputMode="Update", timeMode="None")


def live(updates: DataFrame) -> DataFrame:
    """(user_key, value) of live keys from a sink of latest_state updates."""
    from ..operators.read import newest

    return newest(updates).where(f"type = {VALUE}").select("user_key", "value")
