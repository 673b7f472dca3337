"""Structured Streaming extensions: ingest into the catalogue, sliding rate limits, month counts of late data.

The catalogue itself has polled queues only; these are additions with the semantics of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from galena.operators.sync import leaves


def source(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, kind, n) of tumbling windows; rows later than the watermark are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), kind, "n")


class RateLimit(StatefulProcessor):
    """Admits `limit` attempts per `window` seconds and key; state holds the admitted times only. Rows of a batch are taken in order of time."""

    def __init__(self, limit: int = 5, window: float = 60.0):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()]
        frame = pd.concat(list(rows)).sort_values(["at", "id"])
        admitted = []
        for at in frame["at"]:
            held = [h for h in held if at - h <= self.window]
            admitted.append(len(held) < self.limit)
            if admitted[-1]:
                held.append(at)
        if held:
            self.held.put([(h,) for h in held])
        yield pd.DataFrame({"key": key[0], "id": frame["id"].to_numpy(), "admitted": admitted})

    def close(self) -> None:
        pass


def rate_limited(attempts: DataFrame, limit: int = 5, window: float = 60.0) -> DataFrame:
    """(key, id, admitted) of streamed attempts (key, id, at: epoch seconds)."""
    return attempts.groupBy("key").transformWithStateInPandas(RateLimit(limit, window), "key string, id long, admitted boolean", "Append", "None")


def upsert_into(target: str, keys: list[str]):
    """A foreachBatch sink: each batch is a folder of its own, so a repeated batch overwrites itself; read with latest_state()."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return write


def latest_state(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The newest row of each key over all batches written."""
    rows = spark.read.parquet(target)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys and c != "batch"]), "batch").alias("r")).select(*keys, "r.*")


def manifest_leaves(batch: DataFrame) -> DataFrame:
    """Trie leaves of one batch of manifest rows per device: buckets to refresh."""
    return leaves(batch, ["device_id"])
