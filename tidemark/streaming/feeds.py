"""Streaming consumers of a change log kept as Parquet files.

The checkpoint is the consumer's cursor. Sources and sinks are files; every query here
runs in append mode so that the file sink commits each batch exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.functions.text import micros_of, wall_time
from tidemark.operators.feed import last_change, op_code, op_name
from tidemark.operators.tenancy import REFRESH_MINUTES
from tidemark.schema import CADENCES


def follow(spark: SparkSession, path: str, schema: StructType, name_glob: str | None = None,
           files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream of files."""
    reader = spark.readStream.schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def as_instant(ts: Column) -> Column:
    """A zone-less time as an instant, read as UTC: watermarks need instants."""
    return F.timestamp_micros(micros_of(ts))


def as_wall_time(instant: Column) -> Column:
    return wall_time(F.unix_micros(instant))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Consume everything there is now, append it to Parquet, stop. Run again with the same
    checkpoint to go on where it stopped."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def read_sink(spark: SparkSession, out: str, stream: DataFrame) -> DataFrame:
    return spark.read.schema(stream.schema).parquet(out)


# ----------------------------------------------------------------- feed forms
def deduplicated(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop redelivered entries: (entity, version) names a change once and for all. State is bounded:
    redelivery is expected within ``delay`` of event time."""
    return log.withColumn("_at", as_instant(F.col("changed_at"))).withWatermark(
        "_at", delay).dropDuplicatesWithinWatermark(["entity", "version"]).drop("_at")


def interval_counts(log: DataFrame, cadence: str = "daily", delay: str | None = "1 hour") -> DataFrame:
    """Changes per cadence interval with the op breakdown. In a stream an interval is emitted
    once the watermark has passed its end."""
    timed = log.withColumn("_at", as_instant(F.col("changed_at")))
    if delay is not None:
        timed = timed.withWatermark("_at", delay)

    def tally(op):
        return F.count_if(F.col("op") == op)

    return timed.groupBy("entity", F.window("_at", CADENCES[cadence]).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_changes"), tally("insert").alias("inserted"),
        tally("update").alias("updated"), tally("delete").alias("deleted"),
    ).select("entity", as_wall_time(F.col("_w.start")).alias("interval_start"),
             as_wall_time(F.col("_w.end")).alias("interval_end"),
             "n_changes", "inserted", "updated", "deleted")


def key_states(log: DataFrame) -> DataFrame:
    """Last change per key, for a stream in update mode: each batch emits the keys that moved on.

    A built-in aggregate: version and op packed in one number as in ``last_change``, its maximum
    combined before the shuffle, so a key that makes up much of the log reaches its state as one
    row a task. State is one number per key.
    """
    packed = (F.col("version") * 4 + op_code(F.col("op"))).cast("bigint")
    return log.groupBy("entity", "pk_value").agg(F.max(packed).alias("packed"))


def update_to_end(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Like ``run_to_end`` for a stream in update mode: each batch is a folder of its own, written over
    when the batch is run again, so a restart leaves every batch once."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def current_states(emitted: DataFrame) -> DataFrame:
    """Fold what ``key_states`` emitted to one row per key."""
    changes = emitted.select(
        "entity", "pk_value", F.shiftright("packed", 2).alias("version"), op_name(F.col("packed") % 4).alias("op"))
    return last_change(changes, "entity", "pk_value")


def refreshed_uses(uses: DataFrame, key: str, at: str, minutes: int = REFRESH_MINUTES) -> DataFrame:
    """Streaming form of the throttled last-used rule: state is the last kept time of a key.

    Late is what arrives in a trigger after a later use of its key was kept: it cannot change what has
    been emitted and is left out, so uses must arrive in time order across triggers, in any order
    within one. One task holds the candidate times of a key within one trigger (8 bytes each);
    ``files_per_batch`` of ``follow`` bounds that. Bulk history belongs to the batch form, which
    splits a key's time line.
    """
    gap = minutes * 60_000_000
    timed = uses.select(F.col(key).alias("key"), micros_of(F.col(at)).alias("us"))
    key_type = timed.schema["key"].dataType.simpleString()

    def keep(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # what lies within the gap of the last kept use can never be kept: drop it on arrival
        floor = -(1 << 62) if last is None else last + gap
        times = np.sort(np.concatenate([t[t > floor] for t in (b["us"].to_numpy() for b in batches)]))
        kept, i = [], 0
        while i < len(times):
            kept.append(int(times[i]))
            i = int(times.searchsorted(times[i] + gap, "right"))
        if kept:
            state.update((kept[-1],))
            yield pd.DataFrame({"key": [group[0]] * len(kept), "us": kept})

    kept = timed.groupBy("key").applyInPandasWithState(
        keep, f"key {key_type}, us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
    return kept.select(F.col("key").alias(key), wall_time(F.col("us")).alias(at))
