"""Streams: idempotent commits, session cursors, windows and state histories. The same functions run on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive, a few at a time."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def commits_once(turns: DataFrame, keys: list[str], t: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first of each commit; with an event time, state older than the watermark is let go."""
    if t:
        return turns.withWatermark(t, delay).dropDuplicatesWithinWatermark(keys)
    return turns.dropDuplicates(keys)


def windows(events: DataFrame, t: str, size: str, step: str | None = None, delay: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Counts and sums over tumbling or sliding windows, final once the watermark has passed."""
    w = F.window(t, size, step) if step else F.window(t, size)
    stream = events.withWatermark(t, delay) if events.isStreaming else events
    out = stream.groupBy(w.alias("w"), *(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "n", "total")


def sessions(events: DataFrame, t: str, gap: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with no gap longer than this."""
    stream = events.withWatermark(t, delay) if events.isStreaming else events
    out = stream.groupBy(F.session_window(t, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


STATE_SCHEMA = "key string, value string, valid_from timestamp, status string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, since = state.get if state.exists else (None, None)
    rows = []
    # a trigger's rows come in several batches: none is judged before all are there
    whole = pd.concat([pdf[["value", "t"]] for pdf in batches]).sort_values(["t", "value"])
    for v, t in whole.itertuples(index=False):
        if since is not None and t < pd.Timestamp(since):
            rows.append((key[0], v, t, "out_of_order"))
        elif v != value:
            rows.append((key[0], v, t, "applied"))
            value, since = v, t
        else:
            since = t
    if since is not None:
        state.update((value, pd.Timestamp(since).to_pydatetime()))
    yield pd.DataFrame(rows, columns=["key", "value", "valid_from", "status"])


def state_changes(observations: DataFrame) -> DataFrame:
    """A state machine per key (key, value, t): changes are applied, what comes before the last seen waits as out_of_order.

    A key's state is one value and a time, however many observations it has. Rows of a trigger are taken in order of time; machines.state_log()
    also waits for rows of later triggers, and keeps what is put aside."""
    return observations.groupBy("key").applyInPandasWithState(_advance, STATE_SCHEMA, "value string, seen timestamp", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything there is, batch by batch; a batch that runs again after a failure has the same number, so `each` can overwrite by it."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_sessions(target: str, key: str = "session_id", row: str = "idx", whole: bool = False) -> Callable[[DataFrame, int], None]:
    """A sink that writes just the partitions of the sessions in a batch: its rows take the place of stored ones of the same number, others stay.

    With `whole` a batch has all rows of its sessions, so stored ones that it doesn't have are stale and go.

    A batch that runs again gives the same."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(target)
        if not whole and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            stored = spark.read.schema(batch.schema).parquet(target).join(batch.select(key).distinct(), key, "left_semi")
            batch = batch.unionByName(stored.join(batch.select(key, row), [key, row], "left_anti"))
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(target)

    return write
