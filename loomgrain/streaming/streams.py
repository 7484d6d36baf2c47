"""Streams over files of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.cluster import use_checkpoint_dir
from loomgrain.operators.graph import graph_delta
from loomgrain.operators.ledger import last_meaningful


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, where: str, schema: str, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(where)


def debounced(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, path: str = "path", kind: str = "kind", order: str = "ts", ignored: Column | None = None, every: str | None = "1 second"):
    """Start a query that hands over one row for each path and trigger: its last event of a known kind.

    every None takes what is there and ends. Ignored paths are dropped first.
    """
    if ignored is not None:
        events = events.filter(~ignored)

    def batch(df: DataFrame, number: int) -> None:
        handle(last_meaningful(df, path, kind, [order], "Unknown"), number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def merge_batch(spark: SparkSession, table: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that merges rows by key into a parquet table; deleted keys go.

    Each batch writes a new version beside the last one and then points to it, so that a batch that is
    repeated after a failure gives the same table.
    """

    def apply(df: DataFrame, number: int) -> None:
        target = f"{table}/version={number}"
        fresh = df.withColumn("__batch", F.lit(number))
        if number > 0:
            old = spark.read.parquet(f"{table}/version={number - 1}")
            fresh = old.join(df.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
        gone = F.coalesce(F.col("kind") == "Deleted", F.lit(False)) if "kind" in fresh.columns else F.lit(False)
        fresh.filter(~gone).write.mode("overwrite").parquet(target)

    return apply


def delta_batch(previous: tuple[DataFrame, DataFrame], current: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes what a batch changes in a graph."""

    def apply(df: DataFrame, number: int) -> None:
        nodes, edges = current(df)
        graph_delta(previous[0], nodes, previous[1], edges).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return apply


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with zone; times without are taken as the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """start, kind, n, total by tumbling or sliding windows of event time; later rows than `late` may be left out of a stream."""
    at = F.window(ts, length, slide) if slide else F.window(ts, length)
    return _timed(events, ts).withWatermark(ts, late).groupBy(at.alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """key, start, end, n: runs of a key's events no further apart than the gap; the end is the gap after the last event."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def distinct_events(events: DataFrame, key: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Each key once within the watermark's delay."""
    return _timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and give its result, written to the shared folder."""
    spark = stream.sparkSession
    out, marks = shared_folder(spark, name), shared_folder(spark, f"{name}-marks")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def observed_clocks(stream: DataFrame) -> DataFrame:
    """node, physical, counter: each node's logical clock after every batch of received clocks (node, physical, counter).

    The clock never goes back: with a later physical time it takes that and its counter, with the same the
    greater counter plus 1, with an earlier one its own counter plus 1.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        physical, counter = state.get if state.exists else (0, 0)
        for pdf in batches:
            for p, c in sorted(zip(pdf["physical"].tolist(), pdf["counter"].tolist())):
                if p > physical:
                    physical, counter = p, c + 1
                elif p == physical:
                    counter = max(counter, c) + 1
                else:
                    counter += 1
        state.update((physical, counter))
        yield pd.DataFrame({"node": [key[0]], "physical": [physical], "counter": [counter]})

    return stream.groupBy("node").applyInPandasWithState(fold, "node string, physical bigint, counter bigint", "physical bigint, counter bigint", "update", "NoTimeout")
