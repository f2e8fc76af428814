"""Structured Streaming counterparts: file streams, rounds, buffers and logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.session import scratch


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """STR-01: a folder of parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and key, with a watermark for late rows."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a table of files, and read that."""
    spark = stream.sparkSession
    out, state = scratch(spark, f"stream-{name}"), scratch(spark, f"state-{name}")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def shuffled_batches(stream: DataFrame, key: str, seed: int, sink: Callable[[DataFrame, int], None]) -> None:
    """STR-02: each micro-batch in a seeded hash order, handed to ``sink``."""
    state = scratch(stream.sparkSession, "state-shuffle")
    q = stream.writeStream.foreachBatch(lambda df, n: sink(df.orderBy(F.xxhash64(key, F.lit(seed))), n)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def buffered(stream: DataFrame, key: str, size: int) -> DataFrame:
    """STR-04: (key, n, total) whenever ``size`` rows of a key have gathered; the rest
    waits in the state, which outlives restarts. The stream has (key, value double)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            for v in pdf["value"]:
                n, total = n + 1, total + float(v)
                if n == size:
                    yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})
                    n, total = 0, 0.0
        state.update((n, total))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n int, total double", "n int, total double", "append", "NoTimeout")


def rounds(chains: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 15) -> DataFrame:
    """STR-03: apply ``step`` to the chains that aren't done, round after round; each
    round is written, so a restart goes on from the last. ``chains`` has boolean ``done``."""
    from stepforge.session import written

    now, _ = written(chains, "round-0")
    for i in range(1, most + 1):
        if now.where("NOT done").isEmpty():
            break
        now, _ = written(now.where("done").unionByName(step(now.where("NOT done"))), f"round-{i}")
    return now


def append_log(rows: DataFrame, path: str) -> None:
    """SNK-10, STR-06: append log rows, nulls left out."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


def log_tail(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """SRC-17: the last row of a log."""
    t = spark.read.schema(schema).json(path)
    return t.groupBy().agg(F.max_by(F.struct(*t.columns), order).alias("r")).select("r.*")
