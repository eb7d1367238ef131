"""Streaming operators: a token buffer carried across rows, packing with an end mark, size-triggered shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

PIECE = 2_000  # windows handed to Spark at once


def stream_lines(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Unbounded lines of a folder with their file; a file that cannot be read is skipped."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("ignoreCorruptFiles", "true")
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def packed_stream(rows: DataFrame, key: str, order: str, ids: str, *, length: int, stride: int | None = None, eos: int | None = None) -> DataFrame:
    """Windows ``(key, window, x, y)`` of the tokens of each key as they arrive; of a string ``ids``, the code points are the tokens.

    ``key`` is the shard whose order is kept; more shards run in parallel.  The
    state is the tail of the buffer (fewer than ``length + stride + 1`` tokens)
    and the number of the next window, so it is bounded.  With ``eos`` that mark
    follows each row.  Rows of one trigger are taken in ``order``; a tail too
    short for a window waits.  A task holds the rows of one key and one trigger,
    so the source has to limit a trigger.
    """
    step = stride or length
    mark = [] if eos is None else [eos]

    def update(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail, number = state.get if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("order", kind="stable")["ids"]
        rows = [t for t in rows if t is not None]
        buffer = np.empty(len(tail) + sum(len(t) + len(mark) for t in rows), np.int32)
        buffer[: len(tail)] = tail
        at = len(tail)
        for t in rows:
            buffer[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32) if isinstance(t, str) else t
            buffer[at + len(t) : (at := at + len(t) + len(mark))] = mark
        starts = np.arange(0, max(len(buffer) - length, 0), step)
        state.update((buffer[len(starts) * step :].tolist(), number + len(starts)))
        for low in range(0, len(starts), PIECE):
            v = [buffer[s : s + length + 1] for s in starts[low : low + PIECE]]
            yield pd.DataFrame({"key": group[0], "window": number + low + np.arange(len(v)), "v": v})

    tokens = F.col(ids) if rows.schema[ids].dataType.typeName() == "string" else F.col(ids).cast("array<int>")
    shaped = rows.select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), tokens.alias("ids"))
    cut = shaped.groupBy("key").applyInPandasWithState(update, "key string, window bigint, v array<int>", "tail array<int>, number bigint", "append", "NoTimeout")
    return cut.select("key", "window", F.slice("v", 1, length).alias("x"), F.slice("v", 2, length).alias("y"))


def best_stream(rows: DataFrame, key: str, order: str, metric: str) -> DataFrame:
    """``(key, step, value)`` of every record strictly lower than all before it; the state is one number per key."""

    def update(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        out = []
        for step, value in pd.concat(list(batches)).sort_values("step", kind="stable").itertuples(index=False):
            if pd.notna(value) and (best is None or value < best):
                best = float(value)
                out.append((group[0], int(step), best))
        if best is not None:
            state.update((best,))
        yield pd.DataFrame(out, columns=["key", "step", "value"])

    shaped = rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("step"), F.col(metric).cast("double").alias("value"))
    return shaped.groupBy("key").applyInPandasWithState(
        lambda k, b, s: update(k, (p[["step", "value"]] for p in b), s), "key string, step bigint, value double", "best double", "append", "NoTimeout"
    )


def shard_sink(path: str, max_tokens: int):
    """A ``foreachBatch`` writer of windows of one length: shards of about ``max_tokens`` of each key, and a manifest line per shard and epoch.

    A shard goes on in the next epoch, so only the last one of a key is small.
    An epoch that is run again replaces what it wrote.
    """

    def write(df: DataFrame, epoch: int) -> None:
        upto = (F.col("window") + 1) * F.size("x")
        rows = df.withColumn("shard", F.floor((upto - 1) / max_tokens))
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("key", "shard").parquet(f"{path}/shards/epoch={epoch}")
        written = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/shards/epoch={epoch}")
        written.groupBy("key", "shard").agg(F.sum(F.size("x")).alias("tokens")).write.mode("overwrite").json(f"{path}/manifest/epoch={epoch}")

    return write


def finish(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Drive a stream over what is there now; shuffle files of past triggers are deleted when the driver collects its garbage."""
    query = writer.trigger(availableNow=True).start()
    while not query.awaitTermination(5):
        spark._jvm.System.gc()


def run_to_memory(df: DataFrame, name: str) -> DataFrame:
    """Drive a stream over what is there now and return its rows (tests and demonstrations; the driver holds them all)."""
    query = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, path: str) -> DataFrame:
    """Drive a stream over what is there now into a shared folder and return its rows; the driver holds none of them."""
    target = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    finish(df.sparkSession, target)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
