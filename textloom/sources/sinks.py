"""Sinks: token shards with a manifest, vocabulary and merge tables, metric logs, keyed caches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.windows import running_offset
from textloom.session import materialize


def shard_plan(docs: DataFrame, order: str, ids: str, *, max_bytes: int = 1 << 30, width: int = 2) -> DataFrame:
    """Rows with ``shard``: a document belongs to the shard its first token falls in, and is never split.

    Shard boundaries are multiples of ``max_bytes // width`` tokens of the
    concatenation, found by a distributed running offset instead of a sequential fold.
    """
    tokens = max(1, max_bytes // width)
    rows = running_offset(docs.withColumn("n_tokens", F.size(ids)), order, "n_tokens", "first_token")
    return rows.withColumn("shard", F.floor(F.col("first_token") / tokens))


def write_token_shards(docs: DataFrame, order: str, ids: str, path: str, *, vocab_size: int, max_bytes: int = 1 << 30) -> DataFrame:
    """Write shards as Parquet partitions of token arrays; returns the manifest ``(shard, documents, tokens, first_token)``.

    Tokens of a vocabulary up to 65,535 count as two bytes, of a larger one as four.
    """
    plan = shard_plan(docs, order, ids, max_bytes=max_bytes, width=2 if vocab_size <= 65535 else 4)
    plan.repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("first_token").alias("first_token"))


def write_token_files(plan: DataFrame, order: str, ids: str, path: str, *, dtype: str = "uint16") -> DataFrame:
    """Write each shard of ``shard_plan`` as a headerless little-endian file; returns the manifest ``(shard, file, tokens)``.

    A shard is written row by row under a name of its own and moved to its place
    when it is whole, so a task that is run again leaves the same file.  ``path``
    is a folder that all workers reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(path)
        filesystem.create_dir(base, recursive=True)
        done: list[tuple[int, str, int]] = []
        out = shard = None
        tokens = 0

        def close() -> None:
            out.close()
            filesystem.move(f"{base}/{temporary}", f"{base}/shard-{shard:08d}.bin")
            done.append((shard, f"shard-{shard:08d}.bin", tokens))

        for batch in batches:
            for s, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != shard:
                    if out:
                        close()
                    shard, tokens, temporary = s, 0, f"_{uuid.uuid4().hex}"
                    out = filesystem.open_output_stream(f"{base}/{temporary}")
                data = values.values.to_numpy(zero_copy_only=False) if values.is_valid else np.zeros(0)
                tokens += len(data)
                out.write(data.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.int64()))], names=["shard", "file", "tokens"])

    rows = plan.select(F.col("shard").cast("bigint").alias("shard"), F.col(order).alias("_o"), F.col(ids).alias("ids"))
    return materialize(rows.repartition("shard").sortWithinPartitions("shard", "_o").select("shard", "ids").mapInArrow(run, "shard bigint, file string, tokens bigint"), "manifest")


def save_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables; merges that are no pairs are ignored."""
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges").where("left_token is not null and right_token is not null")


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


METRIC_SCHEMA = "step int, loss double, lr double, grad_norm double, tps double, timestamp double"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


def cache_key(source: str, config: dict, content_digest: str = "") -> str:
    """Digest of a source, its configuration and, unlike a name alone, its content."""
    import hashlib

    return hashlib.sha256(f"{source}:{json.dumps(config, sort_keys=True)}{content_digest}".encode()).hexdigest()


class DatasetCache:
    """Results kept as Parquet under the digest of what made them; a damaged or unfinished entry is a miss."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def get(self, key: str) -> DataFrame | None:
        fs, done = self._fs(f"{self.path}/{key}/_SUCCESS")
        return self.spark.read.parquet(f"{self.path}/{key}") if fs.exists(done) else None

    def get_or_make(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(key)
        if found is None:
            make().write.mode("overwrite").parquet(f"{self.path}/{key}")
            found = self.get(key)
        return found

    def clear(self) -> None:
        fs, target = self._fs(self.path)
        fs.delete(target, True)
