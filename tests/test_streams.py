"""Streams in many triggers against what they are by definition."""

import hashlib

import pytest

from textloom.plans import io
from textloom.streaming import packing


@pytest.mark.parametrize("eos, query", [(None, io.z2_stream_windows), (3, io.z3_stream_packing)])
def test_windows_of_many_triggers_are_in_order_and_not_held_by_the_driver(spark, tmp_path, monkeypatch, eos, query):
    texts = {i: chr(97 + i % 26) * (i * 37 % 600) for i in range(60, 0, -1)}
    spark.createDataFrame([(i, t or None) for i, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(io, "FILE_BYTES", 500)
    monkeypatch.setattr(io, "FILES", 2)
    monkeypatch.setattr(packing, "PIECE", 3)
    monkeypatch.setattr(packing, "run_to_memory", None)
    got = {(r.key, r.window): (r.x, r.y) for r in query(spark, str(tmp_path)).collect()}
    want = {}
    for key in range(4):
        v = [x for i in sorted(texts) if i % 4 == key and texts[i] for x in [*map(ord, texts[i]), *([] if eos is None else [eos])]]
        for k in range((len(v) - 1) // 512):
            want[str(key), k] = tuple(hashlib.md5(",".join(map(str, v[k * 512 + d : k * 512 + d + 512])).encode()).hexdigest() for d in (0, 1))
    assert got == want and len(want) > 20


def test_packed_windows_are_read_from_files(spark, tmp_path):
    spark.createDataFrame([(i, "x" * 600) for i in range(1, 41)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    packed = io.z3_stream_packing(spark, str(tmp_path))
    assert packed.count() == 4 * ((10 * 601 - 1) // 512)
    assert packed.inputFiles()  # rows of a memory sink have none


def test_shards_go_on_over_triggers(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "x" * 5000) for i in range(1, 201)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(io, "FILE_BYTES", 500)
    monkeypatch.setattr(io, "FILES", 2)
    monkeypatch.setattr(io, "_folder", lambda spark, name: str(tmp_path / name))
    totals = {r.key: r.tokens for r in io.z4_stream_shards(spark, str(tmp_path)).collect()}
    assert totals == {str(k): (50 * 5000 - 1) // 512 * 512 for k in range(4)}
    shards = spark.read.parquet(str(tmp_path / "sink" / "shards")).selectExpr("epoch", "key", "shard", "window", "size(x) AS n", "size(y) AS m").collect()
    assert len({r.epoch for r in shards}) > 1 and {(r.n, r.m) for r in shards} == {(512, 512)}
    sizes = {}
    for r in shards:
        sizes[r.key, r.shard] = sizes.get((r.key, r.shard), 0) + r.n
    assert all(abs(n - 100_000) <= 512 or shard == 2 for (key, shard), n in sizes.items()) and len(sizes) == 12
    lines = spark.read.json(str(tmp_path / "sink" / "manifest")).collect()
    assert sum(r.tokens for r in lines) == sum(sizes.values())


def test_lines_are_not_held_by_the_driver(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"a\nb{i}") for i in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(io, "FILE_BYTES", 200)
    monkeypatch.setattr(packing, "run_to_memory", None)
    assert io.z1_stream_lines(spark, str(tmp_path)).collect()[0].lines == 300


def test_streams_of_no_documents(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert io.z2_stream_windows(spark, str(tmp_path)).count() == 0 and io.z4_stream_shards(spark, str(tmp_path)).count() == 0
    assert io.z1_stream_lines(spark, str(tmp_path)).collect()[0].lines == 0
