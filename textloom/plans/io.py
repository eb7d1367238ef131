"""Queries of the file sources and sinks, the streaming operators and the agent parsers.

The tables are first written out as the files an operator reads, into the shared folder.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import agent, validate
from textloom.plans.conversation import SPACE
from textloom.plans.corpus import _CS, CHARS, docs, ids
from textloom.plans.registry import query
from textloom.session import shared_dir
from textloom.sources import readers, sinks
from textloom.streaming import packing


FILE_BYTES = 6 << 20  # of documents, as stored, that make a file of a stream
FILES = 4  # files of a trigger


def _size(df: DataFrame) -> int:
    """Bytes of the files a table is read from."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf: str) -> str:
    """All documents as line files, in document order."""
    path = _folder(spark, "lines")
    text = F.regexp_replace("text", "[\r\n]+", " ")
    rows = docs(spark, sf)
    rows.where("length(text) > 0").repartitionByRange(max(4, math.ceil(_size(rows) / FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id").select(F.concat_ws("\t", "doc_id", text).alias("value")).write.text(path)
    return path


@query("SELECT count(*) AS lines, CAST(sum(length(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) + length(CAST(doc_id AS VARCHAR)) + 2) AS BIGINT) AS chars FROM documents WHERE length(text) > 0")
def s5_read_lines(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_lines(spark, _lines(spark, sf)).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT count(*) AS files FROM documents WHERE length(text) > 0")
def s1_whole_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per document: written by partition, read back whole."""
    path = _folder(spark, "files")
    docs(spark, sf).where("length(text) > 0").select(F.pmod("doc_id", F.lit(8)).alias("part"), F.concat("text", F.lit("\x1e")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    whole = readers.read_whole_texts(spark, path, recursive=True)
    return whole.agg(F.sum(F.size(F.split("text", "\x1e")) - 1).alias("files"))


#: suffix of the files that hold the documents of each type, and of code by its domain
_SUFFIX = {"code": "py", "markdown": "md", "json": "json", "html": "html"}
_CODE_SUFFIX = {"python": "py", "cpp": "cpp", "java": "java", "javascript": "js"}


def _suffixed(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Rows ``(suffix, value)`` as text files of that suffix, a few of each, under names of their own."""
    path = _folder(spark, name)
    rows.repartition("suffix", F.pmod(F.xxhash64("value"), F.lit(3))).write.partitionBy("suffix").text(path)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/suffix=*/part-*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for n, status in enumerate(files.globStatus(pattern)):
        old = status.getPath()
        suffix = old.getParent().getName().partition("=")[2]
        files.rename(old, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{suffix}-{n}.{suffix}"))
    return path


def _when(column: str, table: dict[str, str], other: str):
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _case(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


@query(
    f"""SELECT {_case("suffix", {"py": "code", "md": "markdown", "json": "json", "html": "html"}, "txt")} AS doc_type, CAST(sum(length(text) + 1) AS BIGINT) AS chars
    FROM (SELECT text, {_case("doc_type", _SUFFIX, "txt")} AS suffix FROM documents WHERE length(text) > 0) GROUP BY 1"""
)
def s6_read_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files of their types, read back as a tree: characters by the type the suffix tells."""
    path = _suffixed(spark, docs(spark, sf).where("length(text) > 0").select(_when("doc_type", _SUFFIX, "txt").alias("suffix"), F.col("text").alias("value")), "kb")
    return readers.read_documents(spark, path).groupBy("doc_type").agg(F.sum(F.length("content")).cast("bigint").alias("chars"))


@query(
    f"""SELECT {_case("suffix", {"py": "python", "cpp": "cpp", "java": "java"}, "javascript")} AS language, CAST(sum(length(text) + 1) AS BIGINT) AS chars
    FROM (SELECT text, {_case("lower(domain)", _CODE_SUFFIX, "rs")} AS suffix FROM documents WHERE doc_type = 'code' AND text IS NOT NULL) WHERE suffix <> 'rs' GROUP BY 1"""
)
def s8_read_code(spark: SparkSession, sf: str) -> DataFrame:
    """The code documents as files of their languages, read back by suffix; files of other suffixes are skipped."""
    rows = docs(spark, sf).where("doc_type = 'code' and text is not null").withColumn("domain", F.lower("domain"))
    path = _suffixed(spark, rows.select(_when("domain", _CODE_SUFFIX, "rs").alias("suffix"), F.col("text").alias("value")), "code")
    return readers.read_code(spark, path).groupBy("language").agg(F.sum(F.length("text")).cast("bigint").alias("chars"))


_STRIP = f"regexp_replace({{}}, '^{SPACE}+|{SPACE}+$', '', 'g')".replace("{85}", "{{85}}").replace("{Z}", "{{Z}}")
_I, _G, _O = (f"coalesce({_STRIP.format(c)}, '')" for c in ("instruction", "input", "output"))


@query(
    f"""SELECT CASE WHEN {_G} <> '' THEN {_I} || chr(10) || chr(10) || 'Input:' || chr(10) || {_G} ELSE {_I} END AS "user", {_O} AS assistant, count(*) AS n
    FROM (SELECT DISTINCT record_id, instruction, input, output FROM instruction_records) WHERE {_I} <> '' AND {_O} <> '' GROUP BY 1, 2"""
)
def s10_read_instructions(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "jsonl")
    spark.read.parquet(f"{sf}/instruction_records.parquet").select("record_id", "instruction", "input", "output").distinct().drop("record_id").write.json(path)
    got = readers.read_instructions(spark, path, "alpaca")
    return got.groupBy(F.element_at("messages", 1)["content"].alias("user"), F.element_at("messages", 2)["content"].alias("assistant")).agg(F.count("*").alias("n"))


def _benchmark(spark: SparkSession, sf: str, name: str, columns: list) -> DataFrame:
    path = _folder(spark, name)
    spark.read.parquet(f"{sf}/benchmark_problems.parquet").select(*columns).write.json(path)
    out = readers.read_benchmark(spark, path, name)
    return out.select("task_id", "prompt", "entry_point", "canonical_solution", F.size("test_cases").alias("tests"), F.element_at("metadata", "difficulty").alias("difficulty"))


@query("SELECT task_id, prompt, entry_point, canonical_solution, CAST(1 AS INTEGER) AS tests, 'medium' AS difficulty FROM benchmark_problems")
def s11_read_humaneval(spark: SparkSession, sf: str) -> DataFrame:
    return _benchmark(spark, sf, "humaneval", ["task_id", "prompt", "entry_point", "canonical_solution", F.array_join("test_cases", "\n").alias("test")])


@query("SELECT 'MBPP/' || task_id AS task_id, prompt, 'solution' AS entry_point, canonical_solution, CAST(len(test_cases) AS INTEGER) AS tests, 'medium' AS difficulty FROM benchmark_problems")
def s12_read_mbpp(spark: SparkSession, sf: str) -> DataFrame:
    return _benchmark(spark, sf, "mbpp", ["task_id", F.col("prompt").alias("text"), F.col("canonical_solution").alias("code"), F.col("test_cases").alias("test_list")])


@query("SELECT 'APPS/' || task_id AS task_id, prompt, 'main' AS entry_point, canonical_solution, CAST(1 AS INTEGER) AS tests, element_at(metadata, 'difficulty')[1] AS difficulty FROM benchmark_problems")
def s13_read_apps(spark: SparkSession, sf: str) -> DataFrame:
    return _benchmark(spark, sf, "apps", [F.col("task_id").alias("problem_id"), F.col("prompt").alias("question"), F.array("canonical_solution").alias("solutions"), F.array_join("test_cases", "\n").alias("input_output"), F.element_at("metadata", "difficulty").alias("difficulty")])


@query("SELECT task_id, prompt, entry_point, canonical_solution, CAST(len(test_cases) AS INTEGER) AS tests, 'medium' AS difficulty FROM benchmark_problems")
def s14_read_custom(spark: SparkSession, sf: str) -> DataFrame:
    return _benchmark(spark, sf, "anything", ["task_id", F.col("prompt").alias("question"), "entry_point", F.col("canonical_solution").alias("solution"), "test_cases"])


@query("WITH o AS (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS first FROM documents WHERE text IS NOT NULL) SELECT CAST(first // 50000 AS BIGINT) AS shard, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(min(first) AS BIGINT) AS first_token FROM o GROUP BY 1")
def s16_write_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = sinks.write_token_shards(ids(docs(spark, sf)), "doc_id", "ids", _folder(spark, "shards"), vocab_size=65000, max_bytes=100_000)
    return out.select(F.col("shard").cast("bigint").alias("shard"), "documents", F.col("tokens").cast("bigint").alias("tokens"), "first_token")


@query(
    f"""WITH o AS (SELECT length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS first, list_sum(list_transform({CHARS}, lambda c: unicode(c))) AS total FROM documents WHERE text IS NOT NULL),
    s AS (SELECT first // 50000 AS shard, sum(n) AS n, coalesce(sum(total), 0) AS total FROM o GROUP BY 1)
    SELECT CAST(sum(n) OVER (ORDER BY shard) - n AS BIGINT) AS "offset", CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM s"""
)
def s17_read_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of all documents in shards of binary files, read as one virtual array."""
    path = _folder(spark, "bin")
    sinks.write_token_files(sinks.shard_plan(ids(docs(spark, sf)), "doc_id", "ids", max_bytes=200_000, width=4), "doc_id", "ids", path, dtype="uint32")
    shards = readers.with_global_offset(readers.read_token_shards(spark, path, "uint32"))
    return shards.select("offset", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("SELECT (SELECT count(*) FROM tokenizer_vocab) AS tokens, (SELECT count(*) FROM tokenizer_merges) AS merges, (SELECT max(merge_rank) FROM tokenizer_merges) AS last_rank")
def s18_save_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "tokenizer")
    sinks.save_tokenizer(spark.read.parquet(f"{sf}/tokenizer_vocab.parquet"), spark.read.parquet(f"{sf}/tokenizer_merges.parquet"), path)
    vocab, merges = sinks.load_tokenizer(spark, path)
    return vocab.agg(F.count("*").alias("tokens")).crossJoin(merges.agg(F.count("*").alias("merges"), F.max("merge_rank").alias("last_rank")))


@query("SELECT count(*) AS steps, round(avg(value), 6) AS loss, max(event_id) AS last_step FROM events")
def s22_metric_log(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "metrics")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("int").alias("step"), F.col("value").alias("loss"))
    for half in (0, 1):
        sinks.append_metrics(rows.where(F.pmod("step", F.lit(2)) == half), path)
    return sinks.read_metrics(spark, path).agg(F.count("*").alias("steps"), F.round(F.avg("loss"), 6).alias("loss"), F.max("step").cast("bigint").alias("last_step"))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE length(text) < 10) AS short FROM documents WHERE length(text) > 0")
def v8_validate_folder(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "folder")
    docs(spark, sf).where("length(text) > 0").select("doc_id", "text").write.json(path)
    rows = spark.read.schema("doc_id bigint, text string").option("pathGlobFilter", "*.json").json(path)
    return validate.verdicts(rows, "doc_id", "text").agg(F.count("*").alias("files"), F.count_if(F.col("verdict") == "short").alias("short"))


# --- streams --------------------------------------------------------------


def _in_turn(spark: SparkSession, path: str) -> None:
    """Give the files of a folder times in the order of their names, in which a stream reads them."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.globStatus(pattern) or []), key=lambda p: p.getName())
    now = int(time.time()) * 1000
    for n, file in enumerate(files):
        at = now - (len(files) - n) * 1000
        fs.setTimes(file, at, -1)
        if fs.getFileStatus(file).getModificationTime() != at:
            raise RuntimeError("the shared folder keeps no times of files, so a stream has no order there")


def _stream(spark: SparkSession, df: DataFrame, name: str, files: int = 1000, ordered: bool = False) -> DataFrame:
    path = _folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if ordered:
        _in_turn(spark, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _token_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """``(doc_id, text, key)`` of the documents with text, in the order of their ids; a trigger has about ``FILES * FILE_BYTES`` of them."""
    texts = docs(spark, sf)
    parts = max(FILES, math.ceil(_size(texts) / FILE_BYTES))
    rows = texts.where("length(text) > 0").select("doc_id", "text").repartitionByRange(parts, "doc_id")
    return _stream(spark, rows.withColumn("key", F.pmod("doc_id", F.lit(4)).cast("string")), name, FILES, ordered=True)


def _memory(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:8]}"


@query("SELECT count(*) AS lines FROM documents WHERE length(text) > 0")
def z1_stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = packing.stream_lines(spark, _lines(spark, sf), files_per_trigger=2)
    return packing.run_to_files(lines, _folder(spark, "streamed")).agg(F.count("*").alias("lines"))


def _packed(length: int, eos: str) -> str:
    return f"""WITH e AS (SELECT key, doc_id, unnest(w) AS id, generate_subscripts(w, 1) AS pos FROM (SELECT CAST(doc_id % 4 AS VARCHAR) AS key, doc_id, v{eos} AS w FROM {_CS})),
    g AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) - 1 AS k FROM e),
    a AS (SELECT key, k // {length} AS "window", md5(string_agg(id, ',' ORDER BY k)) AS x FROM g GROUP BY 1, 2 HAVING count(*) = {length}),
    b AS (SELECT key, (k - 1) // {length} AS "window", md5(string_agg(id, ',' ORDER BY k)) AS y FROM g WHERE k > 0 GROUP BY 1, 2 HAVING count(*) = {length})
    SELECT key, "window", x, y FROM a JOIN b USING (key, "window")"""


def _packed_stream(spark: SparkSession, sf: str, name: str, eos: int | None) -> DataFrame:
    stream = packing.packed_stream(_token_stream(spark, sf, name), "key", "doc_id", "text", length=512, eos=eos)
    text = lambda c: F.md5(F.btrim(F.to_json(c), F.lit("[]"))).alias(c)
    return packing.run_to_files(stream.select("key", "window", text("x"), text("y")), _folder(spark, name))


@query(_packed(512, ""))
def z2_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _packed_stream(spark, sf, "windows", None)


@query(_packed(512, " || [3]"))
def z3_stream_packing(spark: SparkSession, sf: str) -> DataFrame:
    return _packed_stream(spark, sf, "packed", 3)


@query("SELECT key, CAST((n - 1) // 512 * 512 AS BIGINT) AS tokens, (n - 1) // 512 * 512 > 0 AS filled FROM (SELECT CAST(doc_id % 4 AS VARCHAR) AS key, sum(length(text)) AS n FROM documents WHERE length(text) > 0 GROUP BY 1)")
def z4_stream_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the stream written in size-triggered shards; per key the tokens of its manifest, and whether the last shard alone may be small."""
    stream = packing.packed_stream(_token_stream(spark, sf, "sharded"), "key", "doc_id", "text", length=512)
    path = _folder(spark, "sink")
    packing.finish(spark, stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(packing.shard_sink(path, 100_000)))
    manifest = spark.read.schema("epoch bigint, key string, shard bigint, tokens bigint").json(f"{path}/manifest")
    return manifest.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.every(F.col("tokens") > 0).alias("filled"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_id AS step, value FROM (SELECT *, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM events) WHERE best")
def z6_stream_best(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    return packing.run_to_memory(packing.best_stream(_stream(spark, events, "best"), "user_id", "event_id", "value"), _memory("best"))


# --- agent ----------------------------------------------------------------


_PLAIN = r"""regexp_replace(regexp_replace(prompt, '[\n"\\]', ' ', 'g'), '^[ \t\n\x0B\f\r]+', '')"""


@query(
    f"""SELECT task_id, nullif(trim({_PLAIN}), '') AS thought, 'file_reader' AS action, entry_point AS path, '5' AS lines, CAST(NULL AS VARCHAR) AS final_answer
    FROM benchmark_problems WHERE prompt IS NOT NULL AND entry_point IS NOT NULL"""
)
def g2_parse_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark prompts wrapped as agent replies, with JSON and with ``k=v`` arguments."""
    rows = spark.read.parquet(f"{sf}/benchmark_problems.parquet").where("prompt is not null and entry_point is not null")
    plain = F.regexp_replace("prompt", "[\n\"\\\\]", " ")
    reply = F.concat(F.lit("Thought: "), plain, F.lit("\nAction: file_reader\nAction Input: "), F.when(F.ascii(F.right("task_id", F.lit(1))) % 2 == 0, F.concat(F.lit('{"path": "'), "entry_point", F.lit('", "lines": 5}'))).otherwise(F.concat(F.lit("path="), "entry_point", F.lit(", lines=5"))))
    p = agent.parse_reply(F.col("reply"))
    return rows.select("task_id", reply.alias("reply")).select("task_id", p.alias("p")).select("task_id", "p.thought", "p.action", F.try_element_at("p.arguments", F.lit("path")).alias("path"), F.try_element_at("p.arguments", F.lit("lines")).alias("lines"), "p.final_answer")


@query()
def g6_outline(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("doc_type = 'code' and lower(domain) = 'python' and text is not null")
    return agent.outline(rows, "doc_id", "text").withColumnRenamed("key", "doc_id")
