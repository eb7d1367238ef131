"""Sources: text and code folders, knowledge bases, instruction and benchmark records, token shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import doc_type_of, path_name, path_stem, path_suffix, strip
from textloom.operators.conversation import adapt_instruction, adapt_prompt_response, adapt_shared

CODE_SUFFIXES = (".py", ".cpp", ".cc", ".c", ".h", ".hpp", ".java", ".js")
LANGUAGE_OF = {".py": "python", ".cpp": "cpp", ".cc": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".java": "java", ".js": "javascript"}

TURN = "struct<role:string,content:string>"
#: one schema over the record shapes of instruction files
INSTRUCTION_SCHEMA = f"instruction string, input string, output string, prompt string, response string, conversations array<struct<`from`:string,value:string>>, messages array<{TURN}>"
BENCHMARK_SCHEMA = (
    "task_id string, problem_id string, prompt string, question string, text string, entry_point string, canonical_solution string, solution string, code string, "
    "solutions array<string>, test string, test_list array<string>, test_cases array<string>, input_output string, difficulty string"
)


def read_whole_texts(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """``(path, text)``, one row per file; a missing path is an error."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def join_files(files: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One row: all texts in the order of their paths.  Meant for folders whose text fits one value."""
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda s: s["text"]), separator).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line)`` with its line feed, as the files' lines read."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.concat("value", F.lit("\n")).alias("line"))


def read_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """``(doc_id, source_file, content, doc_type)`` of a folder tree: type by suffix, blank files dropped, the last path wins a shared stem."""
    files = read_whole_texts(spark, path, recursive=True)
    if suffixes:
        files = files.where(path_suffix(F.col("path")).isin(*suffixes))
    rows = files.where(strip(F.col("text")) != "").select(path_stem(F.col("path")).alias("doc_id"), F.col("path").alias("source_file"), F.col("text").alias("content"), doc_type_of(F.col("path")).alias("doc_type"))
    # paths are compared first, so only the texts that stay are joined
    last = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max("source_file").alias("_last"))
    return rows.join(last, (F.col("doc_id") == F.col("_id")) & (F.col("source_file") == F.col("_last"))).drop("_id", "_last")


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """``(path, language, text)`` of the code files of a tree."""
    files = read_whole_texts(spark, path, recursive=True).where(path_suffix(F.col("path")).isin(*CODE_SUFFIXES))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return files.select("path", F.element_at(known, path_suffix(F.col("path"))).alias("language"), "text")


def _jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and malformed lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return lines.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def _messages_of_pair(df: DataFrame) -> DataFrame:
    rows = adapt_instruction(df.withColumn("record_id", F.monotonically_increasing_id()))
    turn = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))
    return rows.select(F.array(turn("user"), turn("assistant")).alias("messages"), F.lit(None).cast("string").alias("system_prompt"))


def _messages_of_shared(df: DataFrame) -> DataFrame:
    return adapt_shared(df.drop("messages")).select("messages", "system_prompt")


def _messages_of_prompt(df: DataFrame) -> DataFrame:
    return adapt_prompt_response(df).select("messages", F.lit(None).cast("string").alias("system_prompt"))


#: record shapes by name; an unknown name reads prompt and response or a message list
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "alpaca": _messages_of_pair, "code_alpaca": _messages_of_pair, "default": _messages_of_pair,
    "sharegpt": _messages_of_shared, "opencoder": _messages_of_prompt, "ultrachat": _messages_of_prompt, "dolly": _messages_of_prompt,
}


def read_instructions(spark: SparkSession, path: str, shape: str = "default", max_samples: int | None = None) -> DataFrame:
    """``(messages, system_prompt)`` of valid conversations: known roles, no blank content, an assistant turn."""
    rows = ADAPTERS.get(shape, _messages_of_prompt)(_jsonl(spark, path, INSTRUCTION_SCHEMA))
    roles = F.transform("messages", lambda m: F.lower(F.trim(m["role"])))
    valid = rows.where(F.forall(roles, lambda r: r.isin("system", "user", "assistant")) & F.array_contains(roles, "assistant") & F.forall("messages", lambda m: strip(m["content"]) != ""))
    return valid.limit(max_samples) if max_samples is not None else valid


def _problem(task_id, prompt, entry_point, solution, tests, difficulty) -> list:
    text = lambda c: F.coalesce(c, F.lit(""))
    return [
        text(task_id).alias("task_id"), text(prompt).alias("prompt"), text(entry_point).alias("entry_point"), text(solution).alias("canonical_solution"),
        F.coalesce(tests, F.array().cast("array<string>")).alias("test_cases"), F.create_map(F.lit("difficulty"), F.coalesce(difficulty, F.lit("medium"))).alias("metadata"),
    ]


def _one(column: str):
    return F.when(F.col(column).isNotNull(), F.array(column))


#: benchmark layouts by name; an unknown one is read with fallback keys
BENCHMARKS: dict[str, Callable[[], list]] = {
    "humaneval": lambda: _problem(F.col("task_id"), F.col("prompt"), F.col("entry_point"), F.col("canonical_solution"), _one("test"), F.col("difficulty")),
    "mbpp": lambda: _problem(F.concat(F.lit("MBPP/"), "task_id"), F.col("text"), F.lit("solution"), F.col("code"), F.col("test_list"), F.col("difficulty")),
    "apps": lambda: _problem(F.concat(F.lit("APPS/"), "problem_id"), F.col("question"), F.lit("main"), F.try_element_at("solutions", F.lit(1)), _one("input_output"), F.col("difficulty")),
    "custom": lambda: _problem(F.col("task_id"), F.coalesce("prompt", "question"), F.col("entry_point"), F.coalesce("canonical_solution", "solution"), F.coalesce(F.col("test_cases"), _one("test")), F.col("difficulty")),
}


def read_benchmark(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``(task_id, prompt, entry_point, canonical_solution, test_cases, metadata)`` of a benchmark file."""
    return _jsonl(spark, path, BENCHMARK_SCHEMA).select(*BENCHMARKS.get(name.lower(), BENCHMARKS["custom"])())


def read_token_shards(spark: SparkSession, path: str, dtype: str = "uint16") -> DataFrame:
    """``(path, name, ids array<int>)`` of headerless little-endian token files, one row each."""
    kind = np.dtype(dtype).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, kind).astype(np.int64) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["path", "ids"])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return rows.mapInArrow(run, "path string, ids array<bigint>").select("path", path_name(F.col("path")).alias("name"), "ids")


def with_global_offset(shards: DataFrame) -> DataFrame:
    """Shards with the offset of their first token in the concatenation; there is one row per file, and one window over them."""
    sizes = shards.select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.size("ids").cast("bigint").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_n", "_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("_p", before.alias("offset"))
    return shards.join(placed, F.col("path") == F.col("_p")).drop("_p")
