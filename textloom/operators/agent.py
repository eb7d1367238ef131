"""Parsing of agent replies and outlines of source code."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_reply(reply: Column) -> Column:
    """struct(thought, action, arguments, final_answer) of a reply; the arguments are JSON, or comma-separated ``k=v``."""

    def field(name: str, stops: str) -> Column:
        got = F.regexp_extract(reply, rf"(?s){name}:\s*(.*?)(?=\n(?:{stops}):|\z)", 1)
        return F.nullif(F.trim(got), F.lit(""))

    raw = field("Action Input", "Thought|Action|Observation|Final Answer")
    as_json = F.from_json(raw, "map<string,string>")
    bare = F.regexp_replace(raw, r"[{}\"']", "")
    pairs = F.transform(F.filter(F.split(bare, ","), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    as_pairs = F.map_from_entries(F.filter(pairs, lambda e: e["key"] != ""))
    arguments = F.when(F.startswith(F.ltrim(raw), F.lit("{")) & as_json.isNotNull() & (F.size(as_json) > 0), as_json).otherwise(as_pairs)
    return F.struct(
        field("Thought", "Action|Action Input|Final Answer").alias("thought"), field("Action", "Action Input|Thought|Observation|Final Answer").alias("action"),
        F.coalesce(arguments, F.create_map().cast("map<string,string>")).alias("arguments"), field("Final Answer", "Thought|Action").alias("final_answer"),
    )


def outline(df: DataFrame, key: str, code: str) -> DataFrame:
    """``(key, kind, name, arguments, line)`` of the classes and functions of Python sources; text that does not parse has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.ClassDef):
                        rows.append((i, "class", node.name, None, node.lineno))
                    elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append((i, "function", node.name, ",".join(a.arg for a in node.args.args), node.lineno))
            index, kinds, names, arguments, lines = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(arguments, pa.string()), pa.array(lines, pa.int32())],
                names=["key", "kind", "name", "arguments", "line"],
            )

    return df.select(F.col(key).alias("key"), F.col(code).alias("code")).mapInArrow(run, f"key {kind}, kind string, name string, arguments string, line int")
