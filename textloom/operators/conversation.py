"""Instruction and conversation operators: adapters, ChatML rendering, masking, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.session import spread

IM_START, IM_END, PAD, EOS, IGNORE = 50257, 50258, 50259, 3, -100
DEFAULT_SYSTEM = "You are a helpful programming assistant."
#: names a sender goes by in shared conversations
SENDERS = {"system": "system", "sys": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant"}


def normalized_role(role: Column) -> Column:
    """system, user or assistant; null for an unknown sender."""
    low, out = F.lower(F.trim(role)), F.lit(None).cast("string")
    for name in ("system", "user", "assistant"):
        out = F.when(low.isin(*(k for k, v in SENDERS.items() if v == name)), name).otherwise(out)
    return out


def adapt_instruction(df: DataFrame) -> DataFrame:
    """``(record_id, user, assistant)`` of instruction records; those without instruction or output are dropped."""
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    rows = df.select("record_id", text("instruction").alias("i"), text("input").alias("g"), text("output").alias("assistant")).where("i <> '' and assistant <> ''")
    return rows.select("record_id", F.when(F.col("g") != "", F.concat("i", F.lit("\n\nInput:\n"), "g")).otherwise(F.col("i")).alias("user"), "assistant")


def adapt_shared(df: DataFrame, column: str = "conversations") -> DataFrame:
    """Rows with ``messages`` and ``system_prompt`` from an array of ``(from, value)``: blank and unknown senders dropped, the last system value kept apart."""
    turns = F.filter(
        F.transform(column, lambda t: F.struct(normalized_role(t["from"]).alias("role"), strip(t["value"]).alias("content"))),
        lambda m: m["role"].isNotNull() & (F.coalesce(m["content"], F.lit("")) != ""),
    )
    system = F.filter(turns, lambda m: m["role"] == "system")
    return df.withColumn("messages", F.filter(turns, lambda m: m["role"] != "system")).withColumn("system_prompt", F.try_element_at(system, F.lit(-1))["content"]).where(F.size("messages") > 0)


def adapt_prompt_response(df: DataFrame) -> DataFrame:
    """Rows with ``messages`` from prompt and response, else from a message list (role defaults to user, blank contents dropped)."""
    pair = F.array(F.struct(F.lit("user").alias("role"), strip(F.col("prompt")).alias("content")), F.struct(F.lit("assistant").alias("role"), strip(F.col("response")).alias("content")))
    listed = F.filter(F.transform("messages", lambda m: F.struct(F.lower(strip(F.coalesce(m["role"], F.lit("user")))).alias("role"), strip(m["content"]).alias("content"))), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    whole = (F.coalesce(strip(F.col("prompt")), F.lit("")) != "") & (F.coalesce(strip(F.col("response")), F.lit("")) != "")
    return df.withColumn("messages", F.when(whole, pair).otherwise(listed)).where(F.size("messages") > 0)


def conversations(turns: DataFrame, first: int | None = None) -> DataFrame:
    """``(conv_id, messages)`` of ``(conv_id, turn, role, content)``: ordered by turn, repeated deliveries once, unknown roles and blank contents dropped.

    With ``first`` only so many turns of each conversation are gathered; the rank
    filter acts before the shuffle as well, however long a conversation is.
    """
    rows = turns.select("conv_id", "turn", normalized_role(F.col("role")).alias("role"), strip(F.col("content")).alias("content")).where("conv_id is not null and turn is not null and role is not null and content <> ''")
    if first is not None:
        rows = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("_rank") <= first).drop("_rank")
    rows = rows.dropDuplicates(["conv_id", "turn"])
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def render_chatml(messages: Column, system_prompt: Column | None = None) -> Column:
    block = lambda role, content: F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))
    head = block(F.lit("system"), F.coalesce(system_prompt, F.lit(DEFAULT_SYSTEM)) if system_prompt is not None else F.lit(DEFAULT_SYSTEM))
    return F.concat(head, F.array_join(F.transform(messages, lambda m: block(m["role"], m["content"])), ""))


def turns_within(length: int) -> int:
    """No more turns than this begin within ``length`` ids: each takes two marks, a role, a line feed and some content."""
    return length // (min(map(len, SENDERS.values())) + 4) + 1


def tokenize_and_mask(df: DataFrame, system_prompt: Column, length: int, *, messages: str = "messages") -> DataFrame:
    """``df`` with x and y of ``length`` ids in place of its messages.

    Labels are the assistant's content and its end mark, everything else is
    ignored.  Ids are code points, the character-level vocabulary.  Messages are
    encoded batch by batch until ``length`` ids are there.  A null prompt or null
    messages give null x and y; a null role or content is empty.
    """
    rest = [c for c in df.columns if c not in (messages, "x", "y")]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "x array<int>", "y array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(rest)
            systems, roles, contents = (batch.column(n + k).to_pylist() for k in range(3))
            x, y = np.full((len(batch), length), PAD, np.int32), np.full((len(batch), length), IGNORE, np.int32)
            for i, (system, who, what) in enumerate(zip(systems, roles, contents)):
                if system is None or who is None:
                    continue
                at = 0
                for role, content in zip(("system", *who), (system, *what)):
                    if at >= length:
                        break
                    head, text = len(role or "") + 2, f"{role or ''}\n{content or ''}"
                    ids = np.frombuffer(text.encode("utf-32-le"), np.int32)
                    block = np.concatenate([[IM_START], ids, [IM_END]])[: length - at]
                    x[i, at : at + len(block)] = block
                    if role == "assistant":
                        y[i, at + head : at + len(block)] = block[head:]
                    at += len(block)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * length, mask=np.array([*(s is None or w is None for s, w in zip(systems, roles)), False]))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (x, y)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *lists], names=[*rest, "x", "y"])

    field = lambda name: F.transform(messages, lambda m: m[name])
    return spread(df.select(*(F.col(f"`{c}`") for c in rest), system_prompt.alias("_system"), field("role").alias("_roles"), field("content").alias("_contents"))).mapInArrow(run, schema)


def last_turns(turns: DataFrame, n: int = 5, chars: int = 300) -> DataFrame:
    """``(conv_id, memory)``: the last ``n`` turns of each conversation as lines, contents cut to ``chars`` characters.

    The rank filter is applied before the shuffle as well, so each task passes on
    at most ``n`` turns of a conversation however long it is.
    """
    rows = turns.select("conv_id", "turn", normalized_role(F.col("role")).alias("role"), F.substring(strip(F.col("content")), 1, chars).alias("content")).where("conv_id is not null and role is not null and content <> ''")
    ranked = rows.dropDuplicates(["conv_id", "turn"]).withColumn("_rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_rn") <= n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return ranked.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("memory"))


def conversation_statistics(turns: DataFrame, length: int = 1024) -> DataFrame:
    """One row: conversations, turns, average turns and characters per conversation, and the padded token total."""
    n = F.coalesce(F.length("content"), F.lit(0))
    once = turns.select("conv_id", "turn", normalized_role(F.col("role")).alias("role"), n.alias("n")).dropDuplicates(["conv_id", "turn"])  # lengths, not texts, are shuffled
    of = lambda who: F.sum(F.when(F.col("role") == who, F.col("n")).otherwise(0))
    per = once.agg(F.countDistinct("conv_id").alias("c"), F.count("*").alias("t"), of("user").alias("u"), of("assistant").alias("a"))
    avg = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.greatest("c", F.lit(1)), 2)
    return per.select(F.col("c").alias("total_conversations"), F.col("t").alias("total_turns"), avg("t").alias("avg_turns_per_conv"), avg("u").alias("avg_user_length"), avg("a").alias("avg_assistant_length"), (F.col("c") * length).alias("total_tokens"))
