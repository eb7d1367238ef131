"""Queries of the instruction and conversation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import conversation as C
from textloom.operators import validate, windows
from textloom.plans.registry import query
from textloom.session import materialize

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


ROLE = "CASE WHEN lower(trim(role)) IN ('system', 'sys') THEN 'system' WHEN lower(trim(role)) IN ('human', 'user') THEN 'user' WHEN lower(trim(role)) IN ('gpt', 'assistant', 'bot') THEN 'assistant' END"
TURNS = f"SELECT DISTINCT conv_id, turn, {ROLE} AS role, {_strip('content')} AS content FROM chat_messages WHERE content IS NOT NULL AND {_strip('content')} <> ''"


def chat(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/chat_messages.parquet")


def _once(spark: SparkSession, sf: str) -> DataFrame:
    return chat(spark, sf).select("conv_id", "turn", "role", "content").dropDuplicates(["conv_id", "turn"])


@query(
    f"""WITH t AS (SELECT DISTINCT conv_id, turn, lower({_strip('role')}) AS role, {_strip('content')} AS content FROM chat_messages),
    e AS (SELECT conv_id, count(*) FILTER (WHERE coalesce(role NOT IN ('system', 'user', 'assistant'), true)) + count(*) FILTER (WHERE coalesce(content, '') = '') AS n,
      coalesce(bool_or(role = 'assistant'), false) AS a FROM t GROUP BY conv_id)
    SELECT conv_id, CAST(n + CASE WHEN a THEN 0 ELSE 1 END AS INTEGER) AS n_errors, n = 0 AND a AS is_valid FROM e"""
)
def v10_conversation_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validate.conversation_errors(_once(spark, sf)).select("conv_id", "n_errors", "is_valid")


@query(
    f"""WITH r AS (SELECT DISTINCT record_id, coalesce({_strip('instruction')}, '') AS i, coalesce({_strip('input')}, '') AS g, coalesce({_strip('output')}, '') AS o FROM instruction_records)
    SELECT record_id, CASE WHEN g <> '' THEN i || chr(10) || chr(10) || 'Input:' || chr(10) || g ELSE i END AS "user", o AS assistant FROM r WHERE i <> '' AND o <> ''"""
)
def i1_adapt_instruction(spark: SparkSession, sf: str) -> DataFrame:
    return C.adapt_instruction(spark.read.parquet(f"{sf}/instruction_records.parquet")).distinct()


@query(
    f"""WITH t AS ({TURNS}), m AS (SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS n, max(turn) FILTER (WHERE role = 'system') AS s, string_agg(role || ':' || length(content), ' ' ORDER BY turn) FILTER (WHERE role <> 'system') AS shape FROM t WHERE role IS NOT NULL GROUP BY conv_id)
    SELECT m.conv_id, CAST(n AS INTEGER) AS n_messages, t.content AS system_prompt, shape FROM m LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.s AND t.role = 'system' WHERE n > 0"""
)
def i2_adapt_shared(spark: SparkSession, sf: str) -> DataFrame:
    shared = _once(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("content").alias("value")))).alias("conversations"))
    out = C.adapt_shared(shared)
    shape = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), " ")
    return out.select("conv_id", F.size("messages").alias("n_messages"), "system_prompt", shape.alias("shape"))


@query(
    f"""WITH r AS (SELECT DISTINCT record_id, {_strip('instruction')} AS p, {_strip('output')} AS o FROM instruction_records)
    SELECT record_id, CAST(CASE WHEN coalesce(p, '') <> '' AND coalesce(o, '') <> '' THEN 2 ELSE 1 END AS INTEGER) AS n_messages,
    CASE WHEN coalesce(p, '') <> '' AND coalesce(o, '') <> '' THEN o ELSE p END AS last_content FROM r WHERE coalesce(p, '') <> ''"""
)
def i3_adapt_prompt_response(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/instruction_records.parquet").select("record_id", F.col("instruction").alias("prompt"), F.col("output").alias("response")).dropDuplicates(["record_id"])
    rows = rows.withColumn("messages", F.array(F.struct(F.lit(None).cast("string").alias("role"), F.col("prompt").alias("content"))))
    return C.adapt_prompt_response(rows).select("record_id", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last_content"))


@query(
    f"""WITH t AS ({TURNS}) SELECT conv_id, '<|im_start|>system' || chr(10) || '{C.DEFAULT_SYSTEM}' || '<|im_end|>' || chr(10) || string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt
    FROM t WHERE role IS NOT NULL GROUP BY conv_id"""
)
def i5_render_chatml(spark: SparkSession, sf: str) -> DataFrame:
    return C.conversations(chat(spark, sf)).select("conv_id", C.render_chatml(F.col("messages")).alias("prompt"))


_P = "list_transform(list_filter(string_split({}, ''), lambda c: c <> ''), lambda c: unicode(c))"
_MASKED = f"""WITH t AS ({TURNS}), p AS (
      SELECT conv_id, CAST(-1 AS BIGINT) AS turn, [50257] || {_P.format("'system' || chr(10) || 'S'")} || [50258] AS x, list_transform(range(10), lambda i: -100) AS y FROM t WHERE role IS NOT NULL GROUP BY conv_id
      UNION ALL SELECT conv_id, turn, [50257] || {_P.format("role || chr(10)")} || {_P.format("content")} || [50258],
        list_transform(range(length(role) + 2), lambda i: -100) || CASE WHEN role = 'assistant' THEN {_P.format("content")} || [50258] ELSE list_transform(range(length(content) + 1), lambda i: -100) END FROM t WHERE role IS NOT NULL),
    f AS (SELECT conv_id, flatten(list(x ORDER BY turn)) AS x, flatten(list(y ORDER BY turn)) AS y FROM p GROUP BY conv_id),
    z AS (SELECT conv_id, (x || list_transform(range(512), lambda i: 50259))[1:512] AS x, (y || list_transform(range(512), lambda i: -100))[1:512] AS y FROM f)"""


@query(f"{_MASKED} SELECT conv_id, array_to_string(x, ',') AS x, array_to_string(y, ',') AS y FROM z")
def i6_tokenize_and_mask(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda v: F.array_join(F.transform(v, lambda i: i.cast("string")), ",").alias(v)
    return C.tokenize_and_mask(C.conversations(chat(spark, sf), C.turns_within(512)), F.lit("S"), 512).select("conv_id", text("x"), text("y"))


@query(
    f"""WITH t AS (SELECT DISTINCT conv_id, turn, {ROLE} AS role, content FROM chat_messages)
    SELECT count(DISTINCT conv_id) AS total_conversations, count(*) AS total_turns, round(count(*)::DOUBLE / count(DISTINCT conv_id), 2) AS avg_turns_per_conv,
    round(sum(CASE WHEN role = 'user' THEN coalesce(length(content), 0) ELSE 0 END)::DOUBLE / count(DISTINCT conv_id), 2) AS avg_user_length,
    round(sum(CASE WHEN role = 'assistant' THEN coalesce(length(content), 0) ELSE 0 END)::DOUBLE / count(DISTINCT conv_id), 2) AS avg_assistant_length,
    count(DISTINCT conv_id) * 1024 AS total_tokens FROM t"""
)
def i8_conversation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return C.conversation_statistics(chat(spark, sf))


@query(
    f"""{_MASKED}, c AS (SELECT flatten(list(x ORDER BY conv_id)) AS x, flatten(list(y ORDER BY conv_id)) AS y FROM z)
    SELECT k AS "window", md5(array_to_string(x[k * 768 + 1:k * 768 + 768], ',')) AS x, md5(array_to_string(y[k * 768 + 1:k * 768 + 768], ',')) AS y FROM (SELECT x, y, unnest(range(len(x) // 768)) AS k FROM c)"""
)
def i9_pack_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(C.tokenize_and_mask(C.conversations(chat(spark, sf), C.turns_within(512)), F.lit("S"), 512), "masked")
    text = lambda v: F.md5(F.array_join(F.transform(v, lambda i: i.cast("string")), ","))
    parts = [windows.packed_windows(rows, "conv_id", c, length=768, overlap=0).select("window", text("ids").alias(c)) for c in ("x", "y")]
    return parts[0].join(parts[1], "window")


@query("WITH r AS (SELECT DISTINCT record_id FROM instruction_records) SELECT record_id, CASE WHEN row_number() OVER (ORDER BY record_id) <= greatest(1, floor((SELECT count(*) FROM r) * 0.9)) THEN 'train' ELSE 'val' END AS split FROM r")
def i10_ordered_split(spark: SparkSession, sf: str) -> DataFrame:
    return windows.ordered_split(spark.read.parquet(f"{sf}/instruction_records.parquet").select("record_id").distinct(), "record_id", 0.9)


@query(f"WITH t AS ({TURNS}) SELECT conv_id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM t WHERE role IS NOT NULL) WHERE rn = 1")
def w12_last_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The last turn of each conversation, by aggregation: no window over a huge conversation."""
    rows = chat(spark, sf).select("conv_id", "turn", C.normalized_role(F.col("role")).alias("role"), C.strip(F.col("content")).alias("content")).where("role is not null and content <> ''")
    return rows.groupBy("conv_id").agg(F.max_by(F.struct("role", "content"), "turn").alias("m")).select("conv_id", "m.role", "m.content")


@query(
    f"""WITH t AS ({TURNS}), w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM t WHERE role IS NOT NULL)
    SELECT conv_id, string_agg(role || ': ' || substr(content, 1, 300), chr(10) ORDER BY turn) AS memory FROM w WHERE rn <= 5 GROUP BY conv_id"""
)
def w12_working_memory(spark: SparkSession, sf: str) -> DataFrame:
    """The last five turns as a prompt, contents cut to 300 characters."""
    return C.last_turns(chat(spark, sf))


@query(
    """WITH m AS (SELECT DISTINCT conv_id, turn, content FROM chat_messages)
    SELECT conv_id, turn, CASE WHEN contains(content, 'ModuleNotFoundError') OR contains(content, 'ImportError') THEN 'import' WHEN contains(content, 'SyntaxError') OR contains(content, 'IndentationError') THEN 'syntax'
    WHEN contains(content, 'assert') THEN 'assertion' WHEN contains(content, 'fails') THEN 'file' WHEN contains(content, 'late') THEN 'timeout' ELSE 'other' END AS diagnosis FROM m WHERE content IS NOT NULL"""
)
def g3_diagnose(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered substring rules, first match wins."""
    rules = [(("ModuleNotFoundError", "ImportError"), "import"), (("SyntaxError", "IndentationError"), "syntax"), (("assert",), "assertion"), (("fails",), "file"), (("late",), "timeout")]
    out = F.lit("other")
    for needles, name in reversed(rules):
        hit = F.contains("content", F.lit(needles[0]))
        for n in needles[1:]:
            hit = hit | F.contains("content", F.lit(n))
        out = F.when(hit, name).otherwise(out)
    return _once(spark, sf).where("content is not null").select("conv_id", "turn", out.alias("diagnosis"))
