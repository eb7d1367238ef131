"""Record validation: one verdict per record, and table-level summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip, unprintable_ratio

ROLES = ("system", "user", "assistant")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, sha256, first_key, is_duplicate)``: the smallest key of each text is its first occurrence.

    The first occurrence is found by an aggregation over digests (combined
    map-side, so a text that fills a third of the table is no hot spot) and
    joined back on the digest.
    """
    rows = df.select(F.col(key).alias("key"), F.sha2(F.col(text), 256).alias("sha256")).where("sha256 is not null")
    first = rows.groupBy("sha256").agg(F.min("key").alias("first_key"))
    return rows.join(first, "sha256").select("key", "sha256", "first_key", (F.col("key") != F.col("first_key")).alias("is_duplicate"))


def verdicts(df: DataFrame, key: str, text: str, *, min_chars: int = 10, max_unprintable: float = 0.1) -> DataFrame:
    """``(key, n_bytes, n_chars, unprintable, verdict)`` with the first rule a record fails, or ``valid``.

    The order is missing, empty, too short, unprintable; a duplicate stays valid.
    """
    t = F.col(text)
    ratio = unprintable_ratio(t)
    verdict = F.when(t.isNull(), "missing").when(F.octet_length(t) == 0, "empty").when(F.length(t) < min_chars, "short").when(ratio > max_unprintable, "unprintable").otherwise("valid")
    return df.select(F.col(key).alias("key"), F.octet_length(t).alias("n_bytes"), F.length(t).alias("n_chars"), ratio.alias("unprintable"), verdict.alias("verdict"))


def utf8_verdict(df: DataFrame, key: str, content: str) -> DataFrame:
    """Whether a binary column decodes as UTF-8."""
    return df.select(F.col(key).alias("key"), F.coalesce(F.is_valid_utf8(F.col(content).cast("string")), F.lit(False)).alias("valid_utf8"))


def absent_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Requested keys that do not exist."""
    return wanted.join(present.select(key), key, "left_anti")


def conversation_errors(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_errors, errors, is_valid)`` of ``(conv_id, turn, role, content)``.

    Errors are listed in turn order; each turn may have a bad role and empty
    content, and a conversation without an assistant turn has one more.
    """
    role = F.lower(strip(F.col("role")))
    bad_role = F.when(~F.coalesce(role.isin(*ROLES), F.lit(False)), F.concat(F.lit("turn "), F.col("turn"), F.lit(": role")))
    no_content = F.when(F.coalesce(F.length(strip(F.col("content"))), F.lit(0)) == 0, F.concat(F.lit("turn "), F.col("turn"), F.lit(": empty")))
    found = F.filter(F.array(bad_role, no_content), lambda e: e.isNotNull())
    per = turns.select("conv_id", "turn", found.alias("found"), (role == "assistant").alias("answers"))
    # only turns with errors are gathered, so a huge sound conversation gathers nothing
    grouped = per.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.size("found") > 0, F.struct("turn", "found")))), lambda s: s["found"]).alias("lists"),
        F.coalesce(F.bool_or("answers"), F.lit(False)).alias("answered"),
    )
    errors = F.concat(F.flatten("lists"), F.when(~F.col("answered"), F.array(F.lit("no assistant turn"))).otherwise(F.array().cast("array<string>")))
    return grouped.select("conv_id", errors.alias("errors")).select("conv_id", F.size("errors").alias("n_errors"), "errors", (F.size("errors") == 0).alias("is_valid"))


def token_bounds(ids: DataFrame, column: str, vocab_size: int) -> DataFrame:
    """One row: ids below 0, ids at or above the vocabulary size, nulls, and whether all are in bounds."""
    v = F.col(column)
    return ids.agg(F.count_if(v < 0).alias("negative"), F.count_if(v >= vocab_size).alias("too_large"), F.count_if(v.isNull()).alias("missing")).withColumn(
        "ok", (F.col("negative") == 0) & (F.col("too_large") == 0) & (F.col("missing") == 0)
    )


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
