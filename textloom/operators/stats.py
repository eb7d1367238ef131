"""Corpus, token and vocabulary statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import spread

SPECIALS = 4  # ids 0 to 3: padding, unknown, begin, end


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """``(ch, n)``; code points are counted per task, so only distinct characters are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for code in _code_points(batch.column(0)):
                total += np.bincount(code, minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(map(chr, at.tolist()), pa.string()), pa.array(total[at])], names=["ch", "n"])

    own = spread(df.select(F.col(text).alias("t")).where("t <> ''"))
    return own.mapInArrow(run, "ch string, n bigint").groupBy("ch").agg(F.sum("n").alias("n"))


def _code_points(texts: pa.Array, limit: int = 1 << 22) -> Iterator[np.ndarray]:
    """Code points of the texts, joined to parts of about ``limit``."""
    held, size = [], 0
    for t in texts.to_pylist():
        held.append(t)
        size += len(t)
        if size >= limit:
            yield np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
            held, size = [], 0
    if size:
        yield np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)


def adjacent_characters(df: DataFrame, text: str) -> DataFrame:
    """``(left, right, n)`` of overlapping neighbours among the characters of each text, counted per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            # a character that is none stands between texts
            code = np.frombuffer("\x00".join(["", *batch.column(0).to_pylist(), ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
            length = np.array([0, *map(len, batch.column(0).to_pylist()), 0])
            edge = np.zeros(len(code), bool)
            edge[np.cumsum(length + 1)[:-1] - 1] = True
            inner = ~(edge[:-1] | edge[1:])
            found = np.nonzero(np.bincount(code, minlength=0x110000))[0]
            if len(found) <= 2_048:
                table = np.zeros(0x110000, np.int64)
                table[found] = np.arange(len(found))
                count = np.bincount((table[code[:-1]] * len(found) + table[code[1:]])[inner], minlength=len(found) ** 2)
                at = np.nonzero(count)[0]
                pair, n = found[at // len(found)] << 21 | found[at % len(found)], count[at]
            else:
                pair, n = np.unique((code[:-1] << 21 | code[1:])[inner], return_counts=True)
            for p, k in zip(pair.tolist(), n.tolist()):
                total[p] = total.get(p, 0) + k
        pairs = list(total)
        yield pa.RecordBatch.from_arrays([pa.array((chr(p >> 21) for p in pairs), pa.string()), pa.array((chr(p & 0x1FFFFF) for p in pairs), pa.string()), pa.array(list(total.values()), pa.int64())], names=["left", "right", "n"])

    own = spread(df.select(F.col(text).alias("t")).where("length(t) > 1"))
    return own.mapInArrow(run, "left string, right string, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))


_SUMS = ("chars", "lines", "words", "bytes", "word_chars")


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    """One row of corpus statistics; line length counts the breaks, the entropy is of characters in bits.

    The texts are read once: every task yields the counts of its characters and
    one row of sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros(0x110000, np.int64), np.zeros(len(_SUMS), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = t.split()
                sums += (len(t), len(t.splitlines()), len(found), len(t.encode()), sum(map(len, found)))
            for code in _code_points(batch.column(0)):
                total += np.bincount(code, minlength=len(total))
        at = np.nonzero(total)[0]
        none = [None] * len(at)
        columns = [pa.array([*map(chr, at.tolist()), None], pa.string()), pa.array([*total[at].tolist(), None], pa.int64()), *(pa.array([*none, int(v)], pa.int64()) for v in sums)]
        yield pa.RecordBatch.from_arrays(columns, names=["ch", "n", *_SUMS])

    own = spread(df.select(F.col(text).alias("t")).where("t is not null"))
    counts = own.mapInArrow(run, ", ".join(["ch string", "n bigint", *(f"{c} bigint" for c in _SUMS)])).groupBy("ch").agg(*(F.sum(c).alias(c) for c in ("n", *_SUMS)))
    whole = counts.agg(F.count("ch").alias("unique_chars"), F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS))
    entropy = F.when(F.col("m") > 0, F.log2("m") - F.col("nlogn") / F.col("m")).otherwise(0.0)
    return whole.select(
        "chars", "lines", "words", "bytes", "unique_chars",
        F.round(F.col("chars") / F.greatest("lines", F.lit(1)), 4).alias("avg_line_length"),
        F.round(F.col("word_chars") / F.greatest("words", F.lit(1)), 4).alias("avg_word_length"),
        F.round(entropy, 4).alias("entropy"),
    )


def character_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``(ch, n, token_id)`` by falling count, then character; ids begin after the specials.

    The ranking window is over distinct characters, of which there are at most 0x110000.
    """
    order = Window.orderBy(F.desc("n"), "ch")
    return character_counts(df, text).withColumn("token_id", F.row_number().over(order) + F.lit(SPECIALS - 1))


def token_stats(ids: DataFrame, column: str, vocab_size: int) -> DataFrame:
    return ids.agg(
        F.count(column).alias("total"), F.countDistinct(column).alias("unique"), F.min(column).alias("lowest"), F.max(column).alias("highest")
    ).withColumn("utilization", F.round(F.col("unique") * 100.0 / vocab_size, 4))


def vocabulary_report(ids: DataFrame, column: str, vocab_size: int, unknown_id: int = 1) -> DataFrame:
    """Out-of-vocabulary and unknown counts, coverage, and a warning above 5 % unknown."""
    v = F.col(column)
    counted = ids.agg(F.count("*").alias("total"), F.count_if((v < 0) | (v >= vocab_size)).alias("out_of_range"), F.count_if(v == unknown_id).alias("unknown"), F.countDistinct(F.when((v >= 0) & (v < vocab_size), v)).alias("used"))
    return counted.select("*", F.round(F.col("used") / F.lit(vocab_size), 4).alias("coverage"), (F.col("unknown") > 0.05 * F.col("total")).alias("warn_unknown"))


def adjacent_pairs(df: DataFrame, tokens: str) -> DataFrame:
    """``(left, right, n)`` of overlapping neighbours of a token array column."""
    t = F.col(tokens)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return df.where(F.size(t) > 1).select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of ties the largest."""
    return pairs.agg(F.max(F.struct("n", "left", "right")).alias("m")).select("m.left", "m.right", "m.n")
