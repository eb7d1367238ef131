"""Queries of the training-data operators, each over its whole tables with its production parameters.

``oracles.ORACLES`` holds the SQL of those whose results SQL can state.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.chunking import oversized_items, split_oversized
from textloom.llm.language import LanguageModel, fit_language_model
from textloom.llm.leakage import leaked_items
from textloom.llm.oracles import ORACLES
from textloom.llm.mixing import mix_to_weights, mixture_shares
from textloom.llm.near_duplicates import group_pairs, near_duplicate_groups
from textloom.llm.packing import pack_documents
from textloom.llm.pair_defects import broken_pairs
from textloom.llm.shared_spans import shared_spans
from textloom.llm.split_overlap import split_overlaps
from textloom.llm.token_budget import chat_budget, document_budget, knowledge_budget, token_budget
from textloom.llm.tokens import tokenizer_from_tables, with_token_counts
from textloom.session import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{name}.parquet") for name in names]


def _tokenizer(spark: SparkSession, sf: str):
    return tokenizer_from_tables(*_read(spark, sf, "tokenizer_vocab", "tokenizer_merges"))


def _languages(spark: SparkSession, sf: str) -> LanguageModel:
    return fit_language_model(_read(spark, sf, "documents")[0], "doc_id", "text", "lang")


def _groups(spark: SparkSession, sf: str) -> list[DataFrame]:
    knowledge, records = _read(spark, sf, "knowledge_documents", "instruction_records")
    same = {"threshold": 0.5, "min_words": 30, "shingle_words": 3}
    # the two tables have nothing to do with each other: their stages run side by side
    with ThreadPoolExecutor(2) as pool:
        parts = [pool.submit(near_duplicate_groups, knowledge, "doc_id", "content", **same), pool.submit(near_duplicate_groups, records, "record_id", "output", **same)]
        return [p.result() for p in parts]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (group_pairs(g) for g in _groups(spark, sf))
    return a.union(b)


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every record, named by its smallest record, and the number of different texts similar to it."""
    out = None
    for corpus, g in zip(("knowledge_documents", "instruction_records"), _groups(spark, sf)):
        g = materialize(g, "groups")
        named = g.groupBy("group_id").agg(F.min("id").alias("name"))
        part = g.join(named, "group_id").select(F.lit(corpus).alias("corpus"), "id", F.col("name").alias("group_id"), "links")
        out = part if out is None else out.union(part)
    return out


def _document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents")[0].select("doc_id", "domain", "text")
    return materialize(with_token_counts(documents, "text", _tokenizer(spark, sf)), "tokens")


def p2_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix_to_weights(_document_tokens(spark, sf), _read(spark, sf, "pretraining_configs")[0])


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    docs, configs = _document_tokens(spark, sf), _read(spark, sf, "pretraining_configs")[0]
    shares = mixture_shares(materialize(mix_to_weights(docs, configs), "mixture"), docs, configs)
    return shares.withColumns({c: F.round(c, 9) for c in ("target_share", "share")})


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    knowledge, settings = _read(spark, sf, "knowledge_documents", "chunk_settings")
    return split_oversized(knowledge, "doc_id", "content", "doc_type", settings)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("piece = 0 and pieces > 1").select(F.col("id").alias("doc_id"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).withColumnRenamed("id", "doc_id")


def p3_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every cut document put together again from its pieces, and pieces too long or not where the one before ends less the overlap."""
    knowledge, settings = _read(spark, sf, "knowledge_documents", "chunk_settings")
    pieces = _pieces(spark, sf)
    parts = F.array_sort(F.collect_list(F.struct("piece", "begin_char", "end_char", "content")))
    one = pieces.groupBy(F.col("id").alias("doc_id")).agg(parts.alias("p"))
    limits = oversized_items(knowledge, "doc_id", "content", "doc_type", settings).select(F.col("id").alias("doc_id"), F.col("size"), "overlap").distinct()
    upto = lambda i: F.get("p", i)["end_char"]
    fresh = F.transform("p", lambda x, i: F.when(i == 0, x["content"]).otherwise(F.substr(x["content"], (upto(i - 1) - x["begin_char"] + 1).cast("int"))))
    text = F.array_join(fresh, "")
    wrong = lambda x, i: (i > 0) & (upto(i - 1) - x["begin_char"] != F.col("overlap"))
    return one.join(limits, "doc_id").select(
        "doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"), "overlap",
        F.size(F.filter("p", lambda x: F.length(x["content"]) > F.col("size"))).cast("bigint").alias("oversized"), F.size(F.filter("p", wrong)).cast("bigint").alias("misplaced"),
    )


def p4_corpora(spark: SparkSession, sf: str) -> DataFrame:
    documents, knowledge = _read(spark, sf, "documents", "knowledge_documents")
    tokenizer, none = _tokenizer(spark, sf), F.lit(None).cast("string")
    sums = ("records", "usable", "tokens", "unknown_tokens")
    a = document_budget(documents, tokenizer).select(F.lit("documents").alias("corpus"), "source", "lang", "domain", none.alias("doc_type"), *sums)
    return a.union(knowledge_budget(knowledge, tokenizer).select(F.lit("knowledge_documents").alias("corpus"), none.alias("source"), "lang", none.alias("domain"), "doc_type", *sums))


def p4_batches(spark: SparkSession, sf: str) -> DataFrame:
    return chat_budget(*_read(spark, sf, "chat_messages", "conversation_statistics"), _tokenizer(spark, sf), None)


def p4_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return token_budget(*_read(spark, sf, "documents", "knowledge_documents", "chat_messages", "conversation_statistics"), _tokenizer(spark, sf), _languages(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return broken_pairs(*_read(spark, sf, "instruction_records", "chat_messages"), _languages(spark, sf))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return split_overlaps(*_read(spark, sf, "split_samples", "dataset_configs"), threshold=0.6, min_words=20, shingle_words=3)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).select(F.least("sample_train", "sample_eval").alias("sample_a"), F.greatest("sample_train", "sample_eval").alias("sample_b")).distinct()


def p6_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source of the evaluation side: overlapping pairs, samples of both sides in them, and their mean similarity."""
    counts = F.count("*").alias("pairs"), F.countDistinct("sample_eval").alias("samples"), F.countDistinct("sample_train").alias("training_samples"), F.round(F.avg("similarity"), 4).alias("mean_similarity")
    return _overlaps(spark, sf).groupBy("dataset_eval", "side", "source_eval").agg(*counts)


def p6_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation sample met: its pairs, and how much of it the alignment with the best of them covers."""
    return _overlaps(spark, sf).groupBy("dataset_eval", "side", "source_eval", "sample_eval").agg(F.count("*").alias("pairs"), F.round(F.max("coverage_eval"), 4).alias("coverage"), F.max("chained_seeds").alias("chained_seeds"))


def p7_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_document_tokens(spark, sf).select("doc_id", "n_tokens"), _read(spark, sf, "pretraining_configs")[0])


def p7_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per experiment: what was packed, sequences over capacity or with a wrong figure of unused room, and whether first-fit's bound of sequences holds."""
    configs = _read(spark, sf, "pretraining_configs")[0]
    packed = materialize(p7_sequences(spark, sf), "packed")
    lengths = configs.select("experiment_id", F.col("max_sequence_length").cast("bigint").alias("capacity"))
    filled = packed.groupBy("experiment_id", "sequence_id").agg(F.sum("tokens").alias("used"), F.max("unused").alias("unused")).where("sequence_id is not null").join(lengths, "experiment_id")
    bad = filled.groupBy("experiment_id").agg(
        F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), F.count_if(F.col("used") + F.col("unused") != F.col("capacity")).alias("wrong_unused"),
        (F.count("*") <= F.sum("used") * 1.7 / F.max("capacity") + 1).alias("as_few_as_first_fit"),
    )
    documents = packed.groupBy("experiment_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens"))
    whole = documents.groupBy("experiment_id").agg(F.count("*").alias("documents"), F.count_if(F.col("parts") > 1).alias("cut"), F.sum("parts").alias("parts"), F.sum("tokens").alias("tokens"))
    return whole.join(bad, "experiment_id").select("experiment_id", "documents", F.col("cut").alias("cut_documents"), "parts", "tokens", "overfull", "wrong_unused", "as_few_as_first_fit")


def _leaks(spark: SparkSession, sf: str, **how) -> DataFrame:
    documents, items = _read(spark, sf, "documents", "benchmark_problems")
    return leaked_items(documents, "doc_id", "text", items, "task_id", ["prompt", "canonical_solution", "test_cases"], **how)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select(F.col("id").alias("doc_id"), "task_id")


def p8_by_task(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).groupBy("task_id").agg(F.count("*").alias("documents"), F.sum("windows").alias("windows"))


def p8_altered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a passage of 24 words that holds seven tenths of the shingles of an item's passage, by weight."""
    return _leaks(spark, sf, window=24, threshold=0.7).select(F.col("id").alias("doc_id"), "task_id", "windows", "similarity")


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans(_read(spark, sf, "documents")[0], "doc_id", "text", length=300)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select(F.col("id").alias("doc_id"))


def p9_shared(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select(F.col("id").alias("doc_id"), "n_chars", F.size("spans").alias("spans"), "shared_chars")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_groups, p2_mixture, p2_shares, p3_found, p3_pieces, p3_rebuilt, p4_token_budget, p4_corpora, p4_batches, p5_found, p6_found, p6_by_split, p6_coverage, p7_sequences, p7_totals, p8_found, p8_by_task, p8_altered, p9_found, p9_shared)}
