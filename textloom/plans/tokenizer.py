"""Queries of the tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import tokenizer as K
from textloom.plans.registry import query

CHARS = "list_filter(string_split(text, ''), lambda c: c <> '')"
#: (doc_id, v): ids of every document under the single-character tokens of the vocabulary
IDS = f"""vm AS (SELECT map_from_entries(list(row(token, token_id))) AS m FROM tokenizer_vocab WHERE length(token) = 1),
    ids AS (SELECT doc_id, text, list_transform({CHARS}, lambda c: coalesce(m[c], 1)) AS v FROM documents, vm WHERE text IS NOT NULL)"""


_LETTERS = r"[\p{L}\p{Nl}\p{No}]"
#: (doc_id, text, n, u): tokens and unknown tokens of every document; merged tokens begin with a letter or one blank and go on with letters,
#: so nothing is joined across the runs of letters, and merges are applied one by one to each distinct run
MERGED = f"""tx AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
    px AS (SELECT doc_id, unnest(regexp_extract_all(text, ' ?{_LETTERS}+')) AS piece FROM tx),
    bpe AS (SELECT piece, string_split(piece, '') AS toks, 0 AS step FROM (SELECT DISTINCT piece FROM px)
        UNION ALL
        SELECT piece, list_slice(toks, 1, j - 1) || [toks[j] || toks[j + 1]] || list_slice(toks, j + 2, len(toks)), step + 1 FROM (
            SELECT piece, any_value(toks) AS toks, any_value(step) AS step, arg_min(j, merge_rank * 1000000 + j) AS j
            FROM (SELECT piece, toks, step, unnest(range(1, len(toks))) AS j FROM bpe) JOIN tokenizer_merges ON left_token = toks[j] AND right_token = toks[j + 1]
            GROUP BY piece)),
    known AS (SELECT list(token) AS v FROM tokenizer_vocab WHERE token_id <> 1),
    enc AS (SELECT piece, len(toks) AS n, len(list_filter(toks, lambda t: NOT list_contains(v, t))) AS u FROM (SELECT piece, arg_max(toks, step) AS toks FROM bpe GROUP BY piece), known),
    inside AS (SELECT doc_id, sum(n) AS n, sum(u) AS u, sum(length(piece)) AS k FROM px JOIN enc USING (piece) GROUP BY doc_id),
    enc_docs AS (SELECT doc_id, text, CAST(length(text) - coalesce(k, 0) + coalesce(n, 0) AS INTEGER) AS n,
        CAST(coalesce(u, 0) + len(list_filter(string_split(regexp_replace(text, ' ?{_LETTERS}+', '', 'g'), ''), lambda t: t <> '' AND NOT list_contains(v, t))) AS INTEGER) AS u
        FROM tx LEFT JOIN inside USING (doc_id), known)"""


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    vocab = K.load_vocabulary(_read(spark, sf, "tokenizer_vocab").where("length(token) = 1"))
    return K.encode_characters(_read(spark, sf, "documents").where("text is not null"), "doc_id", "text", vocab)


def _text(v) -> F.Column:
    return F.array_join(F.transform(v, lambda i: i.cast("string")), ",")


@query("SELECT coalesce(v.token_id, 1) AS token_id, count(*) AS n FROM (SELECT unnest(" + CHARS + ") AS c FROM documents) d LEFT JOIN tokenizer_vocab v ON v.token = d.c GROUP BY 1")
def j1_token_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Characters are counted first, so the lookup joins distinct characters only."""
    counts = _read(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").count()
    vocab = _read(spark, sf, "tokenizer_vocab")
    return counts.join(vocab, counts.c == vocab.token, "left").groupBy(F.coalesce("token_id", F.lit(K.UNKNOWN)).alias("token_id")).agg(F.sum("count").alias("n"))


@query("SELECT m.merge_rank, coalesce(v.token_id, 1) AS token_id, coalesce(v.token, '<unk>') AS token FROM tokenizer_merges m LEFT JOIN tokenizer_vocab v ON v.token = m.left_token || m.right_token")
def j2_merge_tokens(spark: SparkSession, sf: str) -> DataFrame:
    merges, vocab = _read(spark, sf, "tokenizer_merges"), _read(spark, sf, "tokenizer_vocab")
    joined = merges.join(vocab, F.concat("left_token", "right_token") == vocab.token, "left")
    return joined.select("merge_rank", F.coalesce("token_id", F.lit(K.UNKNOWN)).alias("token_id"), F.coalesce("token", F.lit("<unk>")).alias("token"))


@query("SELECT count(*) AS size, max(token_id) AS highest, count(*) FILTER (WHERE length(token) = 1) AS characters, (SELECT count(*) FROM tokenizer_merges) AS merges FROM tokenizer_vocab")
def a5_vocabulary_stats(spark: SparkSession, sf: str) -> DataFrame:
    merges = _read(spark, sf, "tokenizer_merges").agg(F.count("*").alias("merges"))
    return _read(spark, sf, "tokenizer_vocab").agg(F.count("*").alias("size"), F.max("token_id").alias("highest"), F.count_if(F.length("token") == 1).alias("characters")).crossJoin(merges)


@query()
def t1_train_merges(spark: SparkSession, sf: str) -> DataFrame:
    """The merges of byte-pair training over all documents to a vocabulary of 500 tokens."""
    found = K.train_to_size(_read(spark, sf, "documents"), "text", 500)
    rows = [(i, a, b, n) for i, (a, b, n) in enumerate(found)]
    return spark.createDataFrame(rows, "merge_rank int, left_token string, right_token string, n bigint")


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    vocab, ranks = K.load_vocabulary(_read(spark, sf, "tokenizer_vocab")), K.load_merges(_read(spark, sf, "tokenizer_merges"))
    return K.encode_merged(_read(spark, sf, "documents").where("text is not null"), "doc_id", "text", vocab, ranks)


@query(f"WITH RECURSIVE {MERGED} SELECT doc_id, n AS n_tokens, u AS n_unknown FROM enc_docs")
def t2_encode_merged(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("doc_id", F.size("ids").alias("n_tokens"), F.size(F.filter("ids", lambda i: i == K.UNKNOWN)).alias("n_unknown"))


@query(f"WITH RECURSIVE {MERGED} SELECT doc_id, CASE WHEN n > 0 THEN round(length(text) / n, 4) ELSE 1.0 END AS ratio FROM enc_docs")
def a24_compression(spark: SparkSession, sf: str) -> DataFrame:
    """Characters per token of every document; 1.0 for an empty one."""
    n = _read(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    size = F.size("ids")
    return _encoded(spark, sf).join(n, "doc_id").select("doc_id", F.when(size > 0, F.round(F.col("n") / size, 4)).otherwise(1.0).alias("ratio"))


@query(f"WITH {IDS} SELECT doc_id, array_to_string((([2] || v || [3])[1:128] || list_transform(range(128), lambda i: 0))[1:128], ',') AS ids FROM ids")
def t3_encode_options(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, sf).select("doc_id", _text(K.frame(F.col("ids"), special=True, max_length=128, truncate=True, pad=True)).alias("ids"))


@query(f"WITH {IDS} SELECT doc_id, array_to_string(v, ',') AS ids FROM ids")
def t4_encode_characters(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, sf).select("doc_id", _text(F.col("ids")).alias("ids"))


@query(f"WITH {IDS}, rm AS (SELECT map_from_entries(list(row(token_id, token))) AS r FROM tokenizer_vocab) SELECT doc_id, array_to_string(list_transform(v, lambda i: coalesce(r[i], '<unk>')), '') AS text FROM ids, rm")
def t5_decode(spark: SparkSession, sf: str) -> DataFrame:
    table = F.create_map(*(F.lit(x) for k, v in sorted(K.load_vocabulary(_read(spark, sf, "tokenizer_vocab")).items()) for x in (v, k)))
    return _ids(spark, sf).select("doc_id", K.decode(F.col("ids"), table).alias("text"))


@query(f"WITH {IDS}, l AS (SELECT max(len(v)) AS l FROM ids) SELECT doc_id, l AS length, md5(array_to_string(v || list_transform(range(l - len(v)), lambda i: 0), ',')) AS ids FROM ids, l")
def t6_encode_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Padded to the longest of the batch, which here is the table."""
    rows = _ids(spark, sf)
    longest = rows.agg(F.max(F.size("ids")).alias("l"))
    return rows.crossJoin(F.broadcast(longest)).select("doc_id", F.col("l").cast("bigint").alias("length"), F.md5(_text(F.concat("ids", F.array_repeat(F.lit(K.PADDING), F.col("l") - F.size("ids"))))).alias("ids"))


def _codes(c: str) -> str:
    return f"list_transform(list_filter(string_split({c}, ''), lambda c: c <> ''), lambda c: unicode(c))"


@query(f"SELECT task_id, array_to_string(([2, 100] || {_codes('prompt')} || [101] || {_codes('canonical_solution')} || [3])[1:256], ',') AS ids FROM benchmark_problems WHERE prompt IS NOT NULL AND canonical_solution IS NOT NULL")
def t7_code_pair(spark: SparkSession, sf: str) -> DataFrame:
    codes = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    rows = _read(spark, sf, "benchmark_problems").where("prompt is not null and canonical_solution is not null")
    return rows.select("task_id", _text(K.code_pair(codes("prompt"), codes("canonical_solution"), begin=2, end=3, problem_mark=100, solution_mark=101, max_length=256)).alias("ids"))
