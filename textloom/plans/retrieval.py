"""Queries of chunking, hashed embeddings and hybrid retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import path_name
from textloom.operators import retrieval as R
from textloom.operators import windows
from textloom.plans.registry import query

QUERY = "stable buffer retries the pipeline cache"
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """Knowledge documents, each once (repeated deliveries carry the same values)."""
    return spark.read.parquet(f"{sf}/knowledge_documents.parquet").where("content is not null").select("doc_id", "source_file", "content").dropDuplicates(["doc_id"])


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = knowledge(spark, sf)
    cut = windows.overlapping_chunks(docs, "doc_id", "content")
    return cut.join(docs.select("doc_id", "source_file"), "doc_id")


KB = "kb AS (SELECT DISTINCT doc_id, source_file, content FROM knowledge_documents WHERE content IS NOT NULL)"
CHUNKS = rf"""{KB}, sp AS (SELECT doc_id, source_file, content AS t, unnest(range(0, length(content), 448)) AS b FROM kb WHERE length(content) > 0),
    cc AS (SELECT doc_id, source_file, b, regexp_replace(substr(t, b + 1, 512), '^{SPACE}+|{SPACE}+$', '', 'g') AS content FROM sp),
    chunks AS (SELECT substr(sha256(doc_id || ':' || b || ':' || substr(content, 1, 64)), 1, 16) AS chunk_id, doc_id, source_file, content FROM cc WHERE content <> '')"""


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{SPACE}+'), lambda w: w <> '')"


VALUE = "((CAST('0x' || substr(md5(w), 17, 12) AS BIGINT) + CAST('0x' || substr(md5(w), 1, 16) AS HUGEINT) % 100 * (CAST(281474976710656 AS HUGEINT) % 100)) % 100) / 50.0 - 1.0"
SLOT = "CAST('0x' || substr(md5(w), 31, 2) AS BIGINT) % 128"


def _embedded(source: str, key: str, text: str, name: str) -> str:
    """CTEs: (key, idx, val) of the normalised hashed vectors of a table."""
    return f"""{name}_w AS (SELECT {key}, unnest({_words(text)}) AS w FROM {source}),
    {name}_s AS (SELECT {key}, {SLOT} AS idx, sum({VALUE}) AS val FROM {name}_w GROUP BY 1, 2),
    {name}_n AS (SELECT {key}, sqrt(sum(val * val)) AS n FROM {name}_s GROUP BY 1),
    {name} AS (SELECT {key}, idx, CASE WHEN n > 0 THEN val / n ELSE 0 END AS val FROM {name}_s JOIN {name}_n USING ({key}))"""


_Q = f"(SELECT 1 AS qid, '{QUERY}' AS t)"
DENSE = f"""{CHUNKS}, {_embedded('chunks', 'chunk_id', 'content', 'ce')}, {_embedded(_Q, 'qid', 't', 'qe')},
    dense AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM
      (SELECT c.chunk_id, round(coalesce(sum(ce.val * qe.val), 0), 6) + 0 AS score FROM chunks c LEFT JOIN ce USING (chunk_id) LEFT JOIN qe ON qe.idx = ce.idx GROUP BY c.chunk_id))"""
_TERMS = R.query_terms(QUERY)
_SPARSE = " + ".join(f"(length(lower(content)) - length(replace(lower(content), '{t}', ''))) / {len(t)}" for t in _TERMS)
SPARSE = f"sparse AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT chunk_id, ({_SPARSE}) * 1.5::DOUBLE AS score FROM chunks) WHERE score > 0)"
FUSED = f"""{DENSE}, {SPARSE}, d AS (SELECT chunk_id, rank FROM dense WHERE rank <= 20), s AS (SELECT chunk_id, rank FROM sparse WHERE rank <= 20),
    fused AS (SELECT coalesce(d.chunk_id, s.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score FROM d FULL JOIN s ON d.chunk_id = s.chunk_id),
    hybrid AS (SELECT chunk_id, score FROM fused ORDER BY score DESC, chunk_id LIMIT 10)"""
_DENSITY = " + ".join(f"CAST(contains(lower(content), '{t}') AS INTEGER)" for t in _TERMS)
RERANKED = f"""{FUSED}, reranked AS (SELECT chunk_id, doc_id, source_file, content, round(score * (1 + ({_DENSITY})::DOUBLE / {len(_TERMS)}), 9) AS score FROM hybrid JOIN chunks USING (chunk_id)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM reranked)"""


@query(f"WITH {CHUNKS}, {_embedded('chunks', 'chunk_id', 'content', 'ce')} SELECT chunk_id, CAST(idx AS INTEGER) AS idx, round(val, 6) + 0 AS val FROM ce WHERE round(val, 6) <> 0")
def e1_embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.embed_texts(chunks(spark, sf), "chunk_id", "content").select("chunk_id", F.posexplode("embedding").alias("idx", "val"))
    return rows.select("chunk_id", "idx", (F.round("val", 6) + 0.0).alias("val")).where("val <> 0")


@query(f"WITH w AS (SELECT DISTINCT unnest({_words('text')}) AS w FROM documents) SELECT w AS word, CAST({SLOT} AS INTEGER) AS slot, round({VALUE}, 4) + 0 AS val FROM w")
def e2_hashed_words(spark: SparkSession, sf: str) -> DataFrame:
    """The 128-bit digest arithmetic JVM-side: only the last byte gives the slot, and 2**48 mod 100 folds the high half of the rest."""
    w = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.filter(F.split(F.lower("text"), f"{SPACE}+"), lambda x: x != "")).alias("word")).distinct()
    part = lambda a, n: F.conv(F.substring(F.md5("word"), a, n), 16, 10).cast("decimal(20,0)")
    value = (part(17, 12) + part(1, 16) % 100 * (2**48 % 100)) % 100
    return w.select("word", (part(31, 2) % 128).cast("int").alias("slot"), (F.round(value.cast("double") / 50.0 - 1.0, 4) + 0.0).alias("val"))


@query("SELECT vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 5) AS score, row_number() OVER (ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 5) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q) WHERE rank <= 20")
def r1_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = vectors.orderBy("vec_id").limit(1).collect()
    queries = [("q", np.array(r.embedding, float)) for r in first]
    return R.nearest(vectors, "vec_id", "embedding", queries, 20, digits=5).select("vec_id", "score", "rank")


@query(f"WITH {DENSE} SELECT chunk_id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 20")
def r3_dense_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_hits(R.embed_texts(chunks(spark, sf), "chunk_id", "content"), QUERY, 20)


@query(f"WITH {CHUNKS}, {SPARSE} SELECT chunk_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 20")
def r4_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.sparse_hits(chunks(spark, sf), QUERY, 20)


def _hybrid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cut = chunks(spark, sf)
    return R.fuse(R.dense_hits(R.embed_texts(cut, "chunk_id", "content"), QUERY, 20), R.sparse_hits(cut, QUERY, 20), 10), cut


@query(f"WITH {FUSED} SELECT chunk_id, score FROM hybrid")
def r5_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf)[0]


@query(f"WITH {RERANKED} SELECT chunk_id, score FROM ranked WHERE rank <= 3")
def r6_rerank(spark: SparkSession, sf: str) -> DataFrame:
    hits, cut = _hybrid(spark, sf)
    return R.rerank(hits, cut, QUERY, 3).select("chunk_id", "score")


_ENTRIES = f"""{RERANKED}, h AS (SELECT rank, chunk_id, content, chr(10) || '--- [Doc ' || rank || ': ' || regexp_extract(source_file, '([^/]*)$', 1) || '] (Source: ' || source_file || ') ---' AS head FROM ranked WHERE rank <= 3),
    b AS (SELECT *, 35 - 1 + 1 + coalesce(sum(length(head) + length(content) + 2) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
    o AS (SELECT *, before + length(head) + length(content) + 2 > 1500 AS over FROM b),
    st AS (SELECT *, sum(CAST(over AS INTEGER)) OVER (ORDER BY rank) AS stops, 1500 - before - length(head) - 10 AS rest FROM o),
    entries AS (SELECT rank, chunk_id, CASE WHEN over THEN head || chr(10) || substr(content, 1, CAST(rest AS BIGINT)) || '...' || chr(10) ELSE head || chr(10) || content || chr(10) END AS entry
      FROM st WHERE stops = 0 OR (stops = 1 AND over AND rest > 50))""".replace("35 - 1 + 1", str(len(R.HEADER)))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    hits, cut = _hybrid(spark, sf)
    top = R.rerank(hits, cut, QUERY, 3).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))).withColumn("title", path_name(F.col("source_file")))
    return R.with_context_entries(top)


@query(f"WITH {_ENTRIES} SELECT CAST(rank AS INTEGER) AS rank, chunk_id, entry FROM entries")
def w7_context_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf)


@query(
    f"""WITH {_ENTRIES} SELECT '{R.HEADER}' || chr(10) || string_agg(entry, chr(10) ORDER BY rank) || chr(10) || '=== END KNOWLEDGE CONTEXT ===' || chr(10) || chr(10) || 'Question: {QUERY}' || chr(10) || chr(10) ||
    'Instructions: Answer the question using the retrieved knowledge context above. Cite sources using [Doc N] format.' AS prompt, string_agg(chunk_id, ',' ORDER BY rank) AS cited FROM entries"""
)
def r8_answer_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path: chunk, embed, search, fuse, re-rank, fit the budget and build the prompt with its citations."""
    return R.augmented_prompt(_entries(spark, sf), QUERY)


@query(
    f"""WITH {CHUNKS}, {_embedded('chunks', 'chunk_id', 'content', 'ce')}, {_embedded('benchmark_problems', 'task_id', 'prompt', 'qe')},
    sc AS (SELECT q.task_id, c.chunk_id, round(sum(c.val * q.val), 6) + 0 AS score FROM ce c JOIN qe q USING (idx) GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, chunk_id) AS rank FROM sc)
    SELECT task_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5"""
)
def r3_many_queries(spark: SparkSession, sf: str) -> DataFrame:
    """All evaluation prompts against all chunks, in blocks of queries."""
    prompts = spark.read.parquet(f"{sf}/benchmark_problems.parquet").select(F.col("task_id").alias("query"), "prompt")
    asked = R.embed_texts(prompts, "query", "prompt").withColumnRenamed("embedding", "vector")
    return R.nearest_to_rows(R.embed_texts(chunks(spark, sf), "chunk_id", "content"), "chunk_id", "embedding", asked, 5).withColumnRenamed("query", "task_id")


@query(f"WITH {CHUNKS}, {_embedded('chunks', 'chunk_id', 'content', 'ce')} SELECT count(*) AS vectors, count(DISTINCT doc_id) AS documents, CAST(128 AS INTEGER) AS dimensions FROM chunks")
def a25_index_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).agg(F.count("*").alias("vectors"), F.countDistinct("doc_id").alias("documents"), F.lit(R.DIMENSIONS).alias("dimensions"))


@query(f"WITH {CHUNKS} SELECT chunk_id, CAST({_DENSITY} AS INTEGER) AS overlap FROM chunks WHERE ({_DENSITY}) > 0")
def u3_shared_terms(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.round(R.term_density(F.col("content"), _TERMS) * len(_TERMS)).cast("int")
    return chunks(spark, sf).select("chunk_id", hits.alias("overlap")).where("overlap > 0")


@query(f"WITH {CHUNKS} SELECT DISTINCT unnest({_words('content')}) AS term FROM chunks")
def u2_distinct_terms(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select(F.explode(F.filter(F.split(F.lower("content"), f"{SPACE}+"), lambda w: w != "")).alias("term")).distinct()


@query("SELECT 'documents' AS corpus, CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents UNION ALL SELECT 'knowledge', doc_id, length(content) FROM knowledge_documents")
def u1_bag_union(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("id"), F.length("text").cast("bigint").alias("n"))
    b = spark.read.parquet(f"{sf}/knowledge_documents.parquet").select(F.lit("knowledge").alias("corpus"), F.col("doc_id").alias("id"), F.length("content").cast("bigint").alias("n"))
    return a.unionByName(b)
