"""Queries of the joins, ranks, limits and scalar functions that the operators are built from, each on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evaluation, retrieval, stats, windows
from textloom.plans.corpus import CHARS, CLEAN, WORDS, docs, ids
from textloom.plans.registry import query
from textloom.plans.retrieval import _TERMS, CHUNKS, FUSED, QUERY, RERANKED, SPARSE, chunks
from textloom.session import shared_dir


@query("SELECT source, CAST(sum((length(text) + 999) // 1000) AS BIGINT) AS chunks, count(*) AS files FROM documents WHERE length(text) > 0 GROUP BY source")
def s4_folder_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each folder's files; a chunk never spans files."""
    files = docs(spark, sf).where("length(text) > 0")
    per = windows.character_chunks(files, "doc_id", "text", 1000).groupBy("key").agg(F.count("*").alias("n"))
    return per.join(files.select("doc_id", "source"), per.key == F.col("doc_id")).groupBy("source").agg(F.sum("n").alias("chunks"), F.count("*").alias("files"))


@query("SELECT doc_id, CASE WHEN lower(domain) = 'python' THEN 'python' WHEN lower(domain) = 'cpp' THEN 'cpp' ELSE 'other' END AS language, length(text) > 0 AS readable FROM documents WHERE doc_type = 'code' AND text IS NOT NULL")
def s9_code_language(spark: SparkSession, sf: str) -> DataFrame:
    d = F.lower("domain")
    rows = docs(spark, sf).where("doc_type = 'code' and text is not null")
    return rows.select("doc_id", F.when(d == "python", "python").when(d == "cpp", "cpp").otherwise("other").alias("language"), (F.length("text") > 0).alias("readable"))


@query(f"SELECT count(*) AS size, max(token_id) AS highest, CAST(sum(n) AS BIGINT) AS total FROM (SELECT c, n, CAST(row_number() OVER (ORDER BY n DESC, c) + 3 AS INTEGER) AS token_id FROM (SELECT c, count(*) AS n FROM (SELECT unnest({CHARS}) AS c FROM documents) GROUP BY c))")
def s19_vocabulary_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/textloom-vocab-{uuid.uuid4().hex}"
    stats.character_vocabulary(docs(spark, sf), "text").write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("size"), F.max("token_id").alias("highest"), F.sum("n").alias("total"))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE octet_length(encode(text)) = 0) AS empty_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def v2_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.octet_length("text")
    return docs(spark, sf).where("text is not null").agg(F.count("*").alias("files"), F.count_if(n == 0).alias("empty_files"), F.sum(n).alias("bytes"))


@query("SELECT doc_id FROM documents WHERE length(text) < 10")
def v5_too_short(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("length(text) < 10").select("doc_id")


@query(f"WITH {FUSED} SELECT chunk_id, score FROM fused")
def j3_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """The whole fused list: a full outer join of two ranked lists of at most 20 rows."""
    cut = chunks(spark, sf)
    return retrieval.fuse(retrieval.dense_hits(retrieval.embed_texts(cut, "chunk_id", "content"), QUERY, 20), retrieval.sparse_hits(cut, QUERY, 20), 40)


@query(f"WITH {CHUNKS}, {SPARSE} SELECT chunk_id, doc_id, source_file, content FROM chunks JOIN sparse USING (chunk_id) WHERE rank <= 10")
def j4_hydrate_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of ranked hits; the hits are at most k rows, so they are broadcast."""
    cut = chunks(spark, sf)
    return cut.join(F.broadcast(retrieval.sparse_hits(cut, QUERY, 10).select("chunk_id")), "chunk_id").select("chunk_id", "doc_id", "source_file", "content")


@query("SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) + 0 AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q")
def j5_query_by_all(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector against all rows: the query is a literal in the scan's projection, not a join."""
    from textloom.functions.arrays import dot

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = vectors.orderBy("vec_id").limit(1).collect()
    literal = F.array(*(F.lit(float(x)) for r in first for x in r.embedding))
    return vectors.select("vec_id", (F.round(dot(F.col("embedding"), literal), 5) + 0.0).alias("score"))


@query("WITH " + CHUNKS + ", terms AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TERMS) + "]) AS term) SELECT term, count(*) AS chunks, CAST(sum((length(lower(content)) - length(replace(lower(content), term, ''))) / length(term)) AS BIGINT) AS occurrences FROM chunks JOIN terms ON contains(lower(content), term) GROUP BY term")
def j6_terms_in_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Query terms as substrings of chunks: each chunk tests all terms in one pass."""
    low = F.lower("content")
    hits = F.array(*(F.struct(F.lit(t).alias("term"), T.count_substring(low, F.lit(t)).alias("n")) for t in _TERMS))
    return chunks(spark, sf).select(F.inline(F.filter(hits, lambda h: h["n"] > 0))).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("n").alias("occurrences"))


@query("SELECT DISTINCT sample_id FROM split_samples s WHERE content IS NOT NULL AND EXISTS (SELECT 1 FROM split_samples t WHERE t.content = s.content AND t.sample_id <> s.sample_id)")
def j10_present_elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    """Samples whose text another sample has: counted on digests, so a text copied to a third of the rows is one group row."""
    rows = spark.read.parquet(f"{sf}/split_samples.parquet").where("content is not null").select("sample_id", F.sha2("content", 256).alias("h")).distinct()
    shared = rows.groupBy("h").count().where("count > 1").select("h")
    return rows.join(shared, "h", "left_semi").select("sample_id")


@query(f"WITH {CHUNKS}, {SPARSE} SELECT chunk_id, CAST(rank AS INTEGER) AS rank, round(1.0::DOUBLE / (60 + rank), 9) AS weight FROM sparse WHERE rank <= 20")
def w8_rank_weights(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sparse_hits(chunks(spark, sf), QUERY, 20).select("chunk_id", "rank", F.round(1.0 / (60 + F.col("rank")), 9).alias("weight"))


@query(f"SELECT doc_id, CAST(len(cs) - 1 AS INTEGER) AS pairs, md5(array_to_string(list_transform(range(1, len(cs)), lambda i: unicode(cs[i]) || '>' || unicode(cs[i + 1])), ',')) AS digest FROM (SELECT doc_id, {CHARS} AS cs FROM documents WHERE length(text) > 1)")
def w14_next_token(spark: SparkSession, sf: str) -> DataFrame:
    """Each id of a text with the next: the shift is inside the array, no window is needed."""
    v, n = F.col("ids"), F.size("ids")
    pairs = F.zip_with(F.slice(v, 1, n - 1), F.slice(v, 2, n - 1), lambda a, b: F.concat(a.cast("string"), F.lit(">"), b.cast("string")))
    return ids(docs(spark, sf)).where("size(ids) > 1").select("doc_id", (n - 1).alias("pairs"), F.md5(F.array_join(pairs, ",")).alias("digest"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id LIMIT 15")
def k1_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Top k by a score with ties by id: each task keeps k rows, nothing is sorted whole."""
    score = F.round(F.element_at("embedding", 1).cast("double"), 6)
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(15)


@query(f"WITH {CHUNKS}, {SPARSE} SELECT chunk_id, score FROM sparse ORDER BY rank LIMIT 7")
def k2_sparse_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sparse_hits(chunks(spark, sf), QUERY, 7).select("chunk_id", "score")


@query(f"WITH {FUSED} SELECT chunk_id, score FROM fused ORDER BY score DESC, chunk_id LIMIT 5")
def k3_fused_top_k(spark: SparkSession, sf: str) -> DataFrame:
    cut = chunks(spark, sf)
    return retrieval.fuse(retrieval.dense_hits(retrieval.embed_texts(cut, "chunk_id", "content"), QUERY, 20), retrieval.sparse_hits(cut, QUERY, 20), 5)


@query("SELECT record_id FROM (SELECT DISTINCT record_id FROM instruction_records WHERE output IS NOT NULL) ORDER BY record_id LIMIT 100")
def k10_sample_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The sample cap of a loader, made deterministic by order."""
    return spark.read.parquet(f"{sf}/instruction_records.parquet").where("output is not null").select("record_id").distinct().orderBy("record_id").limit(100)


@query("SELECT event_id, round(log2(value + 1), 6) AS l2, round(ln(value + 1), 6) AS ln, round(sqrt(value), 6) AS root, round(exp(least(value, 5.0)), 6) AS e, round(pow(value, 1.5), 4) AS power FROM events")
def m2_mathematics(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(F.log2(v + 1), 6).alias("l2"), F.round(F.log(v + 1), 6).alias("ln"), F.round(F.sqrt(v), 6).alias("root"), F.round(F.exp(F.least(v, F.lit(5.0))), 6).alias("e"), F.round(F.pow(v, F.lit(1.5)), 4).alias("power"))


@query("SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS clamped FROM events")
def m3_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("clamped"))


@query("SELECT n, k, round(coalesce(list_product(list_transform(range(1, k + 1), lambda i: (n - k + i)::DOUBLE / i)), 1.0), 3) AS combinations FROM range(1, 31) a(n), range(0, 31) b(k) WHERE k <= n")
def m4_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """n over k as a product of fractions."""
    grid = spark.range(1, 31).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id"))).alias("k"))
    product = F.aggregate(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("k")), lambda i: i > 0), F.lit(1.0), lambda a, i: a * (F.col("n") - F.col("k") + i) / i)
    return grid.select("n", "k", F.round(product, 3).alias("combinations"))


@query("SELECT user_id, '| ' || string_agg(format('{:.2f}', value), ' | ' ORDER BY event_id) || ' |' AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 4 GROUP BY user_id")
def f10_formatted(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rn <= 4")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: F.format_string("%.2f", s["value"]))
    return first.groupBy("user_id").agg(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


_STEP = f"SELECT doc_id, {CLEAN} AS text FROM documents WHERE length(text) >= 10"


@query(
    f"""WITH c AS (SELECT doc_id, text FROM ({_STEP})), v AS (SELECT doc_id, list_transform({CHARS}, lambda c: unicode(c)) AS v FROM c),
    w AS (SELECT doc_id, greatest(0, (len(v) - 65) // 64 + 1) AS n FROM v WHERE len(v) >= 65),
    s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS i, count(*) OVER () AS m FROM c)
    SELECT CASE WHEN i < floor(m * 0.8) THEN 'train' WHEN i < floor(m * 0.8) + floor(m * 0.1) THEN 'val' ELSE 'test' END AS split, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS windows FROM s LEFT JOIN w USING (doc_id) GROUP BY 1"""
)
def dataset_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Validate, clean, encode, window and split in one plan."""
    sound = docs(spark, sf).where("length(text) >= 10").select("doc_id", T.clean_text(F.col("text")).alias("text"))
    cut = windows.context_windows(ids(sound), "doc_id", "ids", length=64).groupBy("key").agg(F.count("*").alias("n"))
    split = windows.shuffled_split(sound.select("doc_id"), "doc_id")
    return split.join(cut, split.doc_id == cut.key, "left").groupBy("split").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("windows"))


@query("SELECT experiment_id, CAST(max_sequence_length AS BIGINT) AS capacity, max_repeats BETWEEN 1 AND 10 AND size_factor > 0 AS valid FROM pretraining_configs")
def v14_config_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/pretraining_configs.parquet")
    return rows.select("experiment_id", F.col("max_sequence_length").cast("bigint").alias("capacity"), (F.col("max_repeats").between(1, 10) & (F.col("size_factor") > 0)).alias("valid"))


@query(f"SELECT doc_id, CAST(list_sum(list_transform({WORDS}, lambda w: length(w))) AS BIGINT) AS word_chars, upper(substr(text, 1, 20)) AS head FROM documents WHERE len({WORDS}) > 0")
def f8_word_lengths(spark: SparkSession, sf: str) -> DataFrame:
    w = T.words(F.col("text"))
    return docs(spark, sf).where(F.size(w) > 0).select("doc_id", F.aggregate(w, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("word_chars"), F.upper(F.substring("text", 1, 20)).alias("head"))




@query(f"WITH {RERANKED} SELECT chunk_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def k4_rerank_top_k(spark: SparkSession, sf: str) -> DataFrame:
    cut = chunks(spark, sf)
    hits = retrieval.fuse(retrieval.dense_hits(retrieval.embed_texts(cut, "chunk_id", "content"), QUERY, 20), retrieval.sparse_hits(cut, QUERY, 20), 10)
    top = retrieval.rerank(hits, cut, QUERY, 5).select("chunk_id", "score")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


@query("SELECT doc_id, lower(text) AS low, lower(domain) AS domain FROM documents")
def f4_lower(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.lower("text").alias("low"), F.lower("domain").alias("domain"))


@query(r"SELECT record_id, regexp_extract(output, '(?s)```(\w*)\n(.*?)\n```', 1) AS language, length(regexp_extract(output, '(?s)```(\w*)\n(.*?)\n```', 2)) AS code_chars FROM (SELECT DISTINCT record_id, output FROM instruction_records WHERE output IS NOT NULL)")
def f7_regex_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The first fenced block over line breaks: its language and the size of its code."""
    rows = spark.read.parquet(f"{sf}/instruction_records.parquet").where("output is not null").select("record_id", "output").distinct()
    block = r"(?s)```(\w*)\n(.*?)\n```"
    return rows.select("record_id", F.regexp_extract("output", block, 1).alias("language"), F.length(F.regexp_extract("output", block, 2)).cast("bigint").alias("code_chars"))


@query(f"WITH {CHUNKS} SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id")
def h2_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(('0x' || substr(md5(text), 25, 8))::BIGINT % 1000 AS BIGINT) AS low_digits, CAST(('0x' || substr(md5(text), 1, 8))::BIGINT % 1000 AS BIGINT) AS high_digits FROM documents WHERE text IS NOT NULL")
def h3_digest_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of an MD5 digest as numbers."""
    part = lambda a: F.conv(F.substring(F.md5("text"), a, 8), 16, 10).cast("bigint") % 1000
    return docs(spark, sf).where("text is not null").select("doc_id", part(25).alias("low_digits"), part(1).alias("high_digits"))


@query("SELECT event_id, round(value / 7, 4) + 0 AS rounded, floor(value) AS floored, ceil(value) AS raised FROM events")
def m1_round(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.round(v / 7, 4) + 0.0).alias("rounded"), F.floor(v).cast("double").alias("floored"), F.ceil(v).cast("double").alias("raised"))


@query(f"WITH {RERANKED} SELECT '[Doc ' || rank || ': ' || regexp_extract(source_file, '([^/]*)$', 1) || ']' AS citation, source_file, chunk_id FROM ranked WHERE rank <= 5")
def r7_citations(spark: SparkSession, sf: str) -> DataFrame:
    ranked = k4_rerank_top_k(spark, sf).drop("score")
    found = chunks(spark, sf).join(F.broadcast(ranked), "chunk_id")
    return found.select(F.concat(F.lit("[Doc "), F.col("rank").cast("string"), F.lit(": "), T.path_name(F.col("source_file")), F.lit("]")).alias("citation"), "source_file", "chunk_id")


_CATALOG = [("tok_embeddings.weight", 2, 6400), ("pos_embeddings.weight", 2, 1280), ("blocks.0.ln_1.weight", 1, 64), ("blocks.0.ln_1.bias", 1, 64), ("blocks.0.attention.q.weight", 2, 4096), ("blocks.0.attention.q.bias", 1, 64), ("blocks.0.ffn.w1.weight", 2, 16384), ("lm_head.weight", 2, 6400)]


@query(
    f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {d}, {k})" for n, d, k in _CATALOG)}) t(name, ndim, numel))
    SELECT CASE WHEN contains(name, 'embeddings') THEN 'embedding' WHEN contains(name, 'attention') THEN 'attention' WHEN contains(name, 'ffn') THEN 'ffn' WHEN contains(name, 'ln_') THEN 'norm' ELSE 'head' END AS component,
    CAST(sum(numel) AS BIGINT) AS parameters, CAST(coalesce(sum(numel) FILTER (WHERE NOT (ndim < 2 OR contains(name, 'bias') OR contains(name, 'ln_') OR contains(name, 'norm'))), 0) AS BIGINT) AS decayed FROM p GROUP BY 1"""
)
def a21_parameter_groups(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.parameter_groups(spark.createDataFrame(_CATALOG, "name string, ndim int, numel bigint"))


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT i AS seq_id, vec_id, label FROM n WHERE i IN (0, 7, 99)")
def row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a map-style data set by position."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.lit(1).alias("one"))
    return windows.running_offset(rows, "vec_id", "one", "seq_id").where(F.col("seq_id").isin(0, 7, 99)).select("seq_id", "vec_id", "label")
