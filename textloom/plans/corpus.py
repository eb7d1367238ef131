"""Queries of cleaning, validation, statistics, windows, splits and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.arrays import fit, keep_last
from textloom.operators import stats, validate, windows
from textloom.operators.tokenizer import code_points
from textloom.plans.registry import query

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CLEAN = rf"regexp_replace(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '{CONTROL}', '', 'g')"
WORDS = rf"list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')"
CHARS = "list_filter(string_split(text, ''), lambda c: c <> '')"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids(df: DataFrame) -> DataFrame:
    """Documents with their code points as token ids."""
    return code_points(df.where("text is not null"), "doc_id", "text")


# --- cleaning -------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS clean FROM documents")
def c1_line_endings(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.fix_line_endings(F.col("text")).alias("clean"))


@query("SELECT doc_id, nfc_normalize(text) AS clean FROM documents")
def c2_nfc(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.unicode_normalize(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, regexp_replace(text, '{CONTROL}', '', 'g') AS clean FROM documents")
def c3_strip_control(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.strip_control(F.col("text")).alias("clean"))


@query(
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, chr(13)),
        lambda c: list_reduce(string_split(c, chr(9)), lambda a, s: a || repeat(' ', 4 - length(a) % 4) || s)), chr(13))) AS v FROM documents)
    SELECT doc_id, array_to_string(v, chr(10)) AS clean FROM l"""
)
def c4_expand_tabs(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.expand_tabs(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def c5_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace({CLEAN}, '(?m)[ \t\x0b\f]+$', '', 'g'), '(?m)#.*$', '', 'g') AS clean FROM documents WHERE doc_type = 'code' AND lower(domain) = 'python'")
def c6_clean_python(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("doc_type = 'code' and lower(domain) = 'python'")
    return rows.select("doc_id", T.clean_python(F.col("text")).alias("clean"))


@query(
    rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace({CLEAN}, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*$', '', 'g') AS clean FROM documents WHERE doc_type = 'code'),
    b AS (SELECT doc_id, clean, regexp_replace(clean, '[^{{}}]', '', 'g') AS s FROM c),
    r AS (SELECT doc_id, clean, s, list_transform(range(1, length(s) + 1), lambda i: 2 * length(replace(s[1:i], '}}', '')) - i) AS bal FROM b)
    SELECT doc_id, clean, (length(s) = 0 OR (list_min(bal) >= 0 AND bal[length(s)] = 0)) AS balanced FROM r WHERE clean IS NOT NULL"""
)
def c7_clean_curly(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("doc_type = 'code' and text is not null").select("doc_id", T.clean_curly(F.col("text")).alias("clean"))
    return rows.select("doc_id", "clean", T.braces_balanced(F.col("clean")).alias("balanced"))


@query(
    rf"""SELECT doc_id, CASE WHEN lower(domain) IN ('cpp', 'c', 'java') THEN regexp_replace(regexp_replace({CLEAN}, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*$', '', 'g')
    ELSE {CLEAN} END AS clean FROM documents WHERE doc_type = 'code' AND coalesce(lower(domain), '') <> 'python'"""
)
def c8_clean_by_language(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("doc_type = 'code' and coalesce(lower(domain), '') <> 'python'")
    return rows.select("doc_id", T.clean_code(F.col("text"), F.col("domain")).alias("clean"))


@query(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') AS clean
    FROM documents WHERE doc_type = 'html'"""
)
def c9_clean_html(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("doc_type = 'html'").select("doc_id", T.clean_html(F.col("text")).alias("clean"))


@query(
    rf"""WITH r AS (SELECT DISTINCT record_id, output FROM instruction_records WHERE output IS NOT NULL),
    e AS (SELECT record_id, output, regexp_extract_all(output, '(?s)```python\s*(.*?)\s*```', 1) AS p, regexp_extract_all(output, '(?s)```\s*(.*?)\s*```', 1) AS g FROM r)
    SELECT record_id, regexp_replace(coalesce(p[-1], g[-1], output), '^{SPACE}+|{SPACE}+$', '', 'g') AS code FROM e"""
)
def c10_fenced_code(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/instruction_records.parquet").where("output is not null").select("record_id", "output").distinct()
    return rows.select("record_id", T.fenced_code(F.col("output")).alias("code"))


@query()
def c11_python_syntax(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("doc_type = 'code' and lower(domain) = 'python' and text is not null")
    return rows.select("doc_id", T.python_syntax("text").alias("v")).select("doc_id", "v.ok", "v.message")


# --- functions ------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({WORDS}) AS INTEGER) AS n_words, array_to_string({WORDS}[1:5], ' ') AS head FROM documents WHERE text IS NOT NULL")
def f1_words(spark: SparkSession, sf: str) -> DataFrame:
    w = T.words(F.col("text"))
    return docs(spark, sf).where("text is not null").select("doc_id", F.size(w).alias("n_words"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{BREAK}')) + CASE WHEN text = '' OR regexp_matches(text, '(?:{BREAK})\z') THEN 0 ELSE 1 END AS INTEGER) AS n_lines FROM documents WHERE text IS NOT NULL")
def f2_lines(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text is not null").select("doc_id", T.line_count(F.col("text")).alias("n_lines"))


@query(f"SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS body, lower(text) AS low FROM documents")
def f3_strip_lower(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.strip(F.col("text")).alias("body"), F.lower("text").alias("low"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INTEGER) AS n_the FROM documents WHERE text IS NOT NULL")
def f5_count_substring(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text is not null").select("doc_id", T.count_substring(F.lower("text"), F.lit("the")).alias("n_the"))


@query("SELECT doc_id, substr(text, 101, 300) AS part FROM documents")
def f6_slice(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.substring("text", 101, 300).alias("part"))


@query(r"SELECT DISTINCT source_file, regexp_extract(source_file, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '\.[^.]+$', '') AS stem, lower(regexp_extract(source_file, '(\.[^./]+)$', 1)) AS suffix FROM knowledge_documents WHERE source_file IS NOT NULL")
def f9_path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("source_file")
    rows = spark.read.parquet(f"{sf}/knowledge_documents.parquet").where("source_file is not null").select("source_file").distinct()
    return rows.select("source_file", T.path_name(p).alias("name"), T.path_stem(p).alias("stem"), T.path_suffix(p).alias("suffix"))


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(doc_id || ':0:' || substr(text, 1, 64)), 1, 16) AS chunk_id FROM documents WHERE text IS NOT NULL")
def h1_digests(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("text is not null")
    return rows.select("doc_id", F.sha2("text", 256).alias("digest"), T.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, CAST(ascii AS VARCHAR) AS ids FROM (SELECT doc_id, array_to_string(list_transform((list_transform(" + CHARS + ", lambda c: unicode(c)) || list_transform(range(16), lambda i: 0))[1:16], lambda v: CAST(v AS VARCHAR)), ',') AS ascii, text FROM documents WHERE text IS NOT NULL)")
def m8_pad_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return ids(docs(spark, sf)).select("doc_id", F.array_join(F.transform(fit(F.col("ids"), 16, F.lit(0)), lambda v: v.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, array_to_string(list_transform(" + CHARS + "[greatest(1, len(" + CHARS + ") - 31):], lambda c: CAST(unicode(c) AS VARCHAR)), ',') AS ids FROM documents WHERE text IS NOT NULL")
def n4_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return ids(docs(spark, sf)).select("doc_id", F.array_join(F.transform(keep_last(F.col("ids"), 32), lambda v: v.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, coalesce(element_at(metadata, 'lang')[1], 'unknown') AS lang, CAST(cardinality(map_concat(metadata, MAP {'kind': 'kb'})) AS INTEGER) AS entries FROM (SELECT DISTINCT doc_id, metadata FROM (SELECT doc_id, metadata, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at) AS rn FROM knowledge_documents) WHERE rn = 1 AND metadata IS NOT NULL)")
def m9_map_default(spark: SparkSession, sf: str) -> DataFrame:
    rows = validate.first_per_key(spark.read.parquet(f"{sf}/knowledge_documents.parquet").select("doc_id", "metadata", "loaded_at"), "doc_id", ["loaded_at"]).where("metadata is not null")
    merged = F.map_concat("metadata", F.create_map(F.lit("kind"), F.lit("kb")))
    return rows.select("doc_id", F.coalesce(F.try_element_at("metadata", F.lit("lang")), F.lit("unknown")).alias("lang"), F.size(merged).alias("entries"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events WHERE props IS NOT NULL")
def m10_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").where("props is not null")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$").isNotNull().alias("valid"))


# --- sources --------------------------------------------------------------


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS content FROM (SELECT doc_id, text, unnest(range((length(text) + 999) // 1000)) AS i FROM documents WHERE length(text) > 0)")
def s2_character_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return windows.character_chunks(docs(spark, sf), "doc_id", "text", 1000).select(F.col("key").alias("doc_id"), "chunk", "content")


@query("SELECT source, doc_id, CAST(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id) - length(text) - 2 AS BIGINT) AS start, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE text IS NOT NULL")
def s3_joined_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of each folder joined in order, as the place of each in the whole."""
    return windows.joined_offsets(docs(spark, sf), "source", "doc_id", "text")


@query(
    r"""SELECT DISTINCT source_file, CASE WHEN s IN ('.md', '.markdown') THEN 'markdown' WHEN s IN ('.py', '.cpp', '.c', '.h', '.hpp', '.java', '.js', '.ts', '.go', '.rs') THEN 'code'
    WHEN s = '.json' THEN 'json' WHEN s IN ('.html', '.htm') THEN 'html' ELSE 'txt' END AS doc_type
    FROM (SELECT source_file, lower(regexp_extract(source_file, '(\.[^./]+)$', 1)) AS s FROM knowledge_documents WHERE source_file IS NOT NULL)"""
)
def s7_doc_type_of_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/knowledge_documents.parquet").where("source_file is not null").select("source_file").distinct()
    return rows.select("source_file", T.doc_type_of(F.col("source_file")).alias("doc_type"))


@query("SELECT experiment_id, sha256(experiment_id || ':{\"stride\": 32, \"window\": ' || max_sequence_length || '}') AS cache_key FROM pretraining_configs")
def s20_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/pretraining_configs.parquet")
    return rows.select("experiment_id", F.sha2(F.concat("experiment_id", F.lit(':{"stride": 32, "window": '), F.col("max_sequence_length").cast("string"), F.lit("}")), 256).alias("cache_key"))


@query("SELECT substr(sha256(text), 1, 16) AS key, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1 AND substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) GROUP BY 1")
def s21_missing_in_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The cache here is what the even half of the table has left in it."""
    keyed = docs(spark, sf).where("text is not null").select(F.substring(F.sha2("text", 256), 1, 16).alias("key"), "doc_id")
    return keyed.where("doc_id % 2 = 1").join(keyed.where("doc_id % 2 = 0").select("key"), "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT source_file, arg_max(doc_id, (modified_at, doc_id)) AS doc_id FROM (SELECT DISTINCT source_file, doc_id, modified_at FROM knowledge_documents WHERE modified_at IS NOT NULL) GROUP BY source_file")
def s23_last_per_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/knowledge_documents.parquet").where("modified_at is not null")
    return rows.groupBy("source_file").agg(F.max_by("doc_id", F.struct("modified_at", "doc_id")).alias("doc_id"))


# --- validation -----------------------------------------------------------


@query("SELECT DISTINCT s.dataset_name FROM split_samples s WHERE s.dataset_name NOT IN (SELECT dataset_name FROM dataset_configs WHERE dataset_name <> 'fjord_web')")
def v1_absent_keys(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf}/split_samples.parquet").where("dataset_name is not null").select("dataset_name").distinct()
    return validate.absent_keys(wanted, spark.read.parquet(f"{sf}/dataset_configs.parquet").where("dataset_name <> 'fjord_web'"), "dataset_name")


@query("SELECT doc_id AS key, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_key, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents WHERE text IS NOT NULL")
def v3_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return validate.exact_duplicates(docs(spark, sf), "doc_id", "text")


@query("SELECT doc_id AS key, coalesce(text = '' OR unicode(right(text, 1)) < 128, false) AS valid_utf8 FROM documents")
def v4_utf8(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of each document without the last one, which breaks a character of several bytes."""
    content = F.encode("text", "UTF-8")
    cut = F.substring(content, F.lit(1), F.greatest(F.octet_length(content) - 1, F.lit(0)))
    return validate.utf8_verdict(docs(spark, sf).select("doc_id", cut.alias("content")), "doc_id", "content")


_BYTES = "list_filter(regexp_extract_all(hex(encode(text)), '..'), lambda h: h < '09' OR h IN ('0B', '0C') OR (h >= '0E' AND h <= '1F') OR (h >= '7F' AND h <= '9F'))"


@query(
    f"""WITH r AS (SELECT doc_id, octet_length(encode(text)) AS b, length(text) AS c, CASE WHEN text IS NULL THEN NULL WHEN octet_length(encode(text)) = 0 THEN 0.0 ELSE len({_BYTES})::DOUBLE / octet_length(encode(text)) END AS u FROM documents)
    SELECT doc_id AS key, CAST(b AS INTEGER) AS n_bytes, CAST(c AS INTEGER) AS n_chars, round(u, 6) + 0 AS unprintable,
    CASE WHEN c IS NULL THEN 'missing' WHEN b = 0 THEN 'empty' WHEN c < 10 THEN 'short' WHEN u > 0.1 THEN 'unprintable' ELSE 'valid' END AS verdict FROM r"""
)
def v7_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    out = validate.verdicts(docs(spark, sf), "doc_id", "text")
    return out.withColumn("unprintable", F.when(F.col("n_bytes").isNotNull(), F.round("unprintable", 6) + 0.0))


@query(
    f"""WITH r AS (SELECT octet_length(encode(text)) AS b, length(text) AS c, len({_BYTES})::DOUBLE / octet_length(encode(text)) AS u FROM documents),
    v AS (SELECT CASE WHEN c IS NULL THEN 'missing' WHEN b = 0 THEN 'empty' WHEN c < 10 THEN 'short' WHEN u > 0.1 THEN 'unprintable' ELSE 'valid' END AS verdict, b FROM r)
    SELECT verdict, count(*) AS files, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes FROM v GROUP BY verdict"""
)
def v6_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validate.verdicts(docs(spark, sf), "doc_id", "text").groupBy("verdict").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("bigint").alias("bytes"))


@query("SELECT count(*) FILTER (WHERE unicode(c) < 0) AS negative, count(*) FILTER (WHERE unicode(c) >= 128) AS too_large, CAST(0 AS BIGINT) AS missing, count(*) FILTER (WHERE unicode(c) >= 128) = 0 AS ok FROM (SELECT unnest(" + CHARS + ") AS c FROM documents)")
def v11_token_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return validate.token_bounds(ids(docs(spark, sf)).select(F.explode("ids").alias("id")), "id", 128)


@query("SELECT DISTINCT source_file, starts_with(source_file, 'kb/h') AS inside, split_part(source_file, '/', 2) IN ('handbook', 'hapa') AS allowed FROM knowledge_documents WHERE source_file IS NOT NULL")
def v12_path_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("source_file")
    rows = spark.read.parquet(f"{sf}/knowledge_documents.parquet").where("source_file is not null").select("source_file").distinct()
    return rows.select("source_file", F.startswith(p, F.lit("kb/h")).alias("inside"), F.split_part(p, F.lit("/"), F.lit(2)).isin("handbook", "hapa").alias("allowed"))


# --- statistics -----------------------------------------------------------


@query(
    rf"""WITH d AS (SELECT text FROM documents WHERE text IS NOT NULL),
    s AS (SELECT sum(length(text)) AS chars, sum(len(regexp_extract_all(text, '{BREAK}')) + CASE WHEN text = '' OR regexp_matches(text, '(?:{BREAK})\z') THEN 0 ELSE 1 END) AS lines,
      sum(len({WORDS})) AS words, sum(octet_length(encode(text))) AS bytes, sum(list_sum(list_transform({WORDS}, lambda w: length(w)))) AS wc FROM d),
    c AS (SELECT c, count(*) AS n FROM (SELECT unnest({CHARS}) AS c FROM d) GROUP BY c),
    e AS (SELECT count(*) AS u, sum(n) AS m, sum(n * log2(n)) AS l FROM c)
    SELECT CAST(chars AS BIGINT) AS chars, CAST(lines AS BIGINT) AS lines, CAST(words AS BIGINT) AS words, CAST(bytes AS BIGINT) AS bytes, u AS unique_chars,
      round(chars::DOUBLE / lines, 4) AS avg_line_length, round(wc::DOUBLE / words, 4) AS avg_word_length, round(log2(m::DOUBLE) - l / m, 4) AS entropy FROM s, e"""
)
def a1_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corpus_stats(docs(spark, sf), "text")


@query("SELECT count(*) AS total, count(DISTINCT id) AS unique, CAST(min(id) AS INTEGER) AS lowest, CAST(max(id) AS INTEGER) AS highest, round(count(DISTINCT id) * 100.0::DOUBLE / 65536, 4) AS utilization FROM (SELECT unicode(unnest(" + CHARS + ")) AS id FROM documents)")
def a2_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.token_stats(ids(docs(spark, sf)).select(F.explode("ids").alias("id")), "id", 65536)


@query(
    f"""WITH t AS (SELECT unicode(unnest({CHARS})) AS id FROM documents)
    SELECT count(*) AS total, count(*) FILTER (WHERE id >= 256) AS out_of_range, count(*) FILTER (WHERE id = 10) AS unknown, count(DISTINCT id) FILTER (WHERE id < 256) AS used,
    round(count(DISTINCT id) FILTER (WHERE id < 256)::DOUBLE / 256, 4) AS coverage, count(*) FILTER (WHERE id = 10) > 0.05 * count(*) AS warn_unknown FROM t"""
)
def a3_vocabulary_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.vocabulary_report(ids(docs(spark, sf)).select(F.explode("ids").alias("id")), "id", 256, unknown_id=10)


@query(f"SELECT c AS ch, n, CAST(row_number() OVER (ORDER BY n DESC, c) + 3 AS INTEGER) AS token_id FROM (SELECT c, count(*) AS n FROM (SELECT unnest({CHARS}) AS c FROM documents) GROUP BY c)")
def a4_character_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.character_vocabulary(docs(spark, sf), "text")


@query(f"SELECT c AS ch, n FROM (SELECT c, count(*) AS n FROM (SELECT unnest({CHARS}) AS c FROM documents) GROUP BY c) ORDER BY n DESC, c LIMIT 20")
def k9_most_common_characters(spark: SparkSession, sf: str) -> DataFrame:
    return stats.character_counts(docs(spark, sf), "text").orderBy(F.desc("n"), "ch").limit(20)


_PAIRS = f"SELECT p.a AS \"left\", p.b AS \"right\", count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(cs)), lambda i: {{'a': cs[i], 'b': cs[i + 1]}})) AS p FROM (SELECT {CHARS} AS cs FROM documents WHERE length(text) > 1)) GROUP BY 1, 2"


@query(_PAIRS)
def a6_adjacent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.adjacent_characters(docs(spark, sf), "text")


@query(f'SELECT "left", "right", n FROM ({_PAIRS}) ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1')
def a7_best_pair(spark: SparkSession, sf: str) -> DataFrame:
    return stats.best_pair(a6_adjacent_pairs(spark, sf))


# --- windows --------------------------------------------------------------


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",") for c in columns})


_CS = f"(SELECT doc_id, list_transform({CHARS}, lambda c: unicode(c)) AS v FROM documents WHERE length(text) > 0)"


@query(
    f"""SELECT doc_id AS key, CAST(k AS INTEGER) AS "window", array_to_string(v[k * 64 + 1:k * 64 + 128], ',') AS x, array_to_string(v[k * 64 + 2:k * 64 + 129], ',') AS y
    FROM (SELECT doc_id, v, unnest(range(greatest(0, (len(v) - 129) // 64 + 1))) AS k FROM {_CS} WHERE len(v) >= 129)"""
)
def w1_context_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(windows.context_windows(ids(docs(spark, sf)), "doc_id", "ids", length=128, stride=64), "x", "y")


@query(
    f"""SELECT doc_id AS key, CAST(k AS INTEGER) AS "window", array_to_string(v[k * 128 + 1:k * 128 + 128], ',') AS x, array_to_string(v[k * 128 + 2:k * 128 + 129], ',') AS y
    FROM (SELECT doc_id, v, unnest(range((len(v) - 128) // 128)) AS k FROM {_CS} WHERE len(v) >= 256)"""
)
def w2_memmap_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(windows.context_windows(ids(docs(spark, sf)), "doc_id", "ids", length=128, memmap_count=True), "x", "y")


def _concatenated(length: int, extra: int, eos: str) -> str:
    return f"""WITH e AS (SELECT doc_id, unnest(w) AS id, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, v{eos} AS w FROM (SELECT doc_id, list_transform({CHARS}, lambda c: unicode(c)) AS v FROM documents WHERE text IS NOT NULL))),
    g AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS k FROM e),
    w AS (SELECT k // {length} AS "window", id, k FROM g UNION ALL SELECT k // {length} - 1, id, k FROM g WHERE k % {length} < {extra} AND k >= {length})
    SELECT "window", md5(string_agg(id, ',' ORDER BY k)) AS ids FROM w GROUP BY "window" HAVING count(*) = {length + extra}"""


@query(_concatenated(512, 1, ""))
def w3_rolling_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.packed_windows(ids(docs(spark, sf)), "doc_id", "ids", length=512, overlap=1)
    return _joined(out, "ids").select("window", F.md5("ids").alias("ids"))


@query(_concatenated(1024, 1, " || [3]"))
def w4_packed_with_eos(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.packed_windows(ids(docs(spark, sf)), "doc_id", "ids", length=1024, overlap=1, eos=3)
    return _joined(out, "ids").select("window", F.md5("ids").alias("ids"))


@query(
    rf"""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 448)) AS b FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, b, least(b + 512, length(text)) AS e, regexp_replace(substr(text, b + 1, 512), '^{SPACE}+|{SPACE}+$', '', 'g') AS content FROM s)
    SELECT substr(sha256(doc_id || ':' || b || ':' || substr(content, 1, 64)), 1, 16) AS chunk_id, doc_id, CAST(b AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char, content FROM c WHERE content <> ''"""
)
def w5_overlapping_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return windows.overlapping_chunks(docs(spark, sf), "doc_id", "text")


@query('SELECT doc_id, CAST(sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS BIGINT) AS "offset" FROM documents WHERE text IS NOT NULL')
def w6_running_offset(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("text is not null").select("doc_id", F.length("text").alias("n"))
    return windows.running_offset(rows, "doc_id", "n").select("doc_id", "offset")


@query('WITH o AS (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id) AS e, length(text) AS n FROM documents WHERE length(text) > 0) SELECT p AS "position", doc_id, CAST(p - (e - n) AS BIGINT) AS inner_position FROM (SELECT unnest(range(0, t, greatest(1, t // 1000))) AS p FROM (SELECT CAST(sum(n) AS BIGINT) AS t FROM o)) q JOIN o ON p >= e - n AND p < e')
def j8_position_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Which document holds each of a thousand positions over the whole concatenation: an interval join by buckets of 4096 positions."""
    rows = windows.running_offset(docs(spark, sf).where("length(text) > 0").select("doc_id", F.length("text").alias("n")), "doc_id", "n")
    spans = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("offset") / 4096), F.floor((F.col("offset") + F.col("n") - 1) / 4096))))
    total = rows.agg(F.sum("n")).first()[0] or 0
    asked = spark.range(0, total, max(1, total // 1000)).select(F.col("id").alias("position"), F.floor(F.col("id") / 4096).alias("bucket"))
    hit = asked.join(spans, "bucket").where((F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("n")))
    return hit.select("position", "doc_id", (F.col("position") - F.col("offset")).alias("inner_position"))


# --- batches, splits, mixing ----------------------------------------------


@query(
    f"""WITH b AS (SELECT doc_id, v AS x, v[2:] AS y, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM {_CS}),
    m AS (SELECT batch, max(greatest(len(x), len(y))) AS l FROM b GROUP BY batch)
    SELECT doc_id, batch, md5(array_to_string(x || list_transform(range(l - len(x)), lambda i: 0), ',')) AS x, md5(array_to_string(y || list_transform(range(l - len(y)), lambda i: -100), ',')) AS y FROM b JOIN m USING (batch)"""
)
def b1_padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = ids(docs(spark, sf)).where("size(ids) > 0").select("doc_id", F.col("ids").alias("x"), F.slice("ids", 2, F.size("ids")).alias("y"))
    return _joined(windows.padded_batches(windows.batches(rows, "doc_id", 16), "batch", "x", "y"), "x", "y").select("doc_id", "batch", F.md5("x").alias("x"), F.md5("y").alias("y"))


@query("WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch, count(*) OVER () AS n FROM documents) SELECT doc_id, batch FROM r WHERE batch < n // 32")
def b2_full_batches(spark: SparkSession, sf: str) -> DataFrame:
    return windows.batches(docs(spark, sf).select("doc_id"), "doc_id", 32, drop_last=True).select("doc_id", "batch")


@query(
    f"""WITH b AS (SELECT v AS x, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM {_CS}), m AS (SELECT batch, max(len(x)) AS l FROM b GROUP BY batch),
    p AS (SELECT batch, sum(l - len(x) + len(list_filter(x, lambda c: c = 0))) AS pads, sum(l) AS total FROM b JOIN m USING (batch) GROUP BY batch)
    SELECT batch, CAST(pads AS BIGINT) AS pad_tokens, CAST(total AS BIGINT) AS total_tokens, round(pads::DOUBLE / total, 4) + 0 AS pad_ratio FROM p"""
)
def a8_padding_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = ids(docs(spark, sf)).where("size(ids) > 0").select("doc_id", F.col("ids").alias("x"))
    rows = windows.padded_batches(windows.batches(rows.withColumn("y", F.col("x")), "doc_id", 16), "batch", "x", "y")
    per = rows.groupBy("batch").agg(F.sum(F.size(F.filter("x", lambda v: v == 0))).alias("pad_tokens"), F.sum(F.size("x")).alias("total_tokens"))
    return per.select("batch", "pad_tokens", "total_tokens", (F.round(F.col("pad_tokens") / F.col("total_tokens"), 4) + 0.0).alias("pad_ratio"))


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def b3_shuffled_split(spark: SparkSession, sf: str) -> DataFrame:
    return windows.shuffled_split(docs(spark, sf).select("doc_id"), "doc_id").select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < greatest(1, floor((SELECT count(*) FROM documents) * 0.9)) THEN 'train' ELSE 'val' END AS split FROM documents")
def b4_ordered_split(spark: SparkSession, sf: str) -> DataFrame:
    return windows.ordered_split(docs(spark, sf).select("doc_id"), "doc_id", 0.9).select("doc_id", "split")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS i, count(*) OVER () AS n FROM documents),
    s AS (SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r)
    SELECT CAST((SELECT count(*) FROM (SELECT doc_id FROM s GROUP BY doc_id HAVING count(DISTINCT split) > 1)) + (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)) AS INTEGER) AS shared"""
)
def u4_splits_are_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Number of documents in two splits or in none; must be 0."""
    split = b3_shuffled_split(spark, sf)
    twice = split.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return twice.union(docs(spark, sf).select("doc_id").exceptAll(split.select("doc_id"))).agg(F.count("*").cast("int").alias("shared"))


_WEIGHTS = "SELECT experiment_id, unnest(map_keys(dataset_weights)) AS domain, unnest(map_values(dataset_weights)) AS w FROM pretraining_configs"
_P = f"SELECT experiment_id, domain, pow(w, 1 / 0.7) / sum(pow(w, 1 / 0.7)) OVER (PARTITION BY experiment_id) AS p FROM ({_WEIGHTS})"


def _probabilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/pretraining_configs.parquet").select("experiment_id", F.explode("dataset_weights").alias("domain", "w"))
    power = F.pow("w", F.lit(1 / 0.7))
    total = rows.groupBy("experiment_id").agg(F.sum(power).alias("total"))
    return rows.join(total, "experiment_id").select("experiment_id", "domain", (power / F.col("total")).alias("p"))


@query(f"SELECT experiment_id, domain, round(p, 6) AS p FROM ({_P})")
def b5_mixing_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return _probabilities(spark, sf).select("experiment_id", "domain", F.round("p", 6).alias("p"))


@query(
    f"""WITH c AS (SELECT domain, sum(round(p, 9)) OVER (ORDER BY domain) - round(p, 9) AS lo, sum(round(p, 9)) OVER (ORDER BY domain) AS hi FROM ({_P}) WHERE experiment_id = 'xp-harbor-flat'),
    d AS (SELECT i AS draw, CAST('0x' || substr(md5('42:' || i), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM range(20000) t(i))
    SELECT domain, count(*) AS draws FROM d JOIN c ON u >= lo AND u < hi GROUP BY domain"""
)
def b5_domain_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws with replacement by the inverse of the cumulative probabilities; the few domains are broadcast."""
    from pyspark.sql import Window

    p = _probabilities(spark, sf).where("experiment_id = 'xp-harbor-flat'").select("domain", F.round("p", 9).alias("p"))
    upto = F.sum("p").over(Window.orderBy("domain").rowsBetween(Window.unboundedPreceding, 0))
    bands = p.select("domain", (upto - F.col("p")).alias("lo"), upto.alias("hi"))
    draws = spark.range(20000).select(windows.uniform_hash(F.col("id")).alias("u"))
    return draws.join(F.broadcast(bands), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("domain").agg(F.count("*").alias("draws"))


@query("SELECT source_file, CAST((row_number() OVER (ORDER BY source_file) - 1) % 4 AS INTEGER) AS worker FROM (SELECT DISTINCT source_file FROM knowledge_documents WHERE source_file IS NOT NULL)")
def b6_worker_files(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.read.parquet(f"{sf}/knowledge_documents.parquet").where("source_file is not null").select("source_file", F.lit(1).alias("one")).distinct()
    return windows.running_offset(files, "source_file", "one").select("source_file", F.pmod("offset", F.lit(4)).cast("int").alias("worker"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, split_part(text, chr(10), CAST(i AS INTEGER)) AS content FROM (SELECT doc_id, text, unnest(range(2, 5)) AS i FROM documents WHERE text IS NOT NULL) WHERE i <= len(string_split(text, chr(10)))")
def g5_line_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return rows.where("i between 1 and 3").select("doc_id", (F.col("i") + 1).alias("line"), "content")


@query("SELECT doc_id || ':' || i || ': ' || content AS hit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(content, '(?i)TOKEN-bucket')")
def g4_grep(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return rows.where(F.col("content").rlike("(?i)TOKEN-bucket")).select(F.concat_ws("", F.col("doc_id"), F.lit(":"), F.col("i") + 1, F.lit(": "), "content").alias("hit"))
