"""Queries of the model mathematics, over the embeddings table as vectors, logits or sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.operators import tensors as X
from textloom.operators.retrieval import nearest_to_rows
from textloom.operators.windows import uniform_hash
from textloom.plans.registry import query

LONG = 'long AS (SELECT vec_id AS "row", unnest(embedding)::DOUBLE AS logit, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS token FROM embeddings)'
SOFT = f'{LONG}, mx AS (SELECT *, max(logit) OVER (PARTITION BY "row") AS m FROM long), soft AS (SELECT "row", token, logit, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY "row") AS p FROM mx)'
VALUES = "SELECT unnest(embedding)::DOUBLE AS x FROM embeddings"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def long(spark: SparkSession, sf: str) -> DataFrame:
    return X.logits(vectors(spark, sf), "vec_id", "embedding")


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


@query(f"SELECT a.vec_id, round({_dot('a.embedding', 'b.embedding')}, 5) + 0 AS dot, round(sqrt({_dot('a.embedding', 'a.embedding')}), 5) AS norm, round({_dot('a.embedding', 'b.embedding')} / greatest(sqrt({_dot('a.embedding', 'a.embedding')}) * sqrt({_dot('b.embedding', 'b.embedding')}), 1e-8), 5) + 0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m5_dot_norm_cosine(spark: SparkSession, sf: str) -> DataFrame:
    a, b = vectors(spark, sf).select("vec_id", F.col("embedding").alias("a")), vectors(spark, sf).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, "vec_id").select("vec_id", (F.round(A.dot(x, y), 5) + 0.0).alias("dot"), F.round(A.norm(x), 5).alias("norm"), (F.round(A.cosine(x, y), 5) + 0.0).alias("cosine"))


@query(f'WITH {SOFT} SELECT "row", token, round(p, 6) AS p, round(ln(p), 6) + 0 AS log_p FROM soft')
def m6_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return X.softmax(long(spark, sf), "row", "logit").select("row", "token", F.round("p", 6).alias("p"), (F.round(F.log("p"), 6) + 0.0).alias("log_p"))


@query(f'WITH {LONG} SELECT "row", token, round(greatest(logit, 0), 6) + 0 AS relu, round(logit / (1 + exp(-logit)), 6) + 0 AS silu FROM long')
def m7_activations(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("logit")
    return long(spark, sf).select("row", "token", (F.round(F.greatest(x, F.lit(0.0)), 6) + 0.0).alias("relu"), (F.round(x / (1 + F.exp(-x)), 6) + 0.0).alias("silu"))


@query(f"WITH s AS (SELECT a.vec_id AS query, b.vec_id, round({_dot('a.embedding', 'b.embedding')} / sqrt({_dot('a.embedding', 'a.embedding')}), 5) + 0 AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT CAST(query AS VARCHAR) AS query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def k5_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows, itself excluded."""
    asked = vectors(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vector"))
    out = nearest_to_rows(vectors(spark, sf), "vec_id", "embedding", asked, 5, digits=5, exclude_self=True)
    return out.withColumn("score", F.col("score") + 0.0)


@query(f'WITH {LONG}, r AS (SELECT *, rank() OVER (PARTITION BY "row" ORDER BY logit DESC) AS rk FROM long) SELECT "row", token, round(logit, 6) + 0 AS logit FROM r WHERE rk <= 8')
def k6_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_k(long(spark, sf), "row", "logit", 8).select("row", "token", (F.round("logit", 6) + 0.0).alias("logit"))


@query(f'WITH {LONG} SELECT "row", min(token) AS token FROM long JOIN (SELECT "row" AS r, max(logit) AS m FROM long GROUP BY 1) ON r = "row" AND m = logit GROUP BY "row"')
def k7_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return long(spark, sf).groupBy("row").agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("token"))


@query(f'WITH {LONG}, r AS (SELECT *, row_number() OVER (ORDER BY logit DESC, "row", token) AS rk FROM long) SELECT "row", token, round(logit, 6) AS logit FROM r WHERE rk <= 25')
def k8_largest_logits(spark: SparkSession, sf: str) -> DataFrame:
    return long(spark, sf).orderBy(F.desc("logit"), "row", "token").limit(25).select("row", "token", F.round("logit", 6).alias("logit"))


@query(f'WITH {SOFT}, c AS (SELECT *, round(sum(p) OVER (PARTITION BY "row" ORDER BY logit DESC, token ROWS UNBOUNDED PRECEDING) - p, 9) AS before FROM soft) SELECT "row", token FROM c WHERE before <= 0.3')
def w13_nucleus(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_p(long(spark, sf), "row", "token", "logit", 0.3).select("row", "token")


@query(f'WITH {LONG} SELECT "row", token, round(logit / 0.7, 6) + 0 AS logit FROM long')
def n1_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return long(spark, sf).select("row", "token", (F.round(X.temperature(F.col("logit"), 0.7), 6) + 0.0).alias("logit"))


@query(
    f"""WITH {LONG}, k AS (SELECT *, rank() OVER (PARTITION BY "row" ORDER BY logit DESC) AS rk FROM long), t AS (SELECT "row", token, logit / 0.8 AS logit FROM k WHERE rk <= 20),
    m AS (SELECT *, max(logit) OVER (PARTITION BY "row") AS m FROM t), s AS (SELECT "row", token, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY "row") AS p FROM m),
    c AS (SELECT "row", token, round(sum(p) OVER (PARTITION BY "row" ORDER BY token ROWS UNBOUNDED PRECEDING), 9) AS upto, CAST('0x' || substr(md5('42:' || "row"), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s)
    SELECT "row", min(token) AS token FROM c WHERE upto >= u GROUP BY "row\""""
)
def n2_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Temperature, top-k, softmax and a draw at a hashed uniform number."""
    kept = X.top_k(long(spark, sf), "row", "logit", 20).withColumn("logit", X.temperature(F.col("logit"), 0.8))
    return X.sample(kept, "row", "token", "logit", uniform_hash(F.col("row")))


@query(f'WITH {LONG} SELECT "row", token, round(CASE WHEN token % 5 = "row" % 5 THEN CASE WHEN logit < 0 THEN logit * 1.2::DOUBLE ELSE logit / 1.2::DOUBLE END ELSE logit END, 6) + 0 AS logit FROM long')
def n3_repetition_penalty(spark: SparkSession, sf: str) -> DataFrame:
    seen = long(spark, sf).where("token % 5 = row % 5").select("row", "token")
    return X.repetition_penalty(long(spark, sf), "row", "token", "logit", seen, 1.2).select("row", "token", (F.round("logit", 6) + 0.0).alias("logit"))


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of a label in id order are a sequence."""
    return vectors(spark, sf).select("label", "vec_id", "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("pos"))


@query(
    """WITH s AS (SELECT label, embedding::DOUBLE[] AS e, vec_id % 64 AS want, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
    t AS (SELECT a.e, CAST(b.want AS BIGINT) AS want FROM s a JOIN s b ON a.label = b.label AND b.pos = a.pos + 1 WHERE b.want <> 7),
    l AS (SELECT ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) + list_max(e) - e[want + 1] AS loss, list_position(e, list_max(e)) - 1 = want AS ok FROM t)
    SELECT round(avg(loss), 6) AS loss, round(avg(CAST(ok AS DOUBLE)) * 100, 2) AS accuracy, round(exp(least(avg(loss), 100)), 4) AS perplexity, count(*) AS positions FROM l"""
)
def n5_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    seqs = _sequences(spark, sf)
    scores = seqs.select(F.col("label").alias("seq"), "pos", F.posexplode("embedding").alias("token", "x")).select("seq", "pos", "token", F.col("x").cast("double").alias("logit"))
    return X.cross_entropy(scores, seqs.select(F.col("label").alias("seq"), "pos", (F.col("vec_id") % 64).cast("int").alias("token")), ignore=7)


@query("SELECT i AS step, round(CASE WHEN i < 100 THEN 3e-4::DOUBLE * i / 100 WHEN i > 1000 THEN 3e-5::DOUBLE ELSE 3e-5::DOUBLE + 0.5 * (3e-4::DOUBLE - 3e-5::DOUBLE) * (1 + cos(pi() * (i - 100)::DOUBLE / 900)) END, 9) + 0 AS lr FROM range(1200) t(i)")
def n6_cosine_warmup(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1200).select(F.col("id").alias("step"), (F.round(X.cosine_warmup(F.col("id"), base=3e-4, lowest=3e-5, warmup=100, total=1000), 9) + 0.0).alias("lr"))


@query("SELECT i AS step, round(1e-2::DOUBLE * pow(0.5, i // 100), 12) AS lr FROM range(1200) t(i)")
def n7_step_decay(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1200).select(F.col("id").alias("step"), F.round(X.step_decay(F.col("id"), base=1e-2, size=100, gamma=0.5), 12).alias("lr"))


_ANGLE = f"p * exp((d - d % 2) * {-math.log(10000.0) / 32!r}::DOUBLE)"


@query(f"SELECT p AS pos, d AS dim, round(CASE WHEN d % 2 = 0 THEN sin({_ANGLE}) ELSE cos({_ANGLE}) END, 6) + 0 AS x FROM range(128) a(p), range(32) b(d)")
def n8_sinusoidal(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.range(128).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(31).cast("bigint"))).alias("dim"))
    return table.select("pos", "dim", (F.round(X.sinusoidal(F.col("pos"), F.col("dim"), 32), 6) + 0.0).alias("x"))


@query("SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos, vec_id FROM embeddings")
def n9_position_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _sequences(spark, sf).select("label", "pos", "vec_id")


@query("WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), v AS (SELECT vec_id, e, m, list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e) AS v FROM s) SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS dim, round((unnest(e) - m) / sqrt(v + 1e-5), 5) + 0 AS x FROM v")
def n10_layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", F.posexplode(A.layer_norm(F.col("embedding"))).alias("dim", "x")).select("vec_id", "dim", (F.round("x", 5) + 0.0).alias("x"))


_ATTENTION = f"""s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings),
    sc AS (SELECT a.label AS seq, a.pos AS q, b.pos AS k, {_dot('a.embedding', 'b.embedding')} / sqrt(len(a.embedding)) AS s FROM s a JOIN s b ON a.label = b.label AND b.pos <= a.pos),
    mx AS (SELECT *, max(s) OVER (PARTITION BY seq, q) AS m FROM sc), att AS (SELECT seq, q, k, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY seq, q) AS p FROM mx)"""


@query(f"WITH {_ATTENTION} SELECT seq, CAST(q AS INTEGER) AS q, CAST(k AS INTEGER) AS k, round(p, 5) AS p FROM att")
def n11_causal_attention(spark: SparkSession, sf: str) -> DataFrame:
    return X.causal_attention(_sequences(spark, sf), "label", "pos", "embedding").withColumn("p", F.round("p", 5))


@query(f"WITH {_ATTENTION} SELECT seq, CAST(q AS INTEGER) AS q, CAST(d AS INTEGER) AS dim, round(sum(p * x), 5) + 0 AS x FROM (SELECT att.seq, q, p, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM att JOIN s ON s.label = att.seq AND s.pos = att.k) GROUP BY ALL")
def j7_attention_output(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted sum of the values each query attends to."""
    seqs = _sequences(spark, sf)
    weights = X.causal_attention(seqs, "label", "pos", "embedding")
    values = seqs.select(F.col("label").alias("seq"), F.col("pos").alias("k"), F.posexplode("embedding").alias("dim", "x"))
    out = weights.join(values, ["seq", "k"]).groupBy("seq", "q", "dim").agg(F.sum(F.col("p") * F.col("x").cast("double")).alias("x"))
    return out.withColumn("x", F.round("x", 5) + 0.0)


@query(f"WITH {_ATTENTION}, h AS (SELECT seq, q, sum(-p * ln(p + 1e-12)) AS h, max(p) AS m, count(*) FILTER (WHERE p < 1e-4) AS z, count(*) AS n FROM att GROUP BY seq, q) SELECT round(avg(h), 6) AS mean_entropy, round(max(m), 6) AS max_weight, round(sum(z)::DOUBLE / sum(n), 6) AS sparsity FROM h")
def a17_attention_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return X.attention_statistics(X.causal_attention(_sequences(spark, sf), "label", "pos", "embedding"))


@query("WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings) SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(list_transform(e, lambda x: round_even(x / scale, 0))) AS BIGINT) AS code_sum FROM s")
def n12_quantize(spark: SparkSession, sf: str) -> DataFrame:
    codes = A.quantize_int8(F.col("embedding"))
    return vectors(spark, sf).select("vec_id", F.round(A.quantize_scale(F.col("embedding")), 9).alias("scale"), F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: s + c).alias("code_sum"))


@query("SELECT count(*) FILTER (WHERE label <> 0) AS counted, count(*) FILTER (WHERE label = 0) AS ignored FROM embeddings")
def a16_target_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).agg(F.count_if(F.col("label") != 0).alias("counted"), F.count_if(F.col("label") == 0).alias("ignored"))


@query(
    f"""WITH v AS ({VALUES}), n AS (SELECT sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings)
    SELECT round(avg(x), 6) + 0 AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS lowest, round(max(x), 6) AS highest, (SELECT round(avg(n), 5) FROM n) AS mean_norm, (SELECT round(min(n), 5) FROM n) AS min_norm, (SELECT count(*) FROM n WHERE n = 0) AS zero_vectors FROM v"""
)
def a18_embedding_statistics(spark: SparkSession, sf: str) -> DataFrame:
    n = A.norm(F.col("embedding"))
    norms = vectors(spark, sf).agg(F.round(F.avg(n), 5).alias("mean_norm"), F.round(F.min(n), 5).alias("min_norm"), F.count_if(n == 0).alias("zero_vectors"))
    x = F.col("logit")
    stats = long(spark, sf).agg((F.round(F.avg(x), 6) + 0.0).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.round(F.min(x), 6).alias("lowest"), F.round(F.max(x), 6).alias("highest"))
    return stats.crossJoin(norms)


@query(f"SELECT round(avg(x), 6) + 0 AS mean, round(max(abs(x)), 6) AS max_abs, round(count(*) FILTER (WHERE greatest(x, 0) = 0)::DOUBLE / count(*), 6) AS sparsity FROM ({VALUES})")
def a19_activation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("logit")
    return long(spark, sf).agg((F.round(F.avg(x), 6) + 0.0).alias("mean"), F.round(F.max(F.abs(x)), 6).alias("max_abs"), F.round(F.count_if(F.greatest(x, F.lit(0.0)) == 0) / F.count("*"), 6).alias("sparsity"))


@query(f'WITH {LONG} SELECT "row", round(avg(logit), 6) + 0 AS mean, round(var_pop(logit), 6) AS variance, round(sqrt(sum(logit * logit)), 6) AS l2, round(min(logit), 6) AS lowest, round(max(logit), 6) AS highest FROM long GROUP BY "row"')
def a20_logit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("logit")
    return long(spark, sf).groupBy("row").agg((F.round(F.avg(x), 6) + 0.0).alias("mean"), F.round(F.var_pop(x), 6).alias("variance"), F.round(F.sqrt(F.sum(x * x)), 6).alias("l2"), F.round(F.min(x), 6).alias("lowest"), F.round(F.max(x), 6).alias("highest"))


@query("SELECT d.doc_id, count(*) AS looked_up, round(sum(e.embedding[1]::DOUBLE * sqrt(64::DOUBLE)), 4) + 0 AS total FROM (SELECT doc_id, unnest(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c))) AS id FROM documents WHERE text IS NOT NULL) d JOIN embeddings e ON e.vec_id = d.id GROUP BY d.doc_id")
def j12_embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the embedding table for the ids of each text, scaled by the root of the width; ids are counted per text before the join."""
    codes = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    ids = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", F.explode(codes).alias("id")).groupBy("doc_id", "id").count()
    table = vectors(spark, sf).select("vec_id", (F.element_at("embedding", 1).cast("double") * F.sqrt(F.lit(64.0))).alias("x"))
    joined = ids.join(table, ids.id == table.vec_id).groupBy("doc_id")
    return joined.agg(F.sum("count").alias("looked_up"), F.sum(F.col("x") * F.col("count")).alias("total")).withColumn("total", F.round("total", 4) + 0.0)
