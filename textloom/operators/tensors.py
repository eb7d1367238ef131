"""Model mathematics as relational operators over long tables ``(row, token, logit)`` and array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import dot


def logits(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``(row, token, logit)`` of an array column."""
    return vectors.select(F.col(key).alias("row"), F.posexplode(column).alias("token", "x")).select("row", "token", F.col("x").cast("double").alias("logit"))


def softmax(df: DataFrame, row: str, value: str, name: str = "p") -> DataFrame:
    """Rows with their probability within ``row``; each window is one vocabulary."""
    w = Window.partitionBy(row)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def temperature(value: Column, t: float) -> Column:
    return value / t if t > 0 else value


def top_k(df: DataFrame, row: str, value: str, k: int) -> DataFrame:
    """Rows with one of the k largest values of their row, all ties with the k-th included."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(row).orderBy(F.desc(value)))).where(F.col("_r") <= k).drop("_r")


def top_p(df: DataFrame, row: str, token: str, value: str, p: float) -> DataFrame:
    """The nucleus: tokens before whose turn the cumulative probability is at most p (ties by token)."""
    order = Window.partitionBy(row).orderBy(F.desc(value), token).rowsBetween(Window.unboundedPreceding, 0)
    scored = softmax(df, row, value, "p")
    return scored.withColumn("_c", F.round(F.sum("p").over(order) - F.col("p"), 9)).where(F.col("_c") <= p).drop("_c")


def sample(df: DataFrame, row: str, token: str, value: str, uniform: Column) -> DataFrame:
    """One token per row by the inverse of the cumulative distribution at a uniform number of the row."""
    order = Window.partitionBy(row).orderBy(token).rowsBetween(Window.unboundedPreceding, 0)
    scored = softmax(df, row, value, "p").withColumn("upto", F.round(F.sum("p").over(order), 9)).withColumn("u", uniform)
    return scored.where(F.col("upto") >= F.col("u")).groupBy(row).agg(F.min(token).alias(token))


def repetition_penalty(df: DataFrame, row: str, token: str, value: str, seen: DataFrame, penalty: float) -> DataFrame:
    """Logits of tokens in ``seen(row, token)`` made less likely: negative ones times, others over the penalty."""
    flag = seen.select(F.col("row").alias("_r"), F.col("token").alias("_t")).distinct().withColumn("_seen", F.lit(True))
    joined = df.join(flag, (df[row] == flag._r) & (df[token] == flag._t), "left")
    v = F.col(value)
    return joined.withColumn(value, F.when(F.col("_seen"), F.when(v < 0, v * penalty).otherwise(v / penalty)).otherwise(v)).drop("_r", "_t", "_seen")


def cross_entropy(scores: DataFrame, targets: DataFrame, *, ignore: int = -100, smoothing: float = 0.0) -> DataFrame:
    """One row: mean loss, accuracy in per cent, perplexity and counted positions.

    ``scores(seq, pos, token, logit)`` at a position predicts ``targets(seq, pos,
    token)`` at the next; the shift is a join on the position plus one, so no
    window is needed.  Ignored and missing targets do not count.
    """
    scaled = scores.groupBy("seq", "pos").agg(F.max("logit").alias("m"), F.max_by("token", F.struct("logit", -F.col("token"))).alias("best"), F.collect_list(F.struct("token", "logit")).alias("all"))
    log_sum = F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda s, t: s + F.exp(t["logit"] - F.col("m"))))
    wanted = targets.where(F.col("token") != ignore).select("seq", (F.col("pos") - 1).alias("pos"), F.col("token").alias("want"))
    rows = scaled.withColumn("lse", log_sum).join(wanted, ["seq", "pos"])
    own = F.aggregate("all", F.lit(None).cast("double"), lambda s, t: F.when(t["token"] == F.col("want"), t["logit"]).otherwise(s))
    mean = F.aggregate("all", F.lit(0.0), lambda s, t: s + t["logit"]) / F.size("all")
    loss = (1 - smoothing) * (F.col("lse") - own) + smoothing * (F.col("lse") - mean)
    out = rows.select(loss.alias("loss"), (F.col("best") == F.col("want")).alias("right")).agg(F.avg("loss").alias("l"), F.avg(F.col("right").cast("double")).alias("a"), F.count("*").alias("positions"))
    return out.select(F.round("l", 6).alias("loss"), F.round(F.coalesce("a", F.lit(0.0)) * 100, 2).alias("accuracy"), F.round(F.exp(F.least("l", F.lit(100.0))), 4).alias("perplexity"), "positions")


def causal_attention(vectors: DataFrame, seq: str, pos: str, column: str) -> DataFrame:
    """``(seq, q, k, p)``: scaled dot-product attention of each position to those at or before it in its sequence."""
    q = vectors.select(F.col(seq).alias("seq"), F.col(pos).alias("q"), F.col(column).alias("qv"))
    k = vectors.select(F.col(seq).alias("seq"), F.col(pos).alias("k"), F.col(column).alias("kv"))
    scores = q.join(k, "seq").where("k <= q").select("seq", "q", "k", (dot(F.col("qv"), F.col("kv")) / F.sqrt(F.size("qv"))).alias("s"))
    return softmax(scores.withColumn("at", F.struct("seq", "q")), "at", "s").select("seq", "q", "k", "p")


def attention_statistics(weights: DataFrame) -> DataFrame:
    """One row: mean entropy over queries, largest weight, share of weights under 1e-4."""
    per = weights.groupBy("seq", "q").agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)).alias("h"), F.max("p").alias("m"), F.count_if(F.col("p") < 1e-4).alias("z"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("h"), 6).alias("mean_entropy"), F.round(F.max("m"), 6).alias("max_weight"), F.round(F.sum("z") / F.sum("n"), 6).alias("sparsity"))


def cosine_warmup(step: Column, *, base: float, lowest: float, warmup: int, total: int) -> Column:
    """Linear to ``base``, then half a cosine down to ``lowest``, and ``lowest`` after ``total`` steps."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, base * step / float(max(1, warmup))).when(step > total, lowest).otherwise(lowest + 0.5 * (base - lowest) * (1 + F.cos(F.lit(math.pi) * progress)))


def step_decay(step: Column, *, base: float, size: int, gamma: float) -> Column:
    return base * F.pow(F.lit(gamma), F.floor(step / size))


def sinusoidal(pos: Column, dim: Column, width: int) -> Column:
    """Sine on even and cosine on odd dimensions of a position table."""
    angle = pos * F.exp((dim - dim % 2) * F.lit(-math.log(10000.0) / width))
    return F.when(dim % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
