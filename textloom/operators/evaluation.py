"""Evaluation, run and checkpoint analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import pass_at_k


def problem_counts(attempts: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    """``(keys..., n, c)``: attempts and passes of each problem."""
    return attempts.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(passed).alias("c"))


def mean_pass_at_k(counts: DataFrame, group: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean pass@k per group; problems with fewer than k samples are skipped, an empty mean is 0."""
    return counts.groupBy(group).agg(F.count("*").alias("problems"), *(F.round(F.coalesce(F.avg(pass_at_k(F.col("n"), F.col("c"), k)), F.lit(0.0)), 4).alias(f"pass_at_{k}") for k in ks))


def success_rates(attempts: DataFrame, group: str, compiled: Column, passed: Column) -> DataFrame:
    n = F.greatest(F.lit(1), F.count("*"))
    return attempts.groupBy(group).agg(F.count("*").alias("executions"), F.round(F.count_if(compiled) / n, 4).alias("compile_rate"), F.round(F.count_if(passed) / n, 4).alias("pass_rate"))


def leaderboard_rows(scores: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One markdown row per benchmark."""
    cells = F.concat_ws(" | ", F.upper(name), *(F.concat(F.lit("`"), F.format_string("%.4f", c), F.lit("`")) for c in columns))
    return scores.select(F.col(name).alias("benchmark"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def epoch_summary(log: DataFrame, epoch: str, step: str) -> DataFrame:
    """Means of loss, accuracy and per-step perplexity, the last rate, and the last positive gradient norm."""
    return log.groupBy(epoch).agg(
        F.round(F.avg("loss"), 6).alias("loss"),
        F.round(F.avg("accuracy"), 2).alias("accuracy"),
        F.round(F.avg("perplexity"), 4).alias("perplexity"),
        F.max_by("lr", step).alias("lr"),
        F.coalesce(F.max_by("grad_norm", F.when(F.col("grad_norm") > 0, F.col(step))), F.lit(0.0)).alias("grad_norm"),
        F.count("*").alias("steps"),
    )


def best_so_far(df: DataFrame, run: str, step: str, metric: str, *, lowest: bool = True) -> DataFrame:
    """Rows with ``is_best``: strictly better than everything before in its run; a missing metric never is."""
    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if lowest else F.max)(metric).over(before)
    better = F.col(metric) < best if lowest else F.col(metric) > best
    return df.withColumn("is_best", F.col(metric).isNotNull() & (best.isNull() | better))


def keep_newest(df: DataFrame, run: str, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each run: a bounded list per group, not a sort of it."""
    last = Window.partitionBy(run).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n).drop("_rn")


def ready_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks none of whose dependencies is unmet: ``nodes(plan, task, status)``, ``edges(plan, task, needs)``."""
    done = nodes.where("status = 'completed'").select("plan", F.col("task").alias("needs"))
    unmet = edges.join(done, ["plan", "needs"], "left_anti").select("plan", "task")
    return nodes.where("status = 'pending'").join(unmet, ["plan", "task"], "left_anti")


def parameter_groups(catalog: DataFrame) -> DataFrame:
    """``(component, parameters, decayed)`` of a catalog ``(name, ndim, numel)``.

    Vectors, biases and norms take no weight decay.
    """
    has = lambda part: F.contains("name", F.lit(part))
    component = F.when(has("embeddings"), "embedding").when(has("attention"), "attention").when(has("ffn"), "ffn").when(has("ln_"), "norm").otherwise("head")
    plain = (F.col("ndim") < 2) | has("bias") | has("ln_") | has("norm")
    return catalog.groupBy(component.alias("component")).agg(F.sum("numel").alias("parameters"), F.coalesce(F.sum(F.when(~plain, F.col("numel"))), F.lit(0)).alias("decayed"))
