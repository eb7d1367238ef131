"""Queries of evaluation, run and registry analytics over the event log.

An event stands for an attempt (click: passed, error: did not compile), a
training step (the value is its loss) or a checkpoint, as each query says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.arrays import pass_at_k
from textloom.operators import evaluation as V
from textloom.plans.registry import query

PASS = "CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k}::DOUBLE / i)) END"
COUNTS = "SELECT 'suite' || user_id % 3 AS suite, user_id AS problem, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1, 2"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.concat(F.lit("suite"), F.col("user_id") % 3).alias("suite"), F.col("user_id").alias("problem"), "event_type")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.problem_counts(_attempts(spark, sf), ["suite", "problem"], F.col("event_type") == "click")


@query(f"SELECT suite, problem, n, c, round({PASS.format(k=5)}, 6) AS pass_at_5 FROM ({COUNTS})")
def a9_pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf).withColumn("pass_at_5", F.round(pass_at_k(F.col("n"), F.col("c"), 5), 6))


_MEANS = ", ".join(f"round(coalesce(avg({PASS.format(k=k)}), 0.0), 4) AS pass_at_{k}" for k in (1, 5, 10))


@query(f"SELECT suite, count(*) AS problems, {_MEANS} FROM ({COUNTS}) GROUP BY suite")
def a10_mean_pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return V.mean_pass_at_k(_counts(spark, sf), "suite")


@query("SELECT 'suite' || user_id % 3 AS suite, count(*) AS executions, round(count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(*), 4) AS compile_rate, round(count(*) FILTER (WHERE event_type = 'click')::DOUBLE / count(*), 4) AS pass_rate FROM events GROUP BY 1")
def a11_success_rates(spark: SparkSession, sf: str) -> DataFrame:
    return V.success_rates(_attempts(spark, sf), "suite", F.col("event_type") != "error", F.col("event_type") == "click")


@query(f"SELECT suite AS benchmark, '| ' || upper(suite) || ' | ' || format('`{{:.4f}}`', pass_at_1) || ' | ' || format('`{{:.4f}}`', pass_at_5) || ' | ' || format('`{{:.4f}}`', pass_at_10) || ' |' AS line FROM (SELECT suite, {_MEANS} FROM ({COUNTS}) GROUP BY suite)")
def a12_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return V.leaderboard_rows(V.mean_pass_at_k(_counts(spark, sf), "suite"), "suite", ["pass_at_1", "pass_at_5", "pass_at_10"])


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events of a user are a run's steps: loss, and what the metrics derive from it."""
    v = F.col("value")
    return events(spark, sf).select(
        F.col("user_id").alias("epoch"), F.col("event_id").alias("step"), v.alias("loss"), (100 / (1 + v)).alias("accuracy"), F.exp(F.least(v, F.lit(5.0))).alias("perplexity"),
        (F.lit(1.0) / (1 + F.col("event_id"))).alias("lr"), F.when(F.col("event_type") == "error", 0.0).otherwise(v / 2).alias("grad_norm"),
    )


@query(
    """SELECT user_id AS epoch, round(avg(value), 6) AS loss, round(avg(100 / (1 + value)), 2) AS accuracy, round(avg(exp(least(value, 5.0))), 4) AS perplexity, arg_max(1.0::DOUBLE / (1 + event_id), event_id) AS lr,
    coalesce(arg_max(value / 2, event_id) FILTER (WHERE event_type <> 'error' AND value > 0), 0.0) AS grad_norm, count(*) AS steps FROM events GROUP BY user_id"""
)
def a13_epoch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return V.epoch_summary(_log(spark, sf), "epoch", "step")


@query("SELECT user_id AS run, round(avg(value), 6) AS loss, round(exp(least(avg(value), 20.0)), 4) AS perplexity FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 10 GROUP BY user_id")
def a14_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean loss of the first ten batches of each run."""
    first = V.keep_newest(events(spark, sf).select(F.col("user_id").alias("run"), (-F.col("event_id")).alias("o"), "value"), "run", "o", 10)
    return first.groupBy("run").agg(F.round(F.avg("value"), 6).alias("loss"), F.round(F.exp(F.least(F.avg("value"), F.lit(20.0))), 4).alias("perplexity"))


@query("SELECT user_id AS run, max(event_id) AS last_step, arg_max(value, event_id) AS last_value, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def a15_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    last = events(spark, sf).groupBy(F.col("user_id").alias("run")).agg(F.max_by(F.struct(F.col("event_id").alias("last_step"), F.col("value").alias("last_value"), F.col("event_type").alias("last_type")), "event_id").alias("m"))
    return last.select("run", "m.*")


@query("SELECT count(*) AS files, CAST(sum(length(props)) AS BIGINT) AS bytes, max(CAST(regexp_extract('checkpoint_step_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.pt', 'step_([0-9]+)', 1) AS BIGINT)) AS latest_step, bool_or(event_type = 'purchase') AS has_best FROM events")
def a22_checkpoint_stats(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("checkpoint_step_"), F.lpad(F.col("event_id").cast("string"), 6, "0"), F.lit(".pt"))
    rows = events(spark, sf).select(name.alias("name"), F.length("props").alias("bytes"), (F.col("event_type") == "purchase").alias("best"))
    return rows.agg(F.count("*").alias("files"), F.sum("bytes").cast("bigint").alias("bytes"), F.max(F.regexp_extract("name", r"step_([0-9]+)", 1).cast("bigint")).alias("latest_step"), F.bool_or("best").alias("has_best"))


@query("SELECT event_type, round(sum(user_id)::DOUBLE / greatest(1e-5, sum(value)), 6) AS tokens_per_second, round(min(value), 6) AS first_token, round(avg(value), 6) AS mean_latency FROM events GROUP BY event_type")
def a23_throughput(spark: SparkSession, sf: str) -> DataFrame:
    t = F.sum("value")
    return events(spark, sf).groupBy("event_type").agg(F.round(F.sum("user_id") / F.greatest(F.lit(1e-5), t), 6).alias("tokens_per_second"), F.round(F.min("value"), 6).alias("first_token"), F.round(F.avg("value"), 6).alias("mean_latency"))


@query("SELECT event_id, user_id, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value IS NOT NULL) AS is_best FROM events")
def w9_best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    return V.best_so_far(events(spark, sf), "user_id", "event_id", "value").select("event_id", "user_id", "is_best")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'purchase') WHERE rn <= 3")
def w10_retention(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three checkpoints of each run; the best model is not rotated."""
    rows = events(spark, sf).where("event_type <> 'purchase'").select("event_id", "user_id", F.struct("ts", "event_id").alias("age"))
    return V.keep_newest(rows, "user_id", "age", 3).select("event_id", "user_id")


@query("WITH b AS (SELECT *, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM events) SELECT user_id, max(event_id) FILTER (WHERE best) AS best_event, arg_max(value, event_id) FILTER (WHERE best) AS best_value, max(event_id) AS latest_event FROM b GROUP BY user_id")
def w11_best_and_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last best record of a run is the one with the smallest value, the first of ties: no window is needed."""
    best = F.min_by(F.struct("event_id", "value"), F.struct("value", "event_id"))
    return events(spark, sf).groupBy("user_id").agg(best.alias("b"), F.max("event_id").alias("latest_event")).select("user_id", F.col("b.event_id").alias("best_event"), F.col("b.value").alias("best_value"), "latest_event")


@query("SELECT event_id, CASE WHEN event_id >= 5000 THEN 'second' ELSE 'first' END AS phase, event_id = 5000 AS switches FROM events")
def w15_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """A one-shot phase switch at a step threshold."""
    step = F.col("event_id")
    return events(spark, sf).select("event_id", F.when(step >= 5000, "second").otherwise("first").alias("phase"), (step == 5000).alias("switches"))


@query("SELECT event_id, (event_id + 1) % 8 = 0 AS boundary FROM events")
def w16_accumulation(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", (F.pmod(F.col("event_id") + 1, F.lit(8)) == 0).alias("boundary"))


@query("SELECT user_id, round(100.0::DOUBLE * count(*) / 400, 4) AS percent, round(epoch(max(ts)) - epoch(min(ts)), 3) AS elapsed FROM events GROUP BY user_id")
def progress_p9(spark: SparkSession, sf: str) -> DataFrame:
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return events(spark, sf).groupBy("user_id").agg(F.round(100.0 * F.count("*") / 400, 4).alias("percent"), F.round(seconds(F.max("ts")) - seconds(F.min("ts")), 3).alias("elapsed"))


_PLAN = "n AS (SELECT user_id AS plan, event_id AS task, CASE WHEN event_type IN ('click', 'view') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS needs FROM events)"


def _plans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events are a chain of tasks."""
    from pyspark.sql import Window

    status = F.when(F.col("event_type").isin("click", "view"), "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    rows = events(spark, sf).select(F.col("user_id").alias("plan"), F.col("event_id").alias("task"), status.alias("status"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("needs"))
    return rows.select("plan", "task", "status"), rows.where("needs is not null").select("plan", "task", "needs")


@query(f"WITH {_PLAN} SELECT n.plan, n.task FROM n LEFT JOIN n d ON d.plan = n.plan AND d.task = n.needs WHERE n.status = 'pending' AND (n.needs IS NULL OR d.status = 'completed')")
def j9_ready_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return V.ready_tasks(*_plans(spark, sf)).select("plan", "task")


@query(f"WITH {_PLAN} SELECT n.plan, min(n.task) FILTER (WHERE n.status = 'pending' AND (n.needs IS NULL OR d.status = 'completed')) AS next_task, bool_and(n.status = 'completed') AS completed FROM n LEFT JOIN n d ON d.plan = n.plan AND d.task = n.needs GROUP BY n.plan")
def g1_plan_state(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _plans(spark, sf)
    state = nodes.groupBy("plan").agg(F.bool_and(F.col("status") == "completed").alias("completed"))
    following = V.ready_tasks(nodes, edges).groupBy("plan").agg(F.min("task").alias("next_task"))
    return state.join(following, "plan", "left").select("plan", "next_task", "completed")
