"""Mixing sources to target weights, by weighted fair queueing.

Each domain's documents are put in a hashed order; a document's virtual finish
time is the cumulative tokens of its domain up to its end, divided by the
domain's weight, and a second use of the domain continues where the first ended.
Sorting all uses by virtual finish time and cutting at the total budget serves
every domain in proportion to its weight until its repeats are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize

BUCKETS = 1024


def shuffle_key(key: Column, seed: int) -> Column:
    """Place of a document in the shuffled order of its domain: the first 60 bits of the MD5 of ``key:seed``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def domain_targets(configs: DataFrame) -> DataFrame:
    """``(experiment_id, size_factor, max_repeats, domain, weight)``; weights are relative, names without regard to case."""
    rows = configs.select("experiment_id", "size_factor", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.explode("dataset_weights").alias("name", "w"))
    return (
        rows.where("experiment_id is not null and size_factor is not null and w > 0")
        .groupBy("experiment_id", "size_factor", "max_repeats", F.lower(F.trim("name")).alias("domain"))
        .agg(F.sum("w").alias("weight"))
    )


def _running(rows: DataFrame, key: str, order: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` per ``key`` in two levels: over the buckets, then inside each bucket.

    Every window holds one bucket or one key's row per bucket, never a whole key.
    """
    sums = rows.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum(value).over(Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before.select(key, bucket, F.coalesce("_before", F.lit(0)).alias("_before")), [key, bucket]).withColumn(name, F.col("_before") + inside).drop("_before")


def mix_to_weights(docs: DataFrame, configs: DataFrame, *, seed: int = 42) -> DataFrame:
    """Chosen documents ``(experiment_id, domain, doc_id, repeats, n_tokens)``.

    ``docs`` has ``doc_id, domain, n_tokens``.  A document is used at most
    ``max_repeats`` times, and the sum of ``repeats * n_tokens`` is at most
    ``size_factor`` times the tokens of all documents with a weighted domain:
    uses are taken in the order of their virtual finish time up to the first
    that would pass the budget.  Documents with a null id or domain or without
    tokens are not chosen; a weighted domain without documents gets nothing and
    the others share its part; duplicates of a ``doc_id`` count once.
    """
    targets = domain_targets(configs)
    own = docs.select("doc_id", F.lower(F.trim("domain")).alias("domain"), "n_tokens").where("doc_id is not null and domain is not null and n_tokens > 0")
    own = own.groupBy("doc_id").agg(F.min(F.struct("domain", "n_tokens")).alias("v")).select("doc_id", "v.*")
    own = own.join(targets.select("domain").distinct(), "domain", "left_semi").withColumn("h", shuffle_key(F.col("doc_id"), seed))
    buckets = max(BUCKETS, own.sparkSession.sparkContext.defaultParallelism * 8)
    own = own.withColumn("bucket", F.floor(F.col("h") / float(1 << 60) * buckets))
    queue = materialize(_running(own, "domain", ["h", "doc_id"], "bucket", "n_tokens", "served"), "queue")
    totals = queue.groupBy("domain").agg(F.sum("n_tokens").alias("domain_tokens"), F.max("n_tokens").alias("longest"))
    plan = targets.join(totals, "domain")
    of = Window.partitionBy("experiment_id")
    plan = plan.withColumn("budget", F.floor(F.col("size_factor") * F.sum("domain_tokens").over(of))).withColumn("max_repeats", F.greatest("max_repeats", F.lit(0)))
    # no use finishes before the budget is spent later than when the domains that can run longest share it alone
    plan = plan.withColumn("spent_by", _time_budget_is_spent(of))
    uses = plan.withColumn(
        "passes",
        F.least("max_repeats", F.coalesce(F.floor((F.col("spent_by") * F.col("weight") + F.col("longest")) / F.col("domain_tokens")) + 1, F.col("max_repeats"))).cast("int"),
    ).where("passes > 0")
    items = queue.join(uses, "domain").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    items = items.withColumn("finish", ((F.col("use") - 1) * F.col("domain_tokens") + F.col("served")) / F.col("weight"))
    items = items.select("experiment_id", "domain", "doc_id", "n_tokens", "use", "finish", "budget", F.floor(F.col("finish") / F.greatest("spent_by", F.lit(1.0)) * buckets).alias("slot"))
    items = materialize(items, "uses")
    slots = items.groupBy("experiment_id", "slot").agg(F.sum("n_tokens").alias("size"), F.first("budget").alias("budget"))
    slots = slots.withColumn("upto", F.sum("size").over(Window.partitionBy("experiment_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    slots = slots.where("upto - size < budget").select("experiment_id", "slot", (F.col("upto") - F.col("size")).alias("before"), (F.col("upto") <= F.col("budget")).alias("whole"))
    near = items.join(slots, ["experiment_id", "slot"])
    last = near.where("not whole")  # one slot of each experiment
    order = Window.partitionBy("experiment_id", "slot").orderBy("finish", "domain", "use", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("before") + F.sum("n_tokens").over(order)).where("upto <= budget").drop("upto")
    chosen = near.where("whole").union(last)
    return chosen.groupBy("experiment_id", "domain", "doc_id").agg(F.count("*").alias("repeats"), F.max("n_tokens").alias("n_tokens"))


def _time_budget_is_spent(of: Window):
    """Virtual time at which the budget is spent, from the domains' totals alone (water filling).

    A domain runs dry at ``max_repeats * domain_tokens / weight``.  The answer is
    the smallest t with sum(min(weight * t, capacity)) >= budget, null if the
    capacity is too small.
    """
    domains = F.collect_list(F.struct(F.col("weight").alias("w"), (F.col("max_repeats") * F.col("domain_tokens")).alias("c"))).over(of)
    times = F.array_sort(F.transform(domains, lambda d: d["c"] / d["w"]))

    def filled(t):
        return F.aggregate(domains, F.lit(0.0), lambda s, d: s + F.least(d["w"] * t, d["c"].cast("double")))

    # the first dry time at which the budget is filled; before it the amount grows linearly
    late = F.filter(times, lambda t: filled(t) >= F.col("budget"))
    upper = F.element_at(late, 1)
    lower = F.coalesce(F.array_max(F.filter(times, lambda t: filled(t) < F.col("budget"))), F.lit(0.0))
    rate = F.aggregate(domains, F.lit(0.0), lambda s, d: s + F.when(d["c"] / d["w"] > lower, d["w"]).otherwise(0.0))
    return F.when(F.size(late) == 0, F.array_max(times)).otherwise(F.least(upper, lower + (F.col("budget") - filled(lower)) / rate))


def mixture_shares(chosen: DataFrame, docs: DataFrame, configs: DataFrame) -> DataFrame:
    """Per experiment and weighted domain: target share, tokens chosen, share reached, and use of the domain.

    A weighted domain without documents is listed with 0 tokens.
    """
    targets = domain_targets(configs)
    of = Window.partitionBy("experiment_id")
    got = chosen.groupBy("experiment_id", "domain").agg(
        F.count("*").alias("documents"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    have = docs.select("doc_id", F.lower(F.trim("domain")).alias("domain"), "n_tokens").where("n_tokens > 0").distinct().groupBy("domain").agg(F.sum("n_tokens").alias("domain_tokens"))
    zero = F.lit(0).cast("bigint")
    return (
        targets.join(got, ["experiment_id", "domain"], "left")
        .join(have, "domain", "left")
        .withColumn("target_share", F.col("weight") / F.sum("weight").over(of))
        .withColumn("tokens", F.coalesce("tokens", zero))
        .withColumn("share", F.when(F.sum("tokens").over(of) > 0, F.col("tokens") / F.sum("tokens").over(of)).otherwise(F.lit(0.0)))
        .select("experiment_id", "domain", "target_share", "share", "tokens", F.coalesce("domain_tokens", zero).alias("domain_tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_repeats", zero).alias("most_repeats"), "max_repeats")
    )
