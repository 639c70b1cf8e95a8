"""Target-weighted loss, decoding filters, schedules and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.sequences import running_total


def log_sum_exp(logits: Column) -> Column:
    """Stable: the largest logit is taken out before the exponentials."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def cross_entropy(logits: Column, target: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, target)


def target_weighted(df: DataFrame, loss: str, targets: str) -> DataFrame:
    """(targets, mean_loss, perplexity) over rows of a loss summed over their targets."""
    total = df.agg(F.sum(targets).alias("targets"), (F.sum(loss) / F.sum(targets)).alias("mean_loss"))
    return total.select("targets", "mean_loss", F.exp("mean_loss").alias("perplexity"))


def greedy(logits: Column) -> Column:
    """The id of the largest logit, the smaller one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def nucleus(logits: Column, top_k: int, top_p: float) -> Column:
    """array<struct<id, p>>: the top_k likeliest ids, of those the fewest that reach top_p, renormalised; ties go to smaller ids.

    Each step hands its sums on as a lambda variable, so nothing is computed twice.
    """
    item = "array<struct<id:int,w:double,before:double>>"
    ranked = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("minus"), i.alias("id"))))

    def weighed(acc: Column, r: Column) -> Column:
        w = F.exp(acc["least"] - r["minus"])
        one = F.array(F.struct(r["id"].alias("id"), w.alias("w"), acc["sum"].alias("before")))
        return F.struct(acc["least"].alias("least"), (acc["sum"] + w).alias("sum"), F.concat(acc["items"], one).alias("items"))

    def shares(few: Column) -> Column:
        total = F.aggregate(few, F.lit(0.0), lambda acc, r: acc + r["w"])
        return F.aggregate(F.array(total), F.array().cast("array<struct<id:int,p:double>>"), lambda _, t: F.transform(few, lambda r: F.struct(r["id"].alias("id"), (r["w"] / t).alias("p"))))

    def fewest(acc: Column) -> Column:
        return shares(F.filter(acc["items"], lambda r: r["before"] < top_p * acc["sum"]))

    start = F.struct((-F.array_max(logits)).alias("least"), F.lit(0.0).alias("sum"), F.array().cast(item).alias("items"))
    return F.aggregate(F.slice(ranked, 1, top_k), start, weighed, fewest)


def draw(shares: Column, at: Column) -> Column:
    """The id of array<struct<id, p>> at a place in [0, 1) of its cumulative shares; rounding past the end gives the last id."""
    def step(acc: Column, r: Column) -> Column:
        total = acc["sum"] + r["p"]
        hit = acc["id"].isNull() & (total > at)
        return F.struct(total.alias("sum"), F.when(hit, r["id"]).otherwise(acc["id"]).alias("id"))

    last = F.get(F.filter(shares, lambda r: r["p"] > 0), F.size(F.filter(shares, lambda r: r["p"] > 0)) - 1)["id"]
    return F.aggregate(shares, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("id")), step, lambda acc: F.coalesce(acc["id"], last))


def midpoint_plan(spark: SparkSession, batches: int, samples: int) -> DataFrame:
    """(sample, batch_index, represented): even stretches of the batches, each measured at its middle."""
    n = min(samples, batches)
    at = spark.range(n).select(F.col("id").alias("sample"), F.expr(f"id * {batches} div {n}").alias("low"), F.expr(f"(id + 1) * {batches} div {n}").alias("high"))
    return at.select("sample", F.expr("low + (high - low) div 2").alias("batch_index"), (F.col("high") - F.col("low")).alias("represented"))


def projected_seconds(timed: DataFrame, epochs: int) -> DataFrame:
    """(seconds): the sum of measured seconds times the batches that each stands for, times epochs."""
    return timed.agg((F.sum(F.col("seconds") * F.col("represented")) * epochs).alias("seconds"))


def warm_up(base: float, warmup: int, update: Column) -> Column:
    """A rate that grows in equal steps over the first updates."""
    return F.when((F.lit(warmup) > 0) & (update < warmup), F.lit(base) * (update + 1) / warmup).otherwise(F.lit(base))


def clip_scale(norm: Column, limit: float) -> Column:
    return F.when(norm > limit, limit / norm).otherwise(F.lit(1.0))


def upper_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def latest_checkpoint(entries: DataFrame) -> DataFrame:
    """Per run the checkpoint to go on from: of (run, number, name, status) the largest number that is complete.

    Unfinished ones are passed over; an invalid one above it, or two of the
    same number, is an error, in the column problem.
    """
    known = entries.where("status != 'incomplete'")
    top = known.groupBy("run").agg(F.max(F.when(F.col("status") == "complete", F.col("number"))).alias("number"))
    rows = known.join(top.withColumnRenamed("number", "best"), "run").where("best is null or number >= best")
    return rows.groupBy("run").agg(
        F.max(F.when(F.col("number") == F.col("best"), F.col("name"))).alias("name"),
        F.max("best").alias("number"),
        F.when(F.max((F.col("status") == "invalid") & (F.col("best").isNull() | (F.col("number") > F.col("best")))), "invalid")
        .when(F.sum((F.col("number") == F.col("best")).cast("int")) > 1, "ambiguous")
        .alias("problem"),
    )


def running_targets(updates: DataFrame) -> DataFrame:
    """(epoch, update, targets_so_far): prefix sums inside each epoch, for resuming; from a range sort, not a window of a whole epoch."""
    rows = updates.select(F.struct("epoch", "update").alias("at"), F.col("targets").cast("long").alias("targets"))
    totals = running_total(rows, "at", "targets").select("at.*", "targets", "before")
    first = totals.groupBy("epoch").agg(F.min("before").alias("first")).withColumnRenamed("epoch", "_epoch")
    totals = totals.join(first, F.col("epoch") == F.col("_epoch"))
    return totals.select("epoch", "update", (F.col("before") - F.col("first") + F.col("targets")).alias("targets_so_far"))


def resume_at(updates: DataFrame, targets: int) -> DataFrame:
    """(epoch, update): per epoch the first update of running_targets() that passes so many targets."""
    return running_targets(updates).where(F.col("targets_so_far") > targets).groupBy("epoch").agg(F.min("update").alias("update"))


def global_norm(rows: DataFrame, vector: str) -> DataFrame:
    """(norm, finite): the L2 norm over all components of all rows, and whether each of them is finite."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    good = ~F.exists(vector, not_finite)
    return rows.agg(F.sqrt(F.sum(squares)).alias("norm"), F.bool_and(good).alias("finite"))


def not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def epoch_loss(updates: DataFrame) -> DataFrame:
    """(epoch, targets, loss): the target-weighted loss before each update of (epoch, update, loss, targets) (A12). A loss that isn't finite is an error."""
    bad = updates.where(not_finite(F.col("loss").cast("double")) | F.col("targets").isNull()).select("epoch", "update").limit(3).collect()
    if bad:
        raise ValueError(f"no finite loss at (epoch, update) {[tuple(r) for r in bad]}")
    return updates.groupBy("epoch").agg(F.sum("targets").alias("targets"), (F.sum(F.col("loss").cast("double") * F.col("targets")) / F.sum("targets")).alias("loss"))


def target_rate(timed: DataFrame) -> DataFrame:
    """(targets_per_second) of measured batches (targets, seconds)."""
    return timed.agg((F.sum("targets") / F.sum("seconds")).alias("targets_per_second"))


def sample_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, low, high, median (mean of the middle two) and upper_median (the upper of them) (A20). A group's samples of a benchmark are few and are listed."""
    return samples.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.median(value).alias("median"), upper_median(F.collect_list(value)).alias("upper_median"))
