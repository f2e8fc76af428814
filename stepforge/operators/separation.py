"""Separation of correct from wrong chains: AUC, Cohen's d, bootstrap, paired tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.operators.datasets import hash_number


def auc(scores: DataFrame, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """AGG-17: P(score of a positive > score of a negative), ties one half; null without
    both classes. ``scores`` has ``score``, boolean ``positive`` and perhaps a weight.

    Equal scores are aggregated first. Different ones are dealt out by range of key and
    score, summed within and offset by the sums of the ranges before, so no task has all
    scores of a key."""
    from stepforge.session import written

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    by = scores.groupBy(*keys, "score").agg(F.sum(F.when(F.col("positive"), w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("positive"), 0.0).otherwise(w)).alias("q"))
    parts = max(1, int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written, so that both passes see the same ranges.
    t, _ = written(by.repartitionByRange(parts, *keys, "score").withColumn("_part", F.spark_partition_id()), "auc")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each key and range.
    ranges = t.groupBy(*keys, "_part").agg(F.sum("q").alias("_q")).select(*keys, "_part", F.coalesce(F.sum("_q").over(before), F.lit(0.0)).alias("_before"))
    here = Window.partitionBy("_part", *keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("below", F.coalesce(F.sum("q").over(here), F.lit(0.0))).join(ranges, [*keys, "_part"]).withColumn("below", F.col("below") + F.col("_before"))
    return t.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))), F.sum("p") * F.sum("q")).alias("auc"))


def separation(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-26..28: class means, their difference, Cohen's d with pooled deviation."""
    x = lambda c: F.when(F.col("positive") if c else ~F.col("positive"), F.col("score"))
    t = scores.groupBy(*keys).agg(
        F.count(x(1)).alias("n_correct"), F.count(x(0)).alias("n_wrong"), F.avg(x(1)).alias("mean_correct"), F.avg(x(0)).alias("mean_wrong"),
        F.var_samp(x(1)).alias("_vc"), F.var_samp(x(0)).alias("_vw"),
    )
    pooled = F.sqrt(((F.col("n_correct") - 1) * F.col("_vc") + (F.col("n_wrong") - 1) * F.col("_vw")) / F.nullif(F.col("n_correct") + F.col("n_wrong") - 2, F.lit(0)))
    gap = F.col("mean_correct") - F.col("mean_wrong")
    return t.select(
        *keys, "n_correct", "n_wrong", "mean_correct", "mean_wrong", gap.alias("separation"),
        F.when((F.col("n_correct") >= 2) & (F.col("n_wrong") >= 2) & (pooled >= 1e-12), gap / pooled).alias("cohens_d"),
    )


def draws(spark: SparkSession, problems: list, n_boot: int, seed: int) -> DataFrame:
    """(boot, prob_idx, weight): problems drawn with replacement, by Python's generator.

    The problems of a report are few; drawn ones are counted, so a replicate has at most
    one row for each problem."""
    rng, n, rows = random.Random(seed), len(problems), []
    for b in range(n_boot):
        counts: dict = {}
        for _ in range(n):
            p = problems[rng.randrange(n)]
            counts[p] = counts.get(p, 0) + 1
        rows += [(b, p, w) for p, w in counts.items()]
    return spark.createDataFrame(rows, "boot int, prob_idx long, weight int")


def hashed_draws(spark: SparkSession, problems: DataFrame, n_boot: int) -> DataFrame:
    """(boot, prob_idx, weight) by Poisson(1) weights from hashes: a bootstrap whose draws
    are made where the problems are, for more problems than a driver holds."""
    u = hash_number(F.concat_ws(":", F.col("prob_idx").cast("string"), F.col("boot").cast("string"))) / float(1 << 32)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    weight = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    return problems.select("prob_idx").distinct().crossJoin(F.broadcast(spark.range(n_boot).select(F.col("id").cast("int").alias("boot")))).withColumn("weight", weight).where("weight > 0")


def interval(values: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-29: the values at ``int(.025 n)`` and ``min(n - 1, int(.975 n))``."""
    xs = F.sort_array(F.collect_list(value))
    n = F.size(xs)
    at = lambda i: F.try_element_at(xs, i.cast("int") + 1)
    return values.groupBy(*keys).agg(at(F.floor(0.025 * n)).alias("ci_low"), at(F.least(n - 1, F.floor(0.975 * n))).alias("ci_high"), n.alias("n_boot"))


def weighted_separation(scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Difference of weighted class means, per key."""
    p, w = F.col("positive"), F.col("weight")
    mean = lambda c: F.try_divide(F.sum(F.when(c, w * F.col("score"))), F.sum(F.when(c, w)))
    return scores.groupBy(*keys).agg((mean(p) - mean(~p)).alias("value"))


def bootstrap(scores: DataFrame, drawn: DataFrame, metric: str = "auc") -> DataFrame:
    """AGG-29: interval of ``auc`` or ``separation`` over resampled problems."""
    rows = scores.join(F.broadcast(drawn) if drawn.isLocal() else drawn, "prob_idx")
    by = auc(rows, ("boot",), "weight").withColumnRenamed("auc", "value") if metric == "auc" else weighted_separation(rows, ("boot",))
    return interval(by.where("value IS NOT NULL"), "value")


def paired(reference: DataFrame, other: DataFrame, drawn: DataFrame) -> DataFrame:
    """AGG-30: difference of AUC of two sources over the same resampled problems: point,
    interval and approximate two-sided p."""
    both = reference.withColumn("source", F.lit(0)).unionByName(other.withColumn("source", F.lit(1)))
    shared = reference.select("prob_idx").distinct().join(other.select("prob_idx").distinct(), "prob_idx", "left_semi")
    both = both.join(shared, "prob_idx", "left_semi")
    wide = lambda t, k: t.groupBy(*k).pivot("source", [0, 1]).agg(F.first("auc")).withColumn("delta", F.col("0") - F.col("1"))
    by = wide(auc(both.join(drawn, "prob_idx"), ("source", "boot"), "weight"), ("boot",)).where("delta IS NOT NULL")
    below = F.avg((F.col("delta") <= 0).cast("double"))
    p = by.agg((2 * F.least(below, 1 - below)).alias("p_value"))
    point = wide(auc(both, ("source",)), ()).select(F.col("delta").alias("point"))
    return point.crossJoin(interval(by, "delta")).crossJoin(p)  # one row each
