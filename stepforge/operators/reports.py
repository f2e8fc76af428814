"""Smaller aggregates and joins of the data layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.packing import IGNORED


def valid_ratio(df: DataFrame, labels: str, position: str = "line_no", batch: int = 4) -> DataFrame:
    """AGG-35: valid labels over all places, each batch padded to its longest row."""
    n = F.size(labels)
    valid = F.size(F.filter(labels, lambda x: x != IGNORED))
    per = df.groupBy(F.floor(F.col(position) / batch).alias("b")).agg(F.sum(valid).alias("valid"), (F.max(n) * F.count("*")).alias("total"))
    return per.agg(F.sum("valid").alias("valid"), F.sum("total").alias("total"), (F.sum("valid") / F.sum("total")).alias("ratio"))


def sequence_logps(logps: Column, labels: Column, alpha: float = 0.0, other_length: Column | None = None) -> Column:
    """AGG-41: struct of summed log-probabilities and their number over labels that
    count; with ``alpha`` what is beyond the shorter reply counts that share only."""
    pairs = F.filter(F.arrays_zip(logps.alias("p"), labels.alias("y")), lambda z: z.y != IGNORED)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, z: s + z.p)
    n = F.size(pairs)
    if other_length is None or not alpha:
        return F.struct(total(pairs).alias("logps"), n.alias("length"))
    shared = F.least(n, other_length)
    front = total(F.slice(pairs, F.lit(1), shared))
    back = total(F.slice(pairs, shared + 1, F.greatest(n - shared, F.lit(0))))
    return F.struct((front + alpha * back).alias("logps"), n.alias("length"))


def tokens_per_second(df: DataFrame, ids: str, epochs: float, seconds: float, devices: int = 1) -> DataFrame:
    """AGG-42."""
    return df.agg((F.sum(F.size(ids)) * epochs / seconds / devices).alias("tokens_per_second"))


def balance(df: DataFrame, tag: str) -> DataFrame:
    """AGG-45: both kinds of a preference must be there."""
    return df.agg(F.count_if(tag).alias("desirable"), F.count_if(~F.col(tag)).alias("undesirable"), (F.bool_or(tag) & F.bool_or(~F.col(tag))).alias("balanced"))


def progress(log: DataFrame, step: str, total: str, time: str) -> DataFrame:
    """WIN-13: share done, time gone and time left at each row of a log."""
    gone = F.unix_timestamp(time) - F.min(F.unix_timestamp(time)).over(Window.partitionBy(total))
    return log.withColumn("share", F.col(step) / F.col(total)).withColumn("gone", gone).withColumn("left", (gone / F.col(step) * (F.col(total) - F.col(step))))


def last_query(roles: Column, wrapped: Column) -> Column:
    """WIN-14: place of the last user message that isn't a wrapped tool result; -1 if none."""
    at = F.transform(F.arrays_zip(roles.alias("r"), wrapped.alias("w")), lambda z, i: F.when((z.r == "user") & ~z.w, i).otherwise(-1))
    return F.coalesce(F.array_max(at), F.lit(-1))


def retired(chains: DataFrame, tokens: str, limit: int) -> DataFrame:
    """FLT-07, FLT-08: chains over the token budget are done and have no answer."""
    over = F.col(tokens) > limit
    return chains.withColumn("done", F.col("done") | over).withColumn("answer", F.when(over, F.lit(None)).otherwise(F.col("answer")))


def missing_units(problems: DataFrame, plans: int, have: DataFrame) -> DataFrame:
    """JN-11: (problem, plan) units that have to be made again."""
    every = problems.select("prob_idx").withColumn("plan_idx", F.explode(F.sequence(F.lit(0), F.lit(plans - 1))))
    return every.join(have.select("prob_idx", "plan_idx"), ["prob_idx", "plan_idx"], "left_anti")


def subjects(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-16: the subsets of a benchmark, each with its subject."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("subject", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
