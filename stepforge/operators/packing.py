"""Truncation, packing, batching and collation of token sequences.

Packing works on batches of bounded size, gathered as arrays, so that no group follows the
size of the data.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = -100
_LONGS = T.ArrayType(T.LongType())


def truncated(source: Column, target: Column, cutoff: int | Column) -> Column:
    """TOK-07: struct of source and target lengths that fit the cutoff: the shorter side
    is kept if it is under half, else both shrink in proportion."""
    cut = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    share = F.floor(cut * (target / F.greatest(source + target, F.lit(1))))
    most = F.when(target * 2 < cut, cut).when(source * 2 < cut, cut - source).otherwise(share)
    new_target = F.least(most, target)
    new_source = F.least(F.greatest(cut - new_target, F.lit(0)), source)
    return F.struct(new_source.cast("int").alias("source"), new_target.cast("int").alias("target"))


def knapsacks(lengths: list[int], capacity: int) -> list[list[int]]:
    """PCK-01: fill one bin after another with the largest that still fits; what exceeds
    the capacity is left out."""
    rest = sorted(x for x in lengths if x <= capacity)
    out = []
    while rest:
        bin_, room = [], capacity
        while (at := bisect.bisect_right(rest, room)) > 0:
            bin_.append(rest.pop(at - 1))
            room -= bin_[-1]
        out.append(bin_)
    return out


@F.pandas_udf(T.ArrayType(_LONGS))
def knapsacks_udf(lengths: pd.Series, capacity: pd.Series) -> pd.Series:
    return pd.Series([knapsacks([int(x) for x in ls], int(c)) for ls, c in zip(lengths, capacity, strict=True)])


def packed_bins(df: DataFrame, length: str, capacity: int, position: str = "line_no", batch: int = 1000) -> DataFrame:
    """(batch, bin, lengths) of greedy knapsacks in each batch of rows."""
    from stepforge.session import ship

    ship(df.sparkSession)
    t = df.groupBy(F.floor(F.col(position) / batch).alias("batch")).agg(F.collect_list(F.col(length).cast("long")).alias("ls"))
    return t.select("batch", F.posexplode(knapsacks_udf("ls", F.lit(capacity))).alias("bin", "lengths"))


def blocks(df: DataFrame, ids: str, size: int, position: str = "line_no", batch: int = 1000) -> DataFrame:
    """TOK-06: ids of a batch one after another, cut into full blocks; the rest is dropped."""
    t = df.groupBy(F.floor(F.col(position) / batch).alias("batch")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(position, ids))), lambda s: s[ids])).alias("all"))
    n = F.floor(F.size("all") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("all", i * size + 1, F.lit(size)))
    return t.where(n > 0).select("batch", F.posexplode(cut).alias("block", "ids"))


def padding_free(rows: Column, limit: int) -> Column:
    """PCK-03: samples (input_ids, labels, loss_weights), each cut at ``limit``, one after
    another; positions start anew with each. The first label and weight of all but the
    first sample (by its place) are masked; samples without ids add nothing."""
    pieces = F.transform(
        rows,
        lambda r, i: F.struct(
            F.slice(r.input_ids, F.lit(1), F.lit(limit)).alias("input_ids"),
            _first_masked(F.slice(r.labels, F.lit(1), F.lit(limit)), i, F.lit(IGNORED)).alias("labels"),
            _first_masked(F.slice(r.loss_weights, F.lit(1), F.lit(limit)), i, F.lit(0.0)).alias("loss_weights"),
            F.transform(F.slice(r.input_ids, F.lit(1), F.lit(limit)), lambda _, k: k).alias("position_ids"),
        ),
    )
    joined = lambda name: F.flatten(F.transform(pieces, lambda p: p[name])).alias(name)
    return F.struct(*map(joined, ("input_ids", "labels", "loss_weights", "position_ids")))


def _first_masked(values: Column, place: Column, mask: Column) -> Column:
    return F.transform(values, lambda v, k: F.when((place > 0) & (k == 0), mask).otherwise(v))


def _fold(lengths: Column, micro: int, limit: int, padded: bool, carried: Column | None) -> Column:
    """Struct of the sizes of finished batches and the unfinished one: n, longest, total."""
    budget = micro * limit
    field = lambda k: carried[k] if carried is not None else F.lit(0)
    start = F.struct(F.array().cast("array<int>").alias("sizes"), field("n").cast("int").alias("n"), field("longest").cast("long").alias("longest"), field("total").cast("long").alias("total"))

    def step(s, x):
        x = F.least(x.cast("long"), F.lit(limit).cast("long"))
        over = (F.greatest(s.longest, x) * (s.n + 1) > budget) if padded else (s.total + x > budget)
        over = over & (s.n > 0)
        n = F.when(over, 1).otherwise(s.n + 1)
        longest = F.when(over, x).otherwise(F.greatest(s.longest, x))
        total = F.when(over, x).otherwise(s.total + x)
        # Padded batches are done as soon as they reach the budget, others once a sample
        # would exceed it.
        done = (longest * n >= budget) if padded else F.lit(False)
        none = F.array().cast("array<int>")
        return F.struct(
            F.concat(s.sizes, F.when(over, F.array(s.n)).otherwise(none), F.when(done, F.array(n)).otherwise(none)).alias("sizes"),
            F.when(done, 0).otherwise(n).alias("n"),
            F.when(done, F.lit(0).cast("long")).otherwise(longest).alias("longest"),
            F.when(done, F.lit(0).cast("long")).otherwise(total).alias("total"),
        )

    return F.aggregate(lengths, start, step)


def dynamic_batches(lengths: Column, micro: int, limit: int, padded: bool = True, carried: Column | None = None) -> Column:
    """BAT-02, BAT-03: sizes of successive batches under a token budget: ``micro`` times
    ``limit`` tokens, counted padded to the longest or as they are. ``carried`` is the
    unfinished batch before these lengths, a struct of n, longest and total. A padded batch
    that reaches the budget is done; a tail that doesn't fill a batch is not emitted."""
    return _fold(lengths, micro, limit, padded, carried).sizes


def _carried_on(lengths: list[int], state: tuple[int, int, int], micro: int, limit: int, padded: bool) -> tuple[int, int, int]:
    """The unfinished batch (n, longest, total) after further lengths, folded plainly."""
    n, longest, total = state
    budget = micro * limit
    for x in lengths:
        x = limit if x is None else min(x, limit)
        if n and (max(longest, x) * (n + 1) if padded else total + x) > budget:
            n, longest, total = 1, x, x
        else:
            n, longest, total = n + 1, max(longest, x), total + x
        if padded and longest * n >= budget:
            n, longest, total = 0, 0, 0
    return n, longest, total


def stream_batches(df: DataFrame, length: str, micro: int, limit: int, padded: bool = True, position: str = "line_no", batch: int = 1000, num_micro: int = 1) -> DataFrame:
    """(batch, i, size) and, with ``num_micro`` above 1, step: dynamic batches over all rows
    in line order, as one stream cut into groups of ``batch`` lines; a batch belongs to the
    group that ends it and only the tail at the end of the input is left out. A step has
    ``num_micro`` batches; an unfinished last step is left out too.

    A batch that is unfinished at the end of a group is carried over to the next. All
    groups are folded at once, each from what the fold before left of its predecessor, until
    nothing changes: batches soon end at the same lines whatever was carried in, so a few
    rounds do, each distributed; the result is that of one fold over all lines."""
    from stepforge.operators.datasets import numbered
    from stepforge.session import dropped, written

    spark = df.sparkSession
    lines = F.transform(F.array_sort(F.collect_list(F.struct(position, length))), lambda x: x[length])
    groups = numbered(df.groupBy(F.floor(F.col(position) / batch).alias("batch")).agg(lines.alias("_ls")), "batch", to="_g")
    t, groups_path = written(groups, "stream-groups")
    n_groups = t.count()
    none = [F.lit(0).alias("n"), F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("total")]
    into, path = written(t.select("_g", *none), "carried")
    while True:
        left = t.join(into, "_g").select("_g", _fold(F.col("_ls"), micro, limit, padded, F.struct("n", "longest", "total")).alias("s"))
        out = left.select((F.col("_g") + 1).alias("_g"), "s.n", "s.longest", "s.total").join(t.select("_g"), "_g", "left_semi")
        first = t.where("_g = 0").select("_g", *none)
        after, new = written(out.unionByName(first), "carried")
        same = after.join(into.withColumnsRenamed({c: f"_{c}" for c in ("n", "longest", "total")}), "_g").where("n = _n AND longest = _longest AND total = _total").count()
        dropped(spark, path)
        into, path = after, new
        if same == n_groups:
            break
    sizes = t.join(into, "_g").select("batch", F.posexplode(_fold(F.col("_ls"), micro, limit, padded, F.struct("n", "longest", "total")).sizes).alias("i", "size"))
    out, _ = written(sizes, "stream-batches")
    for p in (path, groups_path):
        dropped(spark, p)
    if num_micro == 1:
        return out
    steps = numbered(out, "batch", "i", to="_no").withColumn("step", F.floor(F.col("_no") / num_micro))
    return steps.where(F.col("step") < out.count() // num_micro).drop("_no")


def padded(values: Column, length: Column, fill) -> Column:
    """BAT-06: truncated or filled up on the right."""
    return F.concat(F.slice(values, F.lit(1), length), F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def causal_mask(ids: Column) -> Column:
    """BAT-07: rows see earlier places of their own sub-sequence; 0 is padding."""
    n = F.sequence(F.lit(0), F.size(ids) - 1)
    return F.transform(n, lambda i: F.transform(n, lambda j: ((j <= i) & (F.get(ids, i) == F.get(ids, j)) & (F.get(ids, i) != 0)).cast("int")))


def unpadded(ids: Column, mask: Column) -> Column:
    """BAT-08: the values where the mask is not 0."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("v"), mask.alias("m")), lambda z: z.m != 0), lambda z: z.v)


def valid_tokens(labels: Column) -> Column:
    """AGG-44: labels that count."""
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def token_accuracy(predicted: Column, labels: Column) -> Column:
    """AGG-37: share of right predictions of the next label."""
    pairs = F.zip_with(F.slice(predicted, F.lit(1), F.greatest(F.size(predicted) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, y: F.struct((p == y).alias("ok"), (y != IGNORED).alias("counts")))
    counted = F.filter(pairs, lambda x: x.counts)
    return F.try_divide(F.size(F.filter(counted, lambda x: x.ok)), F.size(counted))


def dpo_input(chosen: Column, rejected: Column) -> Column:
    """TOK-11: chosen then rejected ids, with type ids 1 and 2 and positions from 1."""
    n, m = F.size(chosen), F.size(rejected)
    places = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.concat(chosen, rejected).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(2), m)).alias("token_type_ids"), F.concat(places(n), places(m)).alias("position_ids"))
