"""Sequence rules over chains and their plans, all inside one row of arrays."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABANDON_RUN = STALL_RUN = 3


def abandoned(deviations: Column, run: int = ABANDON_RUN) -> Column:
    """WIN-04: the chain ends in ``run`` or more deviations."""
    last = F.slice(F.reverse(deviations), 1, run)
    return (F.size(deviations) >= run) & F.forall(last, lambda d: F.coalesce(d, F.lit(False)))


def uncovered(plan_ids: Column, claimed: Column) -> Column:
    """SET-05: plan stages that no step claims, in plan order."""
    return F.array_except(plan_ids, claimed)


def skips(plan_ids: Column, claimed: Column) -> Column:
    """WIN-03: stages passed over by a jump to a later one, in the order of the jumps,
    unless they were claimed at some time."""
    seq = F.filter(claimed, lambda c: c.rlike(r"^P[0-9]+$"))

    def jump(state, pid):
        at = F.array_position(plan_ids, pid).cast("int")
        before = F.slice(plan_ids, F.lit(1), F.greatest(at - 1, F.lit(0)))
        new = F.array_except(F.array_except(before, state.seen), state.skips)
        return F.struct(F.array_union(state.seen, F.array(pid)).alias("seen"), F.concat(state.skips, new).alias("skips"))

    none = F.array().cast("array<string>")
    end = F.aggregate(seq, F.struct(none.alias("seen"), none.alias("skips")), jump)
    return F.array_except(end.skips, seq)


def stalls(steps: DataFrame, run: int = STALL_RUN) -> DataFrame:
    """WIN-02: ``steps(chain_id, step, claimed, code)`` with ``in_stall``: the step is in a
    run of ``run`` or more with equal claim and equal stripped code."""
    by = Window.partitionBy("chain_id").orderBy("step")
    t = steps.withColumn("_code", F.regexp_replace("code", r"(?U)^\s+|\s+$", ""))
    same = F.col("claimed").eqNullSafe(F.lag("claimed").over(by)) & F.col("_code").eqNullSafe(F.lag("_code").over(by)) & F.lag("step").over(by).isNotNull()
    t = t.withColumn("_same", same.cast("int")).drop("_code")
    # A run holds the step if one of the frames of ``run`` steps around it has only equal ones;
    # all frames share the order of the windows before, so nothing is sorted again.
    full = lambda i: F.coalesce(F.sum("_same").over(by.rowsBetween(i + 1, i + run - 1)) == run - 1, F.lit(False))
    held = functools.reduce(lambda a, b: a | b, (full(-i) for i in range(run))) if run > 1 else F.lit(True)
    return t.withColumn("in_stall", held).drop("_same")


def load_bearing(defs_uses: Column) -> Column:
    """WIN-07: steps (from 0) on the path back from the last one along names it needs.
    ``defs_uses`` is an array of structs with arrays ``defs`` and ``uses``."""
    n = F.size(defs_uses)
    last = F.element_at(defs_uses, -1)
    start = F.struct(F.array_union(last.uses, last.defs).alias("need"), F.array(n - 1).alias("path"), (n - 1).alias("at"))

    def back(state, step):
        hit = F.arrays_overlap(step.defs, state.need)
        i = state.at - 1
        return F.struct(F.when(hit, F.array_union(state.need, step.uses)).otherwise(state.need).alias("need"), F.when(hit, F.concat(state.path, F.array(i))).otherwise(state.path).alias("path"), i.alias("at"))

    return F.when(n > 0, F.array_sort(F.aggregate(F.slice(F.reverse(defs_uses), 2, F.greatest(n - 1, F.lit(0))), start, back).path))


def smoothed(values: Column) -> Column:
    """WIN-09: exponential smoothing with a weight that grows with the length."""
    n = F.size(values).cast("double")
    weight = 1.8 * (1 / (1 + F.exp(-0.05 * n)) - 0.5)

    def step(state, x):
        now = F.when(F.size(state) == 0, x * (1 - weight) + F.element_at(values, 1) * weight).otherwise(F.try_element_at(state, F.lit(-1)) * weight + x * (1 - weight))
        return F.concat(state, F.array(now))

    return F.aggregate(values, F.array().cast("array<double>"), step)
