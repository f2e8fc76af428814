"""Score rules and aggregates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label sets of the score rules.
BAD_PROVENANCE = ("localized_fail", "suspect")
BAD_ADHERENCE = ("deviated", "claimed_only")
UNCERTAIN_PROVENANCE = ("unverified",)
UNCERTAIN_ADHERENCE = ("self_declared_deviation",)
GOOD_PROVENANCE = ("corroborated", "outcome_consistent")
#: Precedence of provenances.
PRECEDENCE = {"localized_fail": 5, "corroborated": 4, "outcome_consistent": 3, "suspect": 2, "unverified": 0}
#: The grid of step aggregates and combinations.
AGGREGATES = ("min", "mean", "last", "hybrid", "confident_mean", "adaptive_mean")
WEIGHTS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
COMBINES = (("none", 0.0), *(("weighted", w) for w in WEIGHTS), ("multiply", 0.0), ("plan_trust", 0.0))


def _d(x: float) -> Column:
    return F.lit(float(x))


def step_label_score(adherence: Column, provenance: Column) -> Column:
    """FN-01: label score of a step; rules hold in this order."""
    return (
        F.when(provenance.isin(*BAD_PROVENANCE) | adherence.isin(*BAD_ADHERENCE), _d(0))
        .when(adherence.isin(*UNCERTAIN_ADHERENCE) | provenance.isin(*UNCERTAIN_PROVENANCE), _d(0.5))
        .when(provenance.isin(*GOOD_PROVENANCE), _d(1))
        .otherwise(_d(0.5))
    )


def plan_label_score(rate: Column, truncated: Column, veto: float = 0.5) -> Column:
    """FN-02: three classes of a plan's success rate; null without a rate."""
    return F.when(rate.isNull(), F.lit(None).cast("double")).when(truncated >= veto, _d(0)).when(rate <= 0.25, _d(0)).when(rate >= 0.75, _d(1)).otherwise(_d(0.5))


def normal_adherence(adherence: Column, second: Column) -> Column:
    """FN-08: first of two labels that isn't empty, ``uncertain*`` as one class."""
    label = F.coalesce(F.nullif(adherence, F.lit("")), F.nullif(second, F.lit("")), F.lit("unknown"))
    return F.when(label.startswith("uncertain"), "uncertain").otherwise(label)


def ran_ok(output: Column) -> Column:
    """FN-09: no traceback and no timeout."""
    return ~output.contains("Traceback") & (output != "[timeout]")


def norm01(v: Column) -> Column:
    """FN-05: scores on the five-point scale come to [0, 1]; others beyond it are null."""
    return F.when((v >= 0) & (v <= 1), v).when((v > 1) & (v <= 5), F.bround((v - 1) / 4, 3))


def norm01_strict(v: Column) -> Column:
    """FN-06: scores outside [0, 1] are null."""
    return F.when((v >= 0) & (v <= 1), v)


def combined(step: Column, plan: Column, mode: str, weight: float = 0.3) -> Column:
    """FN-03: a chain's score from its step aggregate and its plan score."""
    if mode == "none":
        return step
    by = {
        "multiply": step * plan,
        "weighted": _d(1 - weight) * step + _d(weight) * plan,
        "plan_trust": F.abs(plan - 0.5) * 2 * plan + (1 - F.abs(plan - 0.5) * 2) * step,
    }
    return F.when(plan.isNull(), step).otherwise(by[mode])


def combined_vote(step: Column, plan: Column, mode: str, weight: float = 0.3) -> Column:
    """FN-04: the voter's combination; without step aggregate zero."""
    step = F.coalesce(step, _d(0))
    return F.when(plan.isNull(), step).otherwise({"none": step, "multiply": step * plan, "weighted": _d(1 - weight) * step + _d(weight) * plan}[mode])


def _sum(a: Column) -> Column:
    return F.aggregate(a, _d(0), lambda s, x: s + x)


def step_aggregate(scores: Column, how: str) -> Column:
    """AGG-10: one aggregate of an ordered array of step scores; null scores count 0.5,
    an empty chain 0."""
    xs = F.transform(scores, lambda x: F.coalesce(x, _d(0.5)))
    n = F.size(scores)
    mean = _sum(xs) / n
    weights = F.transform(xs, lambda x: F.abs(x - 0.5) * 2)
    total = _sum(weights)
    sure = F.when(total < 1e-9, mean).otherwise(_sum(F.zip_with(xs, weights, lambda x, w: x * w)) / total)
    share = F.size(F.filter(weights, lambda w: w > 1e-9)) / n
    by = {
        "min": F.array_min(xs),
        "mean": mean,
        "last": F.element_at(xs, -1),
        "hybrid": (F.array_min(xs) + mean) / 2,
        "confident_mean": sure,
        "adaptive_mean": share * sure + (1 - share) * mean,
    }
    return F.when(F.coalesce(n, F.lit(0)) <= 0, _d(0)).otherwise(by[how])


def vote_aggregate(scores: Column, how: str) -> Column:
    """AGG-11: the voter's aggregates; null without steps."""
    return F.when(F.size(scores) > 0, step_aggregate(scores, how))
