"""Best-of-N selection, weighted and majority votes over candidate chains.

Step scores are gathered once into an ordered array for each chain; whole grids of
aggregates and combinations are then expanded from that one array, so scores are shuffled
once, by chain, and candidates once, by problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions.scores import AGGREGATES, COMBINES, combined, step_aggregate


def score_arrays(steps: DataFrame) -> DataFrame:
    """(chain_id, scores): step scores of each chain in the order of its steps."""
    return steps.groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "step_score"))), lambda s: s.step_score).alias("scores"))


def scored_chains(chains: DataFrame, steps: DataFrame) -> DataFrame:
    """JN-06: chains with their score arrays; chains without steps have none."""
    none = F.array().cast("array<double>")
    return chains.join(score_arrays(steps), "chain_id", "left").withColumn("scores", F.coalesce("scores", none))


def with_grid(scored: DataFrame, aggregates=AGGREGATES, combines=COMBINES) -> DataFrame:
    """A row for each chain and cell of the grid: how, combine, weight, cfg, final.

    Aggregates are computed once for each chain; cells come from a literal array."""
    t = scored.select("*", *(step_aggregate(F.col("scores"), h).alias(f"_{h}") for h in aggregates)).drop("scores")
    cells = [
        F.struct(F.lit(h).alias("how"), F.lit(m).alias("combine"), F.lit(float(w)).alias("weight"), F.lit(i * len(combines) + j).alias("cfg"), combined(F.col(f"_{h}"), F.col("plan_score"), m, w).alias("final"))
        for i, h in enumerate(aggregates)
        for j, (m, w) in enumerate(combines)
    ]
    return t.select(*(c for c in scored.columns if c != "scores"), F.inline(F.array(*cells)))


def cell_finals(scored: DataFrame, aggregates=AGGREGATES, combines=COMBINES) -> tuple[DataFrame, list[tuple[int, str, str, float]]]:
    """Chains with one column ``f{cfg}`` for each cell of the grid, and the cells."""
    t = scored.select("*", *(step_aggregate(F.col("scores"), h).alias(f"_{h}") for h in aggregates)).drop("scores")
    cells = [(i * len(combines) + j, h, m, float(w)) for i, h in enumerate(aggregates) for j, (m, w) in enumerate(combines)]
    own = [c for c in scored.columns if c != "scores"]
    return t.select(*own, *(combined(F.col(f"_{h}"), F.col("plan_score"), m, w).alias(f"f{c}") for c, h, m, w in cells)), cells


def named_cells(t: DataFrame, cells: list[tuple[int, str, str, float]]) -> DataFrame:
    """Rows with ``cfg`` and the names of its cell, which come last, from literals."""
    at = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in cells)), F.col("cfg").cast("int") + 1)
    return t.select("cfg", at(1).alias("how"), at(2).alias("combine"), at(3).alias("weight"), *(c for c in t.columns if c != "cfg"))


def by_problem(scored: DataFrame, *keep: str, aggregates=AGGREGATES, combines=COMBINES) -> tuple[DataFrame, list[Column], list[tuple[int, str, str, float]]]:
    """Chains dealt out by problem, with their aggregates; the score of each cell as an
    expression of those; and the cells.

    What is shuffled and sorted is one narrow row for each chain, however many cells there
    are: scores of cells come into being where they are aggregated."""
    t = scored.select(*keep, "plan_score", is_right().alias("hit"), *(step_aggregate(F.col("scores"), h).alias(f"_{h}") for h in aggregates))
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = [(i * len(combines) + j, h, m, float(w)) for i, h in enumerate(aggregates) for j, (m, w) in enumerate(combines)]
    return t.repartition(parts, "prob_idx"), [combined(F.col(f"_{h}"), F.col("plan_score"), m, w) for _, h, m, w in cells], cells


def listed_cells(t: DataFrame, cells: list[tuple[int, str, str, float]], **values) -> DataFrame:
    """A row for each cell from the one row of ``t``; ``values`` make columns of numbers."""
    rows = [F.struct(F.lit(c).alias("cfg"), F.lit(h).alias("how"), F.lit(m).alias("combine"), F.lit(w).alias("weight"), *(v(c).alias(n) for n, v in values.items())) for c, h, m, w in cells]
    return t.select(F.inline(F.array(*rows)))


def grid_accuracy(scored: DataFrame) -> DataFrame:
    """AGG-16: share of problems whose best candidate is right, for each cell."""
    t, finals, cells = by_problem(scored, "prob_idx", "tpos")
    best = t.groupBy("prob_idx").agg(*(F.max(F.struct(f.alias("final"), (-F.col("tpos")).alias("turn"), F.col("hit").alias("hit"))).alias(f"b{c[0]}") for f, c in zip(finals, cells, strict=True)))
    sums = best.groupBy().agg(F.count("*").alias("n"), *(F.avg(F.col(f"b{c[0]}.hit").cast("double")).alias(f"a{c[0]}") for c in cells))
    return listed_cells(sums.where("n > 0"), cells, accuracy=lambda c: F.col(f"a{c}"), n_problems=lambda c: F.col("n"))


def vote_accuracy(scored: DataFrame) -> DataFrame:
    """AGG-20 for each cell: share of all problems whose voted answer is right; scores are
    rounded to 9 digits and totals to 6."""
    t, finals, cells = by_problem(scored, "prob_idx", "tpos", "answer")
    # Answers are missing in some rows, which count as problems but don't vote.
    groups = t.groupBy("prob_idx", "answer").agg(F.min("tpos").alias("first"), F.min_by("hit", "tpos").alias("hit"), *(F.round(F.sum(F.round(f, 9)), 6).alias(f"t{c[0]}") for f, c in zip(finals, cells, strict=True)))
    vote = lambda c: F.when(F.col("answer").isNotNull(), F.struct(F.col(f"t{c}").alias("total"), (-F.col("first")).alias("turn"), F.col("hit")))
    won = groups.groupBy("prob_idx").agg(*(F.max(vote(c[0])).alias(f"b{c[0]}") for c in cells))
    sums = won.groupBy().agg(F.count("prob_idx").alias("n"), F.count("b0").alias("voted"), *(F.count_if(f"b{c[0]}.hit").alias(f"a{c[0]}") for c in cells))
    return listed_cells(sums.where("voted > 0"), cells, accuracy=lambda c: F.col(f"a{c}") / F.col("n"))


def cell_scores(scored: DataFrame, *keep: str, digits: int | None = None) -> tuple[DataFrame, list[tuple[int, str, str, float]]]:
    """A row (cfg, score, keep) for each chain and cell, scores rounded if asked for."""
    t, cells = cell_finals(scored)
    rows = t.select(*keep, F.posexplode(F.array(*(f"f{c[0]}" if digits is None else F.round(f"f{c[0]}", digits) for c in cells))).alias("cfg", "score"))
    return rows, cells


def is_right() -> Column:
    return F.coalesce(F.col("correct"), F.lit(False))


def problem_bounds(chains: DataFrame) -> DataFrame:
    """AGG-13: per problem the share of correct chains and whether any is."""
    return chains.groupBy("prob_idx").agg(F.count("*").alias("n"), F.count_if(is_right()).alias("n_correct"))


def best_of_n(scored: DataFrame, keys: tuple[str, ...] = (), final: str = "final") -> DataFrame:
    """AGG-14: the candidate of highest score, the first of equal ones, per problem."""
    return scored.groupBy(*keys, "prob_idx").agg(
        F.max_by(F.struct("chain_id", "tpos", F.col(final).alias("final"), is_right().alias("hit")), F.struct(final, -F.col("tpos"))).alias("b")
    ).select(*keys, "prob_idx", "b.*")


def answer_groups(scored: DataFrame, keys: tuple[str, ...] = (), final: str = "final") -> DataFrame:
    """Per problem and answer: summed score, votes, first position and its correctness.

    Scores are added in the order of positions: totals that differ in their last bit only
    decide votes, so they mustn't depend on how rows arrive."""
    listed = F.array_sort(F.collect_list(F.when(F.col(final).isNotNull(), F.struct("tpos", F.col(final).cast("double").alias("x")))))
    total = F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda s, p: s + p.x))
    return scored.where("answer IS NOT NULL").groupBy(*keys, "prob_idx", "answer").agg(
        total.alias("total"), F.count("*").alias("votes"), F.min("tpos").alias("first"), F.min_by(is_right(), "tpos").alias("hit")
    )


def weighted_vote(groups: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-20: the answer of highest summed score, the first seen of equal ones."""
    return groups.groupBy(*keys, "prob_idx").agg(F.max_by(F.struct("answer", "total", "hit"), F.struct("total", -F.col("first"))).alias("b")).select(*keys, "prob_idx", "b.*")


def majority_vote(groups: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-21: the commonest answer, the first seen of equal ones."""
    return groups.groupBy(*keys, "prob_idx").agg(F.max_by(F.struct("answer", "votes", "hit"), F.struct("votes", -F.col("first"))).alias("b")).select(*keys, "prob_idx", "b.*")


def upper_median(values: Column) -> Column:
    """The element at ``n div 2`` of the sorted values."""
    xs = F.sort_array(F.collect_list(values))
    return F.try_element_at(xs, (F.size(xs) / 2).cast("int") + 1)


def with_plan_scores(chains: DataFrame, scores: DataFrame) -> DataFrame:
    """JN-07: chains with the plan score of their place, null where there is none."""
    return chains.join(scores.select("prob_idx", "tpos", "plan_score"), ["prob_idx", "tpos"], "left")
