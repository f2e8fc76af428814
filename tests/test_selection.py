"""Votes and grids against plain versions."""

from stepforge.operators import selection as B


def test_votes_add_in_order_of_position(spark):
    # Equal but for the order of adding: 0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1.
    rows = [(1, i, "a", x, True) for i, x in enumerate((0.3, 0.2, 0.1))] + [(1, i + 3, "b", x, False) for i, x in enumerate((0.1, 0.2, 0.3))]
    for turned in (rows, rows[::-1]):
        t = spark.createDataFrame(turned, "prob_idx int, tpos int, answer string, final double, correct boolean").coalesce(1)
        won = B.weighted_vote(B.answer_groups(t)).first()
        assert (won.answer, won.total, won.hit) == ("b", 0.1 + 0.2 + 0.3, False)
    none = spark.createDataFrame([(1, 0, "a", None, True)], "prob_idx int, tpos int, answer string, final double, correct boolean")
    assert B.answer_groups(none).first().total is None


def test_cells_are_not_shuffled(spark, sf):
    # Rows of cells come last, from one row of all problems: no exchange lies above them.
    from stepforge import catalog

    for name in ("agg16_bon_matrix", "agg20_vote_grid"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate"), name


def test_problems_without_answers_count(spark):
    rows = [(1, 0, None, True, 0.5, [1.0]), (2, 0, "a", True, None, [1.0]), (2, 1, "b", False, 1.0, []), (3, 0, "a", True, 0.5, [0.0, None])]
    t = spark.createDataFrame(rows, "prob_idx int, tpos int, answer string, correct boolean, plan_score double, scores array<double>")
    got = {r.cfg: r.accuracy for r in B.vote_accuracy(t).collect()}
    # Of three problems two vote, and both rightly; plan_trust ties in the second, where the first wins.
    assert len(got) == 54 and set(got.values()) == {2 / 3} and B.vote_accuracy(t.limit(0)).count() == 0
    assert {r.n_problems for r in B.grid_accuracy(t).collect()} == {3}
