"""Golden cases of functions that SQL can't express."""

import pytest
from pyspark.sql import functions as F

from stepforge.functions import code, mathx, overlap, tools
from stepforge.functions import extract as E
from stepforge.functions import scores as S
from stepforge.operators import labels as L
from stepforge.operators import packing as P
from stepforge.operators import tokens


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("pred", "gold"),
    [("40", "40"), ("1/2", "0.5"), ("0.5", "0.50"), ("2*3", "6"), ("50\\%", "0.5"), ("x=3", "3"), ("3*sqrt(13)", "3\\sqrt{13}"), ("(3, pi/2)", "\\left( 3, \\frac{\\pi}{2} \\right)"), ("2π", "2\\pi"), ("180", "180\\text{ miles}"), ("30", "\\$30"), ("x^2+2x+1", "(x+1)^2"), ("B", "b")],
)
def test_equal(pred, gold):
    assert mathx.is_correct(pred, gold)


@pytest.mark.parametrize(("pred", "gold"), [("40", "41"), ("1/2", "1/3"), ("\\sqrt{2}", "\\sqrt{3}"), ("2*sqrt(13)", "3\\sqrt{13}"), ("(3, pi/2, 0)", "(3, π/2)"), (None, "1")])
def test_unequal(pred, gold):
    assert not mathx.is_correct(pred, gold)


def test_values():
    assert mathx.boxed("so \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}" and mathx.boxed("is 42") == "42" and mathx.boxed("") is None
    assert not mathx.values_equal("120", "120")  # integers beyond 100 aren't compared
    assert mathx.stage_equal("Eq(x,3)", "Eq(3,x)") is True and mathx.stage_equal("x < 3", "3") is None
    assert mathx.sides("Eq(f(a, b), 3)") == ("f(a, b)", "3")


@pytest.mark.parametrize(
    ("action", "text", "verdict"),
    [("SOLVE", "r = solve(x - 1)", "faithful"), ("VERIFY_CHECK", "y = x + 1", "uncertain:verify_ambiguous"), ("SOLVE", "y = x + 1", "uncertain:solve_ambiguous"), ("COMPUTE", "print('hi')", "claimed_only"), ("FORMAT_ANSWER", "print(x)", "faithful"), ("COMPUTE", "print(x)", "uncertain:display_only"), ("COMPUTE", "x = (", "uncertain:syntax_broken"), ("RHYME", "x = 1", "uncertain:unknown_action"), ("VERIFY_CHECK", "x = 5", "deviated"), ("COUNT", "n = 3", "faithful"), ("COMPUTE", "y = frob(x)", "uncertain:unknown_calls"), ("COMPUTE", "frob(x)", "claimed_only")],
)
def test_adherence(action, text, verdict):
    assert code.adherence(action, text) == verdict


def test_code_facts():
    assert code.names_of("import a.b as c\nx = y + z\ndef f(q): return q") == (["c", "f", "x"], ["q", "y", "z"])
    assert code.bounded_search("for i in range(10): pass") and not code.bounded_search("for i in range(n): pass")
    assert code.executed("x + 1", ["x = 41"]) == "42" and "ZeroDivisionError" in code.executed("1/0")


def test_scores(spark):
    xs = F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0))
    got = [one(spark, S.step_aggregate(xs, h)) for h in S.AGGREGATES]
    assert got == [0.0, 0.5, 0.0, 0.25, 0.5, 0.5]
    assert one(spark, S.step_aggregate(F.array().cast("array<double>"), "mean")) == 0.0
    assert [round(one(spark, S.combined(F.lit(0.8), F.lit(0.5), m, 0.3)), 9) for m in ("none", "multiply", "weighted", "plan_trust")] == [0.8, 0.4, 0.71, 0.8]
    assert [one(spark, S.norm01(F.lit(v))) for v in (3.0, 0.5, 6.0)] == [0.5, 0.5, None] and one(spark, S.norm01_strict(F.lit(3.0))) is None
    assert [one(spark, S.plan_label_score(F.lit(r).cast("double"), F.lit(t))) for r, t in ((None, 0.0), (1.0, 0.5), (0.25, 0.0), (0.5, 0.0), (0.75, 0.25))] == [None, 0.0, 0.0, 0.5, 1.0]


def test_extract(spark):
    assert one(spark, E.last_value(F.lit("a = 1\nr: x: 3 "))) == "3" and one(spark, E.last_value(F.lit("[timeout]"))) is None
    assert one(spark, E.norm_value(F.lit("The angle at B is 56 degrees."))) == "56"
    step = one(spark, E.parse_step(F.lit("<step>Executing: DEVIATION: why\n```python\nx = 1\n```</step>")))
    assert step.is_deviation and step.code == "x = 1" and step.wrapped


def test_sequences(spark):
    plan = F.array(*(F.lit(f"P{i}") for i in range(1, 6)))
    claimed = F.array(*map(F.lit, ["P1", "P3", "P2", "P5"]))
    assert one(spark, L.skips(plan, claimed)) == ["P4"] and one(spark, L.uncovered(plan, claimed)) == ["P4"]
    du = F.array(*(F.struct(F.array(*map(F.lit, d)).cast("array<string>").alias("defs"), F.array(*map(F.lit, u)).cast("array<string>").alias("uses")) for d, u in (("a", ""), ("b", "z"), ("c", "a"), ("d", "c"))))
    assert one(spark, L.load_bearing(du)) == [0, 2, 3]


def test_packing(spark):
    assert P.knapsacks([2, 3, 5, 7], 8) == [[7], [5, 3], [2]] and P.knapsacks([9], 8) == []
    for a, b, want in ((3000, 2000, (600, 400)), (2000, 3000, (400, 600)), (1000, 100, (900, 100)), (100, 1000, (100, 900)), (100, 500, (100, 500)), (500, 100, (500, 100)), (10, 10, (10, 10))):
        assert tuple(one(spark, P.truncated(F.lit(a), F.lit(b), 1000))) == want == tokens.fitted(a, b, 1000)
    ls = F.array(*map(F.lit, [3, 4, 6, 2, 8, 9]))
    assert one(spark, P.dynamic_batches(ls, 2, 10))[0] == 3 and one(spark, P.dynamic_batches(F.array(F.lit(6)), 2, 10)) == []
    row = lambda i, n: F.struct(F.array(*map(F.lit, i)).alias("input_ids"), F.array(*map(F.lit, n)).alias("labels"), F.array(*[F.lit(1.0)] * len(i)).alias("loss_weights"))
    got = one(spark, P.padding_free(F.array(row([0, 1], [0, 1]), row([10, 11, 12, 13], [10, 11, 12, 13])), 3))
    assert (got.input_ids, got.position_ids, got.labels, got.loss_weights) == ([0, 1, 10, 11, 12], [0, 1, 0, 1, 2], [0, 1, -100, 11, 12], [1.0, 1.0, 0.0, 1.0, 1.0])
    got = one(spark, P.padding_free(F.array(row([], []), row([7, 8], [7, 8]), row([9], [9])), 3))
    assert (got.input_ids, got.position_ids, got.labels, got.loss_weights) == ([7, 8, 9], [0, 1, 0], [-100, 8, -100], [0.0, 1.0, 0.0])
    for lengths, want in (([10, 10], [2]), ([20], []), ([20, 20], [2]), ([6] * 4, [3]), ([6] * 3, []), ([10, 10, 1], [2]), ([5] * 9, [4, 4])):
        assert one(spark, P.dynamic_batches(F.array(*map(F.lit, lengths)), 2, 10)) == want
    # Free of padding, a batch ends only when the next sample would exceed the budget.
    for lengths, want in (([10, 10], []), ([10, 10, 1], [2]), ([6, 6, 6, 6], [3])):
        assert one(spark, P.dynamic_batches(F.array(*map(F.lit, lengths)), 2, 10, False)) == want
    mask = one(spark, P.causal_mask(F.array(*map(F.lit, [1, 1, 2, 2, 2, 0]))))
    assert mask[1] == [1, 1, 0, 0, 0, 0] and mask[4] == [0, 0, 1, 1, 1, 0] and mask[5] == [0] * 6


def test_tokens():
    encode = lambda t: [ord(c) for c in t]
    chat = [{"role": "user", "content": "ab"}, {"role": "assistant", "content": "c"}, {"role": "user", "content": "d"}, {"role": "assistant", "content": "ef"}]
    got = tokens.supervised(chat, encode, 100)
    assert got["labels"] == [-100, -100, 99, -100, 101, 102] and got["input_ids"] == encode("abcdef")
    assert tokens.supervised(chat, encode, 100, mask_history=True)["labels"] == [-100, -100, -100, -100, 101, 102]
    assert len(tokens.supervised(chat, encode, 4)["input_ids"]) == 4
    rows = [{"input_ids": [1, 2, 3], "labels": [1, 2, 3]}, {"input_ids": [4, 5], "labels": [4, 5]}]
    assert tokens.packed(rows, 6)[0]["attention_mask"] == [1, 1, 1, 2, 2, 0, 0]
    assert tokens.flagged([0.5, 2.0], [1, 0]) == [0.5]


@pytest.mark.parametrize("name", sorted(tools.DIALECTS))
def test_dialects(name):
    d = tools.DIALECTS[name]
    calls = [("f", {"a": 1, "b": "x y"}), ("g", {"c": [1, 2]})][: 1 if name == "glm4" else 2]
    text = d.write(calls)
    text = f"<minimax:tool_call>\n{text}\n</minimax:tool_call>" if name == "minimax2" else text
    assert d.read(text) == (text if name == "glm4_moe" else calls)
    assert d.read("no call here") == "no call here"


def test_parts_and_overlap():
    assert tools.reply_parts('<think>a</think>b<tool_call>{"x": 1}</tool_call>') == [("reasoning", "a"), ("text", "b"), ("tool_call", '{"x": 1}')]
    assert overlap.bleu4("hello", "hello") == pytest.approx(1.0) and overlap.bleu4("", "a") == 0.0
    assert overlap.rouge("a b c".split(), "a c".split())["rouge-l"] == pytest.approx(0.8)


@pytest.mark.parametrize("padded", [True, False])
def test_stream_batches(spark, padded):
    lengths = [(i * 7919) % 23 + 1 for i in range(95)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "line_no long, n int")
    want, size, longest, total = [], 0, 0, 0
    for x in lengths:
        x = min(x, 20)
        if size and (max(longest, x) * (size + 1) if padded else total + x) > 40:
            want.append(size)
            size, longest, total = 0, 0, 0
        size, longest, total = size + 1, max(longest, x), total + x
        if padded and longest * size >= 40:
            want.append(size)
            size, longest, total = 0, 0, 0
    # Groups of 10 lines, and of 2, which many batches reach over.
    for batch in (10, 2):
        got = P.stream_batches(rows, "n", 2, 20, padded, batch=batch).orderBy("batch", "i").collect()
        assert [r["size"] for r in got] == want and sum(want) == len(lengths) - size
    steps = P.stream_batches(rows, "n", 2, 20, padded, batch=10, num_micro=3).orderBy("batch", "i").collect()
    assert [(r.step, r["size"]) for r in steps] == [(i // 3, n) for i, n in enumerate(want[: len(want) // 3 * 3])]
    assert P.stream_batches(rows.limit(0), "n", 2, 20, padded).count() == 0


def test_dynamic_query_crosses_groups(spark, tmp_path):
    from stepforge.plans import datasets

    lengths = [(i * 7919) % 9000 + 1 for i in range(2500)]
    spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    last = P._carried_on(lengths, (0, 0, 0), 4, 8192, True)[0]
    got = datasets.bat02_dynamic(spark, str(tmp_path)).collect()
    assert sum(r["size"] for r in got) == len(lengths) - last


def test_all_result_keys_are_sorted(spark, sf):
    from stepforge import catalog
    from stepforge.plans.lens import steps

    got = [tuple(r) for r in catalog.queries()["srt01_sorted_keys"](spark, sf).collect()]
    assert got == sorted(got) and len(got) == steps(spark, sf).count() > 50


def test_knapsacks_clip_at_the_capacity(spark, tmp_path):
    from stepforge.plans import datasets

    spark.createDataFrame([(0, 20_000), (1, 7000), (2, 1000)], "doc_id long, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = datasets.pck01_knapsacks(spark, str(tmp_path)).collect()
    assert [(r.bins, r["rows"], r.fullest) for r in got] == [(2, 3, 8000)]
