"""Golden cases of rendering, checks and batch sizes."""

import time

import pytest
from pyspark.sql import functions as F

from stepforge.functions import checks, mathx
from stepforge.operators import batching, rendering
from stepforge.operators import datasets as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_slots(spark):
    assert one(spark, rendering.filled("a {{content}} b {{content}} {{idx}}", content="X", idx="3")) == "a X b {{content}} 3"
    with pytest.raises(ValueError):
        rendering.register("chatml", rendering.TEMPLATES["chatml"])
    with pytest.raises(ValueError):
        rendering.register("empty", rendering.Template("", "", "", "", ""))


def test_function_calls():
    call = '{"name": "f", "arguments": {"a": 1}}'
    plain = rendering.call_text(call)
    assert "f" in plain and rendering.call_text(f"<think>why</think>{call}") == "<think>why</think>" + plain
    assert rendering.call_text(f"first <c>{call}</c>", calls=("<c>", "</c>")) == "first " + plain
    with pytest.raises(ValueError):
        rendering.call_text("no call")


def test_thinking_layout():
    text = lambda role, value, kind="text": {"role": role, "content": [{"type": kind, "value": value}]}
    reply = {"role": "assistant", "content": [{"type": "reasoning", "value": "\nhm\n"}, {"type": "text", "value": "yes"}, {"type": "tool_call", "value": '{"name": "f", "arguments": {"a": 1}}'}]}
    chat = [text("system", "S"), text("user", "q"), reply, text("tool", "1"), text("tool", "2"), text("assistant", "done")]
    got = rendering.thinking_segments(chat)
    assert got[0] == ("<|im_start|>system\nS<|im_end|>\n", 0.0)
    assert got[2] == ('<|im_start|>assistant\n<think>\nhm\n</think>\n\nyes\n<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call><|im_end|>\n', 1.0)
    assert [t for t, _ in got[3:5]] == ["<|im_start|>user\n<tool_response>\n1\n</tool_response>", "\n<tool_response>\n2\n</tool_response><|im_end|>\n"]
    assert got[5][0] == "<|im_start|>assistant\n<think>\n\n</think>\n\ndone<|im_end|>\n"
    # A thought before the last question goes.
    assert "hm" not in "".join(t for t, _ in rendering.thinking_segments([*chat, text("user", "again")]))
    with_tools = rendering.thinking_segments(chat[:2], tools='{"name": "f"}', generate=True)
    assert with_tools[0][0].startswith("<|im_start|>system\nS\n\n# Tools") and '\n{"name": "f"}\n</tools>' in with_tools[0][0]
    assert with_tools[-1] == ("<|im_start|>assistant\n<think>\n\n</think>\n\n", 0.0)


def test_roots_and_time():
    assert checks.roots_check("solve(x**2 - 9, x)", "[-3, 3]") == "PASS" and checks.roots_check("solve(x**2 - 9, x)", "[3, 4]") == "FAIL"
    assert checks.roots_check("solve(x - a, x)", "[a]") == "PASS" and checks.roots_check("solve(x, x)", "[]") is None and checks.roots_check(None, None) is None
    began = time.perf_counter()
    assert checks.within(5, lambda: True) and not checks.within(0.2, lambda: time.sleep(3) or True)
    assert time.perf_counter() - began < 2


def test_sizes_must_divide():
    assert batching.info_of(2, 4, 10, 16) == (2, 2, 10) and batching.info_of(2, 4, 10).num_micro == 1
    with pytest.raises(ValueError):
        batching.info_of(2, 4, 10, 12)
    with pytest.raises(ValueError):
        batching.info_of(2, 4, 10, drop_last=False)
    info = batching.Info(2, 3, 10)
    assert [(s.provider_rows(info), s.steps(13, info)) for s in batching.STRATEGIES.values()] == [(6, 2), (6, 2), (1, 3), (1, 3)]


def test_parts(spark):
    t = spark.range(10).withColumnRenamed("id", "line_no")
    with pytest.raises(ValueError):
        D.prepared(t, t, 0.5)
    parts = D.prepared(t, size=0.3)
    assert (parts["train"].count(), parts["validation"].count()) == (7, 3) and set(D.prepared(t, {"a": t})) == {"train", "validation_a"}


@pytest.mark.parametrize(
    ("pred", "gold", "same"),
    [
        ("[1, 2]", "(1, 2)", True), ("\\frac12", "0.5", True), ("2\\pi r", "2*pi*r", True), ("x=3", "y=4", False), ("x=3", "2x=6", False), ("x-3=0", "3-x=0", True),
        ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&5\\end{pmatrix}", False), ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&4.0\\end{pmatrix}", True),
        ("1,000", "1000", True), ("90^\\circ", "90", True), ("2^{10}", "1024", True), ("sin(x)^2+cos(x)^2", "1", True), ("a(b+c)", "ab+ac", False), ("a*(b+c)", "a*b+a*c", True), ("\\sqrt[3]{8}", "2", True), ("((", "1", False), ("", "1", False),
        ("-5", "5", False), ("(1, 2)", "(1, 2, 3)", False), ("5 \\text{ cm}", "5", True), ("12 square units", "12", True),
    ],
)
def test_answers(pred, gold, same):
    assert mathx.is_correct(pred, gold) is same
