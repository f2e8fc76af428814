"""Checks of plans and of computed results that templates of code tell."""

from __future__ import annotations

import re
import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.functions import extract as E
from stepforge.functions import mathx

STAGES = "array<struct<id:string,desc:string,action:string>>"


def plan_stages(text: Column) -> Column:
    """FN-24: the JSON from the first ``[`` to the last ``]`` as stages; null if it is none."""
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(found != "", F.from_json(found, STAGES))


def valid_plan(stages: Column) -> Column:
    """FLT-15: every stage has id, description and action."""
    return F.coalesce(F.forall(stages, lambda s: s.isNotNull() & s["id"].isNotNull() & s["desc"].isNotNull() & s["action"].isNotNull()), F.lit(False))


SOLVE = re.compile(r"solve\s*\(\s*([^,]+?)\s*,\s*(\w+)\s*\)")


def _with(tree, name: str, root):
    """``tree`` with a tree in place of a name."""
    if tree[0] == "name":
        return root if tree[1] == name else tree
    if tree[0] in ("op", "call"):
        return (*tree[:2], *(_with(t, name, root) for t in tree[2:]))
    return tree


def roots_check(code: str | None, output: str | None) -> str | None:
    """FN-22: whether the printed roots of ``solve(expression, variable)`` make it zero, by
    value; null where the code has none, no list is printed or either can't be read."""
    call, listed = SOLVE.search(code or ""), re.search(r"\[([^\]]*)\]", output or "")
    roots = [r for r in listed[1].split(",") if r.strip()] if listed else []
    expression = mathx.tree_of(call[1].replace("**", "^")) if call and roots else None
    trees = [mathx.tree_of(r.strip()) for r in roots]
    if expression is None or None in trees:
        return None
    zero = ("num", 0.0)
    return "PASS" if all(mathx.same_value(_with(expression, call[2], t), zero) for t in trees) else "FAIL"


@F.pandas_udf(T.StringType())
def roots_check_udf(code: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([roots_check(c, o) for c, o in zip(code, output, strict=True)])


def c2_verdict(code: Column, output: Column) -> Column:
    """FN-23: the first template that decides; else whether there is a value at all."""
    ran = ~output.contains("Traceback") & (output != "[timeout]")
    decided = F.when(F.coalesce(ran, F.lit(True)), F.coalesce(E.factor_check(code, output), roots_check_udf(code, output)))
    value = F.when(F.coalesce(ran, F.lit(True)), E.last_value_loose(output))
    return F.coalesce(decided, F.when(value.isNotNull(), "UNCHECKABLE_value").otherwise("UNCHECKABLE_novalue"))


@contextmanager
def _alarm(seconds: float):
    def raised(signum, frame):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, raised)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def within(seconds: float, fn: Callable, *args) -> bool:
    """FN-51: ``fn(*args)``, false once the time is over. Off the main thread no alarm can
    be set; the call runs there without one."""
    if threading.current_thread() is not threading.main_thread():
        return bool(fn(*args))
    try:
        with _alarm(seconds):
            return bool(fn(*args))
    except TimeoutError:
        return False
