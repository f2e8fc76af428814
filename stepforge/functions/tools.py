"""Tool-call dialects: how calls are written in text and read back.

A dialect is a writer and a reader of calls ``(name, arguments)``; readers give the text
itself back where it has no well-formed calls. Most dialects are one of three families:
JSON objects in a frame, nested tags, or a whole JSON text.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Call = tuple[str, dict]


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False)


def _plain(v) -> str:
    return v if isinstance(v, str) else _json(v)


def _loaded(text: str):
    """Parsed JSON, or the text itself."""
    try:
        return json.loads(text.strip())
    except ValueError:
        return text


@dataclass(frozen=True)
class Dialect:
    write: Callable[[list[Call]], str]
    find: Callable[[str], list[Call] | None]

    def read(self, text: str) -> list[Call] | str:
        try:
            found = self.find(text)
        except (ValueError, KeyError, TypeError, SyntaxError, AttributeError):
            found = None
        return text if found is None else found


def _objects(key: str, one_bare: bool = False) -> Dialect:
    """A JSON text: a list of objects, or one object."""

    def write(calls):
        rows = [{"name": n, key: a} for n, a in calls]
        return _json(rows[0] if one_bare and len(rows) == 1 else rows)

    def find(text):
        rows = json.loads(text.strip())
        return [(r["name"], r[key]) for r in (rows if isinstance(rows, list) else [rows])]

    return Dialect(write, find)


_BLOCK = re.compile(r"<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)", re.S)


def _find_blocks(text: str) -> list[Call] | None:
    rows = [json.loads(b.strip()) for b in _BLOCK.findall(text)]
    return [(r["name"], r["arguments"]) for r in rows] or None


def _write_blocks(calls: list[Call]) -> str:
    return "\n".join(f"<tool_call>\n{_json({'name': n, 'arguments': a})}\n</tool_call>" for n, a in calls)


def _tagged(outer: str, lead: str, wrap: str, strip: bool) -> Dialect:
    """``<function=name><parameter=key>value`` within an outer tag."""
    call = re.compile(rf"<{outer}>\s*<function=\s*([^\s<>]+)\s*(.*?)\s*</function>\s*</{outer}>", re.S)
    given = re.compile(r"<parameter=(.*?)>(.*?)</parameter>", re.S)

    def write(calls):
        body = lambda a: "".join(f"\n<parameter={k}>{wrap}{_plain(v)}{wrap}</parameter>" for k, v in a.items())
        return "\n".join(f"{lead}<{outer}>\n<function={n}>{body(a)}\n</function>\n</{outer}>" for n, a in calls)

    def value(raw):
        v = _loaded(raw)
        return v.strip() if strip and isinstance(v, str) else v

    def find(text):
        return [(n, {k: value(v) for k, v in given.findall(block)}) for n, block in call.findall(text)] or None

    return Dialect(write, find)


def _find_actions(text: str) -> list[Call] | None:
    found = re.findall(r"Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)", text, re.S)
    return [(n.strip(), json.loads(a.strip().strip('"').strip("`"))) for n, a in found] or None


def _write_single(calls: list[Call]) -> str:
    if len(calls) > 1:
        raise ValueError("this dialect has no parallel calls")
    return f"{calls[0][0]}\n{_json(calls[0][1])}"


def _find_single(text: str) -> list[Call] | None:
    name, newline, rest = text.partition("\n")
    return [(name, json.loads(rest.strip()))] if newline else None


def _find_lines(text: str) -> list[Call] | None:
    frame = re.search(r"<tool_calls>\s*(.+?)\s*</tool_calls>", text, re.S)
    rows = [_loaded(x) for x in frame[1].split("\n") if x.strip()] if frame else None
    return None if rows is None else [(r["name"], r["arguments"]) for r in rows if not isinstance(r, str)]


def _find_invokes(text: str) -> list[Call] | None:
    frame = re.search(r"<minimax:tool_call>\s*(.+?)\s*</minimax:tool_call>", text, re.S)
    if not frame:
        return None
    given = re.compile(r'<parameter name="(.*?)">(.*?)</parameter>', re.S)
    return [(n.strip(), {k: _loaded(v) for k, v in given.findall(b)}) for n, b in re.findall(r'<invoke name="(.*?)">(.*?)</invoke>', frame[1], re.S)]


def _write_invokes(calls: list[Call]) -> str:
    body = lambda a: "".join(f'\n<parameter name="{k}">{_plain(v)}</parameter>' for k, v in a.items())
    return "\n".join(f'<invoke name="{n}">{body(a)}\n</invoke>' for n, a in calls)


def _write_pairs(calls: list[Call]) -> str:
    body = lambda a: "".join(f"\n<arg_key>{k}</arg_key>\n<arg_value>{_plain(v)}</arg_value>" for k, v in a.items())
    return "\n".join(f"\n<tool_call>{n}{body(a)}" for n, a in calls)


_START, _END = "<|tool_call_start|>", "<|tool_call_end|>"
_LITERALS = {"true": True, "false": False, "null": None}


def _write_python(calls: list[Call]) -> str:
    given = lambda a: ", ".join(f'{k}="{v}"' if isinstance(v, str) else f"{k}={_json(v)}" for k, v in a.items())
    return f"{_START}[{', '.join(f'{n}({given(a)})' for n, a in calls)}]{_END}"


def _find_python(text: str) -> list[Call] | None:
    _, start, rest = text.partition(_START)
    body, end, _ = rest.partition(_END)
    if not (start and end):
        return None
    tree = ast.parse(body.strip(), mode="eval").body
    value = lambda n: _LITERALS[n.id] if isinstance(n, ast.Name) else ast.literal_eval(n)
    calls = tree.elts if isinstance(tree, ast.List) else [tree]
    return [(c.func.id, {k.arg: value(k.value) for k in c.keywords}) for c in calls] or None


#: UDF-03: dialects by name.
DIALECTS = {
    "default": Dialect(lambda cs: "\n".join(f"Action: {n}\nAction Input: {_json(a)}" for n, a in cs), _find_actions),
    "glm4": Dialect(_write_single, _find_single),
    "llama3": _objects("parameters", one_bare=True),
    "mistral": _objects("arguments"),
    "qwen": Dialect(_write_blocks, _find_blocks),
    "ling": Dialect(_write_blocks, _find_blocks),
    "glm4_moe": Dialect(_write_pairs, _find_blocks),
    "qwen3_5": _tagged("tool_call", "", "\n", True),
    "seed_oss": _tagged("seed:tool_call", "\n", "", False),
    "minimax1": Dialect(lambda cs: "<tool_calls>\n" + "\n".join(_json({"name": n, "arguments": a}) for n, a in cs) + "\n</tool_calls>", _find_lines),
    "minimax2": Dialect(_write_invokes, _find_invokes),
    "lfm2": Dialect(_write_python, _find_python),
}
_CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))


def calls_udf(dialect: str):
    """FN-33: column of calls in a text, null without any."""

    @F.pandas_udf(_CALLS)
    def find(text: pd.Series) -> pd.Series:
        found = (DIALECTS[dialect].read(t or "") for t in text)
        return pd.Series([None if isinstance(x, str) else [(n, _json(a)) for n, a in x] for x in found])

    return find


def without_thought(text):
    """FN-34: a thought block and the newlines after it off."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\n+", "")


def reply_parts(text: str) -> list[tuple[str, str]]:
    """FN-35: a generated text as parts of kind text, reasoning or tool_call."""
    out, at = [], 0
    for m in re.finditer(r"<(think|tool_call)>\s*(.*?)\s*</\1>\s*", text, re.S):
        if between := text[at : m.start()].strip():
            out.append(("text", between))
        out.append(("reasoning" if m[1] == "think" else "tool_call", m[2]))
        at = m.end()
    return out + ([("text", rest)] if (rest := text[at:].strip()) else [])
