"""Chats as text: templates of slots by role, function calls, the layout with thoughts."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions.tools import DIALECTS
from stepforge.session import ship


class Template(NamedTuple):
    """Slots with ``{{content}}`` and, for users, ``{{idx}}``; a template may begin a chat."""

    user: str
    assistant: str
    observation: str
    function: str
    system: str
    prefix: str = ""
    default_system: str = ""


#: UDF-04: templates by name. The markers of these wire formats.
TEMPLATES: dict[str, Template] = {}


def register(name: str, template: Template) -> None:
    if name in TEMPLATES:
        raise ValueError(f"{name} is registered already")
    if not all("{{content}}" in slot for slot in template[:5]):
        raise ValueError("a slot needs a placeholder")
    TEMPLATES[name] = template


register(
    "chatml",
    Template(
        user="<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n",
        assistant="{{content}}<|im_end|>\n",
        observation="<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n",
        function="{{content}}<|im_end|>\n",
        system="<|im_start|>system\n{{content}}<|im_end|>\n",
    ),
)
register("alpaca", Template("### Instruction:\n{{content}}\n\n### Response:\n", "{{content}}\n\n", "{{content}}", "{{content}}", "{{content}}\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request."))


def filled(slot: str, **values: str | Column) -> Column:
    """FN-31: a slot with the first occurrence of each name replaced."""
    parts: list = [slot]
    for name, value in values.items():
        for i, p in enumerate(parts):
            if isinstance(p, str) and (mark := "{{" + name + "}}") in p:
                before, _, after = p.partition(mark)
                parts[i : i + 1] = [before, F.lit(value) if isinstance(value, str) else value, after]
                break
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def rendered(messages: Column, template: str = "chatml", system: Column | None = None) -> Column:
    """FN-38: the text of a chat of (role, content): prefix and system text, then each
    message in the slot of its role; null where a role has no slot."""
    t = TEMPLATES[template]
    lead = F.coalesce(system, F.lit("")) if system is not None else F.lit("")
    lead = F.when(lead == "", F.lit(t.default_system)).otherwise(lead)
    head = F.concat(F.lit(t.prefix), F.when(lead != "", filled(t.system, content=lead)).otherwise(""))

    def one(m, i):
        place = F.floor(i / 2).cast("string")
        return (
            F.when(m.role == "user", filled(t.user, content=m.content, idx=place))
            .when(m.role == "assistant", filled(t.assistant, content=m.content))
            .when(m.role == "observation", filled(t.observation, content=m.content))
            .when(m.role == "function", filled(t.function, content=m.content))
        )

    parts = F.transform(messages, one)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.concat(head, F.array_join(parts, "")))


def call_text(content: str, dialect: str = "default", thought: tuple[str, str] = ("<think>", "</think>"), calls: tuple[str, str] | None = None) -> str:
    """FN-32: a function message in a dialect's words. Its JSON stands alone, behind a thought,
    which stays, or between the words ``calls``, when all around it stays in front."""

    def between(words: tuple[str, str] | None) -> str | None:
        if not words or words[0] not in content:
            return None
        _, _, rest = content.partition(words[0])
        inner, end, _ = rest.partition(words[1])
        return words[0] + inner + words[1] if end else None

    marked, thoughts = between(calls), between(thought)
    if marked:
        kept, body = content.replace(marked, ""), marked[len(calls[0]) : -len(calls[1])]
    else:
        kept, body = thoughts or "", content.replace(thoughts, "") if thoughts else content
    found = json.loads(body)
    found = found if isinstance(found, list) else [found]
    return kept + DIALECTS[dialect].write([(c["name"], c["arguments"]) for c in found])


#: Fixed texts of the tool section in the layout with thoughts.
TOOLS_HEAD = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'


def _text(message: dict, kind: str = "text") -> str:
    return "".join(p["value"] for p in message["content"] if p["type"] == kind)


def last_question(messages: list[dict]) -> int:
    """The last plain user message that isn't a wrapped tool response; the end if none."""
    plain = lambda m: m["role"] == "user" and all(p["type"] == "text" for p in m["content"]) and not (_text(m).startswith("<tool_response>") and _text(m).endswith("</tool_response>"))
    return max((i for i, m in enumerate(messages) if plain(m)), default=len(messages) - 1)


def thinking_segments(messages: list[dict], tools: str | None = None, generate: bool = False, think: bool = False) -> list[tuple[str, float]]:
    """TOK-10: (text, loss weight) of each message. Thoughts stay only after the last question;
    tool responses that follow each other are one user turn."""
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    weight = lambda m: float(m["loss_weight"] if m.get("loss_weight") is not None else m["role"] == "assistant")
    out: list[tuple[str, float]] = []
    leads = messages[0]["role"] == "system"
    if tools:
        described = json.loads(tools)
        listed = "".join("\n" + json.dumps(t, ensure_ascii=False) for t in (described if isinstance(described, list) else [described]))
        out.append((turn("system", (_text(messages[0]) + "\n\n" if leads else "") + TOOLS_HEAD + listed + TOOLS_TAIL), weight(messages[0]) if leads else 0.0))
    elif leads:
        out.append((turn("system", _text(messages[0])), weight(messages[0])))
    asked, end = last_question(messages), len(messages) - 1
    is_tool = lambda i: 0 <= i <= end and messages[i]["role"] == "tool"
    for i, m in enumerate(messages):
        if m["role"] == "assistant":
            text, thought = _text(m), _text(m, "reasoning")
            if i > asked and (thought or i == end):
                said = "<think>\n" + thought.strip("\n") + "\n</think>\n\n" + text.lstrip("\n")
            else:
                said = text
            for n, call in enumerate(json.loads(p["value"]) for p in m["content"] if p["type"] == "tool_call"):
                arguments = call.get("arguments")
                arguments = arguments if isinstance(arguments, str) else json.dumps(arguments, ensure_ascii=False)
                said += ("\n" if n or text else "") + f'<tool_call>\n{{"name": "{call["name"]}", "arguments": {arguments}}}\n</tool_call>'
            out.append((turn("assistant", said), weight(m)))
        elif m["role"] == "tool":
            opened = "" if is_tool(i - 1) else "<|im_start|>user"
            closed = "" if is_tool(i + 1) else "<|im_end|>\n"
            out.append((f"{opened}\n<tool_response>\n{_text(m)}\n</tool_response>{closed}", weight(m)))
        elif m["role"] == "user" or i:
            out.append((turn(m["role"], _text(m)), weight(m)))
    if generate:
        out.append(("<|im_start|>assistant\n" + ("" if think else "<think>\n\n</think>\n\n"), 0.0))
    return out


def thinking_rendered(df: DataFrame, messages: str = "messages", keep: tuple[str, ...] = ()) -> DataFrame:
    """TOK-10 over rows, in Arrow batches: ``keep`` and segments (text, weight)."""
    import pyarrow as pa

    ship(df.sparkSession)
    kind = pa.list_(pa.struct([("text", pa.string()), ("weight", pa.float64())]))

    def run(batches):
        for b in batches:
            rows = [[{"text": t, "weight": w} for t, w in thinking_segments(m)] for m in b.column(b.schema.get_field_index(messages)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(rows, kind)], names=[*keep, "segments"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.mapInArrow(run, f"{fields}, segments array<struct<text:string,weight:double>>")
