"""Alignment of chat and instruction records, as expressions over one row.

Messages are arrays of structs (role, content). Aligned records have prompt and response
arrays and a system text; a broken record has empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source tags and the roles they stand for; who may speak at even places
#: and who at odd ones.
TAGS = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "observation": "observation", "function_call": "function", "function": "function", "system": "system"}
EVEN, ODD = ("user", "observation"), ("assistant", "function")
MESSAGES = "array<struct<role:string,content:string>>"
#: UDF-01, UDF-02: converters by name.
CONVERTERS: dict = {}


def converter(name: str):
    """Register a builder of expressions under a name."""

    def keep(fn):
        if name in CONVERTERS:
            raise ValueError(f"{name} is registered already")
        CONVERTERS[name] = fn
        return fn

    return keep


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def none() -> Column:
    return F.array().cast(MESSAGES)


def role_of(tag: Column) -> Column:
    pairs = [F.lit(x) for kv in TAGS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), tag)


def _without_system(messages: Column) -> tuple[Column, Column]:
    leads = F.coalesce(F.get(messages, F.lit(0)).role == "system", F.lit(False))
    rest = F.when(leads, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return F.when(leads, F.get(messages, F.lit(0)).content).otherwise(""), rest


@converter("sharegpt")
def sharegpt(messages: Column, ranking: bool = False) -> Column:
    """PRJ-09: who speaks must alternate and the count must be even (odd for rankings)."""
    messages = F.transform(messages, lambda m: F.struct(F.coalesce(role_of(m.role), F.lit("?")).alias("role"), m.content.alias("content")))
    system, rest = _without_system(messages)
    fits = F.forall(F.transform(rest, lambda m, i: F.when(i % 2 == 0, m.role.isin(*EVEN)).otherwise(m.role.isin(*ODD))), lambda ok: ok)
    broken = ~fits | (F.size(rest) % 2 != (1 if ranking else 0)) | (F.size(rest) == 0)
    prompt = F.slice(rest, F.lit(1), F.greatest(F.size(rest) - (0 if ranking else 1), F.lit(0)))
    response = none() if ranking else F.slice(rest, -1, 1)
    return F.struct(F.when(broken, none()).otherwise(prompt).alias("prompt"), F.when(broken, none()).otherwise(response).alias("response"), system.alias("system"), broken.alias("broken"))


def joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


@converter("alpaca")
def alpaca(instruction: Column, query: Column, output: Column, history: Column | None = None, system: Column | None = None, chosen: Column | None = None, rejected: Column | None = None, kto: Column | None = None) -> Column:
    """PRJ-08: history pairs, then instruction and query; the response by kind."""
    past = F.flatten(F.transform(history, lambda p: F.array(message("user", p[0]), message("assistant", p[1])))) if history is not None else none()
    prompt = F.concat(past, F.array(message("user", joined(instruction, query))))
    if kto is not None:
        pair = F.array(message("assistant", output), message("assistant", F.lit("")))
        response = F.when(kto, pair).otherwise(F.reverse(pair))
    elif chosen is not None:
        response = F.array(message("assistant", chosen), message("assistant", rejected))
    else:
        response = F.when(output.isNotNull(), F.array(message("assistant", output))).otherwise(none())
    return F.struct(prompt.alias("prompt"), response.alias("response"), (F.coalesce(system, F.lit("")) if system is not None else F.lit("")).alias("system"))


@converter("openai")
def openai(messages: Column) -> Column:
    """PRJ-10: tool results that follow each other become one observation; what a record
    ends with after its last reply is lost."""
    start = F.struct(none().alias("out"), F.array().cast("array<string>").alias("tools"))

    def step(s, m):
        tool = m.role == "tool"
        waiting = F.size(s.tools) > 0
        flushed = F.when(waiting, F.concat(s.out, F.array(message("observation", F.array_join(s.tools, "\n"))))).otherwise(s.out)
        role = F.when(m.role == "assistant", "assistant").otherwise(m.role)
        return F.struct(
            F.when(tool, s.out).otherwise(F.concat(flushed, F.array(F.struct(role.alias("role"), m.content.alias("content"))))).alias("out"),
            F.when(tool, F.concat(s.tools, F.array(m.content))).otherwise(F.array().cast("array<string>")).alias("tools"),
        )

    return sharegpt(F.aggregate(messages, start, step).out)


def weighted_message(role: str, content: Column, weight: float) -> Column:
    part = F.struct(F.lit("text").alias("type"), content.alias("value"))
    return F.struct(F.lit(role).alias("role"), F.array(part).alias("content"), F.lit(float(weight)).alias("loss_weight"))


@converter("v1_alpaca")
def v1_alpaca(instruction: Column, query: Column, output: Column, system: Column | None = None) -> Column:
    """PRJ-13: weighted messages; instruction and input join without a newline."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    user = F.concat(F.coalesce(instruction, F.lit("")), F.coalesce(query, F.lit("")))
    rows = [] if system is None else [F.when(given(system), weighted_message("system", system, 0.0))]
    rows += [F.when(user != "", weighted_message("user", user, 0.0)), F.when(given(output), weighted_message("assistant", output, 1.0))]
    return F.array_compact(F.array(*rows))


@converter("v1_sharegpt")
def v1_sharegpt(messages: Column) -> Column:
    """PRJ-14: weighted messages; null for a record with an unknown tag."""
    roles = F.create_map(*(F.lit(x) for kv in {"system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "observation": "tool", "function_call": "assistant"}.items() for x in kv))

    def one(m):
        role = F.try_element_at(roles, m.role)
        part = F.struct(F.when(m.role == "function_call", "tool_call").otherwise("text").alias("type"), m.content.alias("value"))
        return F.struct(role.alias("role"), F.array(part).alias("content"), F.when(role == "assistant", 1.0).otherwise(0.0).alias("loss_weight"))

    return F.when(F.forall(messages, lambda m: F.map_contains_key(roles, m.role)), F.transform(messages, one))


@converter("v1_pair")
def v1_pair(chosen: Column, rejected: Column) -> Column:
    """PRJ-15: both sides of a pair as weighted messages."""
    return F.struct(v1_sharegpt(chosen).alias("chosen_messages"), v1_sharegpt(rejected).alias("rejected_messages"))


def found_media(paths: Column, folder: str) -> Column:
    """PRJ-11: media paths under a folder."""
    return F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)))


def media_counted(messages: Column, media: Column, placeholder: str = "<image>") -> Column:
    """FLT-16: as many placeholders as media."""
    n = F.aggregate(F.transform(messages, lambda m: F.regexp_count(m.content, F.lit(placeholder))), F.lit(0), lambda a, x: a + x)
    return n == F.coalesce(F.size(media), F.lit(0))


def valid_example(prompt: Column, response: Column, ranking: bool = False) -> Column:
    """FLT-11: an odd prompt and one response, or two for rankings."""
    return (F.size(prompt) % 2 == 1) & ((F.size(response) > 1) if ranking else (F.size(response) == 1))


def aligned(df, kind: str, *columns: str, keep: tuple[str, ...] = (), **options):
    """PRJ-12: a converter over all rows; source columns go, but for ``keep``."""
    a = CONVERTERS[kind](*map(F.col, columns), **options)
    return df.select(*keep, a.alias("_a")).select(*keep, "_a.*")


def tagged(df, name: str):
    """PRJ-16: rows with the name of their dataset in front."""
    return df.select(F.lit(name).alias("_dataset_name"), *df.columns)


def request(messages: Column) -> Column:
    """PRJ-18: a chat request as aligned messages; the last must be a user's or a tool's."""
    roles = F.create_map(*(F.lit(x) for kv in {"user": "user", "assistant": "assistant", "system": "system", "function": "function", "tool": "observation"}.items() for x in kv))
    known = F.transform(messages, lambda m: F.struct(F.coalesce(F.try_element_at(roles, m.role), F.lit("?")).alias("role"), m.content.alias("content")))
    system, rest = _without_system(known)
    fits = F.forall(F.transform(rest, lambda m, i: F.when(i % 2 == 0, m.role.isin(*EVEN)).otherwise(m.role.isin(*ODD))), lambda ok: ok)
    broken = ~fits | (F.size(rest) % 2 == 0)
    return F.struct(F.when(broken, none()).otherwise(rest).alias("prompt"), system.alias("system"), broken.alias("broken"))
