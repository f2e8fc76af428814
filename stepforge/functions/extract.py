"""Text extraction as column expressions; white space and digits are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of score tags, tried in this order.
SCORE_TAG = r"<score>\s*([0-9]*\.?[0-9]+)\s*</score>"
SUMMARY_TAG = r"<summary>\s*([0-9]*\.?[0-9]+)\s*</summary>"
SUMMARY_TEXT = r"(?i)summary score is\s*([0-9]*\.?[0-9]+)"
SCORE_COLON = r"(?i)\bscore\s*[:=]\s*([0-9]*\.?[0-9]+)"
PLAN_TAG = r"<plan_score>\s*([0-9]*\.?[0-9]+)\s*</plan_score>"
STEP_TAG = r"<step_score>\s*([0-9]*\.?[0-9]+)\s*</step_score>"
#: Outputs that have no printed value.
NO_VALUE = ("[no output]", "[timeout]", "[output too long, discarded]")
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def strip(c: Column) -> Column:
    """All Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def parse_score(text: Column) -> Column:
    """FN-10: the first pattern that matches decides, even if its value is out of range;
    the last pattern takes its last match."""
    from stepforge.functions.scores import norm01

    t = F.coalesce(text, F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(SCORE_COLON), F.lit(1)), F.lit(-1))
    return (
        F.when(t.rlike(SCORE_TAG), norm01(_number(F.regexp_extract(t, SCORE_TAG, 1))))
        .when(t.rlike(SUMMARY_TAG), norm01(_number(F.regexp_extract(t, SUMMARY_TAG, 1))))
        .when(t.rlike(SUMMARY_TEXT), norm01(_number(F.regexp_extract(t, SUMMARY_TEXT, 1))))
        .otherwise(norm01(_number(last)))
    )


def parse_dual_score(text: Column) -> Column:
    """FN-11: struct of plan_score and step_score, each null where its tag is missing."""
    from stepforge.functions.scores import norm01

    t = F.coalesce(text, F.lit(""))
    return F.struct(norm01(_number(first_group(t, PLAN_TAG))).alias("plan_score"), norm01(_number(first_group(t, STEP_TAG))).alias("step_score"))


def _lines(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: x.rlike(r"(?U)\S"))


def _last_line(c: Column) -> Column:
    return F.try_element_at(_lines(c), F.lit(-1))


def last_value_loose(output: Column) -> Column:
    """FN-12: tail of the last line after its first ``:`` or ``=``."""
    last = _last_line(output)
    value = F.when(last.rlike(r"[:=]\s*.+$"), F.regexp_extract(last, r"[:=]\s*(.+)$", 1)).otherwise(last)
    return F.when(output.isNull() | output.isin("", "[no output]", "[timeout]") | output.contains("Traceback"), F.lit(None).cast("string")).otherwise(strip(value))


def tail(line: Column) -> Column:
    """FN-14: what follows the last ``": "``, else a single ``=``, else the whole line."""
    return strip(F.when(line.contains(": "), F.substring_index(line, ": ", -1)).when(F.regexp_count(line, F.lit("=")) == 1, F.substring_index(line, "=", -1)).otherwise(line))


def last_value(output: Column) -> Column:
    """FN-14: the tail of the last printed line."""
    return F.when(output.isNull() | output.isin("", *NO_VALUE) | output.contains("Traceback"), F.lit(None).cast("string")).otherwise(tail(_last_line(output)))


def has_value(output: Column) -> Column:
    """Whether ``last_value`` isn't null: some line has more than white space."""
    return F.coalesce(~output.isin("", *NO_VALUE) & ~output.contains("Traceback") & output.rlike(r"(?U)[^\s\x1c-\x1e]"), F.lit(False))


def terminal_candidates(outputs: Column, most: int = 8) -> Column:
    """WIN-05: tails of printed lines, from the chain's end backwards."""
    usable = F.filter(outputs, lambda o: o.isNotNull() & ~o.isin(*NO_VALUE) & ~o.contains("Traceback"))
    return F.slice(F.flatten(F.transform(F.reverse(usable), lambda o: F.transform(F.reverse(_lines(o)), tail))), 1, most)


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def norm_value(v: Column) -> Column:
    """FN-15: the number that ends a sentence of more than four words."""
    v = strip(v)
    pattern = r"(-?[0-9]+(?:\.[0-9]+)?(?:/[0-9]+)?)\s*(?:degrees?|°)?\s*\.?$"
    return F.when((words(v) > 4) & v.rlike(pattern), F.regexp_extract(v, pattern, 1)).otherwise(v)


def mathy(v: Column) -> Column:
    """FN-16: short, of few words, with something of mathematics in it."""
    return (F.length(v) <= 60) & (words(v) <= 6) & v.rlike(r"(?U)\d|sqrt|pi|frac")


def value_kind(v: Column) -> Column:
    """FN-13: the class within which values can be compared, as text; null if none."""
    s = strip(v)
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    none = F.lit(None).cast("string")
    return (
        F.when((s == "") | s.rlike(r"<=|>=|<|>|\.\.\."), none)
        .when(s.startswith("Eq("), "eq")
        .when(((first == "(") & (last == ")")) | ((first == "[") & (last == "]")), F.concat(F.lit("seq"), first, F.regexp_count(s, F.lit(",")).cast("string")))
        .when((words(s) > 4) | s.rlike("[A-Za-z]{12,}") | (F.length(s) > 80), none)
        .otherwise("expr")
    )


def parse_step(chunk: Column) -> Column:
    """FN-18: struct of a generated step, null where its claim or code is missing."""
    wrapped = chunk.rlike("(?s)<step>.*?</step>")
    body = F.when(wrapped, F.regexp_extract(chunk, "(?s)<step>(.*?)</step>", 1)).otherwise(chunk)
    claim, code = r"(?iU)executing:\s*(P\d+|DEVIATION[^\n]*)", r"(?sU)```python\s*(.*?)```"
    claimed = strip(F.regexp_extract(body, claim, 1))
    step = F.struct(claimed.alias("claimed"), F.upper(claimed).startswith("DEVIATION").alias("is_deviation"), strip(F.regexp_extract(body, code, 1)).alias("code"), chunk.alias("raw"), wrapped.alias("wrapped"))
    return F.when(body.rlike(claim) & body.rlike(code), step)


def answer_tag(text: Column) -> Column:
    """FN-19: text of the answer tag."""
    return strip(first_group(text, "(?s)<answer>(.*?)</answer>"))


def spoils(descriptions: Column, problem: Column) -> Column:
    """FLT-06: a plan text has a number, other than 1 and 2, that the problem lacks."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    found = F.flatten(F.transform(descriptions, lambda d: numbers(F.coalesce(d, F.lit("")))))
    return F.size(F.array_except(found, F.concat(numbers(problem), F.array(F.lit("1"), F.lit("2"))))) > 0


def final_answer(answer: Column) -> Column:
    """PRJ-04: what follows the last ``####``, without commas."""
    return F.when(answer.contains("####"), F.replace(strip(F.substring_index(answer, "####", -1)), F.lit(","), F.lit(""))).otherwise(answer)


#: Names of a problem's fields, first present first taken.
PROBLEM_FIELDS = ("problem", "question", "query", "prompt", "input")
ANSWER_FIELDS = ("answer", "final_answer", "gt_answer", "gt", "target", "answer_text", "solution", "label")
BENCH_ANSWER_FIELDS = ("answer", "solution", "gt", "gt_answer", "target", "label")


def coalesced(columns: list[str], names: tuple[str, ...]) -> Column:
    """PRJ-02, 05..07: the first of ``names`` that is there and not null."""
    there = [F.col(n) for n in names if n in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def factor_check(code: Column, output: Column) -> Column:
    """FN-21: whether printed prime powers multiply back to the factored number, as exact
    decimals; null where a pair can't be read or a product exceeds 38 digits."""
    big = "decimal(38,0)"
    integer = lambda c: F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast(big))
    n = first_group(code, r"factorint\s*\(\s*([0-9]+)\s*\)").try_cast(big)
    body = first_group(output, r"\{([^}]*)\}")
    pairs = F.transform(F.split(body, ","), lambda p: F.split(p, ":"))
    readable = F.forall(pairs, lambda p: (F.size(p) == 2) & F.coalesce(integer(F.get(p, F.lit(0))), integer(F.get(p, F.lit(1)))).isNotNull() & integer(F.get(p, F.lit(0))).isNotNull() & integer(F.get(p, F.lit(1))).isNotNull())

    def product(sign: int) -> Column:
        """Product of the powers whose exponent has this sign."""
        powers = F.transform(pairs, lambda p: F.struct(integer(F.get(p, F.lit(0))).alias("base"), (sign * integer(F.get(p, F.lit(1)))).cast("int").alias("times")))
        factors = F.flatten(F.transform(powers, lambda p: F.array_repeat(p.base, F.least(F.greatest(p.times, F.lit(0)), F.lit(200)))))
        return F.aggregate(factors, F.lit(1).cast(big), lambda s, x: F.try_multiply(s, x).cast(big))

    above, below = product(1), product(-1)
    same = above == F.try_multiply(n, below)
    return F.when(n.isNull() | ~readable | (below == 0) | same.isNull(), F.lit(None).cast("string")).when(same, "PASS").otherwise("FAIL")


def first_of_list(text: Column) -> Column:
    """PRJ-03: the first element of an answer that is a JSON list, else the answer."""
    listed = F.from_json(text, "array<string>")
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$") & listed.isNotNull() & (F.size(listed) > 0), F.get(listed, F.lit(0))).otherwise(text)
