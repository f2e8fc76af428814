"""Queries for text functions and mathematical equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions import extract as E
from stepforge.functions import mathx
from stepforge.plans.lens import read
from stepforge.session import ship


def _answers(spark, d):
    """Generated texts with scores in several styles, from lineitems."""
    v = F.format_string("%.2f", "l_discount")
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount",
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("so <score> "), v, F.lit(" </score>")))
        .when(F.col("l_linenumber") % 5 == 1, F.concat(F.lit("<summary>"), F.col("l_linenumber").cast("string"), F.lit("</summary>")))
        .when(F.col("l_linenumber") % 5 == 2, F.concat(F.lit("Score: 0.9, then score="), v))
        .when(F.col("l_linenumber") % 5 == 3, F.concat(F.lit("the Summary Score is "), v))
        .otherwise("<score>7</score> score: 0.5").alias("text"),
    )


def fn10_parse_score(spark, d):
    return _answers(spark, d).withColumn("score", E.parse_score(F.col("text"))).groupBy("text").agg(F.max("score").alias("score"), F.count("*").alias("n"))


FN10 = """WITH t AS (SELECT l_linenumber % 5 AS k, l_linenumber AS l, printf('%.2f', l_discount) AS v FROM lineitem)
SELECT CASE k WHEN 0 THEN 'so <score> ' || v || ' </score>' WHEN 1 THEN '<summary>' || l || '</summary>' WHEN 2 THEN 'Score: 0.9, then score=' || v WHEN 3 THEN 'the Summary Score is ' || v ELSE '<score>7</score> score: 0.5' END AS text,
max(CASE k WHEN 1 THEN CASE WHEN l = 1 THEN 1.0 WHEN l <= 5 THEN (l - 1) / 4.0 END WHEN 4 THEN NULL ELSE v::DOUBLE END)::DOUBLE AS score, count(*) AS n FROM t GROUP BY 1"""


def fn11_dual_scores(spark, d):
    text = F.concat(F.lit("<plan_score>"), F.format_string("%.2f", "l_tax"), F.lit("</plan_score>"), F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("\n<step_score> "), F.format_string("%.2f", "l_discount"), F.lit("</step_score>"))).otherwise(""))
    t = read(spark, d, "lineitem").select(E.parse_dual_score(text).alias("s"))
    return t.groupBy(F.col("s.plan_score").alias("plan_score"), F.col("s.step_score").alias("step_score")).agg(F.count("*").alias("n"))


FN11 = "SELECT printf('%.2f', l_tax)::DOUBLE AS plan_score, CASE WHEN l_linenumber % 3 <> 0 THEN printf('%.2f', l_discount)::DOUBLE END AS step_score, count(*) AS n FROM lineitem GROUP BY ALL"


def fn14_last_values(spark, d):
    t = read(spark, d, "documents").select("doc_id", E.last_value(F.col("text")).alias("value"))
    return t.select("doc_id", "value", F.length("value").alias("chars"))


FN14 = """WITH l AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_matches(x, '[^\\s]'))[-1] AS x FROM documents),
v AS (SELECT doc_id, text, CASE WHEN contains(x, ': ') THEN list_extract(string_split(x, ': '), -1) WHEN len(x) - len(replace(x, '=', '')) = 1 THEN string_split(x, '=')[2] ELSE x END AS x FROM l)
SELECT doc_id, CASE WHEN text = '' OR contains(text, 'Traceback') THEN NULL ELSE trim(x, chr(32) || chr(9) || chr(10) || chr(13)) END AS value, CASE WHEN text = '' OR contains(text, 'Traceback') THEN NULL ELSE length(trim(x, chr(32) || chr(9) || chr(10) || chr(13))) END AS chars FROM v"""


def fn13_value_kinds(spark, d):
    v = F.expr("CASE p_size % 6 WHEN 0 THEN concat('Eq(x, ', p_size, ')') WHEN 1 THEN concat('(', p_size, ', 2)') WHEN 2 THEN p_name WHEN 3 THEN concat('x <= ', p_size) WHEN 4 THEN concat('[', p_size, ']') ELSE CAST(p_size AS STRING) END")
    return read(spark, d, "part").select(E.value_kind(v).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


FN13 = """SELECT CASE p_size % 6 WHEN 0 THEN 'eq' WHEN 1 THEN 'seq(1' WHEN 2 THEN CASE WHEN len(list_filter(string_split(trim(p_name), ' '), lambda x: x <> '')) > 4 OR regexp_matches(p_name, '[A-Za-z]{12,}') OR length(p_name) > 80 OR trim(p_name) = '' THEN NULL ELSE 'expr' END
WHEN 3 THEN NULL WHEN 4 THEN 'seq[0' ELSE 'expr' END AS kind, count(*) AS n FROM part GROUP BY 1"""


def flt06_spoilers(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", F.lit("use"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("desc"), F.concat(F.lit("given "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" and "), F.col("o_custkey").cast("string"))).otherwise("")).alias("problem"))
    return t.select("o_orderkey", E.spoils(F.array("desc"), F.col("problem")).alias("spoils"))


FLT06 = "SELECT o_orderkey, o_orderkey % 2 <> 0 AND o_custkey NOT IN (1, 2, o_orderkey) AS spoils FROM orders"


def prj02_problem_fields(spark, d):
    t = read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("question"), F.lit("spare").alias("input"), F.concat(F.lit("so 1 + 1 #### "), F.col("item_id").cast("string"), F.lit(",000 ")).alias("solution"))
    return t.select("item_id", E.coalesced(t.columns, E.PROBLEM_FIELDS).alias("problem"), E.final_answer(E.coalesced(t.columns, E.ANSWER_FIELDS)).alias("answer"))


PRJ02 = "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'spare' END AS problem, item_id || '000' AS answer FROM benchmark"


def fn18_parsed_steps(spark, d):
    chunk = F.concat(F.lit("<step>Executing: P"), F.col("l_linenumber").cast("string"), F.lit(" \n```python\nx = "), F.col("l_partkey").cast("string"), F.lit("\n```</step> <answer> "), F.col("l_suppkey").cast("string"), F.lit(" </answer>"))
    t = read(spark, d, "lineitem").select("l_orderkey", E.parse_step(chunk).alias("s"), E.answer_tag(chunk).alias("answer"))
    return t.groupBy("s.claimed", "s.is_deviation", "s.wrapped").agg(F.count("*").alias("n"), F.sum(F.length("s.code")).alias("code_chars"), F.sum(F.col("answer").cast("long")).alias("answers"))


FN18 = "SELECT 'P' || l_linenumber AS claimed, FALSE AS is_deviation, TRUE AS wrapped, count(*) AS n, sum(4 + length(l_partkey::VARCHAR))::BIGINT AS code_chars, sum(l_suppkey)::BIGINT AS answers FROM lineitem GROUP BY 1"


def snk04_oversize(spark, d):
    """Chains without an output of 3,000 characters or more: lines stand for outputs."""
    t = read(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("exec"))).alias("steps"))
    return t.where(~F.exists("steps", lambda s: F.length(s.exec) >= 3000)).select("doc_id", F.size("steps").alias("n_steps"))


SNK04 = "SELECT doc_id, len(x)::INT AS n_steps FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) WHERE len(list_filter(x, lambda s: length(s) >= 3000)) = 0"


def fn40_equal_answers(spark, d):
    """Answers as number and as fraction; judged once for each different pair."""
    ship(spark)
    t = read(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("pred"), F.concat((F.col("l_linenumber") * 2).cast("string"), F.lit("/"), F.when(F.col("l_suppkey") % 2 == 0, "2").otherwise("4")).alias("gold"))
    return mathx.equal_pairs(t, "pred", "gold").groupBy("pred", "gold", "equal").agg(F.count("*").alias("n"))


FN40 = "SELECT l_linenumber::VARCHAR AS pred, (l_linenumber * 2) || CASE WHEN l_suppkey % 2 = 0 THEN '/2' ELSE '/4' END AS gold, l_suppkey % 2 = 0 AS equal, count(*) AS n FROM lineitem GROUP BY ALL"


def fn21_factor_check(spark, d):
    """Powers of 2 and 3 with exponents from 0, some of them wrong, unreadable or too big
    for doubles to tell apart."""
    t = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4).alias("a"), (F.col("l_suppkey") % 3).alias("b"))
    n = F.expr("CAST(power(2, a) * power(3, b) AS BIGINT) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END")
    huge = F.col("l_orderkey") % 7 == 0
    code = F.concat(F.lit("x = factorint( "), F.when(huge, F.lit("9007199254740993")).otherwise(n.cast("string")), F.lit(" )"))
    out = F.when(huge, F.concat(F.lit("{2: 53, 3: "), F.col("b").cast("string"), F.lit("}"))).when(F.col("l_orderkey") % 11 == 0, F.lit("{2: }")).otherwise(F.format_string("{2: %d, 3: %d}", "a", "b"))
    return t.select("a", "b", E.factor_check(code, out).alias("verdict")).groupBy("a", "b", "verdict").agg(F.count("*").alias("n"))


FN21 = """SELECT l_linenumber % 4 AS a, l_suppkey % 3 AS b, CASE WHEN l_orderkey % 7 = 0 THEN 'FAIL' WHEN l_orderkey % 11 = 0 THEN NULL
 WHEN l_orderkey % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n FROM lineitem GROUP BY ALL"""


QUERIES = {
    "fn10_parse_score": (fn10_parse_score, FN10),
    "fn11_dual_scores": (fn11_dual_scores, FN11),
    "fn13_value_kinds": (fn13_value_kinds, FN13),
    "fn14_last_values": (fn14_last_values, FN14),
    "fn18_parsed_steps": (fn18_parsed_steps, FN18),
    "fn21_factor_check": (fn21_factor_check, FN21),
    "fn40_equal_answers": (fn40_equal_answers, FN40),
    "flt06_spoilers": (flt06_spoilers, FLT06),
    "prj02_problem_fields": (prj02_problem_fields, PRJ02),
    "snk04_oversize": (snk04_oversize, SNK04),
}
