"""Queries for labels, verification and assembly over the lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions import code as C
from stepforge.functions import scores as S
from stepforge.operators import assemble as A
from stepforge.operators import labels as L
from stepforge.operators import verify as V
from stepforge.plans.lens import chains, oracle, read, steps
from stepforge.session import ship

_SCORE = """CASE WHEN provenance IN ('localized_fail', 'suspect') OR adherence IN ('deviated', 'claimed_only') THEN 0.0
 WHEN adherence = 'self_declared_deviation' OR provenance = 'unverified' THEN 0.5
 WHEN provenance IN ('corroborated', 'outcome_consistent') THEN 1.0 ELSE 0.5 END::DOUBLE"""
_PLANSCORE = "CASE WHEN quality IS NULL THEN NULL WHEN truncated >= 0.5 THEN 0.0 WHEN quality <= 0.25 THEN 0.0 WHEN quality >= 0.75 THEN 1.0 ELSE 0.5 END::DOUBLE"
_QUALITY = """(SELECT prob_idx, plan_idx, count(*) FILTER (WHERE correct)::DOUBLE / nullif(count(correct), 0) AS quality,
 count(*) FILTER (WHERE correct IS NULL)::DOUBLE / count(*) AS truncated, count(*) AS n FROM chains GROUP BY ALL)"""


def fn01_step_label_scores(spark, d):
    t = steps(spark, d)
    return t.select("chain_id", "step", S.step_label_score(F.col("adherence"), F.col("provenance")).alias("step_label"))


def fn02_plan_label_scores(spark, d):
    q = A.plan_quality(chains(spark, d))
    return q.select("prob_idx", "plan_idx", S.plan_label_score(F.col("quality"), F.col("truncated")).alias("plan_label"))


def agg02_plan_quality(spark, d):
    return A.plan_quality(chains(spark, d))


def agg03_diagnosis(spark, d):
    return A.diagnosis(A.plan_quality(chains(spark, d)))


def agg04_sampling_rates(spark, d):
    t = steps(spark, d)
    per = t.agg(F.count("*").alias("n_steps"), F.avg((F.col("adherence") == "deviated").cast("double")).alias("deviation_rate"), F.avg(F.col("step_score").isNull().cast("double")).alias("format_bad_rate"))
    c = chains(spark, d).agg(F.count("*").alias("n_chains"), (F.count("answer") / F.greatest(F.lit(1), F.count("*"))).alias("answer_rate"), (F.count_if("correct") / F.greatest(F.lit(1), F.count("correct"))).alias("correct_rate"))
    return per.crossJoin(c)  # one row each


def agg06_adherence_distribution(spark, d):
    return A.distribution(steps(spark, d), "adherence")


def agg06_pivot(spark, d):
    t = steps(spark, d).groupBy("adherence").pivot("provenance", ["corroborated", "suspect", "outcome_consistent", "unverified"]).count()
    return t.na.fill(0)


def agg07_enum_violations(spark, d):
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "action string")
    t = read(spark, d, "orders").select(F.col("o_orderpriority").alias("action"))
    return t.join(F.broadcast(allowed), "action", "left_anti").groupBy("action").agg(F.count("*").alias("n"))


def agg08_coverage(spark, d):
    known = F.col("provenance") != "unverified"
    return steps(spark, d).agg(F.count("*").alias("n"), F.avg(known.cast("double")).alias("covered"), (F.count_if(known & F.col("step_score").isNotNull()) / F.count("step_score")).alias("covered_values"))


def agg33_score_histogram(spark, d):
    return A.distribution(fn01_step_label_scores(spark, d), "step_label")


def _assembled(spark, d):
    """Steps with labels, plan scores and step scores, filtered as for training."""
    s = steps(spark, d)
    keys = ["chain_id", "step"]
    bare = s.select(*keys, "claimed", "step_score")
    labels = s.where("step % 5 <> 4").select(*keys, "adherence", F.lit(None).cast("string").alias("b2"))
    checks = s.where("step % 3 <> 2").select(*keys, "provenance")
    t = A.labelled(bare, labels, checks, keys)
    plans = fn02_plan_label_scores(spark, d).withColumnRenamed("plan_label", "plan_score")
    c = chains(spark, d).select("chain_id", "prob_idx", "plan_idx").join(plans, ["prob_idx", "plan_idx"])
    return A.kept(t.join(c, "chain_id")).withColumn("step_label", S.step_label_score(F.col("adherence"), F.col("provenance")))


_ASSEMBLED = f""", t AS (SELECT s.chain_id, s.step, CASE WHEN step % 5 = 4 THEN 'unknown' WHEN adherence LIKE 'uncertain%' THEN 'uncertain' ELSE adherence END AS adherence,
 CASE WHEN step % 3 = 2 THEN 'unverified' ELSE provenance END AS provenance FROM steps s),
 p AS (SELECT prob_idx, plan_idx, {_PLANSCORE} AS plan_score FROM {_QUALITY}),
 a AS (SELECT t.*, p.plan_score, p.prob_idx, p.plan_idx, {_SCORE} AS step_label FROM t JOIN chains USING (chain_id) JOIN p ON p.prob_idx = chains.prob_idx AND p.plan_idx = chains.plan_idx
 WHERE adherence NOT IN ('uncertain', 'unknown') AND p.plan_score IS NOT NULL)"""


def jn01_assembled_steps(spark, d):
    return _assembled(spark, d).select("chain_id", "step", "prob_idx", "plan_idx", "adherence", "provenance", "plan_score", "step_label")


def smp03_oversampled(spark, d):
    t = A.oversampled(_assembled(spark, d))
    return t.groupBy("step_label", "copy").agg(F.count("*").alias("n"))


def fn27_rendered_outputs(spark, d):
    t = _assembled(spark, d)
    return t.select("chain_id", "step", A.rendered_output(F.col("plan_score"), F.col("step_label")).alias("output"))


def _coded(spark, d):
    """Lens steps with code and an expected action."""
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"), F.col("l_partkey"), "l_linenumber",
        F.expr("CASE l_linenumber % 5 WHEN 0 THEN concat('x = ', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 1 THEN 'print(\"done\")' WHEN 2 THEN concat('r = solve(x - ', CAST(CAST(l_quantity AS INT) AS STRING), ')') WHEN 3 THEN 'y = x + 1\nprint(y)' ELSE 'x = (' END").alias("code"),
        F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'SOLVE' WHEN 1 THEN 'COMPUTE' WHEN 2 THEN 'VERIFY_CHECK' ELSE 'RHYME' END").alias("action"),
    )


def ast03_adherence(spark, d):
    ship(spark)
    t = _coded(spark, d)
    # Judged once for each different pair of action and code.
    judged = t.select("action", "code").distinct().withColumn("adherence", C.adherence_udf("action", "code"))
    return t.join(judged, ["action", "code"]).groupBy("action", "adherence").agg(F.count("*").alias("n"))


AST03 = """SELECT action, CASE WHEN action = 'RHYME' THEN 'uncertain:unknown_action' WHEN k = 4 THEN 'uncertain:syntax_broken' WHEN k = 1 THEN 'claimed_only'
 WHEN k = 0 THEN CASE action WHEN 'VERIFY_CHECK' THEN 'deviated' ELSE 'faithful' END
 WHEN k = 2 THEN CASE action WHEN 'VERIFY_CHECK' THEN 'uncertain:verify_ambiguous' ELSE 'faithful' END
 ELSE CASE action WHEN 'COMPUTE' THEN 'faithful' WHEN 'SOLVE' THEN 'uncertain:solve_ambiguous' ELSE 'uncertain:verify_ambiguous' END END AS adherence, count(*) AS n
FROM (SELECT l_linenumber % 5 AS k, CASE l_suppkey % 4 WHEN 0 THEN 'SOLVE' WHEN 1 THEN 'COMPUTE' WHEN 2 THEN 'VERIFY_CHECK' ELSE 'RHYME' END AS action FROM lineitem) GROUP BY ALL"""


def ast05_defs_uses(spark, d):
    ship(spark)
    t = _coded(spark, d)
    found = t.select("code").distinct().withColumn("du", C.names_udf("code")).withColumn("bounded", C.bounded_search_udf("code"))
    return t.join(found, "code").groupBy(F.array_join("du.defs", ",").alias("defs"), F.array_join("du.uses", ",").alias("uses"), "bounded").agg(F.count("*").alias("n"))


AST05 = """SELECT CASE k WHEN 0 THEN 'x' WHEN 2 THEN 'r' WHEN 3 THEN 'y' ELSE '' END AS defs, CASE k WHEN 1 THEN 'print' WHEN 2 THEN 'solve,x' WHEN 3 THEN 'print,x' ELSE '' END AS uses, FALSE AS bounded, count(*) AS n
FROM (SELECT l_linenumber % 5 AS k FROM lineitem) GROUP BY ALL"""


def win02_stalls(spark, d):
    t = steps(spark, d).select("chain_id", "step", F.col("provenance").alias("claimed"), F.concat(F.lit(" "), F.col("adherence")).alias("code"))
    # Steps lie by chain already, so chains are counted where they are.
    per = L.stalls(t).groupBy("chain_id", "in_stall").agg(F.count("*").alias("n"))
    return per.groupBy("in_stall").agg(F.sum("n").alias("n"), F.count("chain_id").alias("chains"))


WIN02 = oracle(""", f AS (SELECT chain_id, step, CASE WHEN provenance = lag(provenance) OVER w AND adherence = lag(adherence) OVER w THEN 0 ELSE 1 END AS s FROM steps WINDOW w AS (PARTITION BY chain_id ORDER BY step)),
 g AS (SELECT chain_id, sum(s) OVER (PARTITION BY chain_id ORDER BY step) AS r FROM f), n AS (SELECT chain_id, count(*) OVER (PARTITION BY chain_id, r) >= 3 AS in_stall FROM g)
 SELECT in_stall, count(*) AS n, count(DISTINCT chain_id) AS chains FROM n GROUP BY in_stall""")


def _sequences(spark, d):
    t = steps(spark, d).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("step", "claimed", "adherence"))).alias("xs"))
    return t.select("chain_id", F.transform("xs", lambda x: x.claimed).alias("claimed"), F.transform("xs", lambda x: x.adherence == "deviated").alias("deviations"))


def win04_abandoned(spark, d):
    return _sequences(spark, d).select("chain_id", L.abandoned(F.col("deviations"), 2).alias("abandoned"))


WIN04 = oracle(" SELECT chain_id, count(*) >= 2 AND bool_and(adherence = 'deviated') FILTER (WHERE r <= 2) AS abandoned FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY step DESC) AS r FROM steps) GROUP BY chain_id")


def win03_skips(spark, d):
    plan = F.array(*(F.lit(f"P{i}") for i in range(1, 8)))
    t = _sequences(spark, d)
    return t.select("chain_id", F.array_join(L.skips(plan, F.col("claimed")), ",").alias("skips"), F.array_join(L.uncovered(plan, F.col("claimed")), ",").alias("uncovered"))


WIN03 = oracle(""", m AS (SELECT chain_id, max(CAST(substr(claimed, 2) AS INT)) AS top, list(DISTINCT claimed) AS c FROM steps GROUP BY chain_id)
 SELECT chain_id, array_to_string(list_filter(list_transform(range(1, top), lambda i: 'P' || i), lambda p: NOT list_contains(c, p)), ',') AS skips,
 array_to_string(list_filter(list_transform(range(1, 8), lambda i: 'P' || i), lambda p: NOT list_contains(c, p)), ',') AS uncovered FROM m""")


def _executions(spark, d):
    """Stage values of sibling executions: quantities of like line numbers."""
    s = steps(spark, d).groupBy("chain_id", F.col("claimed").alias("stage")).agg(F.max_by(F.struct("step", "quantity"), "step").alias("x"))
    c = chains(spark, d).select("chain_id", "prob_idx", "plan_idx", F.col("tpos").cast("long").alias("exec_idx"), "correct")
    value = (F.col("x.quantity").cast("int") % 3).cast("string")
    return s.join(c, "chain_id").select("prob_idx", F.col("plan_idx").cast("long"), "stage", "exec_idx", F.col("x.step").cast("int").alias("step"), value.alias("value"), "correct")


def ver02_agreement(spark, d):
    return V.agreement(_executions(spark, d)).groupBy("verdict", "provenance").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


VER02 = oracle(""", v AS (SELECT chain_id, claimed AS stage, max(step) AS step, arg_max(CAST(floor(quantity) AS INT) % 3, step) AS value FROM steps GROUP BY ALL),
 x AS (SELECT v.*, prob_idx, plan_idx, tpos, correct FROM v JOIN chains USING (chain_id)),
 g AS (SELECT prob_idx, plan_idx, stage, value, min(tpos) AS first, count(*) FILTER (WHERE correct) AS ok FROM x GROUP BY ALL),
 s AS (SELECT prob_idx, plan_idx, stage, count(*) AS groups, sum(ok) AS oks, arg_min(value, first) FILTER (WHERE ok >= 2) AS ref FROM g GROUP BY ALL),
 n AS (SELECT prob_idx, plan_idx, stage, count(*) AS execs FROM x GROUP BY ALL),
 r AS (SELECT x.step, CASE WHEN groups = 1 AND execs >= 2 AND oks > 0 THEN 'PASS' WHEN groups > 1 AND ref IS NOT NULL AND correct = FALSE AND value <> ref THEN 'FAIL' END AS verdict
  FROM x JOIN s USING (prob_idx, plan_idx, stage) JOIN n USING (prob_idx, plan_idx, stage))
 SELECT verdict, CASE verdict WHEN 'PASS' THEN 'corroborated' ELSE 'localized_fail' END AS provenance, count(*) AS n, sum(step)::BIGINT AS steps FROM r WHERE verdict IS NOT NULL GROUP BY ALL""")


def win06_first_divergence(spark, d):
    t = V.agreement(_executions(spark, d))
    return V.onset(t).groupBy("provenance").agg(F.count("*").alias("n"))


_VER02_ROWS = VER02[: VER02.rindex(" SELECT verdict")].replace("SELECT x.step, CASE", "SELECT x.prob_idx, x.plan_idx, x.tpos, x.step, CASE")
WIN06 = _VER02_ROWS + " SELECT 'corroborated' AS provenance, count(*) AS n FROM r WHERE verdict = 'PASS' HAVING count(*) > 0 UNION ALL SELECT 'localized_fail', count(DISTINCT (prob_idx, plan_idx, tpos)) FROM r WHERE verdict = 'FAIL' HAVING count(*) > 0"


def fn07_precedence(spark, d):
    rank = F.create_map(*(x for k, v in S.PRECEDENCE.items() for x in (F.lit(k), F.lit(v))))
    return steps(spark, d).groupBy("chain_id").agg(F.max_by("provenance", F.struct(rank[F.col("provenance")], -F.col("step"))).alias("provenance"))


FN07 = oracle(" SELECT chain_id, arg_max(provenance, (CASE provenance WHEN 'corroborated' THEN 4 WHEN 'outcome_consistent' THEN 3 WHEN 'suspect' THEN 2 ELSE 0 END, -step)) AS provenance FROM steps GROUP BY chain_id")


def win01_history(spark, d):
    t = steps(spark, d).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("step", "claimed"))).alias("xs"))
    t = t.select("chain_id", "xs", F.posexplode("xs").alias("i", "x"))
    return t.select("chain_id", F.col("x.step").alias("step"), F.array_join(F.transform(A.history(F.col("xs"), F.col("i")), lambda s: s.claimed), ">").alias("history"))


WIN01 = oracle(" SELECT chain_id, step, coalesce(string_agg(claimed, '>') OVER (PARTITION BY chain_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM steps")


def win09_smoothed(spark, d):
    t = steps(spark, d).where("step_score IS NOT NULL").groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "step_score"))), lambda s: s.step_score).alias("xs"))
    return t.select("chain_id", F.round(F.element_at(L.smoothed(F.col("xs")), -1), 9).alias("last"))


WIN09 = oracle(""", q AS (SELECT chain_id, step_score AS x, row_number() OVER (PARTITION BY chain_id ORDER BY step) AS i, count(*) OVER (PARTITION BY chain_id) AS n FROM steps WHERE step_score IS NOT NULL),
 w AS (SELECT *, 1.8::DOUBLE * (1 / (1 + exp(-0.05::DOUBLE * n)) - 0.5) AS a FROM q)
 SELECT chain_id, round(sum(CASE WHEN i = 1 THEN x * (1 - a) * pow(a, n - 1) + x * pow(a, n) ELSE x * (1 - a) * pow(a, n - i) END), 9) AS last FROM w GROUP BY chain_id""")

QUERIES = {
    "fn01_step_label_scores": (fn01_step_label_scores, oracle(f" SELECT chain_id, step, {_SCORE} AS step_label FROM steps")),
    "fn02_plan_label_scores": (fn02_plan_label_scores, oracle(f" SELECT prob_idx, plan_idx, {_PLANSCORE} AS plan_label FROM {_QUALITY}")),
    "agg02_plan_quality": (agg02_plan_quality, oracle(f" SELECT * FROM {_QUALITY}")),
    "agg03_diagnosis": (agg03_diagnosis, oracle(f", q AS (SELECT prob_idx, count(*) AS plans, count(quality) AS decided, max(quality) AS best, min(quality) AS worst FROM {_QUALITY} GROUP BY prob_idx) SELECT prob_idx, plans, best, worst, CASE WHEN decided = 0 THEN 'all-censored' WHEN best = 0 THEN 'all-failed' WHEN plans > 1 AND best - worst >= 0.5 THEN 'plan-split' ELSE 'ok' END AS tag FROM q")),
    "agg04_sampling_rates": (agg04_sampling_rates, oracle(" SELECT * FROM (SELECT count(*) AS n_steps, avg((adherence = 'deviated')::INT::DOUBLE) AS deviation_rate, avg((step_score IS NULL)::INT::DOUBLE) AS format_bad_rate FROM steps) CROSS JOIN (SELECT count(*) AS n_chains, count(answer)::DOUBLE / count(*) AS answer_rate, count(*) FILTER (WHERE correct)::DOUBLE / count(correct) AS correct_rate FROM chains)")),
    "agg06_adherence_distribution": (agg06_adherence_distribution, oracle(" SELECT adherence AS label, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM steps) AS share FROM steps GROUP BY adherence")),
    "agg06_pivot": (agg06_pivot, oracle(" SELECT adherence, count(*) FILTER (WHERE provenance = 'corroborated') AS corroborated, count(*) FILTER (WHERE provenance = 'suspect') AS suspect, count(*) FILTER (WHERE provenance = 'outcome_consistent') AS outcome_consistent, count(*) FILTER (WHERE provenance = 'unverified') AS unverified FROM steps GROUP BY adherence")),
    "agg07_enum_violations": (agg07_enum_violations, "SELECT o_orderpriority AS action, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL"),
    "agg08_coverage": (agg08_coverage, oracle(" SELECT count(*) AS n, avg((provenance <> 'unverified')::INT::DOUBLE) AS covered, count(*) FILTER (WHERE provenance <> 'unverified' AND step_score IS NOT NULL)::DOUBLE / count(step_score) AS covered_values FROM steps")),
    "agg33_score_histogram": (agg33_score_histogram, oracle(f" SELECT {_SCORE} AS label, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM steps) AS share FROM steps GROUP BY 1")),
    "jn01_assembled_steps": (jn01_assembled_steps, oracle(_ASSEMBLED + " SELECT chain_id, step, prob_idx, plan_idx, adherence, provenance, plan_score, step_label FROM a")),
    "smp03_oversampled": (smp03_oversampled, oracle(_ASSEMBLED + ", c AS (SELECT step_label, 0 AS copy FROM a UNION ALL SELECT step_label, 1 FROM a WHERE step_label = 0) SELECT step_label, copy, count(*) AS n FROM c GROUP BY ALL")),
    "fn27_rendered_outputs": (fn27_rendered_outputs, oracle(_ASSEMBLED + " SELECT chain_id, step, printf('<plan_score>%.1f</plan_score>' || chr(10) || '<step_score>%.1f</step_score>', plan_score, step_label) AS output FROM a")),
    "ast03_adherence": (ast03_adherence, AST03),
    "ast05_defs_uses": (ast05_defs_uses, AST05),
    "win01_history": (win01_history, WIN01),
    "win02_stalls": (win02_stalls, WIN02),
    "win03_skips": (win03_skips, WIN03),
    "win04_abandoned": (win04_abandoned, WIN04),
    "win06_first_divergence": (win06_first_divergence, WIN06),
    "win09_smoothed": (win09_smoothed, WIN09),
    "ver02_agreement": (ver02_agreement, VER02),
    "fn07_precedence": (fn07_precedence, FN07),
}
