"""Queries for records and files, checks, verification, encoding, batches and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions import checks as K
from stepforge.functions import extract as E
from stepforge.functions import mathx, overlap
from stepforge.functions import scores as S
from stepforge.functions.code import bounded_search_udf
from stepforge.operators import batching as B
from stepforge.operators import convert as C
from stepforge.operators import datasets as D
from stepforge.operators import packing as P
from stepforge.operators import rendering as R
from stepforge.operators import selection as X
from stepforge.operators import tokens as T
from stepforge.operators import verify as V
from stepforge.plans.datasets import PRJ09, _chats
from stepforge.plans.labelling import VER02, _executions
from stepforge.plans.lens import chains, oracle, read, steps, trajectories
from stepforge.session import scratch, ship
from stepforge.sources import files

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return keep


# ------------------------------------------------------------------ records and files
_TRAJ = "SELECT prob_idx::INT AS prob_idx, plan_idx::INT AS plan_idx, tpos::INT AS exec_idx, (c.chain_id % 7)::VARCHAR AS answer, correct, n AS n_steps FROM chains c JOIN (SELECT chain_id, count(*)::INT AS n FROM steps GROUP BY chain_id) USING (chain_id)"


@query("src01_trajectories", oracle(f" {_TRAJ}"))
def src01_trajectories(spark, d):
    path = scratch(spark, "trajectories")
    files.write_jsonl(trajectories(spark, d), path)
    t = files.jsonl(spark, path, files.TRAJECTORY)
    return t.select("prob_idx", "plan_idx", "exec_idx", "answer", "correct", F.size("steps").alias("n_steps"))


@query("src01_numbered_lines", "SELECT n_nationkey AS key, row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no FROM nation")
def src01_numbered_lines(spark, d):
    path = scratch(spark, "lines")
    files.write_jsonl(read(spark, d, "nation").select(F.col("n_nationkey").alias("key")), path, "key")
    return files.jsonl(spark, path, "key int", numbered=True).select("key", "line_no")


_SCORES = oracle(" SELECT prob_idx::INT AS prob_idx, tpos::INT AS tpos, step::INT AS step, step_score AS score FROM steps JOIN chains USING (chain_id) WHERE step_score IS NOT NULL")


@query("src03_score_shards", _SCORES)
def src03_score_shards(spark, d):
    """Shards are written, found by their names and parsed."""
    path = scratch(spark, "shards")
    t = steps(spark, d).where("step_score IS NOT NULL").join(chains(spark, d), "chain_id").select("prob_idx", "tpos", "step", F.col("step_score").alias("score"))
    files.write_shards(t, path, 4)
    return files.shard_scores(files.shards(spark, f"{path}/shard=*/*.json"))


@query("prj01_subset", "SELECT c_custkey, c_name FROM customer")
def prj01_subset(spark, d):
    return files.subset(read(spark, d, "customer"), ["c_custkey", "no_such", "c_name"])


@query("prj03_first_of_list", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS answer FROM customer")
def prj03_first_of_list(spark, d):
    listed = F.concat(F.lit('["'), F.col("c_name"), F.lit('", "x"]'))
    return read(spark, d, "customer").select("c_custkey", E.first_of_list(F.when(F.col("c_custkey") % 3 == 0, listed).otherwise(F.col("c_mktsegment"))).alias("answer"))


@query("prj04_final_answers", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS answer FROM customer")
def prj04_final_answers(spark, d):
    text = F.concat(F.lit("so #### no #### "), F.format_number("c_custkey", 0), F.lit(" "))
    return read(spark, d, "customer").select("c_custkey", E.final_answer(F.when(F.col("c_custkey") % 2 == 0, text).otherwise(F.col("c_name"))).alias("answer"))


@query("prj05_answer_orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'gt' || o_orderkey ELSE 'sol' || o_orderkey END AS voter, 'sol' || o_orderkey AS bench FROM orders")
def prj05_answer_orders(spark, d):
    """Two orders of answer fields over the same records."""
    t = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("gt"), F.col("o_orderkey"))).alias("gt"), F.concat(F.lit("sol"), F.col("o_orderkey")).alias("solution"))
    return t.select("o_orderkey", E.coalesced(t.columns, E.ANSWER_FIELDS).alias("voter"), E.coalesced(t.columns, E.BENCH_ANSWER_FIELDS).alias("bench"))


@query("prj12_aligned", f"SELECT conv_id, n_prompt FROM ({PRJ09})")
def prj12_aligned(spark, d):
    t = C.aligned(_chats(spark, d), "sharegpt", "messages", keep=("conv_id",))
    return t.select("conv_id", F.size("prompt").alias("n_prompt"))


@query("prj16_tagged", "SELECT 'nation' AS _dataset_name, n_nationkey FROM nation")
def prj16_tagged(spark, d):
    return C.tagged(read(spark, d, "nation").select("n_nationkey"), "nation")


@query("prj18_requests", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
s AS (SELECT conv_id, coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN 1 END), 0) AS sys, coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN text END), '') AS system FROM m GROUP BY conv_id),
b AS (SELECT m.conv_id, count(*) AS n, bool_and(CASE WHEN (i - sys) % 2 = 0 THEN role IN ('user', 'tool') ELSE role IN ('assistant', 'function') END) AS ok FROM m JOIN s USING (conv_id) WHERE i >= sys GROUP BY m.conv_id)
SELECT s.conv_id, length(system) AS system_chars, coalesce(NOT ok OR n % 2 = 0, TRUE) AS broken FROM s LEFT JOIN b USING (conv_id)""")
def prj18_requests(spark, d):
    t = _chats(spark, d).withColumn("a", C.request(F.col("messages")))
    return t.select("conv_id", F.length("a.system").alias("system_chars"), "a.broken")


@query("snk06_report", "SELECT 'orders' AS name, count(*) AS n, NULL AS missing FROM orders")
def snk06_report(spark, d):
    path = scratch(spark, "report")
    files.write_report(read(spark, d, "orders").agg(F.lit("orders").alias("name"), F.count("*").alias("n"), F.lit(None).cast("string").alias("missing")), path)
    return spark.read.schema("name string, n long, missing string").json(path)


@query("snk08_tokenized", "SELECT part, count(*) AS n, sum(len)::BIGINT AS ids FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'validation' ELSE 'train' END AS part, c_custkey % 5 + 1 AS len FROM customer) GROUP BY part")
def snk08_tokenized(spark, d):
    path = scratch(spark, "tokenized")
    if files.tokenized(spark, path) is not None:
        raise ValueError("a folder that isn't there has no parts")
    t = read(spark, d, "customer").select("c_custkey", F.sequence(F.lit(0), F.pmod("c_custkey", F.lit(5))).alias("input_ids"))
    files.write_tokenized({"train": t.where("c_custkey % 10 <> 0"), "validation": t.where("c_custkey % 10 = 0")}, path)
    parts = [x.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("n"), F.sum(F.size("input_ids").cast("long")).alias("ids")) for name, x in files.tokenized(spark, path).items()]
    return parts[0].unionByName(parts[1])


@query("snk09_predictions", "SELECT c_custkey, array_to_string(list_concat(list_transform(range(0, c_custkey % 3 + 1), lambda i: 7), list_transform(range(0, c_custkey % 4), lambda i: 0)), ' ') AS predict, '0 5' AS label FROM customer")
def snk09_predictions(spark, d):
    t = read(spark, d, "customer").select("c_custkey", F.concat(F.array_repeat(F.lit(0), (F.col("c_custkey") % 4).cast("int")), F.array_repeat(F.lit(7), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("p"), F.array(F.lit(-100), F.lit(5)).alias("y"))
    out = files.predictions(t, "c_custkey", "p", "y", 0)
    return out.select(F.col("prompt").alias("c_custkey"), F.array_join("predict", " ").alias("predict"), F.array_join("label", " ").alias("label"))


# ------------------------------------------------------------------ checks
@query("fn24_plans", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END::INT AS stages, c_custkey % 4 = 0 AS valid FROM customer")
def fn24_plans(spark, d):
    good = 'Plan: [{"id": "P1", "desc": "a", "action": "SOLVE"}, {"id": "P2", "desc": "[b]", "action": "COMPUTE"}] end'
    text = F.when(F.col("c_custkey") % 4 == 0, good).when(F.col("c_custkey") % 4 == 1, 'x [{"id": "P1", "desc": "a"}]').when(F.col("c_custkey") % 4 == 2, "no plan").otherwise('[{"id": }]')
    t = read(spark, d, "customer").select("c_custkey", K.plan_stages(text).alias("s"))
    return t.select("c_custkey", F.when(F.size("s") >= 0, F.size("s")).alias("stages"), K.valid_plan(F.col("s")).alias("valid"))


@query("fn22_solved_roots", "SELECT c_custkey % 30 AS k, c_custkey % 5 AS r, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n FROM customer GROUP BY ALL")
def fn22_solved_roots(spark, d):
    ship(spark)
    k, r = F.col("c_custkey") % 30, F.col("c_custkey") % 5
    code = F.concat(F.lit("r = solve(x**2 - "), (k * k + F.when(r == 1, 1).otherwise(0)).cast("string"), F.lit(", x)"))
    out = F.when(r == 0, "none").otherwise(F.concat(F.lit("["), (-k).cast("string"), F.lit(", sqrt("), (k * k).cast("string"), F.lit(")]")))
    t = read(spark, d, "customer").select(k.alias("k"), r.alias("r"), code.alias("code"), out.alias("out"))
    return t.select("k", "r", K.roots_check_udf("code", "out").alias("verdict")).groupBy("k", "r", "verdict").agg(F.count("*").alias("n"))


@query("fn23_c2_verdicts", "SELECT CASE c_custkey % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'PASS' WHEN 3 THEN 'UNCHECKABLE_value' WHEN 4 THEN 'UNCHECKABLE_novalue' ELSE 'UNCHECKABLE_novalue' END AS verdict, count(*) AS n FROM customer GROUP BY 1")
def fn23_c2_verdicts(spark, d):
    ship(spark)
    cases = [("factorint(12)", "{2: 2, 3: 1}"), ("factorint(12)", "{2: 1, 3: 1}"), ("solve(x - 4, x)", "[4]"), ("print(3)", "a: 3"), ("print(3)", "[no output]"), ("factorint(12)", "Traceback {2: 2, 3: 1}")]
    pick = lambda i: F.get(F.array(*(F.lit(c[i]) for c in cases)), (F.col("c_custkey") % 6).cast("int"))
    t = read(spark, d, "customer").select(pick(0).alias("code"), pick(1).alias("out"))
    return t.groupBy(K.c2_verdict(F.col("code"), F.col("out")).alias("verdict")).agg(F.count("*").alias("n"))


@query("fn54_stage_equality", "SELECT k, CASE k WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE TRUE END AS same, n FROM (SELECT c_custkey % 6 AS k, count(*) AS n FROM customer GROUP BY 1)")
def fn54_stage_equality(spark, d):
    ship(spark)
    cases = [("1/2", "0.5"), ("(1, 2)", "(1, 3)"), ("Eq(x, 3)", "Eq(3, x)"), ("x < 3", "3"), ("120", "120"), ("2*sqrt(3)", "sqrt(12)")]
    pick = lambda i: F.get(F.array(*(F.lit(c[i]) for c in cases)), F.col("k").cast("int"))
    t = read(spark, d, "customer").groupBy((F.col("c_custkey") % 6).alias("k")).agg(F.count("*").alias("n"))
    return t.select("k", mathx.stage_equal_udf(pick(0), pick(1)).alias("same"), "n")


@query("fn20_boxed_answers", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '\\frac{' || c_custkey || '}{2}' WHEN 1 THEN c_custkey || '/3' END AS answer FROM customer")
def fn20_boxed_answers(spark, d):
    ship(spark)
    text = F.when(F.col("c_custkey") % 3 == 0, F.format_string("\\boxed{1} so \\boxed{\\frac{%s}{2}} 7", "c_custkey")).when(F.col("c_custkey") % 3 == 1, F.format_string("it is 4 or %s/3", "c_custkey")).otherwise("none")
    return read(spark, d, "customer").select("c_custkey", mathx.boxed_udf(text).alias("answer"))


@query("agg36_overlap", "SELECT avg(CASE WHEN c_custkey % 2 = 0 THEN 100.0::DOUBLE ELSE 0 END) AS bleu_4, avg(CASE WHEN c_custkey % 2 = 0 THEN 100.0::DOUBLE WHEN c_custkey % 4 = 1 THEN 66.6667 ELSE 0 END) AS rouge_1, avg(CASE WHEN c_custkey % 2 = 0 THEN 100.0::DOUBLE ELSE 0 END) AS rouge_2, avg(CASE WHEN c_custkey % 2 = 0 THEN 100.0::DOUBLE WHEN c_custkey % 4 = 1 THEN 66.6667 ELSE 0 END) AS rouge_l FROM customer")
def agg36_overlap(spark, d):
    """Equal texts, one of two words, and nothing at all; the one word is too short for
    pairs of words and is scored apart for its characters."""
    ship(spark)
    gold = F.concat("c_name", F.lit(" x"))
    pred = F.when(F.col("c_custkey") % 2 == 0, gold).when(F.col("c_custkey") % 4 == 1, "x").otherwise("")
    t = read(spark, d, "customer").select("c_custkey", gold.alias("gold"), pred.alias("pred"))
    out = overlap.averaged(t, "pred", "gold")
    same = overlap.averaged(t.withColumn("pred", F.when(F.col("c_custkey") % 2 == 0, F.col("pred")).otherwise("")), "pred", "gold")
    return same.select("bleu_4").crossJoin(out.select("rouge_1", "rouge_2", "rouge_l"))  # one row each


@query("fn12_loose_values", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '3: ' || c_custkey WHEN 1 THEN 'plain' ELSE NULL END AS value FROM customer")
def fn12_loose_values(spark, d):
    out = F.when(F.col("c_custkey") % 4 == 0, F.format_string("x\nr = 3: %s\n", "c_custkey")).when(F.col("c_custkey") % 4 == 1, "plain ").when(F.col("c_custkey") % 4 == 2, "Traceback: a = 1").otherwise("[timeout]")
    return read(spark, d, "customer").select("c_custkey", E.last_value_loose(out).alias("value"))


# ------------------------------------------------------------------ verification
_INTEGRITY = """, v AS (SELECT chain_id, list(CAST(floor(quantity) AS INT) % 7 ORDER BY step DESC)[1:8] AS vs FROM steps WHERE step % 4 <> 3 GROUP BY chain_id),
 f AS (SELECT CASE WHEN coalesce(correct, FALSE) THEN 'final_reformulation' ELSE 'ungrounded_final_answer' END AS flag, chain_id % 7 AS answer, vs[1] AS terminal FROM chains JOIN v USING (chain_id) WHERE NOT list_contains(vs, (chain_id % 7)::INT))"""
_OUTCOME = """, n AS (SELECT chain_id, count(*) AS n FROM steps GROUP BY chain_id),
 o AS (SELECT prob_idx, plan_idx, tpos, step, correct FROM steps JOIN n USING (chain_id) JOIN chains USING (chain_id) WHERE correct IS NOT NULL AND step % 4 <> 3
  AND (step = n - 1 OR ((n - 1) % 3 <> 2 AND (n - 1) // 3 = step // 3)))"""


@query("ver01_integrity", oracle(_INTEGRITY + " SELECT flag, answer::VARCHAR AS answer, terminal::VARCHAR AS terminal, count(*) AS n FROM f GROUP BY ALL"))
def ver01_integrity(spark, d):
    return V.integrity(trajectories(spark, d)).groupBy("flag", "answer", "terminal").agg(F.count("*").alias("n"))


@query("ver06_outcomes", oracle(_OUTCOME + " SELECT prob_idx::INT AS prob_idx, plan_idx::INT AS plan_idx, tpos::INT AS exec_idx, step::INT AS step, CASE WHEN correct THEN 'PASS' END AS verdict, CASE WHEN correct THEN 'outcome_consistent' ELSE 'suspect' END AS provenance FROM o"))
def ver06_outcomes(spark, d):
    return V.outcome(trajectories(spark, d))


_VER02_ROWS = VER02[: VER02.rindex(" SELECT verdict")].replace("SELECT x.step, CASE", "SELECT x.prob_idx, x.plan_idx, x.tpos, x.stage, x.step, CASE")


@query("ver05_onsets", _VER02_ROWS + """, e AS (SELECT prob_idx, plan_idx, tpos AS exec_idx, arg_min(step, CAST(substr(stage, 2) AS INT)) AS step FROM r WHERE verdict = 'FAIL' GROUP BY ALL)
 SELECT prob_idx, plan_idx, exec_idx, step::INT AS step, 'localized_fail' AS provenance FROM e
 UNION ALL SELECT prob_idx, plan_idx, tpos, step::INT, 'corroborated' FROM r WHERE verdict = 'PASS'""")
def ver05_onsets(spark, d):
    return V.onset(V.agreement(_executions(spark, d))).select("prob_idx", "plan_idx", "exec_idx", "step", "provenance")


@query("agg09_attempts", oracle(_INTEGRITY + _OUTCOME + """, b AS (SELECT 'L1' AS layer, 'bounded_search_flag' AS label, 0 AS n)
 SELECT 'L1' AS layer, flag AS label, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'L3', CASE WHEN correct THEN 'outcome_consistent' ELSE 'suspect' END, count(*) FROM o GROUP BY ALL
 UNION ALL SELECT 'L1', 'bounded_search_flag', (SELECT count(*) FROM lineitem WHERE l_linenumber % 2 = 0)"""))
def agg09_attempts(spark, d):
    t = trajectories(spark, d)
    ship(spark)
    code = F.when(F.col("l_linenumber") % 2 == 0, "for i in range(50): pass").otherwise("for i in range(9): pass")
    bounded = read(spark, d, "lineitem").select(bounded_search_udf(code).alias("bounded"))
    outcomes = V.outcome(t)
    return V.attempt_counts(V.integrity(t), outcomes.limit(0), outcomes, bounded)


@query("fn07_settled", oracle(_OUTCOME + """ SELECT c.prob_idx::INT AS prob_idx, c.plan_idx::INT AS plan_idx, c.tpos::INT AS exec_idx, s.step::INT AS step, CASE WHEN o.correct THEN 'PASS' END AS verdict,
 CASE WHEN o.correct THEN 'outcome_consistent' WHEN NOT o.correct THEN 'suspect' ELSE 'unverified' END AS provenance
 FROM steps s JOIN chains c USING (chain_id) LEFT JOIN o ON o.prob_idx = c.prob_idx AND o.plan_idx = c.plan_idx AND o.tpos = c.tpos AND o.step = s.step"""))
def fn07_settled(spark, d):
    """Labels by precedence: what the same steps were given before stands below."""
    t = trajectories(spark, d)
    outcomes = V.outcome(t)
    lower = outcomes.withColumn("provenance", F.lit("unverified")).withColumn("verdict", F.lit("FAIL"))
    return V.settled(t, lower, outcomes)


@query("jn07_plan_scores", oracle(" SELECT chain_id, CASE WHEN tpos % 2 = 0 THEN plan_score END AS score FROM chains"))
def jn07_plan_scores(spark, d):
    c = chains(spark, d)
    return X.with_plan_scores(c.drop("plan_score"), c.where("tpos % 2 = 0")).select("chain_id", F.col("plan_score").alias("score"))


@query("fn05_unit_scores", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN q BETWEEN 0 AND 1 THEN q WHEN q > 1 AND q <= 5 THEN round((q - 1) / 4, 3) END AS score, CASE WHEN q BETWEEN 0 AND 1 THEN q END AS strict FROM (SELECT *, l_quantity / 10 AS q FROM lineitem)")
def fn05_unit_scores(spark, d):
    q = F.col("l_quantity") / 10
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.norm01(q).alias("score"), S.norm01_strict(q).alias("strict"))


@query("flt01_kept_steps", oracle(" SELECT adherence, count(*) AS n FROM (SELECT CASE WHEN adherence LIKE 'uncertain%' THEN 'uncertain' ELSE adherence END AS adherence, provenance FROM steps) WHERE adherence NOT IN ('uncertain', 'unknown') AND provenance <> 'suspect' GROUP BY adherence"))
def flt01_kept_steps(spark, d):
    from stepforge.operators import assemble as A

    t = steps(spark, d).withColumn("adherence", S.normal_adherence(F.col("adherence"), F.lit(None).cast("string"))).withColumn("plan_score", F.lit(None).cast("double"))
    return A.kept(t, drop_suspect=True, keep_unknown_plan=True).groupBy("adherence").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ encoding
def _exchanges(spark, d):
    """One exchange for each event; ids are the bytes of a text."""
    return read(spark, d, "events").select("event_id", F.col("props").alias("ask"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("reply"))


_FITTED = """t AS (SELECT event_id, strlen(props) AS s, strlen(event_type || ' ' || user_id) AS t FROM events),
f AS (SELECT *, CASE WHEN t * 2 < 24 THEN 24 WHEN s * 2 < 24 THEN 24 - s ELSE floor(24 * (t::DOUBLE / (s + t)))::INT END AS m FROM t),
x AS (SELECT event_id, least(m, t) AS nt, least(greatest(24 - least(m, t), 0), s) AS ns FROM f)"""


def _bytes(text: str) -> list[int]:
    return list(text.encode())


def _encoded(spark, d, fn, schema):
    messages = lambda r: [{"role": "user", "content": r["ask"]}, {"role": "assistant", "content": r["reply"]}]
    return T.applied(_exchanges(spark, d), lambda r: {"event_id": r["event_id"], **fn(messages(r))}, f"event_id long, {schema}")


def _learned(c):
    return F.size(F.filter(c, lambda x: x != P.IGNORED))


@query("tok01_supervised", f"WITH {_FITTED} SELECT event_id, (ns + nt)::INT AS n, nt::INT AS learned FROM x")
def tok01_supervised(spark, d):
    t = _encoded(spark, d, lambda m: T.supervised(m, _bytes, 24), T.MODEL_INPUT)
    return t.select("event_id", F.size("input_ids").alias("n"), _learned("labels").alias("learned"))


@query("tok03_pairwise", f"WITH {_FITTED} SELECT event_id, (ns + nt)::INT AS chosen, (ns + least(nt, 2))::INT AS rejected, least(nt, 2)::INT AS learned FROM x")
def tok03_pairwise(spark, d):
    schema = ", ".join(f"{s}_{c} array<int>" for s in ("chosen", "rejected") for c in ("input_ids", "attention_mask", "labels"))
    t = _encoded(spark, d, lambda m: T.pairwise(m[:1], m[1], {"role": "assistant", "content": "no"}, _bytes, 24), schema)
    return t.select("event_id", F.size("chosen_input_ids").alias("chosen"), F.size("rejected_input_ids").alias("rejected"), _learned("rejected_labels").alias("learned"))


@query("tok04_feedback", f"WITH {_FITTED} SELECT event_id, (ns + nt)::INT AS n, TRUE AS tag FROM x")
def tok04_feedback(spark, d):
    schema = "kto_tags boolean, " + ", ".join(f"{s}{c} array<int>" for s in ("", "kl_") for c in ("input_ids", "attention_mask", "labels"))
    t = _encoded(spark, d, lambda m: T.feedback(m[:1], m[1], m[1], True, _bytes, 24), schema)
    return t.select("event_id", F.size("kl_input_ids").alias("n"), F.col("kto_tags").alias("tag"))


@query("tok05_unsupervised", f"WITH {_FITTED} SELECT event_id, ns::INT AS n, nt::INT AS labels FROM x")
def tok05_unsupervised(spark, d):
    t = _encoded(spark, d, lambda m: T.unsupervised(m[:1], m[1], _bytes, 24), T.MODEL_INPUT)
    return t.select("event_id", F.size("input_ids").alias("n"), F.size("labels").alias("labels"))


@query("tok09_chatml", "SELECT event_id, (strlen(props) + strlen(event_type || ' ' || user_id) + 2 * strlen('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) + 13)::INT AS n, (strlen(event_type || ' ' || user_id) + strlen('<|im_start|>assistant' || chr(10) || '<|im_end|>' || chr(10)))::INT AS learned FROM events")
def tok09_chatml(spark, d):
    t = _encoded(spark, d, lambda m: T.chatml(m, _bytes), T.MODEL_INPUT + ", loss_weights array<double>")
    return t.select("event_id", F.size("input_ids").alias("n"), _learned("labels").alias("learned"))


@query("tok10_thinking_layout", """WITH m AS (SELECT conv_id, turn, CASE WHEN role IN ('gpt', 'assistant') THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
q AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'user'), max(n) - 1) AS asked FROM m GROUP BY conv_id)
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND i > asked AND i = n - 1 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(text, chr(10)) ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered, sum(CASE WHEN role = 'assistant' THEN 1.0::DOUBLE ELSE 0 END) AS weight
FROM m JOIN q USING (conv_id) GROUP BY conv_id""")
def tok10_thinking_layout(spark, d):
    role = lambda m: F.when(m.role.isin("gpt", "assistant"), "assistant").otherwise("user")
    t = _chats(spark, d).select("conv_id", F.transform("messages", lambda m: F.struct(role(m).alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.coalesce(m.content, F.lit("")).alias("value"))).alias("content"), F.lit(None).cast("double").alias("loss_weight"))).alias("messages"))
    out = R.thinking_rendered(t, "messages", ("conv_id",))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("rendered"), F.aggregate("segments", F.lit(0.0), lambda a, s: a + s.weight).alias("weight"))


@query("fn38_rendered_chats", """WITH m AS (SELECT conv_id, CASE WHEN role IN ('gpt', 'assistant') THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS text, turn FROM conversations)
SELECT conv_id, '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || string_agg(CASE WHEN role = 'user' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text || '<|im_end|>' || chr(10) END, '' ORDER BY turn) AS rendered FROM m GROUP BY conv_id""")
def fn38_rendered_chats(spark, d):
    t = _chats(spark, d).select("conv_id", F.transform("messages", lambda m: F.struct(F.when(m.role.isin("gpt", "assistant"), "assistant").otherwise("user").alias("role"), F.coalesce(m.content, F.lit("")).alias("content"))).alias("messages"))
    return t.select("conv_id", R.rendered(F.col("messages"), "chatml", F.lit("Be brief.")).alias("rendered"))


# ------------------------------------------------------------------ batches
@query("pck03_padding_free", """WITH s AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, least(n_nationkey % 6, 4) AS n FROM nation)
SELECT r AS region, sum(n)::INT AS ids, sum(CASE WHEN i > 0 AND n > 0 THEN 1 ELSE 0 END)::INT AS masked, sum(n * (n - 1) // 2)::INT AS places, sum(CASE WHEN n = 0 THEN 0 WHEN i > 0 THEN n - 1 ELSE n END)::DOUBLE AS weight FROM s GROUP BY r""")
def pck03_padding_free(spark, d):
    ids = F.transform(F.sequence(F.lit(0), F.col("n_nationkey") % 6), lambda i: i + 1)
    ids = F.slice(ids, F.lit(1), F.col("n_nationkey") % 6)
    t = read(spark, d, "nation").select("n_regionkey", F.struct("n_nationkey", ids.alias("input_ids"), ids.alias("labels"), F.transform(ids, lambda _: F.lit(1.0)).alias("loss_weights")).alias("s"))
    t = t.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("s")).alias("rows")).select("region", P.padding_free(F.col("rows"), 4).alias("p"))
    total = lambda c, zero: F.aggregate(c, F.lit(zero), lambda a, x: a + x)
    return t.select("region", F.size("p.input_ids").alias("ids"), F.size(F.filter("p.labels", lambda x: x == P.IGNORED)).alias("masked"), total(F.col("p.position_ids"), 0).alias("places"), total(F.col("p.loss_weights"), 0.0).alias("weight"))


def _stream_sql(limit: int, micro: int, padded: bool) -> str:
    """The fold of dynamic batches over all documents, line by line."""
    budget = limit * micro
    over = f"greatest(f.longest, t.x) * (f.n + 1) > {budget}" if padded else f"f.total + t.x > {budget}"
    done = f"longest * n >= {budget}" if padded else "FALSE"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, least(n_chars, {limit})::BIGINT AS x FROM documents),
f(line, ended, done, n, longest, total) AS (SELECT -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
 UNION ALL SELECT line, ended, CASE WHEN {done} THEN n ELSE 0 END, CASE WHEN {done} THEN 0 ELSE n END, CASE WHEN {done} THEN 0 ELSE longest END, CASE WHEN {done} THEN 0 ELSE total END FROM (
  SELECT t.line, CASE WHEN f.n > 0 AND {over} THEN f.n ELSE 0 END AS ended, CASE WHEN f.n > 0 AND {over} THEN 1 ELSE f.n + 1 END AS n,
   CASE WHEN f.n > 0 AND {over} THEN t.x ELSE greatest(f.longest, t.x) END AS longest, CASE WHEN f.n > 0 AND {over} THEN t.x ELSE f.total + t.x END AS total
  FROM f JOIN t ON t.line = f.line + 1)),
e AS (SELECT line, 0 AS k, ended AS size FROM f WHERE ended > 0 UNION ALL SELECT line, 1, done FROM f WHERE done > 0)
SELECT line // 1000 AS batch, (row_number() OVER (PARTITION BY line // 1000 ORDER BY line, k) - 1)::INT AS i, size::INT AS size FROM e"""


@query("bat03_dynamic_padding_free", _stream_sql(8192, 4, False))
def bat03_dynamic_padding_free(spark, d):
    t = D.numbered(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return P.stream_batches(t, "n_chars", 4, 8192, padded=False)


@query("bat04_strategy_steps", f"SELECT count(*) AS n, max(step) + 1 AS steps, min(rows) AS least, max(rows) AS most FROM (SELECT step, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 24 AS step, count(*) OVER () AS total FROM customer) WHERE step < total // 24 GROUP BY step)")
def bat04_strategy_steps(spark, d):
    t = D.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey")
    placed = B.STRATEGIES["normal"].placed(t, "c_custkey", B.Info(8, 3, 100)).groupBy("step").agg(F.count("*").alias("rows"))
    return placed.agg(F.count("*").alias("n"), (F.max("step") + 1).alias("steps"), F.min("rows").alias("least"), F.max("rows").alias("most"))


@query("bat04_dynamic_rows", f"""WITH s AS ({_stream_sql(8192, 4, True)}), o AS (SELECT size, row_number() OVER (ORDER BY batch, i) - 1 AS k, sum(size) OVER (ORDER BY batch, i) - size AS start, count(*) OVER () AS n FROM s),
x AS (SELECT k, unnest(range(start::BIGINT, (start + size)::BIGINT)) AS line FROM o WHERE k < n // 2 * 2), t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents)
SELECT doc_id, k // 2 AS step, k % 2 AS micro FROM x JOIN t USING (line)""")
def bat04_dynamic_rows(spark, d):
    t = D.numbered(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return B.STRATEGIES["dynamic_batching"].placed(t, "n_chars", B.Info(4, 2, 8192)).select("doc_id", "step", "micro")


@query("bat05_replicas", """WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || ':45'), c_custkey) - 1 AS g, count(*) OVER () AS n FROM customer)
SELECT c_custkey, g % 4 AS replica, g // 4 // 10 AS step, g // 4 % 10 // 5 AS micro FROM o WHERE g < n // 4 * 4 AND g // 4 < n // 4 // 10 * 10""")
def bat05_replicas(spark, d):
    info = B.info_of(micro=5, replicas=4, limit=100, total=40)
    dealt = B.replicated(read(spark, d, "customer").select("c_custkey"), "c_custkey", 4, epoch=3)
    # Each replica has equally many rows, so steps end alike.
    rows, n = info.micro * info.num_micro, dealt.count() // 4
    t = dealt.where(F.col("line_no") < n // rows * rows)
    return t.select("c_custkey", "replica", F.floor(F.col("line_no") / rows).alias("step"), F.floor(F.col("line_no") % rows / info.micro).alias("micro"))


@query("str05_resumed", """WITH n AS (SELECT count(*) AS n FROM customer), e AS (SELECT c_custkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5(c_custkey || ':' || (42 + epoch)), c_custkey) - 1 + epoch * n AS place, n FROM customer, n, (VALUES (0), (1), (2)) v(epoch))
SELECT c_custkey, epoch, place FROM e WHERE place >= n - 50 AND place < 2 * n + 50""")
def str05_resumed(spark, d):
    t = read(spark, d, "customer").select("c_custkey")
    n = t.count()
    return B.resumed(t, "c_custkey", n - 50, n + 100)


def _pairs(spark, d):
    row = lambda n, v: F.array_repeat(F.lit(v), n.cast("int"))
    k = F.col("n_nationkey")
    t = read(spark, d, "nation").select(k.cast("long").alias("line_no"), row(k % 5 + 1, 1).alias("chosen_input_ids"), row(k % 5 + 1, 2).alias("chosen_labels"), row(k % 3 + 1, 3).alias("rejected_input_ids"), row(k % 3 + 1, 4).alias("rejected_labels"))
    return t


@query("bat09_pairwise", """WITH p AS (SELECT n_nationkey // 4 AS batch, n_nationkey % 4 AS spot, count(*) OVER (PARTITION BY n_nationkey // 4) AS k, n_nationkey % 5 + 1 AS c, n_nationkey % 3 + 1 AS r FROM nation),
u AS (SELECT batch, spot AS place, c AS n FROM p UNION ALL SELECT batch, spot + k, r FROM p)
SELECT batch, place, least(max(n) OVER (PARTITION BY batch), 4)::INT AS width, least(n, 4)::INT AS seen, least(n, 4)::INT AS learned FROM u""")
def bat09_pairwise(spark, d):
    t = B.pairwise_collated(_pairs(spark, d), 4, 4)
    return t.select("batch", "place", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("seen"), _learned("labels").alias("learned"))


@query("bat10_feedback", """WITH p AS (SELECT n_nationkey // 4 AS batch, n_nationkey % 4 AS place, n_nationkey % 5 + 1 AS c, n_nationkey % 3 + 1 AS r, n_nationkey % 2 = 0 AS tag FROM nation)
SELECT batch, place, least(max(c) OVER (PARTITION BY batch), 4)::INT AS width, least(max(r) OVER (PARTITION BY batch), 4)::INT AS kl_width, tag FROM p""")
def bat10_feedback(spark, d):
    t = _pairs(spark, d).withColumnsRenamed({"chosen_input_ids": "input_ids", "chosen_labels": "labels", "rejected_input_ids": "kl_input_ids", "rejected_labels": "kl_labels"}).withColumn("kto_tags", F.col("line_no") % 2 == 0)
    return B.feedback_collated(t, 4, 4).select("batch", "place", F.size("input_ids").alias("width"), F.size("kl_input_ids").alias("kl_width"), F.col("kto_tags").alias("tag"))


@query("bat11_positions", "SELECT n_nationkey, (n_nationkey % 4 * (n_nationkey % 4 - 1) // 2)::INT AS places FROM nation")
def bat11_positions(spark, d):
    mask = F.concat(F.array_repeat(F.lit(0), F.col("n_regionkey")), F.array_repeat(F.lit(1), F.col("n_nationkey") % 4), F.array(F.lit(0)))
    return read(spark, d, "nation").select("n_nationkey", F.aggregate(B.position_ids(mask), F.lit(0), lambda a, x: a + x).alias("places"))


# ------------------------------------------------------------------ samples and splits
_HASH = "(('0x' || substr(md5({x}), 1, 8))::BIGINT)"


@query("smp02_sized", f"""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS line, count(*) OVER () AS n FROM customer),
d AS (SELECT i AS draw, {_HASH.format(x="i || ':weight:42'")} % 300 AS j FROM range(0, 450) t(i)), e AS (SELECT draw, {_HASH.format(x="j || ':size:42'")} % (SELECT count(*) FROM customer) AS line FROM d)
SELECT draw, c_custkey FROM e JOIN c USING (line)""")
def smp02_sized(spark, d):
    t = D.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey")
    return D.sized(t, 300, 1.5).select("draw", "c_custkey")


@query("smp05_buffered", "SELECT c_custkey, line // 256 * 256 + row_number() OVER (PARTITION BY line // 256 ORDER BY md5(c_custkey || ':42'), c_custkey) - 1 AS shuffled_no FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS line FROM customer)")
def smp05_buffered(spark, d):
    t = D.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey")
    return D.buffered(t, "c_custkey", 256).select("c_custkey", "shuffled_no")


@query("spl02_taken", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= 40 THEN 'validation' ELSE 'train' END AS part FROM customer")
def spl02_taken(spark, d):
    t = D.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey")
    parts = D.prepared(t, size=40, streaming=True)
    return parts["train"].select("c_custkey", F.lit("train").alias("part")).unionByName(parts["validation"].select("c_custkey", F.lit("validation").alias("part")))


@query("spl03_named_sets", "SELECT 'train' AS part, count(*) AS n FROM orders UNION ALL SELECT 'validation_small', count(*) FROM nation UNION ALL SELECT 'validation_tiny', count(*) FROM region")
def spl03_named_sets(spark, d):
    parts = D.prepared(read(spark, d, "orders"), {"small": read(spark, d, "nation"), "tiny": read(spark, d, "region")})
    counts = [t.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, t in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("spl01_members", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5(c_custkey || ':42'), c_custkey) <= floor(count(*) OVER () * 0.1) THEN 'test' ELSE 'train' END AS part FROM customer")
def spl01_members(spark, d):
    return D.split(read(spark, d, "customer").select("c_custkey"), "c_custkey", 0.1)


@query("smp01_members", f"""WITH o AS (SELECT n_nationkey, row_number() OVER (ORDER BY md5(n_nationkey || ':42'), n_nationkey) - 1 AS no, count(*) OVER () AS n FROM nation)
SELECT n_nationkey, count(*) AS times FROM (SELECT n_nationkey FROM o UNION ALL SELECT o.n_nationkey FROM (SELECT {_HASH.format(x="i || ':42'")} % 25 AS no FROM range(0, 35) t(i)) JOIN o USING (no)) GROUP BY 1""")
def smp01_members(spark, d):
    return D.sampled(read(spark, d, "nation").select("n_nationkey"), "n_nationkey", 60).groupBy("n_nationkey").agg(F.count("*").alias("times"))


def _shots_sql(k: int) -> str:
    """k places of n, the j-th by adding one for each smaller place already taken."""
    body = "p0 AS (SELECT s_suppkey, (SELECT count(*) FROM nation) AS n, CAST([] AS BIGINT[]) AS got FROM supplier)"
    for j in range(k):
        r = f"({_HASH.format(x=f's_suppkey || chr(58) || {j} || chr(58) || 42')} % (n - {j}))"
        body += f", p{j + 1} AS (SELECT s_suppkey, n, list_append(got, list_reduce(list_prepend({r}::BIGINT, list_sort(got)), lambda x, p: CASE WHEN x >= p THEN x + 1 ELSE x END)) AS got FROM p{j})"
    return f"WITH {body}, o AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS no FROM nation), s AS (SELECT s_suppkey, unnest(got) AS no, generate_subscripts(got, 1) AS shot FROM p{k}) SELECT s_suppkey, n_nationkey, shot::INT AS shot FROM s JOIN o USING (no)"


@query("jn15_shots", _shots_sql(5))
def jn15_shots(spark, d):
    return D.few_shot(read(spark, d, "supplier"), read(spark, d, "nation"), "s_suppkey", "n_nationkey", 5)


@query("mix02_drawn", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT i AS t, CASE WHEN {_HASH.format(x="i || ':42'")} / 4294967296.0 < 0.5 THEN 0 ELSE 1 END AS src FROM range(0, 4000) r(i)),
c AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t) - 1 AS nth FROM s), n AS (SELECT (SELECT count(*) FROM region) AS n0, 25 AS n1),
e AS (SELECT min(t) AS last FROM c, n WHERE nth = CASE src WHEN 0 THEN n0 ELSE n1 END - 1)
SELECT t AS mix_no, src AS source, nth AS line_no FROM c, e WHERE t <= last""")
def mix02_drawn(spark, d):
    a, b = (D.numbered(read(spark, d, t).select(F.col(k).cast("long").alias("id")), "id") for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey")))
    return D.interleaved([a, b], [a.count(), b.count()], "under", probabilities=[0.5, 0.5]).select("mix_no", F.col("_source").alias("source"), "line_no")
