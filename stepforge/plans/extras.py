"""Queries for the smaller aggregates, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions import scores as S
from stepforge.operators import assemble as A
from stepforge.operators import packing as P
from stepforge.operators import reports as R
from stepforge.operators import selection as B
from stepforge.plans.lens import chains, oracle, read, steps


def _labels(spark, d):
    """Rows with labels: every third place is masked."""
    t = read(spark, d, "events").select("event_id", F.transform(F.sequence(F.lit(0), F.pmod("event_id", F.lit(9)).cast("int")), lambda i: F.when(i % 3 == 0, -100).otherwise(i)).alias("labels"))
    return t.withColumn("line_no", F.col("event_id"))


def agg35_valid_ratio(spark, d):
    return R.valid_ratio(_labels(spark, d), "labels")


AGG35 = """WITH t AS (SELECT event_id // 4 AS b, event_id % 9 + 1 AS n, event_id % 9 + 1 - (event_id % 9) // 3 - 1 AS v FROM events)
SELECT sum(v)::BIGINT AS valid, sum(total)::BIGINT AS total, sum(v)::DOUBLE / sum(total) AS ratio FROM (SELECT sum(v) AS v, max(n) * count(*) AS total FROM t GROUP BY b)"""


def agg37_token_accuracy(spark, d):
    # Even rows predict each next label, odd ones always 2.
    t = _labels(spark, d).withColumn("predicted", F.transform("labels", lambda x, i: F.when(F.col("event_id") % 2 == 0, i + 1).otherwise(2)))
    return t.select("event_id", P.token_accuracy(F.col("predicted"), F.col("labels")).alias("accuracy"))


AGG37 = "SELECT event_id, CASE WHEN e = 0 THEN NULL WHEN event_id % 2 = 0 THEN 1.0::DOUBLE WHEN e >= 2 THEN 1.0::DOUBLE / (e - e // 3) ELSE 0.0 END AS accuracy FROM (SELECT event_id, event_id % 9 AS e FROM events)"


def agg41_sequence_logps(spark, d):
    t = _labels(spark, d).withColumn("p", F.transform("labels", lambda x, i: -(i + 1).cast("double")))
    return t.select("event_id", R.sequence_logps(F.col("p"), F.col("labels")).alias("x")).select("event_id", "x.logps", "x.length")


AGG41 = "SELECT event_id, coalesce(-list_sum(list_filter(range(1, event_id % 9 + 2), lambda i: (i - 1) % 3 <> 0)), 0)::DOUBLE AS logps, len(list_filter(range(1, event_id % 9 + 2), lambda i: (i - 1) % 3 <> 0))::INT AS length FROM events"


def agg42_throughput(spark, d):
    return R.tokens_per_second(_labels(spark, d), "labels", 2.0, 10.0)


def agg44_valid_tokens(spark, d):
    return _labels(spark, d).agg(F.sum(P.valid_tokens(F.col("labels"))).alias("valid"))


def agg45_balance(spark, d):
    return R.balance(read(spark, d, "labels").select((F.col("quality") == 1).alias("tag")), "tag")


def bat06_padded(spark, d):
    t = _labels(spark, d).select("event_id", P.padded(F.col("labels"), F.lit(5), -100).alias("x"))
    return t.select("event_id", F.size("x").alias("n"), F.size(F.filter("x", lambda v: v == -100)).alias("masked"))


BAT06 = "SELECT event_id, 5 AS n, 5 - len(list_filter(range(0, least(event_id % 9 + 1, 5)), lambda i: i % 3 <> 0))::INT AS masked FROM events"


def bat07_causal_mask(spark, d):
    t = read(spark, d, "nation").select("n_nationkey", F.concat(F.array_repeat(F.lit(1), F.lit(2)), F.array_repeat(F.lit(2), F.col("n_regionkey")), F.array(F.lit(0))).alias("ids"))
    return t.select("n_nationkey", F.aggregate(F.flatten(P.causal_mask(F.col("ids"))), F.lit(0), lambda a, x: a + x).alias("ones"))


def bat08_unpadded(spark, d):
    t = _labels(spark, d).select("event_id", P.unpadded(F.col("labels"), F.transform("labels", lambda x: (x != -100).cast("int"))).alias("x"))
    return t.select("event_id", F.size("x").alias("n"))


def tok11_dpo(spark, d):
    t = _labels(spark, d).select("event_id", P.dpo_input(F.col("labels"), F.slice("labels", 1, 1)).alias("x"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)
    return t.select("event_id", F.size("x.input_ids").alias("n"), total(F.col("x.token_type_ids")).alias("types"), total(F.col("x.position_ids")).alias("places"))


TOK11 = "SELECT event_id, (event_id % 9 + 2)::INT AS n, (event_id % 9 + 3)::INT AS types, ((event_id % 9 + 1) * (event_id % 9 + 2) // 2 + 1)::INT AS places FROM events"


def win14_last_query(spark, d):
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("xs"))
    roles = F.transform("xs", lambda x: F.when(x.role.isin("user", "human"), "user").otherwise(x.role))
    return t.select("conv_id", R.last_query(roles, F.transform("xs", lambda x: x.turn % 4 == 0)).alias("at"))


WIN14 = "SELECT conv_id, coalesce(max(i) FILTER (WHERE role IN ('user', 'human') AND turn % 4 <> 0), -1)::INT AS at FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id"


def jn03_problem_text(spark, d):
    t = chains(spark, d).join(read(spark, d, "customer").select(F.col("c_custkey").alias("prob_idx"), F.col("c_name").alias("problem")), "prob_idx")
    return t.select("chain_id", "problem")


def jn08_stage_action(spark, d):
    plan = F.create_map(*(F.lit(x) for i in range(1, 6) for x in (f"P{i}", ("SOLVE", "COMPUTE")[i % 2])))
    return steps(spark, d).groupBy(F.coalesce(F.try_element_at(plan, F.col("claimed")), F.lit("?")).alias("action")).agg(F.count("*").alias("n"))


def jn09_plan_labels(spark, d):
    return chains(spark, d).join(A.plan_quality(chains(spark, d)), ["prob_idx", "plan_idx"], "left").select("chain_id", "quality", "truncated")


def jn11_missing_units(spark, d):
    p = read(spark, d, "customer").select(F.col("c_custkey").alias("prob_idx"))
    return R.missing_units(p, 2, chains(spark, d).select("prob_idx", F.col("plan_idx").cast("int")))


def jn14_score_sources(spark, d):
    t = B.scored_chains(chains(spark, d), steps(spark, d))
    parts = [t.select(F.lit(h).alias("source"), S.step_aggregate(F.col("scores"), h).alias("score"), "correct") for h in ("mean", "min")]
    return parts[0].unionByName(parts[1]).where("correct IS NOT NULL").groupBy("source", "correct").agg(F.count("*").alias("n"))


def agg12_plan_means(spark, d):
    t = steps(spark, d)
    return t.groupBy("chain_id").agg(F.avg("step_score").alias("plan_mean"), F.min_by("step_score", F.when(F.col("step_score").isNotNull(), F.col("step"))).alias("plan_first"))


def agg43_running(spark, d):
    return read(spark, d, "orders").groupBy("o_orderstatus").agg((F.sum(F.col("o_totalprice") * F.col("o_custkey")) / F.sum("o_custkey")).alias("mean"))


def flt19_mixed_schemes(spark, d):
    scheme = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    return read(spark, d, "orders").agg((F.countDistinct(F.coalesce(scheme, F.lit("(none)"))) > 1).alias("with_null"), F.countDistinct(scheme).alias("schemes"))


def flt08_retired(spark, d):
    t = chains(spark, d).select("chain_id", "answer", (F.col("chain_id") % 2 == 0).alias("done"), F.pmod("chain_id", F.lit(5000)).alias("tokens"))
    return R.retired(t, "tokens", 4000).groupBy("done").agg(F.count("*").alias("n"), F.count("answer").alias("answers"))


def srt01_result_keys(spark, d):
    return steps(spark, d).select("chain_id", "step").orderBy("chain_id", "step").limit(50)


def srt01_sorted_keys(spark, d):
    """All result keys in order; ``srt01_result_keys`` is the head that its SQL asks for."""
    return steps(spark, d).select("chain_id", "step").orderBy("chain_id", "step")


def srt09_first_failures(spark, d):
    return steps(spark, d).where("step_score IS NULL").orderBy("chain_id", "step").limit(20).select("chain_id", "step")


def set03_difference(spark, d):
    a = read(spark, d, "customer").select("c_custkey")
    return a.exceptAll(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


def set04_covered(spark, d):
    a = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return a.union(read(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey")).distinct()


def set08_shared(spark, d):
    a, b = (read(spark, d, "orders").where(f"o_orderstatus = '{x}'").select("o_custkey") for x in "FO")
    return a.intersect(b)


def src16_subjects(spark, d):
    t = read(spark, d, "orders")
    parts = {x: t.where(f"o_orderstatus = '{x}'").select("o_orderkey") for x in "FOP"}
    return R.subjects(parts).groupBy("subject").agg(F.count("*").alias("n"))


def win13_progress(spark, d):
    t = read(spark, d, "events").select("event_id", F.lit(1).alias("total_steps"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") + 1).alias("step"))
    return R.progress(t, "step", "total_steps", "ts").select("event_id", "share", "gone")


QUERIES = {
    "agg12_plan_means": (agg12_plan_means, oracle(" SELECT chain_id, avg(step_score) AS plan_mean, arg_min(step_score, step) FILTER (WHERE step_score IS NOT NULL) AS plan_first FROM steps GROUP BY chain_id")),
    "agg35_valid_ratio": (agg35_valid_ratio, AGG35),
    "agg37_token_accuracy": (agg37_token_accuracy, AGG37),
    "agg41_sequence_logps": (agg41_sequence_logps, AGG41),
    "agg42_throughput": (agg42_throughput, "SELECT sum(event_id % 9 + 1) * 2.0::DOUBLE / 10.0 AS tokens_per_second FROM events"),
    "agg43_weighted_totals": (agg43_running, "SELECT o_orderstatus, sum(o_totalprice * o_custkey) / sum(o_custkey) AS mean FROM orders GROUP BY 1"),
    "agg44_valid_tokens": (agg44_valid_tokens, "SELECT sum(event_id % 9 - (event_id % 9) // 3)::BIGINT AS valid FROM events"),
    "agg45_balance": (agg45_balance, "SELECT count(*) FILTER (WHERE quality = 1) AS desirable, count(*) FILTER (WHERE quality <> 1) AS undesirable, bool_or(quality = 1) AND bool_or(quality <> 1) AS balanced FROM labels"),
    "bat06_padded": (bat06_padded, BAT06),
    "bat07_causal_mask": (bat07_causal_mask, "SELECT n_nationkey, (3 + n_regionkey * (n_regionkey + 1) // 2)::INT AS ones FROM nation"),
    "bat08_unpadded": (bat08_unpadded, "SELECT event_id, (event_id % 9 - (event_id % 9) // 3)::INT AS n FROM events"),
    "tok11_dpo": (tok11_dpo, TOK11),
    "win13_progress": (win13_progress, "SELECT event_id, (event_id + 1)::DOUBLE AS share, epoch(date_trunc('second', ts))::BIGINT - min(epoch(date_trunc('second', ts))::BIGINT) OVER () AS gone FROM events"),
    "win14_last_query": (win14_last_query, WIN14),
    "jn03_problem_text": (jn03_problem_text, "SELECT o_orderkey AS chain_id, c_name AS problem FROM orders JOIN customer ON c_custkey = o_custkey"),
    "jn08_stage_action": (jn08_stage_action, "SELECT CASE WHEN l_linenumber > 5 THEN '?' WHEN l_linenumber % 2 = 1 THEN 'COMPUTE' ELSE 'SOLVE' END AS action, count(*) AS n FROM lineitem GROUP BY 1"),
    "jn09_plan_labels": (jn09_plan_labels, oracle(", q AS (SELECT prob_idx, plan_idx, count(*) FILTER (WHERE correct)::DOUBLE / nullif(count(correct), 0) AS quality, count(*) FILTER (WHERE correct IS NULL)::DOUBLE / count(*) AS truncated FROM chains GROUP BY ALL) SELECT chain_id, quality, truncated FROM chains JOIN q USING (prob_idx, plan_idx)")),
    "jn11_missing_units": (jn11_missing_units, "SELECT c_custkey AS prob_idx, p AS plan_idx FROM customer CROSS JOIN (VALUES (0), (1)) v(p) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = p)"),
    "jn14_score_sources": (jn14_score_sources, oracle(" SELECT source, correct, count(*) AS n FROM chains CROSS JOIN (VALUES ('mean'), ('min')) v(source) WHERE correct IS NOT NULL GROUP BY ALL")),
    "flt08_retired": (flt08_retired, oracle(" SELECT chain_id % 2 = 0 OR chain_id % 5000 > 4000 AS done, count(*) AS n, count(CASE WHEN chain_id % 5000 <= 4000 THEN answer END) AS answers FROM chains GROUP BY 1")),
    "flt19_mixed_schemes": (flt19_mixed_schemes, "SELECT count(DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN '(none)' ELSE o_orderstatus END) > 1 AS with_null, count(DISTINCT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END) AS schemes FROM orders"),
    "srt01_result_keys": (srt01_result_keys, oracle(" SELECT chain_id, step FROM steps ORDER BY chain_id, step LIMIT 50")),
    "srt01_sorted_keys": (srt01_sorted_keys, oracle(" SELECT chain_id, step FROM steps ORDER BY chain_id, step")),
    "srt09_first_failures": (srt09_first_failures, oracle(" SELECT chain_id, step FROM steps WHERE step_score IS NULL ORDER BY chain_id, step LIMIT 20")),
    "set03_difference": (set03_difference, "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "set04_covered": (set04_covered, "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O')"),
    "set08_shared": (set08_shared, "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'"),
    "src16_subjects": (src16_subjects, "SELECT o_orderstatus AS subject, count(*) AS n FROM orders GROUP BY 1"),
}
