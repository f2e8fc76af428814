"""Queries for scores, selection, votes and separation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions import scores as S
from stepforge.operators import selection as B
from stepforge.operators import separation as D
from stepforge.plans.lens import chains, oracle, read, steps

# ----------------------------------------------------------------- shared oracle text
ARRAYS = """
 arr AS (SELECT chain_id, list(coalesce(step_score, CAST(0.5 AS DOUBLE)) ORDER BY step) AS xs FROM steps GROUP BY chain_id),
 base AS (SELECT c.*, coalesce(c.correct, FALSE) AS hit, coalesce(a.xs, CAST([] AS DOUBLE[])) AS xs FROM chains c LEFT JOIN arr a USING (chain_id)),
 pre AS (SELECT *, CASE WHEN len(xs) > 0 THEN list_min(xs) ELSE CAST(0 AS DOUBLE) END AS a_min,
   CASE WHEN len(xs) > 0 THEN list_sum(xs) / len(xs) ELSE CAST(0 AS DOUBLE) END AS a_mean,
   CASE WHEN len(xs) > 0 THEN xs[-1] ELSE CAST(0 AS DOUBLE) END AS a_last,
   list_sum(list_transform(xs, lambda x: abs(x - 0.5) * 2)) AS wsum,
   list_sum(list_transform(xs, lambda x: x * abs(x - 0.5) * 2)) AS xw,
   CAST(len(list_filter(xs, lambda x: abs(x - 0.5) > 0)) AS DOUBLE) / nullif(len(xs), 0) AS frac FROM base),
 agg AS (SELECT *, (a_min + a_mean) / 2 AS a_hybrid,
   CASE WHEN len(xs) = 0 THEN CAST(0 AS DOUBLE) WHEN wsum < 1e-9 THEN a_mean ELSE xw / wsum END AS a_confident_mean FROM pre),
 agg2 AS (SELECT *, CASE WHEN len(xs) = 0 THEN CAST(0 AS DOUBLE) ELSE frac * a_confident_mean + (1 - frac) * a_mean END AS a_adaptive_mean FROM agg)
"""
_COMBINE = {
    "none": "{a}",
    "multiply": "{a} * plan_score",
    "weighted": "(1 - CAST({w} AS DOUBLE)) * {a} + CAST({w} AS DOUBLE) * plan_score",
    "plan_trust": "abs(plan_score - 0.5) * 2 * plan_score + (1 - abs(plan_score - 0.5) * 2) * {a}",
}
GRID = ", grid AS (" + " UNION ALL ".join(
    f"SELECT prob_idx, chain_id, tpos, answer, correct, hit, plan_score, '{h}' AS how, '{m}' AS combine, CAST({w} AS DOUBLE) AS weight, {i * len(S.COMBINES) + j} AS cfg, "
    + _COMBINE[m].format(a=f"a_{h}", w=w)
    + " AS final FROM agg2"
    for i, h in enumerate(S.AGGREGATES)
    for j, (m, w) in enumerate(S.COMBINES)
) + ")"


def _sql(body: str, grid: bool = False) -> str:
    return oracle(", " + ARRAYS + (GRID if grid else "") + body).replace(") , \n arr", "),\n arr").replace(")  , ", "), ")


def _scored(spark, d):
    return B.scored_chains(chains(spark, d), steps(spark, d))


def _weighted(spark, d, how="mean", mode="weighted", weight=0.3):
    t = _scored(spark, d)
    return t.withColumn("final", S.combined(S.step_aggregate(F.col("scores"), how), F.col("plan_score"), mode, weight))


# ----------------------------------------------------------------- queries
def agg14_best_of_n(spark, d):
    picked = B.best_of_n(_weighted(spark, d))
    bounds = B.problem_bounds(chains(spark, d))
    return picked.join(bounds, "prob_idx").select("prob_idx", "chain_id", "tpos", "final", "hit", "n", "n_correct")


AGG14 = _sql("""
SELECT prob_idx, arg_max(chain_id, (f, -tpos)) AS chain_id, arg_max(tpos, (f, -tpos)) AS tpos, max(f) AS final,
       arg_max(hit, (f, -tpos)) AS hit, count(*) AS n, count(*) FILTER (WHERE hit) AS n_correct
FROM (SELECT *, (1 - CAST(0.3 AS DOUBLE)) * a_mean + CAST(0.3 AS DOUBLE) * plan_score AS f FROM agg2) GROUP BY prob_idx""")


def agg10_step_aggregates(spark, d):
    t = _scored(spark, d)
    return t.select("chain_id", *(S.step_aggregate(F.col("scores"), h).alias(h) for h in S.AGGREGATES))


AGG10 = _sql(' SELECT chain_id, a_min AS "min", a_mean AS mean, a_last AS "last", a_hybrid AS hybrid, a_confident_mean AS confident_mean, a_adaptive_mean AS adaptive_mean FROM agg2')


def agg11_vote_aggregates(spark, d):
    t = _scored(spark, d)
    return t.select("chain_id", *(S.vote_aggregate(F.col("scores"), h).alias(f"vote_{h}") for h in ("min", "last", "mean")), S.combined_vote(S.vote_aggregate(F.col("scores"), "mean"), F.col("plan_score"), "multiply").alias("vote_final"))


AGG11 = _sql(" SELECT chain_id, CASE WHEN len(xs) > 0 THEN a_min END AS vote_min, CASE WHEN len(xs) > 0 THEN a_last END AS vote_last, CASE WHEN len(xs) > 0 THEN a_mean END AS vote_mean, a_mean * plan_score AS vote_final FROM agg2")


def agg13_bounds(spark, d):
    p = B.problem_bounds(chains(spark, d))
    return p.agg(F.count("*").alias("n_problems"), F.avg(F.col("n_correct") / F.col("n")).alias("pass_at_1"), F.avg((F.col("n_correct") > 0).cast("double")).alias("oracle"))


AGG13 = oracle(" SELECT count(*) AS n_problems, avg(k / n) AS pass_at_1, avg(CASE WHEN k > 0 THEN 1.0::DOUBLE ELSE 0 END) AS oracle FROM (SELECT prob_idx, count(*)::DOUBLE AS n, count(*) FILTER (WHERE correct) AS k FROM chains GROUP BY prob_idx)")


def agg16_bon_matrix(spark, d):
    return B.grid_accuracy(_scored(spark, d))


AGG16 = _sql(" SELECT cfg, how, combine, weight, avg(CAST(h AS INT)::DOUBLE) AS accuracy, count(*) AS n_problems FROM (SELECT cfg, how, combine, weight, prob_idx, arg_max(hit, (final, -tpos)) AS h FROM grid GROUP BY ALL) GROUP BY ALL", True)


def agg15_diagnosis(spark, d):
    t = _weighted(spark, d, mode="none").withColumn("positive", B.is_right())
    g = t.groupBy("positive").agg(F.count("*").alias("n"), F.avg("final").alias("mean"), B.upper_median(F.col("final")).alias("median"))
    r = lambda c, v, a: F.max(F.when(F.col("positive") == c, F.col(v))).alias(a)
    w = g.agg(r(True, "n", "n_correct"), r(True, "mean", "mean_correct"), r(True, "median", "median_correct"), r(False, "n", "n_wrong"), r(False, "mean", "mean_wrong"), r(False, "median", "median_wrong"))
    gap = F.col("mean_correct") - F.col("mean_wrong")
    return w.withColumn("separation", gap).withColumn("class", F.when(F.abs(gap) < 0.03, "none").when(gap > 0.03, "separated").otherwise("reversed"))


AGG15 = _sql(""", g AS (SELECT hit, count(*) AS n, avg(a_mean) AS m, list_sort(list(a_mean))[count(*) // 2 + 1] AS md FROM agg2 GROUP BY hit),
 w AS (SELECT max(n) FILTER (WHERE hit) AS n_correct, max(m) FILTER (WHERE hit) AS mean_correct, max(md) FILTER (WHERE hit) AS median_correct,
 max(n) FILTER (WHERE NOT hit) AS n_wrong, max(m) FILTER (WHERE NOT hit) AS mean_wrong, max(md) FILTER (WHERE NOT hit) AS median_wrong FROM g)
 SELECT *, mean_correct - mean_wrong AS separation, CASE WHEN abs(mean_correct - mean_wrong) < 0.03 THEN 'none' WHEN mean_correct - mean_wrong > 0.03 THEN 'separated' ELSE 'reversed' END AS class FROM w""")


def agg17_auc(spark, d):
    t = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return D.auc(t.select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive")))


AGG17 = """WITH t AS (SELECT n_chars AS s, quality AS q FROM labels JOIN documents USING (doc_id))
SELECT sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auc
FROM (SELECT s FROM t WHERE q = 1) p CROSS JOIN (SELECT s FROM t WHERE q = 0) n"""


def agg18_auc_matrix(spark, d):
    t, cells = B.cell_scores(_scored(spark, d).where("correct IS NOT NULL"), "correct", digits=9)
    return B.named_cells(D.auc(t.withColumnRenamed("correct", "positive"), ("cfg",)), cells)


_AUC = """, s AS (SELECT {k}, round({f}, 9) AS score, correct AS p FROM {t} WHERE correct IS NOT NULL),
 b AS (SELECT {k}, score, count(*) FILTER (WHERE p)::DOUBLE AS pc, count(*) FILTER (WHERE NOT p)::DOUBLE AS q FROM s GROUP BY ALL),
 r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
 SELECT {k}, sum(pc * (below + 0.5 * q)) / (sum(pc) * sum(q)) AS auc FROM r GROUP BY {k}"""
AGG18 = _sql(_AUC.format(k="cfg, how, combine, weight", f="final", t="grid"), True)


def agg19_plan_auc(spark, d):
    t = chains(spark, d).where("correct IS NOT NULL").select(F.col("plan_score").alias("score"), F.col("correct").alias("positive"))
    return D.auc(t)


AGG19 = oracle(" SELECT sum(CASE WHEN p.plan_score > n.plan_score THEN c.x * 2 WHEN p.plan_score = n.plan_score THEN c.x ELSE 0 END * p.k * n.k)::DOUBLE / sum(p.k * n.k) AS auc FROM (SELECT plan_score, count(*) AS k FROM chains WHERE correct GROUP BY 1) p CROSS JOIN (SELECT plan_score, count(*) AS k FROM chains WHERE NOT correct GROUP BY 1) n CROSS JOIN (SELECT 0.5::DOUBLE AS x) c")


def agg20_weighted_vote(spark, d):
    return B.weighted_vote(B.answer_groups(_weighted(spark, d)))


AGG20 = _sql("""SELECT prob_idx, arg_max(answer, (total, -first)) AS answer, max(total) AS total, arg_max(hit, (total, -first)) AS hit FROM (
 SELECT prob_idx, answer, sum(f) AS total, min(tpos) AS first, arg_min(hit, tpos) AS hit FROM (SELECT *, (1 - CAST(0.3 AS DOUBLE)) * a_mean + CAST(0.3 AS DOUBLE) * plan_score AS f FROM agg2) WHERE answer IS NOT NULL GROUP BY prob_idx, answer) GROUP BY prob_idx""")


def agg20_vote_grid(spark, d):
    return B.vote_accuracy(_scored(spark, d))


AGG20G = _sql(""", g AS (SELECT cfg, how, combine, weight, prob_idx, answer, round(sum(round(final, 9)), 6) AS total, min(tpos) AS first, arg_min(hit, tpos) AS hit FROM grid WHERE answer IS NOT NULL GROUP BY ALL),
 w AS (SELECT cfg, how, combine, weight, prob_idx, arg_max(hit, (total, -first)) AS hit FROM g GROUP BY ALL)
 SELECT cfg, how, combine, weight, count(*) FILTER (WHERE hit)::DOUBLE / (SELECT count(DISTINCT prob_idx) FROM chains) AS accuracy FROM w GROUP BY ALL""", True)


def srt06_best_cell(spark, d):
    t = agg20_vote_grid(spark, d)
    return t.agg(F.max_by(F.struct("how", "combine", "weight", "accuracy"), F.struct("accuracy", -F.col("cfg"))).alias("b")).select("b.*")


SRT06 = AGG20G.replace("SELECT cfg, how, combine, weight, count(*) FILTER", "SELECT arg_max(how, (accuracy, -cfg)) AS how, arg_max(combine, (accuracy, -cfg)) AS combine, arg_max(weight, (accuracy, -cfg)) AS weight, max(accuracy) AS accuracy FROM (SELECT cfg, how, combine, weight, count(*) FILTER") + ")"


def agg21_majority(spark, d):
    return B.majority_vote(B.answer_groups(chains(spark, d).withColumn("final", F.lit(0.0))))


AGG21 = oracle("""SELECT prob_idx, arg_max(answer, (votes, -first)) AS answer, max(votes) AS votes, arg_max(hit, (votes, -first)) AS hit FROM (
 SELECT prob_idx, answer, count(*) AS votes, min(tpos) AS first, arg_min(coalesce(correct, FALSE), tpos) AS hit FROM chains WHERE answer IS NOT NULL GROUP BY prob_idx, answer) GROUP BY prob_idx""")


def agg22_vote_report(spark, d):
    t = _weighted(spark, d, mode="multiply")
    groups = B.answer_groups(t)
    p = B.problem_bounds(t)
    part = lambda x, n: x.select("prob_idx", F.col("hit").cast("double").alias(n))
    rows = p.join(part(B.weighted_vote(groups), "vote"), "prob_idx", "left").join(part(B.best_of_n(t), "top1"), "prob_idx", "left").join(part(B.majority_vote(groups), "major"), "prob_idx", "left")
    share = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(n)
    return rows.agg(F.count("*").alias("n_problems"), share(F.col("n_correct") / F.col("n"), "pass_at_1"), share((F.col("n_correct") > 0).cast("double"), "oracle"), share(F.col("vote"), "prm_weighted_vote"), share(F.col("top1"), "prm_top1"), share(F.col("major"), "majority"))


AGG22 = _sql(""", f AS (SELECT *, a_mean * plan_score AS f FROM agg2),
 g AS (SELECT prob_idx, answer, sum(f) AS total, count(*) AS votes, min(tpos) AS first, arg_min(hit, tpos) AS hit FROM f WHERE answer IS NOT NULL GROUP BY ALL),
 v AS (SELECT prob_idx, arg_max(hit, (total, -first))::INT AS vote, arg_max(hit, (votes, -first))::INT AS major FROM g GROUP BY ALL),
 p AS (SELECT prob_idx, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS p1, max(hit::INT) AS o, arg_max(hit, (f, -tpos))::INT AS top1 FROM f GROUP BY ALL)
 SELECT count(*) AS n_problems, round(avg(p1), 4) AS pass_at_1, round(avg(o::DOUBLE), 4) AS oracle, round(avg(coalesce(vote, 0)::DOUBLE), 4) AS prm_weighted_vote, round(avg(top1::DOUBLE), 4) AS prm_top1, round(avg(coalesce(major, 0)::DOUBLE), 4) AS majority FROM p LEFT JOIN v USING (prob_idx)""")


def agg23_vote_detail(spark, d):
    t = _weighted(spark, d, mode="multiply")
    groups = B.answer_groups(t)
    scores = groups.groupBy("prob_idx").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%.9f", "answer", "total"))), ";").alias("group_scores"))
    won = B.weighted_vote(groups).select("prob_idx", F.col("answer").alias("winner"), F.col("hit").alias("winner_correct"))
    p = B.problem_bounds(t).select("prob_idx", F.col("n").alias("n_candidates"), F.col("n_correct").alias("n_correct_candidates"))
    return p.join(won, "prob_idx", "left").join(scores, "prob_idx", "left").withColumn("winner_correct", F.coalesce("winner_correct", F.lit(False)))


AGG23 = _sql(""", f AS (SELECT *, a_mean * plan_score AS f FROM agg2),
 g AS (SELECT prob_idx, answer, sum(f) AS total, min(tpos) AS first, arg_min(hit, tpos) AS hit FROM f WHERE answer IS NOT NULL GROUP BY ALL),
 v AS (SELECT prob_idx, arg_max(answer, (total, -first)) AS winner, arg_max(hit, (total, -first)) AS wc, array_to_string(list_sort(list(answer || '=' || printf('%.9f', total))), ';') AS group_scores FROM g GROUP BY ALL)
 SELECT prob_idx, count(*) AS n_candidates, count(*) FILTER (WHERE hit) AS n_correct_candidates, any_value(winner) AS winner, coalesce(any_value(wc), FALSE) AS winner_correct, any_value(group_scores) AS group_scores FROM f LEFT JOIN v USING (prob_idx) GROUP BY prob_idx""")


def agg24_vote_ablation(spark, d):
    t = B.with_grid(_scored(spark, d), ("mean",), tuple(("weighted", w) for w in (0.0, 1.0, 0.3))).withColumn("final", F.round("final", 9))
    won = B.weighted_vote(B.answer_groups(t, ("weight",)).withColumn("total", F.round("total", 6)), ("weight",))
    return won.groupBy("weight").agg(F.count_if("hit").alias("hits"), F.count("*").alias("voted"))


AGG24 = _sql(""", c AS (SELECT * FROM agg2 CROSS JOIN (VALUES (0.0::DOUBLE), (1.0), (0.3)) v(weight)),
 g AS (SELECT weight, prob_idx, answer, round(sum(round((1 - weight) * a_mean + weight * plan_score, 9)), 6) AS total, min(tpos) AS first, arg_min(hit, tpos) AS hit FROM c WHERE answer IS NOT NULL GROUP BY ALL),
 w AS (SELECT weight, prob_idx, arg_max(hit, (total, -first)) AS hit FROM g GROUP BY ALL) SELECT weight, count(*) FILTER (WHERE hit) AS hits, count(*) AS voted FROM w GROUP BY weight""")


def agg25_summary(spark, d):
    t = B.with_grid(_scored(spark, d), S.AGGREGATES, (("weighted", 0.3),))
    hits = B.best_of_n(t.withColumn("final", F.round("final", 9)), ("how",)).groupBy("how").agg(F.avg(F.col("hit").cast("double")).alias("bon"))
    both = hits.crossJoin(agg13_bounds(spark, d))  # one row
    gap = F.col("oracle") - F.col("pass_at_1")
    return both.select("how", F.round("bon", 4).alias("bon"), F.round(F.col("bon") - F.col("pass_at_1"), 4).alias("gain"), F.when(gap > 1e-9, F.round((F.col("bon") - F.col("pass_at_1")) / gap, 4)).alias("fraction_of_gap"))


AGG25 = _sql(""", b AS (SELECT how, avg(h::INT::DOUBLE) AS bon FROM (SELECT how, prob_idx, arg_max(hit, (round(final, 9), -tpos)) AS h FROM grid WHERE combine = 'weighted' AND weight = CAST(0.3 AS DOUBLE) GROUP BY ALL) GROUP BY how),
 p AS (SELECT avg(p1) AS p1, avg(o::DOUBLE) AS o FROM (SELECT prob_idx, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS p1, max(hit::INT) AS o FROM base GROUP BY ALL))
 SELECT how, round(bon, 4) AS bon, round(bon - p1, 4) AS gain, CASE WHEN o - p1 > 1e-9 THEN round((bon - p1) / (o - p1), 4) END AS fraction_of_gap FROM b CROSS JOIN p""", True)


def _positive(spark, d, how="mean", mode="none"):
    return _weighted(spark, d, how, mode).where("correct IS NOT NULL").select("prob_idx", F.col("final").alias("score"), F.col("correct").alias("positive"))


def agg28_separation(spark, d):
    return D.separation(_positive(spark, d))


AGG28 = _sql(""", t AS (SELECT a_mean AS s, correct AS p FROM agg2 WHERE correct IS NOT NULL),
 g AS (SELECT count(*) FILTER (WHERE p) AS n_correct, count(*) FILTER (WHERE NOT p) AS n_wrong, avg(s) FILTER (WHERE p) AS mean_correct, avg(s) FILTER (WHERE NOT p) AS mean_wrong, var_samp(s) FILTER (WHERE p) AS vc, var_samp(s) FILTER (WHERE NOT p) AS vw FROM t)
 SELECT n_correct, n_wrong, mean_correct, mean_wrong, mean_correct - mean_wrong AS separation, (mean_correct - mean_wrong) / sqrt(((n_correct - 1) * vc + (n_wrong - 1) * vw) / (n_correct + n_wrong - 2)) AS cohens_d FROM g""")


def agg29_bootstrap(spark, d):
    t = _positive(spark, d)
    drawn = D.hashed_draws(spark, t, 200)
    return D.bootstrap(t, drawn, "auc").withColumn("metric", F.lit("auc")).unionByName(D.bootstrap(t, drawn, "separation").withColumn("metric", F.lit("separation")))


def agg30_paired(spark, d):
    a, b = _positive(spark, d, "mean", "weighted"), _positive(spark, d, "last", "none")
    return D.paired(a, b, D.hashed_draws(spark, a, 100))


def agg32_chain_counts(spark, d):
    c = F.col("correct")
    return chains(spark, d).agg(F.count(c).alias("labeled"), F.count_if(c.isNull()).alias("censored"), F.count_if(c).alias("correct"), F.count_if(~c).alias("wrong"))


AGG32 = oracle(" SELECT count(correct) AS labeled, count(*) FILTER (WHERE correct IS NULL) AS censored, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE NOT correct) AS wrong FROM chains")


def jn13_paired_sources(spark, d):
    a = chains(spark, d).where("plan_idx = 0 AND correct IS NOT NULL").select("prob_idx").distinct()
    b = chains(spark, d).where("plan_idx = 1 AND correct IS NOT NULL").select("prob_idx")
    return a.join(b, "prob_idx", "left_semi")


JN13 = oracle(" SELECT DISTINCT prob_idx FROM chains WHERE plan_idx = 0 AND correct IS NOT NULL AND prob_idx IN (SELECT prob_idx FROM chains WHERE plan_idx = 1 AND correct IS NOT NULL)")

QUERIES = {
    "agg14_best_of_n": (agg14_best_of_n, AGG14),
    "agg10_step_aggregates": (agg10_step_aggregates, AGG10),
    "agg11_vote_aggregates": (agg11_vote_aggregates, AGG11),
    "agg13_bounds": (agg13_bounds, AGG13),
    "agg15_diagnosis": (agg15_diagnosis, AGG15),
    "agg16_bon_matrix": (agg16_bon_matrix, AGG16),
    "agg17_auc": (agg17_auc, AGG17),
    "agg18_auc_matrix": (agg18_auc_matrix, AGG18),
    "agg19_plan_auc": (agg19_plan_auc, AGG19),
    "agg20_weighted_vote": (agg20_weighted_vote, AGG20),
    "agg20_vote_grid": (agg20_vote_grid, AGG20G),
    "srt06_best_cell": (srt06_best_cell, SRT06),
    "agg21_majority": (agg21_majority, AGG21),
    "agg22_vote_report": (agg22_vote_report, AGG22),
    "agg23_vote_detail": (agg23_vote_detail, AGG23),
    "agg24_vote_ablation": (agg24_vote_ablation, AGG24),
    "agg25_summary": (agg25_summary, AGG25),
    "agg28_separation": (agg28_separation, AGG28),
    "agg29_bootstrap": (agg29_bootstrap, None),
    "agg30_paired": (agg30_paired, None),
    "agg32_chain_counts": (agg32_chain_counts, AGG32),
    "jn13_paired_sources": (jn13_paired_sources, JN13),
}
