"""The deterministic lens from the star-schema fixtures to chains, steps and chats.

The same SQL text serves Spark and the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHAINS = """
SELECT o_custkey AS prob_idx, o_orderkey AS chain_id, o_orderkey % 2 AS plan_idx,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS tpos,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS answer,
       CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS correct,
       (o_orderkey % 3) / CAST(2.0 AS DOUBLE) AS plan_score
FROM {orders}
"""
STEPS = """
SELECT l_orderkey AS chain_id,
       row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS step,
       CAST(CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN NULL
                 WHEN l_discount < 0.03 THEN 0.0 WHEN l_discount < 0.07 THEN 0.5
                 ELSE 1.0 END AS DOUBLE) AS step_score,
       CASE l_returnflag WHEN 'A' THEN 'corroborated' WHEN 'R' THEN 'suspect'
            ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'outcome_consistent' ELSE 'unverified' END END AS provenance,
       CASE WHEN l_linestatus = 'F' THEN 'faithful'
            WHEN l_linenumber % 4 = 0 THEN 'uncertain:display_only'
            WHEN l_linenumber % 4 = 1 THEN 'deviated'
            WHEN l_linenumber % 4 = 2 THEN 'self_declared_deviation' ELSE 'faithful' END AS adherence,
       concat('P', CAST(l_linenumber AS VARCHAR(8))) AS claimed,
       l_quantity AS quantity
FROM {lineitem}
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHAINS, orders=read(spark, sf_dir, "orders"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STEPS, lineitem=read(spark, sf_dir, "lineitem"))


def oracle(body: str) -> str:
    """SQL with the lens views before it."""
    return f"WITH chains AS ({CHAINS.format(orders='orders')}), steps AS ({STEPS.format(lineitem='lineitem')}) {body}"


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with a plan and nested steps. Odd steps of three use the step before, every
    third stands alone; every fourth prints nothing."""
    from pyspark.sql import functions as F

    raw = F.array_sort(F.collect_list(F.struct("step", "claimed", "adherence", "quantity")))
    text = lambda c: c.cast("string")

    def step(s):
        code = F.when(s.step % 3 == 2, F.concat(F.lit("u"), text(s.step), F.lit(" = 1"))).otherwise(F.concat(F.lit("v"), text(s.step), F.lit(" = v"), text(s.step - 1)))
        out = F.when(s.step % 4 == 3, "[no output]").otherwise(F.concat(F.lit("v = "), text(F.floor(s.quantity).cast("int") % 7)))
        return F.struct(s.claimed.alias("claimed"), (s.adherence == "self_declared_deviation").alias("is_deviation"), code.alias("code"), code.alias("raw"), F.lit(True).alias("wrapped"), out.alias("exec"))

    t = steps(spark, sf_dir).groupBy("chain_id").agg(F.transform(raw, step).alias("steps"))
    plan = F.array(*(F.struct(F.lit(f"P{i}").alias("id"), F.lit(f"stage {i}").alias("desc"), F.lit("COMPUTE").alias("action")) for i in range(1, 4)))
    c = chains(spark, sf_dir).select("chain_id", F.col("prob_idx").cast("int"), F.col("plan_idx").cast("int"), F.col("tpos").cast("int").alias("exec_idx"), (F.col("chain_id") % 7).cast("string").alias("answer"), "correct")
    return c.join(t, "chain_id").select("prob_idx", "plan_idx", "exec_idx", plan.alias("plan"), "steps", "answer", F.lit(0).alias("fmt_bad"), "correct", F.lit(None).cast("double").alias("plan_quality"), F.lit(None).cast("double").alias("plan_trunc_rate"))
