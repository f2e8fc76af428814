"""Assembly of supervised rows: joins of labels, scores, prompts, oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions import scores as S

#: Fixed texts of the scoring instruction, by score and number of classes.
_HEAD = (
    "You are given a PLAN (a multi-stage solution strategy) and an EXECUTION "
    "HISTORY ending in a CURRENT STEP. Output exactly two scores and nothing else:\n"
)
_PLAN = {
    3: "plan_score: how reliable is the PLAN itself (independent of how well any single execution carries it out)? Use exactly one of: 0.0 (this plan rarely leads to a correct answer, or frequently fails to even produce a complete result), 0.5 (mixed or inconsistent results across attempts), or 1.0 (this plan reliably leads to a correct answer).",
    2: "plan_score: how reliable is the PLAN itself (independent of how well any single execution carries it out)? Use exactly one of: 0.0 (this plan rarely leads to a correct answer, or frequently fails to even produce a complete result) or 1.0 (this plan reliably leads to a correct answer).",
}
_STEP = {
    3: "step_score: is the CURRENT STEP itself correct and trustworthy? Use exactly one of: 0.0 (no — wrong, deviates from the plan, or does no real work), 0.5 (cannot be independently determined), or 1.0 (yes — well-supported).",
    2: "step_score: is the CURRENT STEP itself correct and trustworthy? Use exactly one of: 0.0 (no — wrong, deviates from the plan, or does no real work) or 1.0 (yes — well-supported).",
}
_TAIL = "\nOutput ONLY the following two tags, in this exact order, with no other text:\n<plan_score>X.X</plan_score>\n<step_score>X.X</step_score>"
#: FN-26: instruction of each label scheme.
INSTRUCTIONS = {name: f"{_HEAD}{_PLAN[p]}\n{_STEP[s]}{_TAIL}" for name, (p, s) in {"v6": (3, 3), "step01": (3, 2), "full01": (2, 2)}.items()}


def last_of(df: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Of rows with equal keys the last in file order, as a dictionary would keep it."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def labelled(steps: DataFrame, labels: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """JN-01, JN-02: steps with adherence and provenance; unknown and unverified without."""
    t = steps.join(labels, keys, "left").join(checks, keys, "left")
    return t.withColumn("adherence", S.normal_adherence(F.col("adherence"), F.col("b2"))).withColumn("provenance", F.coalesce("provenance", F.lit("unverified"))).drop("b2")


def kept(df: DataFrame, keep_uncertain: bool = False, drop_suspect: bool = False, keep_unknown_plan: bool = False) -> DataFrame:
    """FLT-01..03: filters over adherence, provenance and plan score."""
    if not keep_uncertain:
        df = df.where(~F.col("adherence").isin("uncertain", "unknown"))
    if drop_suspect:
        df = df.where("provenance <> 'suspect'")
    return df.withColumn("plan_score", F.coalesce("plan_score", F.lit(0.5))) if keep_unknown_plan else df.where("plan_score IS NOT NULL")


def oversampled(df: DataFrame, score: str = "step_label", times: int = 2) -> DataFrame:
    """SMP-03, SET-02: rows of score 0 come ``times`` times, with ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col(score) == 0, F.lit(times - 1)).otherwise(0))))


def shuffled(df: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """SMP-04: a global order that depends on seed and key alone."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def history(steps: Column, at: Column) -> Column:
    """WIN-01: the steps before position ``at`` (from 0)."""
    return F.slice(steps, F.lit(1), at)


def _block(s) -> Column:
    return F.concat(F.lit("code:\n"), s.code, F.lit("\noutput:\n"), s.exec, F.lit("\n"))


def rendered_input(problem: Column, plan: Column, before: Column, step: Column) -> Column:
    """FN-25: the prompt of a step: problem, plan, history and the step itself."""
    stages = F.array_join(F.transform(plan, lambda p: F.concat(F.lit("  "), p.id, F.lit(" ("), F.coalesce(p.action, F.lit("?")), F.lit("): "), p.desc)), "\n")
    past = F.array_join(F.transform(before, lambda s, j: F.concat(F.lit("\n[Step "), (j + 1).cast("string"), F.lit("] claims "), s.claimed, F.lit("\n"), _block(s))), "")
    return F.concat(
        F.lit("Problem:\n"), problem, F.lit("\n\n=== PLAN ===\n"), stages, F.lit("\n\n=== EXECUTION HISTORY ===\n"), F.when(past == "", "(none)").otherwise(past),
        F.lit("\n=== CURRENT STEP ===\nclaims "), step.claimed, F.lit("\n"), _block(step), F.lit("\nOutput plan_score and step_score for the above."),
    )


def rendered_output(plan_score: Column, step_score: Column) -> Column:
    """FN-27: both scores in their tags, with one decimal."""
    return F.format_string("<plan_score>%.1f</plan_score>\n<step_score>%.1f</step_score>", plan_score, step_score)


def chain_text(steps: Column, separator: str = "\n\n") -> Column:
    """FN-28: a chain for an outside scorer."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("["), s.claimed, F.lit("] "), s.code, F.lit("\n"), s.exec)), separator)


def plan_quality(chains: DataFrame) -> DataFrame:
    """AGG-02: share correct among decided chains and share censored, by plan."""
    c = F.col("correct")
    return chains.groupBy("prob_idx", "plan_idx").agg(F.try_divide(F.count_if(c), F.count(c)).alias("quality"), (F.count_if(c.isNull()) / F.count("*")).alias("truncated"), F.count("*").alias("n"))


def diagnosis(quality: DataFrame) -> DataFrame:
    """AGG-03: a problem's tag from the qualities of its plans."""
    q = F.col("quality")
    t = quality.groupBy("prob_idx").agg(F.count("*").alias("plans"), F.count(q).alias("decided"), F.max(q).alias("best"), F.min(q).alias("worst"))
    tag = F.when(F.col("decided") == 0, "all-censored").when(F.col("best") == 0, "all-failed").when((F.col("plans") > 1) & (F.col("best") - F.col("worst") >= 0.5), "plan-split").otherwise("ok")
    return t.select("prob_idx", "plans", "best", "worst", tag.alias("tag"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """AGG-06, AGG-33: counts of a label and their share of all."""
    t = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("total"))
    return t.crossJoin(total).select("label", "n", (F.col("n") / F.col("total")).alias("share"))  # one row
