"""Quality rules: learned decision lists over document statistics.

Statistics are SQL expressions over whole texts. Rules are learned by sequential covering:
a conjunction of thresholds is grown on one part of the labelled rows by FOIL gain, pruned
on the other part, and kept while it is precise; the rows it covers are set aside and the
next rule is grown. All counting is done by Spark over all labelled rows, in quantile bins,
so the driver sees a few hundred counts at a time. The list becomes one ordered
conditional expression.

A window is told by its position and what a 64-bit hash leaves beside it; neighbours in
sorted order are compared word by word, so that a repeated window is never a mere collision.
Where different windows share a hash, which could stand between equal ones, the windows of
that text are sorted by their words instead, so none is missed either.

Defined results: null and empty texts have no words and fail the base; very long texts are
read whole; rows that repeat an id are judged each by their own text; without labelled
rows, or with none of one class, no rule is learned and only the base rejects; labels
without document and null labels are ignored; other columns are kept by ``accepted``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import dropped, table, written

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
#: Fixed limits of the base.
MIN_WORDS, REPEAT_PERCENT = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_word_share", "distinct_word_share", "upper_share", "digit_share", "words_per_line", "n_words")
BINS, MAX_RULES, MAX_CONDITIONS = 32, 6, 3
#: Least precision of a rule on either part; least rows a rule rejects, as a share of the bad.
PRECISION, SUPPORT = 0.95, 0.02


def _share(a, b) -> Column:
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and, for every whole text, the base statistics and learned-rule features."""
    t = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # Each step names what the next uses more than once, so that nothing is computed twice.
    t = t.withColumn("_w", F.regexp_extract_all("_t", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    t = t.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    t = t.withColumn("n_words", F.size("_w").cast("long")).withColumn("_bits", F.length(F.bin(F.size("_w"))))
    window = "transform(sequence(1, size(_w) - 2), i -> shiftleft(shiftright(xxhash64(element_at(_w, i), element_at(_w, i + 1), element_at(_w, i + 2)), _bits), _bits) | CAST(i AS BIGINT))"
    t = t.withColumn("_k", F.expr(f"sort_array(CASE WHEN size(_w) > 2 THEN {window} ELSE CAST(array() AS ARRAY<BIGINT>) END)"))
    place = lambda i: f"CAST(element_at(_k, {i}) & (shiftleft(1L, _bits) - 1) AS INT)"
    same = lambda i, j: "(shiftright(element_at(_k, {i}), _bits) = shiftright(element_at(_k, {j}), _bits) AND {words})".format(i=i, j=j, words=" AND ".join(f"element_at(_w, {place(i)} + {d}) = element_at(_w, {place(j)} + {d})" for d in range(3)))
    t = t.withColumn("_dup", F.expr(f"CASE WHEN size(_k) > 1 THEN filter(sequence(1, size(_k)), i -> (i > 1 AND {same('i', 'i - 1')}) OR (i < size(_k) AND {same('i', 'i + 1')})) ELSE CAST(array() AS ARRAY<INT>) END"))
    # Different windows with one hash may hide equal ones from each other.
    hidden = "exists(sequence(2, size(_k)), i -> shiftright(element_at(_k, i), _bits) = shiftright(element_at(_k, i - 1), _bits) AND NOT {same})".format(same=same("i", "i - 1"))
    t = t.withColumn("_clash", F.expr(f"size(_k) > 2 AND size(_dup) < size(_k) AND {hidden}"))
    whole = "sort_array(transform(sequence(1, size(_w) - 2), i -> named_struct('g', concat_ws(' ', element_at(_w, i), element_at(_w, i + 1), element_at(_w, i + 2)), 'p', i)))"
    t = t.withColumn("_g", F.expr(f"CASE WHEN _clash THEN {whole} END"))
    again = "filter(_g, (x, i) -> get(_g, i - 1).g <=> x.g OR get(_g, i + 1).g <=> x.g)"
    t = t.withColumn("_at", F.expr(f"CASE WHEN _clash THEN sort_array(transform({again}, x -> x.p)) ELSE sort_array(transform(_dup, i -> {place('i')})) END"))
    # A repeated window covers its three words, less those that the next one covers.
    covered = "aggregate(sequence(1, size(_at)), 0, (a, i) -> a + CASE WHEN i < size(_at) THEN least(3, element_at(_at, least(i + 1, size(_at))) - element_at(_at, i)) ELSE 3 END)"
    without = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    t = t.select(
        *keep,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CAST(CASE WHEN size(_at) > 0 THEN {covered} ELSE 0 END AS BIGINT)").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_w")).alias("_n_distinct"),
        without("[A-Z]+").alias("_n_upper"),
        without("[0-9]+").alias("_n_digit"),
    )
    return t.select(
        *keep,
        *BASE,
        _share("word_chars", "n_words").alias("chars_per_word"),
        _share("n_symbols", "n_words").alias("symbols_per_word"),
        _share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        _share("n_repeat_words", "n_words").alias("repeat_word_share"),
        _share("_n_distinct", "n_words").alias("distinct_word_share"),
        _share("_n_upper", "word_chars").alias("upper_share"),
        _share("_n_digit", "word_chars").alias("digit_share"),
        _share("n_words", "_n_lines").alias("words_per_line"),
    )


def base_failed() -> Column:
    return F.coalesce((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")), F.lit(True))


class Rule:
    """A conjunction of (feature, whether greater, bin, threshold)."""

    def __init__(self, conditions: tuple):
        self.conditions = conditions

    def binned(self) -> Column:
        out = F.lit(True)
        for f, greater, k, _ in self.conditions:
            out = out & ((F.col(f) > k) if greater else (F.col(f) <= k))
        return out

    def column(self) -> Column:
        """The rule over the features themselves."""
        out = F.lit(True)
        for f, greater, _, threshold in self.conditions:
            out = out & ((F.col(f) > threshold) if greater else (F.col(f) <= threshold))
        return out

    def __repr__(self) -> str:
        return " AND ".join(f"{f} {'>' if greater else '<='} {x:.6g}" for f, greater, _, x in self.conditions)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL gain of going from (p0, n0) to (p, n) covered rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bin(feature: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x < F.col(feature)))


def learned(labelled: DataFrame, bad: str = "bad", features: tuple[str, ...] = FEATURES) -> list[Rule]:
    """The decision list of ``labelled``: its features, boolean ``bad`` and ``prune``."""
    cuts = labelled.select(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in features)).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in features}
    if not any(cuts.values()):
        return []
    # In bin k are the values with k thresholds below.
    bins = labelled.select(bad, "prune", *(_bin(f, cuts[f]).alias(f) for f in features))
    rows, path = written(bins.groupBy(*bins.columns).count().withColumnRenamed("count", "w"), "labelled")
    rules: list[Rule] = []
    left = F.lit(True)
    total_bad = rows.where(bad).agg(F.sum("w")).first()[0] or 0
    while len(rules) < MAX_RULES:
        rule = Rule(())
        while len(rule.conditions) < MAX_CONDITIONS:
            pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features))).alias("x")
            counted = rows.where(left & ~F.col("prune") & rule.binned()).select(bad, "w", pairs).groupBy("x.f", "x.b").agg(F.sum(F.when(F.col(bad), F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col(bad), 0).otherwise(F.col("w"))).alias("n"))
            by: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
            for r in counted.collect():  # features times bins rows at most
                by[r.f][r.b] = (r.p, r.n)
            p0, n0 = (sum(v[i] for v in by[features[0]].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in features:
                for k in range(len(cuts[f])):
                    p, n = (sum(v[i] for b, v in by[f].items() if b <= k) for i in (0, 1))
                    for greater, cp, cn in ((False, p, n), (True, p0 - p, n0 - n)):
                        g = _gain(cp, cn, p0, n0)
                        if g > best[0] + 1e-9:
                            best = (g, (f, greater, k, cuts[f][k]))
            if best[1] is None:
                break
            rule = Rule((*rule.conditions, best[1]))
        if not rule.conditions:
            break
        prefixes = [Rule(rule.conditions[: i + 1]) for i in range(len(rule.conditions))]
        sums = [F.sum(F.when(cond & r.binned() & part, F.col("w")).otherwise(0)) for r in prefixes for part in (F.col("prune"), ~F.col("prune")) for cond in (F.col(bad), ~F.col(bad))]
        found = [x or 0 for x in rows.where(left).agg(*sums).first()]
        worth = []
        for i, r in enumerate(prefixes):
            p, n, gp, gn = found[4 * i : 4 * i + 4]
            worth.append(((p - n) / (p + n) if p + n else -1.0, -i, p, n, gp, gn, r))
        _, _, p, n, gp, gn, rule = max(worth, key=lambda x: x[:2])
        if p < PRECISION * (p + n) or gp < PRECISION * (gp + gn) or p + gp < max(3, SUPPORT * total_bad):
            break
        rules.append(rule)
        left = left & ~rule.binned()
    dropped(rows.sparkSession, path)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects."""
    out = F.when(base_failed(), False)
    for r in rules:
        out = out.when(r.column(), False)
    return out.otherwise(True)


def fitted(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> list[Rule]:
    """Rules learned from all labelled rows of ``stats`` that pass the base."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(key).agg(F.max("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(known, key)
    return learned(rows.select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("prune"), *(F.col(f).cast("double").alias(f) for f in FEATURES)))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base and the learned rules keep, columns unchanged."""
    stats, path = written(statistics(docs.join(labels.select(key).distinct(), key, "left_semi"), text, (key,)), "label-stats")
    rules = fitted(stats, labels, key)
    dropped(docs.sparkSession, path)
    own = [f"_own{i}" for i in range(len(docs.columns))]
    judged = statistics(docs.toDF(*own), own[docs.columns.index(text)], tuple(own))
    # Indeterminate in name only: else the filter would be pushed below the statistics and
    # their expressions copied into it, over and over.
    sure = F.monotonically_increasing_id() >= 0
    return judged.withColumn("_ok", verdict(rules) & sure).where("_ok").select(*own).toDF(*docs.columns)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics, base verdict and learned verdict of every whole document."""
    stats, _ = written(statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = fitted(stats, table(spark, sf_dir, "labels"))
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(rules).alias("kept"))
