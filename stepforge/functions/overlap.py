"""Overlap metrics of predicted and reference texts: BLEU-4 and ROUGE."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grams(xs: list, n: int) -> Counter:
    return Counter(tuple(xs[i : i + n]) for i in range(len(xs) - n + 1))


def bleu4(pred: str, gold: str) -> float:
    """Character BLEU-4; orders without a match are smoothed by halving (method 3)."""
    logs, halved = 0.0, 1
    if not pred or not gold:
        return 0.0
    for n in range(1, 5):
        have, want = grams(list(pred), n), grams(list(gold), n)
        hits, total = sum((have & want).values()), max(1, sum(have.values()))
        if n == 1 and not hits:
            return 0.0
        if not hits:
            halved *= 2
        logs += math.log(hits / total if hits else 1 / (halved * total)) / 4
    return math.exp(logs + min(0.0, 1 - len(gold) / len(pred)))


def _f(hits: int, have: int, want: int) -> float:
    return 2 * hits / (have + want) if hits else 0.0


def longest_common(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge(pred: list[str], gold: list[str]) -> dict[str, float]:
    """F-measures of ROUGE-1, ROUGE-2 and ROUGE-L over words."""
    out = {}
    for n in (1, 2):
        have, want = set(grams(pred, n)), set(grams(gold, n))
        out[f"rouge-{n}"] = _f(len(have & want), len(have), len(want))
    return out | {"rouge-l": _f(longest_common(pred, gold), len(pred), len(gold))}


def metrics_udf(segment: Callable[[str], list[str]] = str.split):
    """UDF-12: struct of four metrics in percent; the word segmenter is injected."""
    names = ("bleu-4", "rouge-1", "rouge-2", "rouge-l")

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def score(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
        rows = [{"bleu-4": bleu4(p, g)} | rouge(segment(p), segment(g)) for p, g in zip(pred.fillna(""), gold.fillna(""), strict=True)]
        return pd.DataFrame([{n: round(r[n] * 100, 4) for n in names} for r in rows], columns=list(names))

    return score


def averaged(df, pred: str, gold: str, segment: Callable[[str], list[str]] = str.split):
    """AGG-36: the average of each metric over all rows."""
    scores = df.select(metrics_udf(segment)(pred, gold).alias("m"))
    return scores.agg(*(F.avg(f"m.`{n}`").alias(n.replace("-", "_")) for n in ("bleu-4", "rouge-1", "rouge-2", "rouge-l")))
