"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are cut into quantile bins; trees are grown on gradient
histograms, level by level, for the logistic loss. The forest is flattened into arrays of
features, thresholds and children, in which leaves lead to themselves, so that a batch of
documents walks all trees at once in numpy.

The model is fitted on the driver on at most ``SAMPLE_ROWS`` labelled rows, those of least
hash of their id, so the choice depends neither on order nor on partitions. Labels are
learned from only where ``crc32(id as text) mod 3`` is not 1; labels, language, source and
id are no inputs of a score.

Defined results: null and empty texts are scored from their (zero) statistics; very long
texts are read whole; repeated rows have equal scores; a null id isn't held out and not
learned from; labels that are null, not 0 or 1, or without document are ignored; without
two classes the score is the share of label 1, or 0.5 without labels; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import extended, mapped, table, texts

#: Labelled rows that are learned from, at most: bounds the driver's memory.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, L2 = 80, 4, 0.15, 64, 20, 1.0
FEATURES = ("chars", "words", "chars_per_word", "upper", "digit", "symbol", "bang", "punctuation", "beyond_ascii", "space", "distinct_words", "short_words", "lines", "repeated_lines", "longest_line")

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "bang": b"!?",
    "punctuation": b".,;:'\"-()",
    "beyond_ascii": range(128, 256),
    "space": (32, *range(9, 14)),
}


def statistics(rows: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = np.zeros((len(rows), len(FEATURES)))
    member = np.zeros((256, len(_CLASSES)))
    for j, codes in enumerate(_CLASSES.values()):
        member[list(codes), j] = 1
    for i, text in enumerate(rows):
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        n, w = max(1, len(data)), max(1, len(words))
        share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ member / n
        out[i] = (np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / w, *share, len(set(words)) / w, sum(len(x) < 4 for x in words) / w, len(lines) / w, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, lines), default=0)))
    return out


class Forest:
    """Flattened trees: a row below a threshold goes left, leaves lead to themselves."""

    def __init__(self, start: float):
        self.start, self.depth = start, 0
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = ([] for _ in range(6))

    def leaf(self, value: float) -> int:
        k = len(self.feature)
        for a, x in ((self.feature, 0), (self.threshold, 0.0), (self.left, k), (self.right, k), (self.value, value)):
            a.append(x)
        return k

    def flat(self) -> Forest:
        for name, kind in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float), ("roots", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if len(self.roots):
            node = np.repeat(self.roots[None, :], len(x), 0)
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node].sum(1)
        return 1 / (1 + np.exp(-total))


def fitted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for labels 0 and 1."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Forest(float(np.log(share / (1 - share)))).flat()
    start = float(np.log(y.mean() / (1 - y.mean())))
    forest = Forest(start)
    forest.depth = depth
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    offsets = np.arange(x.shape[1]) * BINS
    score = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        where = np.zeros(len(y), np.int64)  # the node of each row in this level
        level = {0: forest.leaf(0.0)}
        forest.roots.append(level[0])
        for _ in range(depth):
            size = (max(level) + 1) * x.shape[1] * BINS
            cell = ((where[:, None] * x.shape[1] * BINS) + offsets + bins)[where >= 0]
            live = where >= 0
            repeat = lambda v: np.repeat(v[live], x.shape[1])
            hist = [np.bincount(cell.ravel(), repeat(v), size).reshape(-1, x.shape[1], BINS).cumsum(2) for v in (g, h, np.ones(len(y)))]
            after, following = np.full(len(y), -1), {}
            for slot, node in level.items():
                gl, hl, nl = (v[slot] for v in hist)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
                for f, c in enumerate(cuts):
                    gain[f, len(c) :] = 0
                f, b = divmod(int(gain.argmax()), BINS)
                if gain[f, b] <= 1e-9:
                    continue
                forest.feature[node], forest.threshold[node] = f, float(cuts[f][b])
                sides = []
                for gs, hs in ((gl[f, b], hl[f, b]), (gt[f, 0] - gl[f, b], ht[f, 0] - hl[f, b])):
                    sides.append(forest.leaf(float(-rate * gs / (hs + L2))))
                forest.left[node], forest.right[node] = sides
                inside = where == slot
                for k, side in enumerate(sides):
                    following[2 * slot + k] = side
                    after[inside & ((bins[:, f] <= b) == (k == 0))] = 2 * slot + k
            if not following:
                break
            # Slots are numbered anew, so that histograms stay small.
            order = {slot: i for i, slot in enumerate(following)}
            renumber = np.full(max(following) + 2, -1)
            renumber[list(order)] = list(order.values())
            where, level = renumber[after], {order[s]: n for s, n in following.items()}
        node = np.full(len(y), forest.roots[-1])
        feature, threshold, left, right, value = (np.array(a) for a in (forest.feature, forest.threshold, forest.left, forest.right, forest.value))
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), feature[node]] <= threshold[node], left[node], right[node])
        score += value[node]
    return forest.flat()


def held_out(key: Column) -> Column:
    """Whether labels of an id are kept from learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """The forest learned from labelled rows that aren't held out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    known = known.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).distinct()
    known = known.orderBy(F.xxhash64("k", F.lit(11)), "k", "y").limit(sample_rows)
    # Broadcast: sample_rows rows of 12 bytes at most.
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k").select("k", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(texts(b.column(2)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["k", "y", "x"])

    # Of rows that repeat an id the least: as many rows as labels come to the driver.
    found = mapped(rows, run, "k long, y int, x array<double>").groupBy("k", "y").agg(F.min("x").alias("x")).toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(found) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, found.column("y").to_numpy())) if len(found) else []
    return fitted(x[order], found.column("y").to_numpy()[order].astype(float))


def scored(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every whole text."""
    schema = extended(docs.select(key, held_out(F.col(key)).alias("held_out")), "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.scores(statistics(texts(b.column(2))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return mapped(docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).alias("text")), run, schema)


def op8_quality_model(spark, sf_dir: str) -> DataFrame:
    """Quality scores of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, model(docs, table(spark, sf_dir, "labels")))
