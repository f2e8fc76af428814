"""Batches of a training run: strategies by name, replicas, resuming, collation.

Rows are placed by arithmetic on dense line numbers or by the sizes of dynamic batches, so a
batch is a column (step, micro) and not a loop; orders are hashes of key, seed and epoch.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.datasets import hash_order, numbered
from stepforge.operators.packing import IGNORED, padded, stream_batches


class Info(NamedTuple):
    """Rows of a micro batch, micro batches of a step, longest sample."""

    micro: int
    num_micro: int
    limit: int


class Strategy(NamedTuple):
    """UDF-07, BAT-04: how many rows are asked for at once, how many steps that many rows
    give at about, and in which step and micro batch each row is."""

    provider_rows: Callable[[Info], int]
    steps: Callable[[int, Info], int]
    placed: Callable[[DataFrame, str, Info], DataFrame]


def _fixed(df: DataFrame, length: str, info: Info, position: str = "line_no") -> DataFrame:
    """BAT-01: steps of equally many rows; the unfinished last one is left out."""
    rows = info.micro * info.num_micro
    whole = df.count() // rows * rows
    at = F.col(position)
    return df.where(at < whole).withColumn("step", F.floor(at / rows)).withColumn("micro", F.floor(F.pmod(at, F.lit(rows)) / info.micro))


def _dynamic(padded_tokens: bool):
    def placed(df: DataFrame, length: str, info: Info, position: str = "line_no") -> DataFrame:
        sizes = stream_batches(df, length, info.micro, info.limit, padded_tokens, position)
        # Batches follow each other without gaps: a batch begins where those before end.
        order = numbered(sizes, "batch", "i", to="_no")
        groups = order.groupBy("batch").agg(F.sum("size").alias("rows"))
        before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
        starts = groups.select("batch", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("_from"))
        within = Window.partitionBy("batch").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        spans = order.join(starts, "batch").withColumn("_from", F.col("_from") + F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
        lines = spans.select("_no", F.explode(F.sequence("_from", F.col("_from") + F.col("size") - 1)).alias(position))
        whole = sizes.count() // info.num_micro * info.num_micro
        lines = lines.where(F.col("_no") < whole).select(position, F.floor(F.col("_no") / info.num_micro).alias("step"), F.pmod("_no", F.lit(info.num_micro)).alias("micro"))
        return df.join(lines, position)

    return placed


def _rows(info: Info) -> int:
    return info.micro * info.num_micro


STRATEGIES = {
    "normal": Strategy(_rows, lambda n, info: n // _rows(info), _fixed),
    "padding_free": Strategy(_rows, lambda n, info: n // _rows(info), _fixed),
    "dynamic_batching": Strategy(lambda info: 1, lambda n, info: -(-n // _rows(info)), _dynamic(True)),
    "dynamic_padding_free": Strategy(lambda info: 1, lambda n, info: -(-n // _rows(info)), _dynamic(False)),
}


def info_of(micro: int, replicas: int, limit: int, total: int | None = None, drop_last: bool = True) -> Info:
    """BAT-05: the micro batches of a step on each replica; a global size must divide."""
    if not drop_last:
        raise ValueError("an unfinished last batch is always left out")
    total = replicas * micro if total is None else total
    if total % (replicas * micro):
        raise ValueError(f"{total} rows are no multiple of {replicas} replicas with {micro}")
    return Info(micro, total // replicas // micro, limit)


def replicated(df: DataFrame, key: str, replicas: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """BAT-05: ``df`` in the order of an epoch, dealt out to replicas in turn, as many rows to
    each: replica and line_no on it."""
    n = df.count()
    rows = numbered(df.withColumn("_h", hash_order(key, seed + epoch)), "_h", key, to="_g").drop("_h")
    rows = rows.where(F.col("_g") < n // replicas * replicas)
    return rows.withColumn("replica", F.pmod("_g", F.lit(replicas))).withColumn("line_no", F.floor(F.col("_g") / replicas)).drop("_g")


def resumed(df: DataFrame, key: str, start: int, rows: int, seed: int = 42) -> DataFrame:
    """STR-05: ``rows`` rows of an endless stream from place ``start`` on: epoch after epoch,
    each in an order of its own, so that any place can be gone on from. Adds place, epoch."""
    n = df.count()
    out = None
    # Epochs that the asked rows lie in.
    for epoch in range(start // n, -(-(start + rows) // n)) if n else ():
        t = numbered(df.withColumn("_h", hash_order(key, seed + epoch)), "_h", key, to="place").drop("_h")
        t = t.withColumn("place", F.col("place") + epoch * n).withColumn("epoch", F.lit(epoch))
        out = t if out is None else out.unionByName(t)
    if out is None:
        return df.limit(0).withColumn("place", F.lit(0).cast("long")).withColumn("epoch", F.lit(0))
    return out.where((F.col("place") >= start) & (F.col("place") < start + rows))


def _filled(df: DataFrame, by: list[str], ids: str, labels: str, limit: int) -> DataFrame:
    """BAT-06 within each group: ids, labels and mask as long as the longest, ``limit`` at most."""
    longest = F.least(F.max(F.size(ids)).over(Window.partitionBy(*by)), F.lit(limit))
    t = df.withColumn("_n", longest)
    mask = F.transform(F.col(ids), lambda x: F.lit(1))
    return t.select(*by, "place", padded(F.col(ids), F.col("_n"), 0).alias("input_ids"), padded(mask, F.col("_n"), 0).alias("attention_mask"), padded(F.col(labels), F.col("_n"), IGNORED).alias("labels"))


def pairwise_collated(df: DataFrame, size: int, limit: int, position: str = "line_no") -> DataFrame:
    """BAT-09: batches of ``size`` pairs as rows (batch, place): all chosen, then all rejected."""
    batch, at = F.floor(F.col(position) / size).alias("batch"), F.pmod(position, F.lit(size))
    n = F.count("*").over(Window.partitionBy(F.floor(F.col(position) / size)))
    t = df.select(batch, at.alias("_at"), n.alias("_k"), *(f"{side}_{c}" for side in ("chosen", "rejected") for c in ("input_ids", "labels")))
    sides = [t.select("batch", (F.col("_at") + F.col("_k") * i).alias("place"), F.col(f"{side}_input_ids").alias("ids"), F.col(f"{side}_labels").alias("own")) for i, side in enumerate(("chosen", "rejected"))]
    return _filled(sides[0].unionByName(sides[1]), ["batch"], "ids", "own", limit)


def feedback_collated(df: DataFrame, size: int, limit: int, position: str = "line_no") -> DataFrame:
    """BAT-10: batches of ``size`` rows, target and KL side each filled up for itself."""
    t = df.select(F.floor(F.col(position) / size).alias("batch"), F.pmod(position, F.lit(size)).alias("place"), "input_ids", "labels", "kl_input_ids", "kl_labels", "kto_tags")
    target = _filled(t.withColumnsRenamed({"input_ids": "ids", "labels": "own"}), ["batch"], "ids", "own", limit)
    kl = _filled(t.drop("input_ids", "labels").withColumnsRenamed({"kl_input_ids": "ids", "kl_labels": "own"}), ["batch"], "ids", "own", limit)
    kl = kl.withColumnsRenamed({c: f"kl_{c}" for c in ("input_ids", "attention_mask", "labels")})
    return target.join(kl, ["batch", "place"]).join(t.select("batch", "place", "kto_tags"), ["batch", "place"])


def position_ids(mask: Column) -> Column:
    """BAT-11: places of the tokens that count, from 0; padding is at place 0."""
    before = lambda i: F.aggregate(F.slice(mask, F.lit(1), i), F.lit(0), lambda a, x: a + F.when(x != 0, 1).otherwise(0))
    return F.transform(mask, lambda m, i: F.when(m != 0, before(i)).otherwise(0))
