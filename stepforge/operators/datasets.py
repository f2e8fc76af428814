"""Mixing, splitting and sampling of datasets with reproducible hash orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = 1024


def numbered(df: DataFrame, *order: str, to: str = "line_no") -> DataFrame:
    """Rows numbered from 0 in the order of ``order``, without one task for all rows:
    range-partitioned, counted by partition, numbered within, offset by a broadcast of one
    row for each partition."""
    spark = df.sparkSession
    from stepforge.session import written

    parts = max(1, min(NUMBERS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Written, so that both passes see the same partitions.
    t, _ = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = t.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part").orderBy(*order)
    return t.withColumn("_in", F.row_number().over(here) - 1).join(F.broadcast(offsets), "_part").withColumn(to, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def concatenated(*parts: DataFrame) -> DataFrame:
    """MIX-01, SET-01."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def interleaved(parts: list[DataFrame], sizes: list[int], strategy: str = "under", position: str = "line_no", probabilities: list[float] | None = None, seed: int = 42) -> DataFrame:
    """MIX-02: rows of numbered datasets in turns, ``mix_no`` from 0.

    ``under`` stops once one dataset is exhausted, ``over`` starts exhausted ones again
    until all have been, ``once`` takes every row once. With probabilities the source of
    each turn is drawn by a hash of the turn's number, and the n-th turn of a source has its
    n-th row; without, turns are arithmetic. All sizes must be above 0."""
    if strategy not in ("under", "over", "once"):
        raise ValueError(strategy)
    k = len(parts)
    tagged = [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]
    if probabilities is None:
        limit = min(sizes) if strategy == "under" else max(sizes)
        out = []
        for i, (p, n) in enumerate(zip(tagged, sizes, strict=True)):
            if strategy == "over":
                p = p.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-limit // max(1, n)) - 1))))).withColumn("_turn", F.col(position) + F.col("_round") * n).where(F.col("_turn") < limit).drop("_round")
            else:
                p = p.withColumn("_turn", F.col(position).cast("long")).where(F.col("_turn") < limit)
            out.append(p.withColumn("mix_no", F.col("_turn") * k + i).drop("_turn"))
        return concatenated(*out)
    spark = parts[0].sparkSession
    bounds, total = [], 0.0
    for p in probabilities:
        total += p / sum(probabilities)
        bounds.append(total)
    # Turns enough for the end to lie among them, or more once they turn out too few.
    turns = int(max((n + 10) / p for n, p in zip(sizes, probabilities, strict=True)) * 1.2) + 100
    while True:
        u = hash_number(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))) / float(1 << 32)
        source = F.coalesce(*(F.when(u < b, i) for i, b in enumerate(bounds[:-1])), F.lit(k - 1)) if k > 1 else F.lit(0)
        drawn = spark.range(turns).select(F.col("id").alias("mix_no"), source.alias("_source"))
        t = concatenated(*(numbered(drawn.where(F.col("_source") == i), "mix_no", to="_nth").withColumn("_n", F.lit(n)) for i, n in enumerate(sizes)))
        last = {r["_source"]: r.at for r in t.where("_nth = _n - 1").groupBy("_source").agg(F.min("mix_no").alias("at")).collect()}
        if len(last) == k or strategy == "under" and last:
            break
        turns *= 2
    end = min(last.values()) if strategy == "under" else max(last.values())
    t = t.where(F.col("mix_no") <= end)
    t = t.where("_nth < _n") if strategy != "over" else t
    t = t.withColumn(position, F.pmod("_nth", "_n").cast("long")).select("mix_no", "_source", position)
    out = concatenated(*tagged).join(t, ["_source", position])
    if strategy != "once":
        return out
    # Turns of exhausted sources are no turns.
    return numbered(out.withColumnRenamed("mix_no", "_turn"), "_turn", to="mix_no").drop("_turn")


def hash_number(text: Column) -> Column:
    """A number below 2^32: the first eight hex digits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_order(key: str, seed: int = 42) -> Column:
    """What rows are ordered by at random: the MD5 of key and seed, the same in any engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def split(df: DataFrame, key: str, size: float | int, seed: int = 42) -> DataFrame:
    """SPL-01: ``part`` train or test with an exact test size (a share or a count): the
    rows of least hash. Only keys are ordered; the cut is found among them."""
    n = df.count()
    k = int(size) if size >= 1 else int(n * size)
    cut = df.select(hash_order(key, seed).alias("h"), key).orderBy("h", key).limit(k).select(F.col(key))
    test = cut.withColumn("_t", F.lit(True))
    return df.join(test, key, "left").withColumn("part", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SMP-01: n rows: a permutation, and what is missing drawn with replacement."""
    from stepforge.session import written

    ordered, _ = written(numbered(df.withColumn("_h", hash_order(key, seed)), "_h", key, to="_no").drop("_h"), "ordered")
    total = ordered.count()
    if n <= total or not total:
        return ordered.where(F.col("_no") < n).drop("_no")
    more = df.sparkSession.range(n - total).select(F.pmod(hash_number(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), F.lit(total)).alias("_no"))
    return ordered.drop("_no").unionByName(ordered.join(more, "_no").drop("_no"))


def sized(df: DataFrame, size: int | None = None, weight: float | None = None, position: str = "line_no", seed: int = 42) -> DataFrame:
    """SMP-02: ``size`` rows drawn with replacement, then ``weight`` times as many of these;
    ``draw`` numbers them. Each draw is a hash, so draws are made where they are used."""
    n = df.count()
    if (size is None and weight is None) or not n:
        return df.withColumn("draw", F.col(position))
    total = n if size is None else size
    draws = total if weight is None else int(total * weight)
    t = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.col("id").alias(position))
    number = lambda salt, c: hash_number(F.concat(c.cast("string"), F.lit(f":{salt}:{seed}")))
    if weight is not None:
        t = t.withColumn(position, F.pmod(number("weight", F.col(position)), F.lit(total)))
    if size is not None:
        t = t.withColumn(position, F.pmod(number("size", F.col(position)), F.lit(n)))
    return t.join(df, position)


def buffered(df: DataFrame, key: str, buffer: int = 16_384, position: str = "line_no", seed: int = 42) -> DataFrame:
    """SMP-05: rows in hash order within each ``buffer`` lines, ``shuffled_no`` from 0: no row
    goes further than a buffer, as in a stream."""
    group = F.floor(F.col(position) / buffer)
    here = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return df.withColumn("shuffled_no", group * buffer + F.row_number().over(here) - 1)


def taken(df: DataFrame, n: int, position: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """SPL-02, SRT-07, SRT-08: the first n rows for validation, the others for training."""
    return df.where(F.col(position) < n), df.where(F.col(position) >= n)


def prepared(train: DataFrame | None, evaluation: DataFrame | dict[str, DataFrame] | None = None, size: float = 0, key: str = "line_no", streaming: bool = False, seed: int = 42) -> dict[str, DataFrame]:
    """SPL-03, SET-10: named parts: train, and validation or a ``validation_`` part for each
    named set; a share can be split off only where no evaluation set is given."""
    if evaluation is not None and size > 1e-6:
        raise ValueError("either a validation set or a share to split off")
    out: dict[str, DataFrame] = {}
    if train is not None and size > 1e-6:
        if streaming:
            out["validation"], out["train"] = taken(train, int(size), key)
        else:
            parts = split(train, key, size, seed)
            out = {"train": parts.where("part = 'train'").drop("part"), "validation": parts.where("part = 'test'").drop("part")}
    elif train is not None:
        out["train"] = train
    if isinstance(evaluation, dict):
        out |= {f"validation_{name}": t for name, t in evaluation.items()}
    elif evaluation is not None:
        out["validation"] = evaluation
    return out


def few_shot(targets: DataFrame, pool: DataFrame, target: str, item: str, k: int = 3, seed: int = 42) -> DataFrame:
    """JN-15: k different items of the pool for each target, ``shot`` from 1: the j-th is the
    r-th item that the target has not got, r a hash below what is left. Targets meet only the
    items they draw, so the pool may be of any size."""
    numbers = numbered(pool.select(item), item, to="_no")
    n = numbers.count()

    def draw(got: Column, j: Column) -> Column:
        r = F.pmod(hash_number(F.concat(F.col(target).cast("string"), F.lit(":"), j.cast("string"), F.lit(f":{seed}"))), F.lit(n) - j)
        place = F.aggregate(F.array_sort(got), r, lambda x, p: F.when(x >= p, x + 1).otherwise(x))
        return F.concat(got, F.array(place))

    places = F.aggregate(F.sequence(F.lit(0), F.lit(min(k, n) - 1)), F.array().cast("array<bigint>"), draw) if n else F.array().cast("array<bigint>")
    t = targets.select(target).distinct().select(target, F.posexplode(places).alias("shot", "_no"))
    return t.join(numbers, "_no").select(target, item, (F.col("shot") + 1).alias("shot"))


def previous_in_batch(df: DataFrame, value: str, position: str = "line_no", batch: int = 1000, to: str = "kl") -> DataFrame:
    """JN-16, WIN-10: the value of the row before in the batch, of its last for the first."""
    by = Window.partitionBy(F.floor(F.col(position) / batch)).orderBy(position)
    last = F.last(value).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(to, F.when(F.row_number().over(by) == 1, last).otherwise(F.lag(value).over(by)))
