"""Mixing sources to target weights by Pfair scheduling.

Time is a sequence of slots, one block of rows each. With ``s`` of the ``frame`` slots of a
frame to its name, a source's k-th block is released at ``floor(k * frame / s)`` and due at
``ceil((k + 1) * frame / s)``; in every slot the released block with the earliest deadline
goes. As the shares add up to the frame, every block goes within its window, so at any slot
a source is less than one block away from its exact share. The schedule of a frame repeats.

A source's rows are numbered without sorting them in one task: rows are dealt out by source
and hash bucket of their id, numbered there, and offset by the counts of the buckets before;
buckets multiply with the rows, from ``BUCKETS`` on, so that none grows with the data.
Every row comes exactly once. When a source has run out, its slots are skipped and the
others go on in their own proportions; ``held_rows`` tells how many leading rows of the mix
hold the target weights.

All on SQL expressions; what is broadcast is bounded by ``frame`` and, while that is under
``BROADCAST`` rows, by sources times buckets.

Defined results: null sources and sources without a weight are one source, ``other``;
null ids are numbered first in their bucket; rows that repeat an id are ordered by the hash
of the whole row, equal rows anyhow; columns of any type, maps as well, are carried; texts
are carried, not read; an empty table gives no rows; other columns are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.llm.common import table

OTHER = "other"
#: Target weights of the query and of the pipeline: the hot source is held to a tenth.
WEIGHTS = {"src0": 0.10} | {f"src{i}": 0.045 for i in range(1, 20)} | {OTHER: 0.045}
FRAME, BLOCK_ROWS, BUCKETS = 1000, 16, 1024
#: Rows of a bucket, of all sources, beyond which there are more buckets.
BUCKET_ROWS, BROADCAST = 100_000, 100_000


def shares(weights: dict[str, float], frame: int = FRAME) -> dict[str, int]:
    """Whole slots of a frame for each source, by largest remainders, one at least."""
    if not weights or any(not w > 0 for w in weights.values()) or len(weights) > frame:
        raise ValueError("weights must be positive, and no more than slots of a frame")
    total = sum(weights.values())
    exact = {s: w * frame / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    k = 0
    while (rest := frame - sum(out.values())) != 0:
        s = order[k % len(order)] if rest > 0 else max(out, key=lambda s: (out[s], s))
        out[s] += 1 if rest > 0 else -1
        k += 1
    return out


def schedule(spark, slots: dict[str, int]) -> DataFrame:
    """(_source, _k, _slot, _share, _release, _deadline) of a frame, by earliest deadline."""
    frame, names = sum(slots.values()), list(slots)
    share = "array(" + ", ".join(str(slots[s]) for s in names) + ")"
    due = f"transform(st.counts, (c, i) -> named_struct('due', ((c + 1) * {frame} + {share}[i] - 1) div {share}[i], 'i', i, 'out', c * {frame} div {share}[i]))"
    pick = f"array_min(filter({due}, x -> x.out <= t)).i"
    step = f"transform(array({pick}), p -> named_struct('counts', transform(st.counts, (c, i) -> IF(i = p, c + 1, c)), 'order', concat(st.order, array(p))))[0]"
    fold = f"aggregate(sequence(0, {frame - 1}), named_struct('counts', array_repeat(0, {len(names)}), 'order', CAST(array() AS ARRAY<INT>)), (st, t) -> {step}).order"
    rows = spark.range(1).select(F.posexplode(F.expr(fold)).alias("_slot", "_i"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_i").orderBy("_slot")) - 1)
    named = F.element_at(F.array(*map(F.lit, names)), F.col("_i") + 1)
    of = F.expr(f"{share}[_i]")
    return rows.select(
        named.alias("_source"), F.col("_k").cast("long"), F.col("_slot").cast("long"), of.cast("long").alias("_share"),
        F.expr(f"_k * {frame} div {share}[_i]").alias("_release"), F.expr(f"((_k + 1) * {frame} + {share}[_i] - 1) div {share}[_i]").alias("_deadline"),
    )


def mixed(df: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", frame: int = FRAME, block_rows: int = BLOCK_ROWS, buckets: int | None = None) -> DataFrame:
    """``df`` and mix_block (of its source), mix_slot, mix_offset, mix_release and
    mix_deadline; the mix is the order by mix_slot, mix_offset."""
    weights = {OTHER: min((weights or WEIGHTS).values())} | (weights or WEIGHTS)
    slots = shares(weights, frame)
    while buckets is None or buckets < 1:
        buckets = max(BUCKETS, 1 << (df.count() // BUCKET_ROWS).bit_length())
    own = [f"_own{i}" for i in range(len(df.columns))]
    key, source = (own[df.columns.index(c)] for c in (key, source))
    known = [s for s in slots if s != OTHER]
    rows = df.toDF(*own).withColumn("_source", F.when(F.col(source).isin(known), F.col(source)).otherwise(OTHER) if known else F.lit(OTHER))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    rows = rows.withColumn("_bucket", bucket)
    # A row for each source and bucket at most.
    counts = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    # Maps have no hash of their own.
    hashed = [F.to_json(F.struct(o)) if _has_map(f.dataType) else F.col(o) for o, f in zip(own, df.schema.fields, strict=True)]
    here = Window.partitionBy("_source", "_bucket").orderBy(F.col(key).asc_nulls_first(), F.xxhash64(*hashed))
    few = buckets * len(slots) <= BROADCAST
    rows = rows.withColumn("_in", F.row_number().over(here) - 1).join(F.broadcast(offsets) if few else offsets, ["_source", "_bucket"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_in")).withColumn("_block", F.expr(f"_rank div {block_rows}"))
    slot_of = schedule(df.sparkSession, slots)
    share = F.element_at(F.create_map(*(F.lit(x).cast(t) for s, n in slots.items() for x, t in ((s, "string"), (n, "long")))), F.col("_source"))
    rows = rows.withColumn("_frame", F.floor(F.col("_block") / share).cast("long")).withColumn("_k", F.col("_block") - F.col("_frame") * share)
    rows = rows.join(F.broadcast(slot_of), ["_source", "_k"])
    start = F.col("_frame") * frame
    return rows.select(
        *(F.col(o).alias(c) for o, c in zip(own, df.columns, strict=True)),
        F.col("_block").alias("mix_block"),
        (start + F.col("_slot")).alias("mix_slot"),
        (F.col("_rank") - F.col("_block") * block_rows).alias("mix_offset"),
        (start + F.col("_release")).alias("mix_release"),
        (start + F.col("_deadline")).alias("mix_deadline"),
    )


def _has_map(t: T.DataType) -> bool:
    inner = [f.dataType for f in t.fields] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else []
    return isinstance(t, T.MapType | T.VariantType) or any(map(_has_map, inner))


def held_rows(counts: dict[str, int], weights: dict[str, float] | None = None, frame: int = FRAME, block_rows: int = BLOCK_ROWS) -> int:
    """How many leading rows of the mix of sources with ``counts`` rows hold the target
    weights: those before the first slot in which a source that has rows has none left."""
    weights = {OTHER: min((weights or WEIGHTS).values())} | (weights or WEIGHTS)
    slots = shares(weights, frame)
    there = {s: n for s, n in counts.items() if n and s in slots}
    # A source's block k goes in the slot of its place in the frame.
    order = _simulated(slots)
    at = {s: [t for t, name in enumerate(order) if name == s] for s in there}
    slot_of = lambda s, k: k // slots[s] * frame + at[s][k % slots[s]]
    end = min((slot_of(s, -(-n // block_rows)) for s, n in there.items()), default=0)
    blocks = {s: end // frame * slots[s] + sum(t < end % frame for t in at[s]) for s in there}
    return sum(min(n, blocks[s] * block_rows) for s, n in there.items())


def _simulated(slots: dict[str, int]) -> list[str]:
    """The source of each slot of a frame, earliest deadline first, by plain simulation."""
    frame, counts, order, out = sum(slots.values()), dict.fromkeys(slots, 0), {s: i for i, s in enumerate(slots)}, []
    for t in range(frame):
        _, _, s = min((-(-(counts[s] + 1) * frame // n), order[s], s) for s, n in slots.items() if counts[s] * frame // n <= t)
        out.append(s)
        counts[s] += 1
    return out


def op3_mix(spark, sf_dir: str) -> DataFrame:
    """The place of every document in the mix."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


def _frame_rows(slots: dict[str, int]) -> str:
    """The schedule of a frame, found by plain simulation, as rows of SQL."""
    frame, counts, rows = sum(slots.values()), dict.fromkeys(slots, 0), []
    for t, s in enumerate(_simulated(slots)):
        k, n = counts[s], slots[s]
        rows.append(f"('{s}', {k}, {t}, {k * frame // n}, {-(-(k + 1) * frame // n)}, {n})")
        counts[s] += 1
    return ", ".join(rows)


_SLOTS = shares({OTHER: min(WEIGHTS.values())} | WEIGHTS)
ORACLE_SQL = f"""
WITH f(s, k, slot, release, due, share) AS (VALUES {_frame_rows(_SLOTS)}),
d AS (SELECT doc_id, source, CASE WHEN source IN ({', '.join(f"'{s}'" for s in WEIGHTS if s != OTHER)}) THEN source ELSE '{OTHER}' END AS s,
  (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT) % {BUCKETS} AS bucket FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY bucket, doc_id) - 1 AS rank FROM d),
b AS (SELECT r.*, rank // {BLOCK_ROWS} AS block, n.share FROM r JOIN (SELECT DISTINCT s, share FROM f) n USING (s))
SELECT doc_id, source, CAST(block AS BIGINT) AS mix_block, CAST(block // b.share * {FRAME} + slot AS BIGINT) AS mix_slot,
  CAST(rank % {BLOCK_ROWS} AS BIGINT) AS mix_offset, CAST(block // b.share * {FRAME} + release AS BIGINT) AS mix_release,
  CAST(block // b.share * {FRAME} + due AS BIGINT) AS mix_deadline
FROM b JOIN f ON f.s = b.s AND f.k = block % b.share
"""
