"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sketch. With k bins, round i throws every shingle into one hashed bin with the value
``i + hash``; the first k rounds hash the bin, later rounds would walk all shingles through
bin ``i - k``; a bin keeps its least value. Rounds go on until every bin is full, so every
coordinate is filled, and agreement of coordinates concentrates about the Jaccard
similarity as with independent hash functions, at the cost of about n + k log k hashes.

Banding. ``bands`` bands of ``rows`` coordinates; with 42 bands of 6, a pair at similarity
0.8 shares no band with probability 3e-6.

Verification and components. Documents with equal shingle sets are one class, held by the
smallest id. Within a bucket, members are compared with a centre; two more rounds take
other centres for members that are still in other components, and rounds end once no
bucket has members of two; at last every pair of members from different components is
compared that no centre has joined, minority against all, in cells of bounded size. So no
pair that a bucket has is lost, yet pairs inside a component that links have already joined
are never made: a component's members need no further links. Comparison is exact, on full
shingle sets.

Skew. A hot bucket, class or centre (a large group of copies) is never gathered in one
task: its few facts are broadcast to its rows (``hot_join``), a hot centre's set is copied to the
parts that its pairs are cut into, and links of one node are dealt out in parts. Documents
without shingles take no part in any join.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; shingles of five words
unless a caller says otherwise (``op1_minhash_dedup`` takes two). Shingles are 64-bit
hashes.

Defined results: null texts and texts without words have no shingles and link with
nothing; fewer words than a shingle make one shingle; very long texts are whole; repeated
rows have equal results; rows with equal ids are one node, whose set is the least of their
sets where texts differ; a null id never links, its component is null and it is kept; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import dropped, hot_join, hot_limit, mapped, table, texts, written
from stepforge.llm.components import components

BANDS, ROWS = 42, 6
SHINGLE_WORDS, PERCENT = 5, 80
#: Comparisons of a group that may become pairs; sets to a side of a grid's cell, and
#: shingles of these.
PAIRS_LIMIT, CELL, CELL_SHINGLES = 256, 256, 1 << 20
#: Rows of full sets in a batch: a long document has very many shingles.
SET_ROWS = 64
#: Remembered words of a worker process.
MEMORY = 500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text. ``bytes.split`` and ``bytes.lower`` know
    ASCII only: white space is 0x20 and 0x09-0x0D, letters are A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([*map(word_hashes().__getitem__, words)], np.uint64)
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * _A + h[i : len(h) - width + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(s: np.ndarray, k: int) -> np.ndarray:
    """k coordinates of a set that is not empty."""
    n, done = len(s), 0
    low = np.uint64((1 << 48) - 1)
    best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    pace = max(1, int(1.15 * k * np.log(k) / n) + 1)
    while done < k:
        rounds = np.arange(done, min(k, done + pace), dtype=np.uint64)
        h = mixed(s[None, :] ^ mixed((rounds + np.uint64(1)) * _A)[:, None])
        # Bin from the high 16 bits; round and the low 48 bits are the value.
        bins = ((h >> np.uint64(48)) * np.uint64(k) >> np.uint64(16)).astype(np.int64)
        value = (rounds[:, None] << np.uint64(48)) | (h & low)
        np.minimum.at(best, bins.ravel(), value.ravel())
        done += len(rounds)
        if best.max() != np.iinfo(np.uint64).max:
            return best
        pace = max(1, pace // 4)
    # Rounds k to 2k: the empty bins take the least of all shingles' own hashes.
    for b in np.flatnonzero(best == np.iinfo(np.uint64).max):
        h = mixed(s ^ mixed(np.array([k + b + 1], np.uint64) * _A))
        best[b] = (np.uint64(k + b) << np.uint64(48)) | (h & low).min()
    return best


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    c = coordinates[: bands * rows].reshape(bands, rows)
    for i in range(rows):
        out = mixed(out * _A + c[:, i])
    return out.view(np.int64)


def sketches(df: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, set1, set2, bands): size, 128-bit digest and band keys of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t, width) for t in texts(b.column(1))]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            full = np.array([len(s) for s in sets], np.int64)
            keys = [band_keys(sketch(s, bands * rows), bands, rows) for s in sets if len(s)]
            offsets = np.concatenate(([0], np.cumsum(np.where(full > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists], names=["id", "n", "set1", "set2", "bands"])

    return mapped(df.select(F.col(key).cast("long"), text), run, "id long, n long, set1 long, set2 long, bands array<long>")


def full_sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, shingles): the full sets, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width).tobytes() for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return mapped(df.select(F.col(key).cast("long"), text), run, "id long, shingles binary", SET_ROWS)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, kept) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # merges the two sorted runs
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = kept(pairs.select("a", "b"), "pairs")
    limit = hot_limit(pairs.count())
    # A hot centre's pairs are cut into parts of about ``limit``.
    many = pairs.groupBy("a").count().where(F.col("count") > limit).select("a", F.ceil(F.col("count") / limit).alias("_parts"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    if many.limit(1).count():
        hot = F.broadcast(many)  # HOT_KEYS rows at most
        parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
        part, copies = F.pmod(F.xxhash64("b"), parts), F.sequence(F.lit(0).cast("long"), parts - 1)
        pairs = pairs.join(hot, "a", "left").withColumn("salt", part)
        left = left.join(hot, "a", "left").withColumn("salt", F.explode(copies))
    else:
        pairs, left = pairs.withColumn("salt", F.lit(0)), left.withColumn("salt", F.lit(0))
    return mapped(pairs.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "x", "y"), run, "a long, b long", SET_ROWS)


def remaining(now: DataFrame, open_: DataFrame, sets: DataFrame, percent: int, similar_size, total: int, kept) -> DataFrame:
    """Links between members of unresolved buckets that no centre has joined.

    Whoever is not of a bucket's majority component is compared with the bucket's other
    members, by bucket, or, where that is less work as buckets share most of their members,
    once with all of that component's members in such buckets. Small groups become pairs;
    the sets of large ones are laid out in a grid of bounded cells, each of which counts all
    intersections at once and gives one link for each document and component, so that no
    table of pairs arises."""
    members = kept(hot_join(now, open_, ["bucket"], "members", total).select("bucket", "majority", "id", "n", "root"), "open")
    minority = F.col("root") != F.col("majority")
    by_bucket = members.groupBy("majority", "bucket").agg(F.count("*").alias("m"), F.count_if(minority).alias("few")).groupBy("majority").agg(F.sum("m").alias("members"), F.sum(F.col("m") * F.col("few")).alias("work"))
    different = members.groupBy("majority", "id", "root").agg(F.lit(1).alias("one")).groupBy("majority").agg((F.count("*") * F.count_if(minority)).alias("once"))
    sized = kept(by_bucket.join(different, "majority").select("majority", (F.col("work") <= F.col("once")).alias("apart"), "members"), "sized")
    keyed = hot_join(members, sized, ["majority"], "members", total)
    group = F.when(F.col("apart"), F.struct(F.lit(0).alias("kind"), F.col("bucket").alias("key"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("majority").alias("key")))
    all_ = kept(keyed.select(group.alias("c"), "id", "n", "root", minority.alias("few")).distinct(), "groups")
    all_ = all_.select(F.xxhash64("c.kind", "c.key").alias("c"), "id", "n", "root", "few")
    few = all_.where("few")
    side = lambda n, s: F.expr(f"greatest(({n} - 1) div {CELL}, {s} div {CELL_SHINGLES}) + 1")
    sizes = all_.groupBy("c").agg(F.count("*").alias("nl"), F.sum("n").alias("sl"), F.count_if("few").alias("nr"), F.sum(F.when(F.col("few"), F.col("n")).otherwise(0)).alias("sr"))
    sizes = kept(sizes.select("c", "nl", "nr", side("nl", "sl").alias("i"), side("nr", "sr").alias("j"), F.col("nl").alias("members")), "sizes")

    small = sizes.where(f"nl * nr <= {PAIRS_LIMIT}").select("c")
    left = all_.join(small, "c").select("c", "id", "n", "root")
    right = few.join(small, "c").select("c", F.col("id").alias("a"), F.col("n").alias("m"), F.col("root").alias("ra"))
    pairs = left.join(right, "c").where("root <> ra").where(similar_size).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()

    cells = sizes.where(f"nl * nr > {PAIRS_LIMIT}").drop("nl", "nr")
    apart = lambda t: hot_join(t, cells, ["c"], "members", total)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = apart(all_).select("c", place("i").alias("x"), spread("j").alias("y"), "id", "root").join(sets, "id")
    columns = apart(few).select("c", spread("i").alias("x"), place("j").alias("y"), "id", "root").join(sets, "id")
    columns = columns.select(*(F.col(c).alias(f"{c}_") for c in ("c", "x", "y", "id", "root", "shingles")))

    def cell(rows: pa.Table, columns: pa.Table) -> pa.Table:
        a, b = [], []
        if len(rows) and len(columns):
            ids, roots = rows.column("id").to_pylist(), rows.column("root").to_numpy()
            packed = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
            n = np.array([len(x) for x in packed])
            every = np.concatenate(packed)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(n)), n)[order]
            for key, root, s in zip(columns.column("id_").to_pylist(), columns.column("root_").to_pylist(), columns.column("shingles_"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                low, high = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
                many = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                same = np.bincount(owner[at], minlength=len(n))
                linked = np.flatnonzero((100 * same >= percent * (n + len(s) - same)) & (roots != root))
                for k in linked[np.unique(roots[linked], return_index=True)[1]].tolist():
                    a.append(ids[k])
                    b.append(key)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    large = rows.groupBy("c", "x", "y").cogroup(columns.groupBy("c_", "x_", "y_")).applyInArrow(cell, "a long, b long")
    return verified(pairs, sets, percent, kept).union(large)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``df``."""
    spark = df.sparkSession
    paths: list[str] = []

    def kept(t: DataFrame, name: str) -> DataFrame:
        t, path = written(t, name)
        paths.append(path)
        return t

    # The result is read from the sketches and classes, which stay.
    marks, _ = written(sketches(df, key, text, width, bands, rows), "sketches")
    full = marks.where("n > 0 AND id IS NOT NULL")
    classes, _ = written(full.groupBy("set1", "set2").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "classes")
    # A class is in the buckets of its representative alone.
    reps = full.join(classes.select("set1", "set2", F.col("rep").alias("id")), ["set1", "set2", "id"], "left_semi").select("set1", "set2", "id", "n", "bands")
    if full.groupBy("id").count().where("count > 1").limit(1).count():
        reps = reps.groupBy("set1", "set2", "id", "n").agg(F.first("bands").alias("bands"))
    reps = kept(reps.select("id", "n", "bands"), "reps")
    entries = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = kept(entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("centre")).where("members > 1"), "shared")
    buckets = kept(hot_join(entries, shared, ["bucket"], "members", bands * reps.count()), "buckets")
    total = buckets.count()
    wanted = buckets.select("id").distinct()
    sets = kept(full_sets(df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi"), "id", "text", width).where("octet_length(shingles) > 0").groupBy("id").agg(F.min("shingles").alias("shingles")), "sets")

    similar_size = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    roots, roots_path = None, None
    for step in range(4):
        if not step:
            pairs = buckets.where("id <> centre").groupBy("id").agg(F.min("centre").alias("a"))
            found = verified(pairs.select("a", F.col("id").alias("b")), sets, percent, kept)
        else:
            now = kept(buckets.drop("centre").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "now")
            by = now.groupBy("bucket").agg(
                F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"),
                F.min_by(F.struct("id", "n", "root"), F.xxhash64("id", F.lit(step))).alias("c"),
            ).where("r0 < r1").drop("r0", "r1")
            open_ = kept(by, "open-buckets")
            if not open_.limit(1).count():
                break
            if step < 3:
                pairs = hot_join(now, open_, ["bucket"], "members", total).where("root <> c.root").withColumn("m", F.col("c.n")).where(similar_size)
                pairs = pairs.groupBy("id").agg(F.min("c.id").alias("a"))
                found = verified(pairs.select("a", F.col("id").alias("b")), sets, percent, kept)
            else:
                # The commonest component of each open bucket, counted by bucket and component.
                counted = hot_join(now, open_.select("bucket", "members"), ["bucket"], "members", total).groupBy("bucket", "root").agg(F.count("*").alias("w"))
                most = counted.groupBy("bucket").agg(F.sum("w").alias("members"), F.max_by("root", F.struct("w", "root")).alias("majority"))
                found = remaining(now, kept(most, "majorities"), sets, percent, similar_size, total, kept)
        links = kept(found, "links")
        if roots is not None and not links.limit(1).count():
            continue
        linked = links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        new, new_path = components(linked)
        if roots_path:
            dropped(spark, roots_path)
        roots, roots_path = new, new_path
    found, _ = written(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set1", "set2", "members", F.coalesce("root", "rep").alias("root")), "class-roots")
    for path in (*paths, roots_path):
        dropped(spark, path)
    named = hot_join(full.drop("bands"), found, ["set1", "set2"], "members", marks.count()).select("id", "n", "root")
    alone = marks.where("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("root"))
    return named.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents on shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: Exact components by an inverted index of shingles; sets only, no sketches.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)
"""
