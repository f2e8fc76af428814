"""Readers and writers of record files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.session import dropped, written

#: Extensions and the formats that read them.
FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}
STAGE = "struct<id:string,desc:string,action:string>"
STEP = "struct<claimed:string,is_deviation:boolean,code:string,raw:string,wrapped:boolean,exec:string>"
#: Schemas of the pipeline's records.
TRAJECTORY = f"prob_idx int, plan_idx int, exec_idx int, plan array<{STAGE}>, steps array<{STEP}>, answer string, fmt_bad int, correct boolean, plan_quality double, plan_trunc_rate double"
STEP_LABEL = "prob_idx int, plan_idx int, exec_idx int, step int, claimed string, b2 string, ran_ok boolean, c2 string, in_stall boolean, traj_skips array<string>, traj_uncovered array<string>, traj_abandoned boolean"
C2_LABEL = "prob_idx int, plan_idx int, exec_idx int, step int, verdict string, provenance string, evidence string, bounded_search boolean"
SHARD = "parse_fail int, covered_probs array<int>, covered array<int>, score_scheme string, step_score map<string,map<string,double>>, plan_score map<string,double>, plan_score_step0 map<string,double>"


def jsonl(spark: SparkSession, path: str, schema: str, numbered: bool = False) -> DataFrame:
    """SRC-01: records of a JSON-lines file; with ``numbered`` also ``line_no``, their
    place in the file, where that is a key."""
    if not numbered:
        return spark.read.schema(schema).json(path)
    from stepforge.operators.datasets import numbered as in_order

    # Rows of a partition ascend by byte; partitions by where they begin in their file.
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    rows = spark.read.text(path).select("value", *(c.alias(f"_at{i}") for i, c in enumerate(at)))
    t = in_order(rows, "_at0", "_at1", "_at2")
    return t.select("line_no", F.from_json("value", schema).alias("r")).select("line_no", "r.*")


def shards(spark: SparkSession, glob: str) -> DataFrame:
    """SRC-03: score shards with the name of their file."""
    return spark.read.schema(SHARD).option("multiLine", True).json(glob).withColumn("file", F.input_file_name())


def shard_scores(shard: DataFrame) -> DataFrame:
    """SRC-04, AGG-46: (prob_idx, tpos, step, score) of all shards; later files win."""
    t = shard.select("file", F.explode("step_score").alias("key", "by")).select("file", "key", F.explode("by").alias("step", "score"))
    at = F.split("key", ":")
    t = t.select("file", at[0].cast("int").alias("prob_idx"), at[1].cast("int").alias("tpos"), F.col("step").cast("int").alias("step"), "score")
    # A row for each file; their numbers are short and hashable where names aren't.
    turns = shard.select("file").distinct().withColumn("_turn", F.row_number().over(Window.orderBy("file")))
    t = t.join(F.broadcast(turns), "file")
    return t.groupBy("prob_idx", "tpos", "step").agg(F.max_by("score", "_turn").alias("score"))


def shard_plan_scores(shard: DataFrame) -> DataFrame:
    """SRC-04: (prob_idx, tpos, plan_score); later files win."""
    t = shard.select("file", F.explode("plan_score").alias("key", "plan_score"))
    at = F.split("key", ":")
    return t.groupBy(at[0].cast("int").alias("prob_idx"), at[1].cast("int").alias("tpos")).agg(F.max_by("plan_score", "file").alias("plan_score"))


def mixed_schemes(shard: DataFrame, count_null: bool = True) -> bool:
    """FLT-19: whether shards of different schemes were merged."""
    scheme = F.coalesce("score_scheme", F.lit("(none)")) if count_null else F.col("score_scheme")
    return (shard.agg(F.countDistinct(scheme)).first()[0] or 0) > 1


def format_of(path: str) -> str:
    """SRC-05, SRC-06: the one format of a file or of all files of a folder."""
    names = [path] if not os.path.isdir(path) else [os.path.join(d, n) for d, _, ns in os.walk(path) for n in ns if n[0] not in "._"]
    found = {FORMATS.get(n.rpartition(".")[2].lower()) for n in names}
    if len(found) != 1 or None in found:
        raise ValueError(f"files of {path} have no one known type: {sorted(map(str, found))}")
    return found.pop()


def load(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """SRC-05, SRC-12: a local path by its extension; Arrow files go through pyarrow."""
    fmt = fmt or format_of(path)
    if fmt == "arrow":
        import pyarrow as pa

        with pa.memory_map(path) as f:
            try:
                rows = pa.ipc.open_file(f).read_all()
            except pa.ArrowInvalid:
                f.seek(0)
                rows = pa.ipc.open_stream(f).read_all()
        return spark.createDataFrame(rows)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


def cloud_json(spark: SparkSession, uri: str, schema: str | None = None) -> DataFrame:
    """SRC-08, FLT-20: JSON files of an object store; other extensions are passed over."""
    scheme = uri.partition("://")[0]
    if scheme not in ("s3", "s3a", "gs", "gcs"):
        raise ValueError(f"not an object store: {uri}")
    uri = {"s3": "s3a", "gcs": "gs"}.get(scheme, scheme) + "://" + uri.partition("://")[2]
    reader = spark.read.option("pathGlobFilter", "*.{json,jsonl}")
    return (reader.schema(schema) if schema else reader).json(uri)


def rows_at(df: DataFrame, places, position: str = "line_no") -> DataFrame:
    """SRC-14: rows by place: one number, a slice or a list."""
    if isinstance(places, int):
        return df.where(F.col(position) == places)
    if isinstance(places, slice):
        start, stop = places.start or 0, F.lit(None) if places.stop is None else F.lit(places.stop)
        return df.where((F.col(position) >= start) & F.coalesce(F.col(position) < stop, F.lit(True)) & ((F.col(position) - start) % (places.step or 1) == 0))
    wanted = df.sparkSession.createDataFrame([(int(p),) for p in places], T.StructType([T.StructField(position, T.LongType())]))
    return df.join(wanted, position, "left_semi")


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """SNK-01, SNK-02: JSON lines with nulls kept, in order where one is asked for."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_shards(scores: DataFrame, path: str, n: int, most: int = 10_000) -> None:
    """SNK-05: JSON objects for each shard ``prob_idx % n``, each in a file of its own.

    A shard of more than about ``most`` chains has several objects, dealt out by hash of
    the key, so that no task holds a whole shard; readers merge files anyway."""
    key = F.concat_ws(":", "prob_idx", "tpos")
    by = scores.groupBy(F.pmod("prob_idx", F.lit(n)).alias("shard"), key.alias("key")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("step").cast("string"), "score")))).alias("by"))
    by, scratched = written(by, "shards")
    parts = max(1, -(-by.count() // (n * most)))
    dealt = by.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    out = dealt.groupBy("shard", "_part").agg(F.map_from_entries(F.collect_list(F.struct("key", "by"))).alias("step_score"), F.lit(0).alias("parse_fail"))
    out.drop("_part").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("shard").json(path)
    dropped(scores.sparkSession, scratched)


def failures(df: DataFrame, score: str, order: str, most: int = 20) -> DataFrame:
    """SNK-07, SRT-09: the first texts that gave no score."""
    return df.where(F.col(score).isNull()).orderBy(order).limit(most)


def checked(df: DataFrame, required: list[str]) -> DataFrame:
    """FLT-14: the rows, or an error with the number that lack a required field."""
    bad = df.where(" OR ".join(f"{c} IS NULL" for c in required)).count()
    if bad:
        raise ValueError(f"{bad} rows lack one of {required}")
    return df


def last_row(df: DataFrame, order: str) -> DataFrame:
    """SRC-17: the row that is last in ``order``."""
    return df.groupBy().agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def subset(df: DataFrame, keys: list[str]) -> DataFrame:
    """PRJ-01: the named fields that are there, in the order named."""
    return df.select(*(k for k in keys if k in df.columns))


def write_report(df: DataFrame, path: str) -> None:
    """SNK-06, SNK-11: a report as one JSON object in one file; its rows are metrics, few."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tokenized(parts: dict[str, DataFrame], path: str) -> None:
    """SNK-08: named parts of a tokenized dataset, each a folder of Parquet."""
    for name, t in parts.items():
        t.write.mode("overwrite").parquet(f"{path}/split={name}")


def tokenized(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """SRC-13: the parts that were written, none where the folder has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    found = {n.partition("=")[2]: spark.read.parquet(f"{path}/{n}") for n in names if n.startswith("split=")}
    return found or None


def predictions(df: DataFrame, prompt: str, predicted: str, labels: str, pad: int, ignored: int = -100) -> DataFrame:
    """SNK-09: id arrays as they are decoded: padding in front of a prediction goes to its
    end, ignored labels become padding."""
    first = F.array_position(F.transform(predicted, lambda x: (x != pad).cast("int")), 1).cast("int")
    lead = F.when(first > 1, first - 1).otherwise(F.lit(0))
    turned = F.concat(F.slice(predicted, lead + 1, F.greatest(F.size(predicted) - lead, F.lit(0))), F.slice(predicted, F.lit(1), lead))
    return df.select(F.col(prompt).alias("prompt"), turned.alias("predict"), F.transform(labels, lambda x: F.when(x == ignored, pad).otherwise(x)).alias("label"))
