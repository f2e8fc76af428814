"""A corpus pipeline of five stages, each over all that the one before kept.

Quality rules reject documents; of each group of near-duplicates one stays; secrets are
replaced by placeholders; sources are interleaved to target weights; at last texts are
encoded and decoded. All stages but the last return the columns of ``documents``. The mix
is an order: its stage writes the documents in it, and the last stage reads it from where
they stand in the files, as ``mix_no``. The leading rows hold the target weights; what comes
after a source has run out is kept too, with ``mix_surplus`` true.

Defined results: null and empty texts fail the base rules; very long texts are whole; of
rows that repeat an id the one with the least text stays; ties of the mix are broken as
in its operator; empty tables give no rows; further columns would be kept by all stages but
the last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.llm.bpe import digests
from stepforge.llm.common import dropped, table, written
from stepforge.llm.minhash import near_duplicates
from stepforge.llm.mixing import OTHER, WEIGHTS, held_rows, mixed
from stepforge.llm.rules import accepted
from stepforge.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned rules keep."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of rows
    that repeat an id one stays; rows without id stay."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # The join has dealt rows out by id already, so texts aren't shuffled again.
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id")))
    found = docs.join(kept, "doc_id", "left_semi").withColumn("_again", again).where("_again = 1").select(*docs.columns)
    return found.unionByName(docs.where("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for secrets."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mixed(docs).orderBy("mix_slot", "mix_offset").select(*docs.columns)


def positions(docs: DataFrame) -> DataFrame:
    """``docs`` and ``mix_no``, the place of each row, from 0: by file and row where they are
    read from files, whose names ascend as they were written, else by partition and row."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        rows = docs.select("*", F.lpad(F.shiftright(at, 33).cast("string"), 10, "0").alias("_file"), at.bitwiseAND((1 << 33) - 1).alias("_row"))
    # A row for each file.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_file").count().select("_file", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("_before"))
    return rows.join(F.broadcast(files), "_file").withColumn("mix_no", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of every document, its place in
    the mix and whether that is beyond what holds the target weights."""
    known = [s for s in WEIGHTS if s != OTHER]
    # A row for each source that has a weight, and one for the others.
    counts = docs.groupBy(F.when(F.col("source").isin(known), F.col("source")).otherwise(OTHER).alias("s")).count().collect()
    held = held_rows({r.s: r["count"] for r in counts})
    rows = positions(docs).withColumn("mix_surplus", F.col("mix_no") >= held)
    return digests(rows, keep=("doc_id", "text", "lang", "source", "n_chars", "mix_no", "mix_surplus"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("secrets", secrets),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Learned rules, sketches and token ids are beyond SQL; tests hold the result against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, new = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            dropped(spark, path)
        path = new
    return docs
