"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepforge.session import dropped, scratch, ship, shared_dir, written

__all__ = ["dropped", "scratch", "ship", "shared_dir", "written", "table", "tokenizer_path", "mapped", "texts", "extended", "salts", "facts_of", "hot_limit", "hot_join"]

#: Rows in an Arrow batch: whole texts are long, so batches are short.
BATCH_ROWS = 1000
#: A key with more rows than this and than one ``HOT_KEYS``-th of all is hot, so that there
#: are never more than ``HOT_KEYS`` hot keys and what is broadcast for them is bounded.
HOT_ROWS, HOT_KEYS = 100, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public vocabulary lies; the files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` in batches of ``rows``, with this package on the workers. The session's
    setting holds when a plan runs, perhaps with another operator's value by then, so
    batches are cut here as well."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(cut, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a string column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and further columns, in DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def salts(df: DataFrame, rows: int) -> int:
    """How many parts a group that has all rows of ``df`` is cut into: ``rows`` in each,
    and so many that a hot group doesn't stand out on a small cluster either."""
    return max(64, -(-df.count() // rows))


def facts_of(rows: DataFrame, keys: list[str], salt: str = "salt", **facts: str) -> DataFrame:
    """(keys, salt, facts): aggregates of groups by ``keys``, a row for each salt that a
    group has, so that rows can be joined with them by keys and salt and no group, however
    large, meets in one task. ``facts`` are ``min``, ``max``, ``sum`` or ``count`` of an
    expression; they are aggregated by salt first and then merged."""
    parts = rows.groupBy(*keys, salt).agg(*(F.expr(e).alias(f"_{n}") for n, e in facts.items()))
    merge = {n: "sum" if (kind := e.partition("(")[0].strip()) == "count" else kind for n, e in facts.items()}
    whole = parts.groupBy(*keys).agg(*(F.expr(f"{m}(_{n})").alias(n) for n, m in merge.items()))
    return parts.select(*keys, salt).join(whole, keys)


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, total // HOT_KEYS)


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], members: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``facts``, a table read from disk with one row for each
    group and the group's number of rows in column ``members``, which is left out. Rows of
    hot groups stay where they are and get the facts of these few groups by broadcast; only
    the others are dealt out by their keys."""
    limit = hot_limit(total)
    hot, cold = facts.where(F.col(members) > limit).drop(members), facts.where(F.col(members) <= limit).drop(members)
    if not hot.limit(1).count():
        return rows.join(cold, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
