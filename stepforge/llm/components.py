"""Connected components of a table of links, by large-star and small-star rounds.

Defined results: links of a node with itself, repeated links and links in either direction
count once; ties don't arise, as roots are least ids; nodes without links aren't returned; an
empty table has no nodes; texts, however long, are never read here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import dropped, facts_of, written

#: Parts that the links of one node are cut into; links, counted first, up to which the
#: least neighbours of all nodes are broadcast instead (16 bytes each).
SALTS, BROADCAST_LINKS = 64, 200_000


def _least(links: DataFrame, few: bool) -> DataFrame:
    """``links`` with the least neighbour ``m`` of their u; a node with very many links is
    aggregated and joined in parts, or where its links are."""
    if few:
        return links.join(F.broadcast(links.groupBy("u").agg(F.min("v").alias("m"))), "u")
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return salted.join(facts_of(salted, ["u"], m="min(v)"), ["u", "salt"]).drop("salt")


def components(links: DataFrame, name: str = "links") -> tuple[DataFrame, str]:
    """(node, root) for every node of ``links(a, b)``, and the path of that table; root is
    the smallest node that can be reached. Each round is written to the shared folder, so
    that lineage stays short and a lost executor costs no more than a round."""
    spark = links.sparkSession
    now, path = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    state = None
    while True:
        few = now.count() <= BROADCAST_LINKS
        # Large star: the larger neighbours of a node are tied to its least one, or itself.
        both = _least(now.union(now.select("v", "u")), few)
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are tied to the least of them.
        small = _least(large, few).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        after, new_path = written(small.select("x.u", "x.v").where("u <> v").distinct(), name)
        dropped(spark, path)
        now, path = after, new_path
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path
