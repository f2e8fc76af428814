"""Queries over streams; each drains what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.plans.lens import read
from stepforge.session import scratch
from stepforge.streaming import flows


def _folder(spark, d):
    """Events as a folder of a few files, so that the stream has several batches."""
    path = scratch(spark, "events")
    read(spark, d, "events").repartitionByRange(3, "event_id").write.parquet(path)
    return path


def str01_windows(spark, d):
    counts = flows.windowed_counts(flows.file_stream(spark, _folder(spark, d)), "ts", "event_type", late="1000 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("stepforge_windows").option("checkpointLocation", scratch(spark, "state-windows")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("stepforge_windows").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


STR01 = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


def str04_buffers(spark, d):
    stream = flows.file_stream(spark, _folder(spark, d)).select("event_type", F.lit(1.0).alias("value"))
    t = flows.drained(flows.buffered(stream, "event_type", 50), "buffers")
    return t.groupBy("event_type").agg(F.count("*").alias("batches"), F.sum("total").alias("total"))


STR04 = "SELECT event_type, count(*) // 50 AS batches, (count(*) // 50 * 50)::DOUBLE AS total FROM events GROUP BY event_type HAVING count(*) >= 50"


def str06_log_tail(spark, d):
    path = scratch(spark, "log")
    t = read(spark, d, "events").select(F.col("event_id").alias("current_steps"), "value", F.lit(None).cast("double").alias("lr"))
    flows.append_log(t, path)
    return flows.log_tail(spark, path, "current_steps long, value double, lr double", "current_steps").select("current_steps", "value")


def str03_rounds(spark, d):
    t = read(spark, d, "customer").select("c_custkey", F.lit(0).alias("steps"), F.lit(False).alias("done"))
    grow = lambda x: x.withColumn("steps", F.col("steps") + 1).withColumn("done", F.col("steps") > F.col("c_custkey") % 4)
    return flows.rounds(t, grow).groupBy("steps", "done").agg(F.count("*").alias("n"))


QUERIES = {
    "str01_windows": (str01_windows, STR01),
    "str03_rounds": (str03_rounds, "SELECT (c_custkey % 4 + 1)::INT AS steps, TRUE AS done, count(*) AS n FROM customer GROUP BY 1"),
    "str04_buffers": (str04_buffers, STR04),
    "str06_log_tail": (str06_log_tail, "SELECT event_id AS current_steps, value FROM events ORDER BY event_id DESC LIMIT 1"),
}
