"""Queries for alignment, mixing, splitting, packing and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.operators import convert as C
from stepforge.operators import datasets as D
from stepforge.operators import packing as P
from stepforge.plans.lens import read


def _chats(spark, d):
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("xs"))
    return t.select("conv_id", F.transform("xs", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("messages"))


def prj09_sharegpt(spark, d):
    t = _chats(spark, d).withColumn("a", C.sharegpt(F.col("messages")))
    return t.select("conv_id", F.col("a.broken").alias("broken"), F.size("a.prompt").alias("n_prompt"), F.size("a.response").alias("n_response"), F.length("a.system").alias("system_chars"), F.coalesce(F.get("a.response", F.lit(0)).content, F.lit("")).alias("response"))


PRJ09 = """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
s AS (SELECT conv_id, coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN 1 END), 0) AS sys, coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN text END), '') AS system FROM m GROUP BY conv_id),
r AS (SELECT m.conv_id, i - sys AS i, role, text FROM m JOIN s USING (conv_id) WHERE i >= sys),
b AS (SELECT conv_id, count(*) AS n, bool_and(CASE WHEN i % 2 = 0 THEN role IN ('human', 'user', 'observation') ELSE role IN ('gpt', 'assistant', 'function_call', 'function') END) AS ok, arg_max(text, i) AS last FROM r GROUP BY conv_id),
x AS (SELECT s.conv_id, sys, system, coalesce(n, 0) AS n, NOT coalesce(ok, FALSE) OR n % 2 <> 0 AS broken, last FROM s LEFT JOIN b USING (conv_id))
SELECT conv_id, broken, CASE WHEN broken THEN 0 ELSE n - 1 END AS n_prompt, CASE WHEN broken THEN 0 ELSE 1 END AS n_response, length(system) AS system_chars, CASE WHEN broken THEN '' ELSE last END AS response FROM x"""


def flt11_valid_examples(spark, d):
    t = _chats(spark, d).withColumn("a", C.sharegpt(F.col("messages")))
    return t.groupBy(C.valid_example(F.col("a.prompt"), F.col("a.response")).alias("valid")).agg(F.count("*").alias("n"))


FLT11 = f"SELECT NOT broken AS valid, count(*) AS n FROM ({PRJ09}) GROUP BY 1"


def _records(spark, d):
    """Instruction records from events."""
    return read(spark, d, "events").select("event_id", F.col("event_type").alias("instruction"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("props")).alias("query"), F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("output"))


def prj08_alpaca(spark, d):
    t = _records(spark, d).withColumn("a", C.alpaca(F.col("instruction"), F.col("query"), F.col("output")))
    return t.select("event_id", F.get("a.prompt", F.lit(0)).content.alias("prompt"), F.size("a.response").alias("n_response"))


PRJ08 = "SELECT event_id, CASE WHEN user_id % 3 = 0 OR coalesce(props, '') = '' THEN event_type ELSE event_type || chr(10) || props END AS prompt, CASE WHEN event_id % 4 <> 0 AND user_id IS NOT NULL THEN 1 ELSE 0 END AS n_response FROM events"


def prj13_v1_alpaca(spark, d):
    t = _records(spark, d).withColumn("m", C.v1_alpaca(F.col("instruction"), F.col("query"), F.col("output")))
    return t.select("event_id", F.size("m").alias("n"), F.get(F.get("m", F.lit(0)).content, F.lit(0)).value.alias("user"), F.aggregate("m", F.lit(0.0), lambda s, x: s + x.loss_weight).alias("weight"))


PRJ13 = "SELECT event_id, CASE WHEN event_id % 4 <> 0 AND user_id IS NOT NULL THEN 2 ELSE 1 END AS n, event_type || CASE WHEN user_id % 3 = 0 THEN '' ELSE coalesce(props, '') END AS user, CASE WHEN event_id % 4 <> 0 AND user_id IS NOT NULL THEN 1.0 ELSE 0 END::DOUBLE AS weight FROM events"


def prj14_v1_sharegpt(spark, d):
    t = _chats(spark, d).withColumn("m", C.v1_sharegpt(F.col("messages")))
    return t.where("m IS NOT NULL").select("conv_id", F.size("m").alias("n"), F.aggregate("m", F.lit(0.0), lambda s, x: s + x.loss_weight).alias("weight"))


PRJ14 = "SELECT conv_id, count(*)::INT AS n, sum(CASE WHEN role IN ('gpt', 'assistant', 'function_call') THEN 1.0 ELSE 0 END)::DOUBLE AS weight FROM conversations GROUP BY conv_id HAVING bool_and(role IN ('system', 'human', 'user', 'gpt', 'assistant', 'observation', 'function_call'))"


def prj10_openai(spark, d):
    t = _chats(spark, d).withColumn("messages", F.transform("messages", lambda m, i: F.struct(F.when(i % 5 == 3, "tool").otherwise(m.role).alias("role"), m.content.alias("content"))))
    t = t.withColumn("a", C.openai(F.col("messages")))
    return t.groupBy("a.broken").agg(F.count("*").alias("n"))


PRJ10 = """WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, role FROM conversations),
k AS (SELECT conv_id, i, CASE WHEN i % 5 = 3 THEN 'observation' ELSE role END AS role FROM m WHERE NOT (i % 5 = 3 AND i = n - 1)),
s AS (SELECT conv_id, coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN 1 END), 0) AS sys FROM k GROUP BY conv_id),
b AS (SELECT k.conv_id, count(*) AS n, bool_and(CASE WHEN (i - sys) % 2 = 0 THEN role IN ('human', 'user', 'observation') ELSE role IN ('gpt', 'assistant', 'function_call', 'function') END) AS ok FROM k JOIN s USING (conv_id) WHERE i >= sys GROUP BY k.conv_id)
SELECT broken, count(*) AS n FROM (SELECT coalesce(NOT ok OR n % 2 <> 0, TRUE) AS broken FROM s LEFT JOIN b USING (conv_id)) GROUP BY 1"""


def mix01_concat(spark, d):
    a = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    b = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return D.concatenated(a, b).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


MIX01 = "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT NULL AS lang, text FROM benchmark UNION ALL SELECT lang, text FROM documents) GROUP BY lang"


def _mix_parts(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    b = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return [D.numbered(a, "id"), D.numbered(b, "id")]


def _mix(strategy):
    def run(spark, d):
        parts = _mix_parts(spark, d)
        return D.interleaved(parts, [p.count() for p in parts], strategy).select("mix_no", F.col("_source").alias("source"), "id")

    return run


_M = "a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), b AS (SELECT n_nationkey::BIGINT AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)"
MIX_UNDER = f"WITH {_M} SELECT i * 2 AS mix_no, 0 AS source, id FROM a, n WHERE i < least(na, nb) UNION ALL SELECT i * 2 + 1, 1, id FROM b, n WHERE i < least(na, nb)"
MIX_ONCE = f"WITH {_M} SELECT i * 2 AS mix_no, 0 AS source, id FROM a UNION ALL SELECT i * 2 + 1, 1, id FROM b"
MIX_OVER = f"WITH {_M}, t AS (SELECT unnest(range(0, greatest(na, nb))) AS t FROM n) SELECT t * 2 AS mix_no, 0 AS source, id FROM t, n, a WHERE a.i = t % na UNION ALL SELECT t * 2 + 1, 1, id FROM t, n, b WHERE b.i = t % nb"


def mix02_probabilities(spark, d):
    parts = _mix_parts(spark, d)
    t = D.interleaved(parts, [p.count() for p in parts], "once", probabilities=[0.7, 0.3])
    return t.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))


def spl01_split(spark, d):
    return D.split(read(spark, d, "customer").select("c_custkey"), "c_custkey", 0.1).groupBy("part").agg(F.count("*").alias("n"))


def smp01_num_samples(spark, d):
    t = read(spark, d, "nation").select("n_nationkey")
    return D.sampled(t, "n_nationkey", 60).agg(F.count("*").alias("n"), F.countDistinct("n_nationkey").alias("different"))


def jn15_few_shot(spark, d):
    t = D.few_shot(read(spark, d, "supplier"), read(spark, d, "nation"), "s_suppkey", "n_nationkey", 5)
    return t.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.countDistinct("n_nationkey").alias("different"))


def win10_previous(spark, d):
    t = D.numbered(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return D.previous_in_batch(t, "c_custkey").select("c_custkey", "kl")


WIN10 = """WITH t AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 1000 AS b FROM customer)
SELECT c_custkey, coalesce(lag(c_custkey) OVER (PARTITION BY b ORDER BY c_custkey), max(c_custkey) OVER (PARTITION BY b)) AS kl FROM t"""


def src02_bounded(spark, d):
    return D.numbered(read(spark, d, "orders").select("o_orderkey"), "o_orderkey").where("line_no < 100")


def src15_preview(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(6).limit(2)


def tok07_truncated(spark, d):
    t = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") * 20).cast("int").alias("source"), (F.col("l_linenumber") * 150).alias("target"))
    return t.select("source", "target", P.truncated(F.col("source"), F.col("target"), 1000).alias("x")).groupBy("source", "target").agg(F.max("x.source").alias("new_source"), F.max("x.target").alias("new_target"), F.count("*").alias("n"))


TOK07 = """WITH t AS (SELECT floor(l_quantity * 20)::INT AS source, l_linenumber * 150 AS target, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT *, CASE WHEN target * 2 < 1000 THEN 1000 WHEN source * 2 < 1000 THEN 1000 - source ELSE floor(1000 * (target::DOUBLE / (source + target)))::INT END AS most FROM t)
SELECT source, target, least(greatest(1000 - least(most, target), 0), source)::INT AS new_source, least(most, target)::INT AS new_target, n FROM m"""


def tok06_blocks(spark, d):
    t = D.numbered(read(spark, d, "events").select("event_id", F.sequence(F.lit(0), F.pmod("event_id", F.lit(7)).cast("int")).alias("ids")), "event_id")
    return P.blocks(t, "ids", 64).groupBy("batch").agg(F.count("*").alias("blocks"), F.sum(F.aggregate("ids", F.lit(0), lambda a, x: a + x)).alias("total"))


TOK06 = """WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS line FROM events),
x AS (SELECT line // 1000 AS batch, event_id, unnest(range(0, event_id % 7 + 1)) AS id FROM t),
r AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY event_id, id) - 1 AS i, count(*) OVER (PARTITION BY batch) AS n FROM x)
SELECT batch, max(n // 64) AS blocks, sum(id)::BIGINT AS total FROM r WHERE i < n // 64 * 64 GROUP BY batch"""


def pck01_knapsacks(spark, d):
    t = D.numbered(read(spark, d, "documents").select("doc_id", F.least(F.col("n_chars"), F.lit(8000)).alias("n")), "doc_id")
    bins = P.packed_bins(t, "n", 8000)
    return bins.groupBy("batch").agg(F.count("*").alias("bins"), F.sum(F.size("lengths")).alias("rows"), F.max(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("fullest"))


PCK01 = """WITH RECURSIVE l AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch, least(n_chars, 8000) AS n FROM documents),
f(batch, rest, room, bin, took) AS (SELECT batch, list(n ORDER BY n), 8000::BIGINT, 0, 0::BIGINT FROM l GROUP BY batch
 UNION ALL SELECT batch, CASE WHEN k > 0 THEN list_concat(rest[1:k - 1], rest[k + 1:]) ELSE rest END, CASE WHEN k > 0 THEN room - rest[k] ELSE 8000 END, CASE WHEN k > 0 THEN bin ELSE bin + 1 END, CASE WHEN k > 0 THEN rest[k] ELSE -1 END
 FROM (SELECT *, len(list_filter(rest, lambda x: x <= room)) AS k FROM f WHERE len(rest) > 0)),
b AS (SELECT batch, bin, sum(took) AS filled FROM f WHERE took > 0 GROUP BY ALL)
SELECT x.batch, x.bins, y.rows, x.fullest FROM (SELECT batch, count(*) AS bins, max(filled)::BIGINT AS fullest FROM b GROUP BY batch) x JOIN (SELECT batch, count(*) AS rows FROM l GROUP BY batch) y USING (batch)"""


def bat02_dynamic(spark, d):
    t = D.numbered(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return P.stream_batches(t, "n_chars", 4, 8192)


BAT02 = """WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, least(n_chars, 8192)::BIGINT AS x FROM documents),
f(line, ended, done, n, longest) AS (SELECT -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
 UNION ALL SELECT line, ended, CASE WHEN longest * n >= 32768 THEN n ELSE 0 END, CASE WHEN longest * n >= 32768 THEN 0 ELSE n END, CASE WHEN longest * n >= 32768 THEN 0 ELSE longest END FROM (
  SELECT t.line, CASE WHEN f.n > 0 AND greatest(f.longest, t.x) * (f.n + 1) > 32768 THEN f.n ELSE 0 END AS ended, CASE WHEN f.n > 0 AND greatest(f.longest, t.x) * (f.n + 1) > 32768 THEN 1 ELSE f.n + 1 END AS n,
   CASE WHEN f.n > 0 AND greatest(f.longest, t.x) * (f.n + 1) > 32768 THEN t.x ELSE greatest(f.longest, t.x) END AS longest FROM f JOIN t ON t.line = f.line + 1)),
e AS (SELECT line, 0 AS k, ended AS size FROM f WHERE ended > 0 UNION ALL SELECT line, 1, done FROM f WHERE done > 0)
SELECT line // 1000 AS batch, (row_number() OVER (PARTITION BY line // 1000 ORDER BY line, k) - 1)::INT AS i, size::INT AS size FROM e"""


def bat01_micro(spark, d):
    t = D.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey")
    return t.groupBy(F.floor(F.col("line_no") / 32).alias("micro")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def agg34_length_cdf(spark, d):
    from pyspark.sql import Window

    t = read(spark, d, "documents").groupBy((F.floor(F.col("n_chars") / 1000) * 1000).alias("bucket")).agg(F.count("*").alias("n"))
    # One row for each bucket.
    w = Window.orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy())
    return t.select("bucket", "n", F.sum("n").over(w).alias("running"), (F.sum("n").over(w) / total).alias("share"))


AGG34 = "SELECT n_chars // 1000 * 1000 AS bucket, count(*) AS n, sum(count(*)) OVER (ORDER BY n_chars // 1000)::BIGINT AS running, sum(count(*)) OVER (ORDER BY n_chars // 1000)::DOUBLE / sum(count(*)) OVER () AS share FROM documents GROUP BY n_chars // 1000"


def agg38_reward_accuracy(spark, d):
    t = read(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.avg((F.col("l_discount") > F.col("l_tax")).cast("double")).alias("accuracy"))


def agg39_category_accuracy(spark, d):
    t = read(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("double").alias("ok"))
    return t.rollup("o_orderpriority").agg((F.avg("ok") * 100).alias("accuracy"), F.count("*").alias("n")).withColumn("category", F.coalesce("o_orderpriority", F.lit("Average"))).drop("o_orderpriority")


def agg40_perplexity(spark, d):
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.exp(F.avg("l_tax")).alias("ppl"))
    return t.agg(F.avg("ppl").alias("mean_ppl"), F.count("*").alias("n"))


def agg43_running_mean(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("mean"))


def flt10_shards(spark, d):
    return read(spark, d, "orders").groupBy(F.pmod("o_custkey", F.lit(8)).alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("problems"))


def flt18_uncovered(spark, d):
    covered = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).where("c_custkey % 5 <> 0")
    return read(spark, d, "customer").select("c_custkey").join(covered, "c_custkey", "left_anti")


def jn10_expansion(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("exec_idx"))


def agg46_merged_shards(spark, d):
    """Two shards with overlapping keys: the later file wins, failures add up."""
    t = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_suppkey", F.lit(2)).alias("file"), "l_discount", "l_partkey")
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_discount", F.struct("file", "l_partkey", "l_discount")).alias("score"), F.count("*").alias("written"))


QUERIES = {
    "prj08_alpaca": (prj08_alpaca, PRJ08),
    "prj09_sharegpt": (prj09_sharegpt, PRJ09),
    "prj10_openai": (prj10_openai, PRJ10),
    "prj13_v1_alpaca": (prj13_v1_alpaca, PRJ13),
    "prj14_v1_sharegpt": (prj14_v1_sharegpt, PRJ14),
    "flt10_shards": (flt10_shards, "SELECT o_custkey % 8 AS shard, count(*) AS n, count(DISTINCT o_custkey) AS problems FROM orders GROUP BY 1"),
    "flt11_valid_examples": (flt11_valid_examples, FLT11),
    "flt18_uncovered": (flt18_uncovered, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 <> 0)"),
    "jn10_expansion": (jn10_expansion, "SELECT c_custkey, unnest([0, 1, 2, 3]) AS exec_idx FROM customer"),
    "agg46_merged_shards": (agg46_merged_shards, "SELECT l_orderkey, l_linenumber, arg_max(l_discount, (l_suppkey % 2, l_partkey, l_discount)) AS score, count(*) AS written FROM lineitem GROUP BY ALL"),
    "mix01_concat": (mix01_concat, MIX01),
    "mix02_under": (_mix("under"), MIX_UNDER),
    "mix02_over": (_mix("over"), MIX_OVER),
    "mix02_once": (_mix("once"), MIX_ONCE),
    "mix02_probabilities": (mix02_probabilities, "SELECT 0 AS source, count(*) AS n FROM supplier UNION ALL SELECT 1, count(*) FROM nation"),
    "spl01_split": (spl01_split, "SELECT 'test' AS part, floor(count(*) * 0.1)::BIGINT AS n FROM customer UNION ALL SELECT 'train', count(*) - floor(count(*) * 0.1)::BIGINT FROM customer"),
    "smp01_num_samples": (smp01_num_samples, "SELECT 60 AS n, count(*) AS different FROM nation"),
    "jn15_few_shot": (jn15_few_shot, "SELECT s_suppkey, 5 AS n, 5 AS different FROM supplier"),
    "win10_previous": (win10_previous, WIN10),
    "src02_bounded": (src02_bounded, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no FROM orders QUALIFY line_no < 100"),
    "src15_preview": (src15_preview, "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 2 OFFSET 6"),
    "tok06_blocks": (tok06_blocks, TOK06),
    "tok07_truncated": (tok07_truncated, TOK07),
    "pck01_knapsacks": (pck01_knapsacks, PCK01),
    "bat01_micro": (bat01_micro, "SELECT i // 32 AS micro, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) GROUP BY 1"),
    "bat02_dynamic": (bat02_dynamic, BAT02),
    "agg34_length_cdf": (agg34_length_cdf, AGG34),
    "agg38_reward_accuracy": (agg38_reward_accuracy, "SELECT l_returnflag, avg((l_discount > l_tax)::INT::DOUBLE) AS accuracy FROM lineitem GROUP BY 1"),
    "agg39_category_accuracy": (agg39_category_accuracy, "SELECT coalesce(o_orderpriority, 'Average') AS category, avg((o_orderstatus = 'F')::INT::DOUBLE) * 100 AS accuracy, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)"),
    "agg40_perplexity": (agg40_perplexity, "SELECT avg(p) AS mean_ppl, count(*) AS n FROM (SELECT exp(avg(l_tax)) AS p FROM lineitem GROUP BY l_orderkey)"),
    "agg43_running_mean": (agg43_running_mean, "SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1"),
}
