"""Steps whose work or memory must not grow with what is judged or written at once."""

import glob
import itertools

import pyarrow as pa
from pyspark.sql import functions as F

from stepforge.functions import code as C
from stepforge.functions import extract as E
from stepforge.operators import labels as L
from stepforge.operators import verify as V
from stepforge.sources import files


def test_shards_are_bounded(spark, tmp_path):
    rows = [(p, t, s, p + t / 8 + s / 64) for p in range(10) for t in range(4) for s in range(3)]
    files.write_shards(spark.createDataFrame(rows, "prob_idx int, tpos int, step int, score double"), str(tmp_path / "x"), 2, most=5)
    found = files.shards(spark, str(tmp_path / "x/shard=*/*.json"))
    assert len(glob.glob(str(tmp_path / "x/shard=0/*.json"))) > 1 and found.agg(F.max(F.size("step_score"))).first()[0] < 20
    assert sorted(tuple(r) for r in files.shard_scores(found).collect()) == rows


def test_facts_once_for_each_code():
    seen = []
    got = C._once(pa.array(["a", None, "a", "b", None]), lambda c: seen.append(c) or c is None, pa.bool_())
    assert got.to_pylist() == [False, True, False, False, True] and len(seen) == 3


def test_patterns_judged_once(spark):
    V._pattern.cache_clear()
    rows = [[(v, c) for v, c in zip(vs, cs, strict=True)] for vs in itertools.product(("1", "2/2", "x <"), repeat=3) for cs in itertools.product((True, False, None), repeat=3)]
    one = lambda r, k: [{"exec_idx": 10 * i + k, "step": k, "value": v, "correct": c} for i, (v, c) in enumerate(r)]
    kind = pa.list_(pa.struct([("exec_idx", pa.int64()), ("step", pa.int32()), ("value", pa.string()), ("correct", pa.bool_())]))
    for k in (1, 2):
        got = V.judged_udf.func(pa.array([one(r, k) for r in rows], kind)).to_pylist()
        assert [[tuple(x.values()) for x in g] for g in got] == [V.judged(one(r, k)) for r in rows]
    assert V._pattern.cache_info().misses == len(rows)


def test_stalls_sort_once(spark):
    rows = [(c, i, x, "k") for c, xs in enumerate(("aaab", "aab", "abbbbcc", "a", "ccc", "abab")) for i, x in enumerate(xs)]
    t = spark.createDataFrame(rows, "chain_id int, step int, claimed string, code string")
    for run in (1, 2, 3, 4):
        got = {(r.chain_id, r.step): r.in_stall for r in L.stalls(t, run).collect()}
        want = {}
        for c, g in itertools.groupby(rows, lambda r: r[0]):
            for _, held in itertools.groupby(list(g), lambda r: r[2]):
                held = list(held)
                want |= {(c, r[1]): len(held) >= run for r in held}
        assert got == want, run
    assert L.stalls(t)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_has_value_is_last_value(spark):
    outs = ["", " ", "\n", "\x1c", "\x1d \x1e", "\x85", " ", " ", "a", " a: ", "=", "x = 1\n\n", "[timeout]", "[no output]", "a\nTraceback", "\x1f", None, " b", "\x0b\x0c"]
    t = spark.createDataFrame([(o,) for o in outs], "o string").select("o", E.has_value(F.col("o")).alias("a"), E.last_value(F.col("o")).isNotNull().alias("b"))
    assert [r for r in t.collect() if r.a is not r.b] == []
