"""Readers, writers, the registry and verification of chains."""

import json

import pytest
from pyspark.sql import functions as F

from stepforge.operators import verify
from stepforge.operators.labels import load_bearing  # noqa: F401
from stepforge.sources import files, registry


def test_jsonl_numbered(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("".join(json.dumps({"problem": f"q{i}", "answer": str(i)}) + "\n" for i in range(50)))
    got = files.jsonl(spark, str(p), "problem string, answer string", numbered=True).orderBy("line_no").collect()
    assert [(r.line_no, r.problem) for r in got] == [(i, f"q{i}") for i in range(50)]
    assert files.rows_at(files.jsonl(spark, str(p), "problem string", True), slice(2, 6, 2)).count() == 2


def test_shards(spark, tmp_path):
    for name, score in (("s0", 0.5), ("s1", 1.0)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"parse_fail": 1, "covered_probs": [3], "step_score": {"3:0": {"0": score, "1": None}}, "plan_score": {"3:0": score}}, indent=1))
    t = files.shards(spark, str(tmp_path / "*.json"))
    assert [tuple(r) for r in files.shard_scores(t).orderBy("step").collect()] == [(3, 0, 0, 1.0), (3, 0, 1, None)]
    assert files.shard_plan_scores(t).first().plan_score == 1.0 and not files.mixed_schemes(t)
    files.write_shards(files.shard_scores(t), str(tmp_path / "out"), 2)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.first().step_score["3:0"]["0"] == 1.0


def test_registry(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"q": "a", "r": "b"}\n')
    (tmp_path / "dataset_info.json").write_text(json.dumps({"d": {"file_name": "d.json", "columns": {"prompt": "q", "system": "none"}}, "h": {"hf_hub_url": "x/y", "file_name": "d.json"}}))
    r = registry.Registry.open(str(tmp_path))
    assert r["h"].load_from == "hf_hub" and tuple(r.read(spark, "d").first()) == ("a", None)
    r.upsert("e", {"file_name": "d.json"})
    assert registry.Registry.open(str(tmp_path)).read(spark, "e").columns == ["q", "r"]
    with pytest.raises(NotImplementedError):
        r.read(spark, "h")
    assert r.read(spark, "h", {"hf_hub": lambda s, e: s.range(2)}).count() == 2
    (tmp_path / "mix").mkdir()
    (tmp_path / "mix" / "a.csv").write_text("x")
    (tmp_path / "mix" / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        files.format_of(str(tmp_path / "mix"))


def test_verification(spark):
    step = lambda c, code, out: (c, False, code, "", True, out)
    plan = [("P1", "d", "COMPUTE")]
    rows = [
        (1, 0, 0, plan, [step("P1", "x = 2", "x = 2"), step("P2", "y = x + 1\nprint(y)", "y = 3")], "3", 0, True, None, None),
        (1, 0, 1, plan, [step("P1", "x = 2", "x = 2"), step("P2", "y = x + 1\nprint(y)", "y = 3")], "3", 0, True, None, None),
        (1, 0, 2, plan, [step("P1", "x = 2", "x = 2"), step("P2", "y = x + 2\nprint(y)", "y = 4")], "5", 0, False, None, None),
    ]
    chains = spark.createDataFrame(rows, files.TRAJECTORY)
    adherence = chains.select("prob_idx", "plan_idx", "exec_idx", F.posexplode("steps").alias("step", "s")).select("prob_idx", "plan_idx", "exec_idx", "step", F.lit("faithful").alias("adherence"))
    got = {(r.exec_idx, r.step): (r.verdict, r.provenance) for r in verify.verified(chains, adherence).collect()}
    assert all(got[e, 0] == ("PASS", "corroborated") for e in range(3))
    assert got[0, 1] == got[1, 1] == ("PASS", "outcome_consistent") and got[2, 1] == ("FAIL", "localized_fail")
    flags = verify.integrity(chains).collect()
    assert [(r.exec_idx, r.flag) for r in flags] == [(2, "ungrounded_final_answer")]
