"""The pipeline against a brute-force version, stage by stage."""

import collections
import hashlib
import re

from tokenizers import Tokenizer

from stepforge.llm import mixing, rules, secrets
from stepforge.llm.common import table, tokenizer_path
from tests.llm.test_operators import base_statistics, brute_components

corpus_pipeline = __import__("corpus_pipeline")


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in rules.accepted(docs, table(spark, sf, "labels")).collect()}
    for d, r in rows.items():
        n, _, _, _, again = base_statistics(r.text)
        if n < 50 or 100 * again > 50 * n:
            assert d not in kept
    passing = [d for d, r in rows.items() if (s := base_statistics(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    assert all(d in kept for d in passing if labels.get(d) == 1)
    stays = {d for d, (_, c) in brute_components([(d, rows[d].text) for d in kept], 5).items() if c == d}
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(stays)
    # What run returns has the order of the mix, and its leading rows hold the weights.
    left = spark.createDataFrame([(r.doc_id, r.source) for r in got], "doc_id long, source string")
    want = {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixing.mixed(left).collect()}
    order = [r.doc_id for r in sorted(got, key=lambda r: r.mix_no)]
    assert [r.mix_no for r in sorted(got, key=lambda r: r.mix_no)] == list(range(len(got)))
    assert order == sorted(want, key=want.get)
    held = mixing.held_rows(collections.Counter(r.source for r in got))
    assert all(r.mix_surplus == (r.mix_no >= held) for r in got) and 0 < held
    for r in got:
        text = secrets.without(rows[r.doc_id].text, secrets.scan([rows[r.doc_id].text], path)[0])
        assert (r.text, r.n_chars, r.source) == (text, len(text), rows[r.doc_id].source)
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert not re.search("AKIA[A-Z0-9]{14,}", r.text)


def test_mixing_stage_orders(spark, sf):
    docs = table(spark, sf, "documents")
    out = corpus_pipeline.mixing(spark, docs, sf)
    assert out.columns == docs.columns
    order = [r.doc_id for r in out.collect()]
    want = [r.doc_id for r in sorted(mixing.mixed(docs.select("doc_id", "source", "text", "lang", "n_chars")).collect(), key=lambda r: (r.mix_slot, r.mix_offset))]
    assert order == want


def test_held_rows():
    weights = {"a": 0.5, "b": 0.3, "it's": 0.2}
    for counts in ({"a": 500, "b": 900, "it's": 90}, {"a": 7, "b": 1, "it's": 2, "other": 0}, {"b": 40}, {}):
        share = mixing.shares({mixing.OTHER: 0.2} | weights, 100)
        at, taken, slot = 0, collections.Counter(), 0
        frame = mixing._simulated(share)
        while any(counts.values()):
            s = frame[slot % 100]
            if counts.get(s):
                if taken[s] >= counts[s]:
                    break
                step = min(4, counts[s] - taken[s])
                taken[s] += step
                at += step
            slot += 1
        assert mixing.held_rows(counts, weights, 100, 4) == at


def test_mix_of_maps_and_quotes(spark):
    rows = [(i, "it's" if i % 2 else "b", {"k": i}) for i in range(50)] + [(1, "it's", {"k": 99})]
    t = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, m map<string, int>"), {"it's": 0.6, "b": 0.4}, buckets=8).collect()
    assert len(t) == 51 and {r.m["k"] for r in t} == {*range(50), 99} and {r.source for r in t} == {"it's", "b"}


def test_stages_odd(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c d e f " * 20, "en", "src1", 9), (2, "", "en", "src1", 0), (2, "", "en", "src1", 0), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 1), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 1)], docs.schema)
    for t in (odd, docs.limit(0)):
        now = t
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            rows = now.collect()
            if name != "bpe":
                assert now.columns == docs.columns
        assert [r.doc_id for r in rows] == ([3] if t is odd else [])
