"""Every registered text query on the smallest sample, with its SQL where there is one, and the pipeline."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from runlens.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = compare.normal(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in ORACLE_SQL:
        assert got == compare.oracle(FOLDER, ORACLE_SQL[name])


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_takes_each_stage_to_effect(spark):
    from runlens.llm import decontamination, jaccard_join, toxicity
    from runlens.llm.registry import stored, table

    docs = table(spark, FOLDER, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER), "stage")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.train(before, table(spark, FOLDER, "labels"))
            want = {r.doc_id for r in toxicity.score(before, model).where("score < 0.5").collect()}
        elif name == "n-gram Jaccard join":
            want = {r.component_id for r in jaccard_join.join(before).collect()}
        elif name == "benchmark decontamination":
            bad = {r.doc_id for r in decontamination.leaks(before, table(spark, FOLDER, "benchmark")).collect()}
            want = {r.doc_id for r in before.collect()} - bad
        else:
            assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
            continue
        assert kept[name] == want
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert docs.columns == [*corpus_pipeline.COLUMNS, "shard", "slot"]
    assert kept["sharding"] == kept["mixing sources to target weights"]
