"""Decoding and extraction of flattened payloads."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import payload
from runlens.operators import queue

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)

PLAIN = ('[{"resultData":"1"},{"error":"2","lastNodeExecuted":"3"},'
         '{"description":"4","httpCode":"5","status":404},"My Node","Boom {x}","503"]')
LISTED = '[["1"],{"resultData":"2","message":"6"},{"error":"3"},{"message":"4","name":"5"},"deep","NodeApiError","own"]'
LISTED_DIRECT = '[["1"],{"error":"2"},{"message":"3","node":"4"},"direct",{"name":"5","type":"6","id":"7"},"N","T","I"]'
LISTED_BARE = '[["1"],{"message":"2"},"only the root speaks"]'
EMPTY_DESCRIPTION = '[{"resultData":"1"},{"error":"2"},{"description":"3","message":"4"},"","said"]'
MISSING_PATH = '[{"resultData":"1"},{"error":"99"}]'
INLINE_NUMBER = '[{"resultData":"1"},{"error":"2"},{"message":5}]'
LOOKS_LIKE_JSON = '[{"resultData":"1"},{"error":"2"},"{\\"message\\":\\"no\\"}"]'
CYCLE = ('[{"resultData":"1","executionData":"4"},{"error":"2"},{"message":"3"},"round",'
         '{"metadata":"5"},{"self":"5"}]')
FRAME = ('[{"resultData":"1","executionData":"2"},{"error":"9"},{"nodeExecutionStack":"3","metadata":"12",'
         '"runtimeData":"14"},["8","4"],{"source":"5","data":"11"},{"main":"6"},["7"],'
         '{"previousNode":"10","previousNodeOutput":0},{"data":"12"},{"message":"10"},"Up","ignored",'
         '{"b":1.0,"a":["10",true,null,"13"]},{"deep":"10"},{"source":"10"}]')
DOUBLE = json.dumps([{"data": "1"}, PLAIN])
NOT_DOUBLE = json.dumps([{"data": "1", "resultData": "2"}, "plain text", {"error": "3"}, {"message": "4"}, "outer"])


def frame(spark, *texts):
    rows = [(i, f"w{i}", START, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "execution_id long, workflow_id string, started_at timestamp, data string")


def extracted(spark, *texts):
    out = payload.extract_errors(frame(spark, *texts), F.lit(None).cast("timestamp"))
    return {r["id"]: r for r in out.collect()}


def test_shapes(spark):
    texts = [PLAIN, LISTED, LISTED_DIRECT, LISTED_BARE, EMPTY_DESCRIPTION, MISSING_PATH, DOUBLE, NOT_DOUBLE]
    got = extracted(spark, *texts)
    assert [got[i].error_message for i in range(len(texts))] == [
        "Boom {x}", "deep", "direct", None, "said", None, "Boom {x}", "outer"]
    assert got[0].node_name == "My Node" and got[0].http_code == 503
    assert got[1].error_type == "NodeApiError" and got[1].node_name == "Unknown Node"
    assert (got[2].node_name, got[2].node_type, got[2].node_id) == ("N", "T", "I")
    assert got[3].error_category == got[5].error_category == "unparsed"


def test_values_that_are_no_references(spark):
    got = extracted(spark, INLINE_NUMBER, LOOKS_LIKE_JSON)
    assert got[0].error_message == "5"
    assert got[1].error_message is None


def test_undecodable_rows_drop_out(spark):
    got = extracted(spark, "not json", '{"a":1}', "", None, "[]", '["text"]', PLAIN)
    assert sorted(got) == [4, 5, 6]
    assert got[4].error_category == got[5].error_category == "unparsed"


def test_last_frame_and_subtrees(spark):
    row = extracted(spark, FRAME)[0]
    assert (row.source_node, row.source_output_index) == ("Up", 0)
    assert row.execution_source == "Up"
    assert row.input_data == '"ignored"'
    assert row.metadata == '{"b":1,"a":["Up",true,null,{"deep":"Up"}]}'


def test_cycle_gives_no_text(spark):
    row = extracted(spark, CYCLE)[0]
    assert row.error_message == "round" and row.metadata == ""


def test_trace_lookup_falls_back_to_the_root(spark):
    rows = {r["execution_id"]: r for r in payload.trace_lookup(
        frame(spark, PLAIN, LISTED_BARE, MISSING_PATH, "bad"), full=True).collect()}
    assert rows[1].message == "only the root speaks"
    assert rows[2].message == "Unknown error detail" and rows[2].node_name == "Unknown Node"
    assert 3 not in rows
    assert json.loads(rows[0].full_error)["resultData"]["error"]["description"] == "Boom {x}"


def test_cap_keeps_the_size(spark):
    rows = payload.capped(frame(spark, "é" * 10, "x" * 10), cap=15).orderBy("execution_id").collect()
    assert [(r.data, r.data_bytes) for r in rows] == [(None, 20), ("x" * 10, 10)]


def test_outcomes(spark):
    read = payload.capped(frame(spark, PLAIN, "bad", "x" * 300, "", None), cap=200)
    asked = spark.range(6)
    got = dict(queue.outcomes(asked, read, payload.extract(read)).collect())
    assert got == {0: "done", 1: "retry", 2: "oversized", 3: "done", 4: "done", 5: "vanished"}


@pytest.mark.parametrize("text", ['[{"a":"1"},{"b":"0"}]', '["1"]'])
def test_never_fails_on_odd_graphs(spark, text):
    assert extracted(spark, text)[0].error_category == "unparsed"


def _chain(n):
    return [{"resultData": "1"}, *[{"next": str(i + 2), "v": i} for i in range(n)], {"end": True}]


def test_deep_subtrees_are_written():
    items = _chain(10_000)
    text = payload._whole(items, ("resultData",))
    assert text.startswith('{"next":{"next":') and text.endswith('"v":1},"v":0}') and text.count('"next"') == 10_000
    nested = payload._whole([{"a": "1", "b": 2.0}, ["2", None, 7], {}], (), indent=2)
    assert nested == json.dumps({"a": [{}, None, 7], "b": 2}, indent=2)


def _doubling(n):
    return [{"resultData": "1"}, *[[str(i + 2), str(i + 2)] for i in range(n)], {"leaf": True}]


def test_shared_subtrees_have_one_form():
    def tree(n):
        return {"leaf": True} if n == 0 else [tree(n - 1)] * 2

    for n in (1, 3, 12):
        assert payload._whole(_doubling(n), ("resultData",)) == json.dumps(tree(n), separators=(",", ":"))
    assert payload._whole([{"r": "0"}], ()) == ""
    assert payload._whole([{"r": "1"}, ["2"], {"x": "1"}], ("r",)) == ""


def test_what_no_cell_can_hold_is_not_written():
    assert payload._whole(_doubling(200), ("resultData",)) == ""


def test_odd_leaves(spark):
    got = extracted(spark, '[{"resultData":"1"},{"error":"2"},{"message":"3","name":"\u00b2","status":"4"},"half \\ud800 pair"," 404x"]',
                    '[{"resultData":"1"},{"error":"2"},{"message":NaN}]', "[" * 5000 + "]" * 5000)
    assert got[0].error_message == "half ? pair" and got[0].http_code == 404
    assert 1 not in got


def test_decoding_is_one_arrow_step(spark):
    plan = payload.extract(frame(spark, PLAIN))._jdf.queryExecution().executedPlan().toString()
    assert "transform(array(" not in plan and plan.count("MapInArrow") == 1 and "EvalPython" not in plan
