"""Streams and answers read their input once, in one Python pass; jobs refuse columns that they would overwrite."""

import re

import pytest
from pyspark.sql import functions as F

from cloakwork.kernels import jsonwalk, sse
from cloakwork.operators import jobs
from cloakwork.plans import catalog
from cloakwork.streaming.restore import restore_batch


@pytest.mark.parametrize("name", ["sse_round_trip", "sse_chat", "sse_responses", "restored_answers"])
def test_plans_have_one_scan_and_one_python_pass(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert len(re.findall(r"MapInArrow|ArrowEvalPython|FlatMapGroups", plan)) == 1


def test_streams_over_several_batches(spark):
    event = lambda t: "data: " + '{"type":"response.output_text.delta","delta":"' + t + '"}'
    token = "OG_PRIVATE_PERSON_00000a"
    rows = []
    for n in range(12):
        parts = [token[k : k + 5] for k in range(0, len(token), 5)] * 9
        mapping = [("Ada", token)] if n % 3 == 0 else None
        rows += [(f"s{n:02}", k, event(p), k == len(parts) - 1, jsonwalk.RESPONSES, mapping if k == 0 else None) for k, p in enumerate(parts)]
    rows += [(None, 0, "data: x", False, None, None), ("empty", 0, None, True, None, None)]
    lines = spark.createDataFrame(rows, "stream_id string, seq long, line string, closes boolean, kind string, mapping array<struct<from:string,to:string>>").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a stream goes on in the next batch
    try:
        got = restore_batch(lines).orderBy("stream_id", "seq", "ord").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    said = {}
    for r in got:
        said[r["stream_id"]] = said.get(r["stream_id"], "") + r["line"].removeprefix("data: ").removeprefix('{"type":"response.output_text.delta","delta":"').removesuffix('"}')
    assert said == {f"s{n:02}": ("Ada" if n % 3 == 0 else token) * 9 for n in range(12)} | {None: "x"}


def test_text_without_blanks_is_settled():
    restorer = sse.Restorer(jsonwalk.RESPONSES, [("Ada", "OG_P_1")])
    for _ in range(50):
        restorer.feed('data: {"type":"response.output_text.delta","delta":"日本語、テスト。OG_P"}\n')
        assert len(restorer.state.content) <= 12


@pytest.mark.parametrize("clash", ["url", "error", "kind", "status_code", "mapping", "_auth"])
def test_jobs_refuse_what_they_would_overwrite(spark, clash):
    rows = spark.createDataFrame([("POST", "/x", None, {}, "{}")], "method string, path string, query string, headers map<string,string>, body string")
    with pytest.raises(ValueError, match="rename"):
        jobs.forward_requests(rows.withColumn(clash, F.lit(1)), catalog.CONF, b"s" * 32, "https://u.example")
    answers = spark.createDataFrame([("passthrough", "text/plain", "x", [])], "kind string, content_type string, body string, mapping array<struct<from:string,to:string>>")
    with pytest.raises(ValueError, match="rename"):
        jobs.restore_answers(answers.withColumn("mode", F.lit(1)))
