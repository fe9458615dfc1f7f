"""The span store, and the streaming jobs that stand on it."""

import datetime

import pytest
from pyspark.sql import functions as F

from cloakwork.kernels import chunk, text
from cloakwork.operators import redaction
from cloakwork.operators.detect import RuleDetector, ScriptedDetector
from cloakwork.operators.redaction import EngineConf, find_spans
from cloakwork.operators.store import SpanStore, bucket
from cloakwork.streaming.jobs import BatchSink, answers_with_mappings, redact_stream

NONCE = b"store nonce"
CONF = EngineConf(NONCE, ScriptedDetector([("Ada", "private_person"), ("Ada Low", "private_person"), ("k9", "secret"), ("sesame", "secret")]), 64, 16)
LONG = " ".join(f"word{n} Ada Low said sesame" for n in range(40))


def failing():
    class Failing:  # a local class travels to the workers by value
        def detect(self, said):
            raise RuntimeError("must not be asked")

    return Failing()


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def spans(df):
    return sorted(tuple(r)[:4] for r in df.collect())


def test_a_second_run_detects_what_changed(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path), "scripted-1")
    first = [(1, LONG), (2, LONG), (3, "x" * 300 + "Ada"), (4, None), (5, ""), (6, "k9"), (7, "Ada")]
    assert spans(store.detect(docs(spark, first), CONF, ["id"])) == sorted((d, s, e, k) for d, t in first if t for s, e, k, _ in find_spans(t, CONF))
    held = store.read().count()
    assert held == len({c.text for _, t in first if t for c in chunk.split(t, 64, 16) if len(c.text.encode()) >= text.SPAN_MIN})
    # the same again: nothing is detected
    report = {r["id"]: r for r in store.report(docs(spark, first), EngineConf(NONCE, failing(), 64, 16), ["id"]).collect()}
    assert all(r["cached"] == r["chunks"] for r in report.values()) and report[4]["field_len"] is None and report[6]["chunks"] == 0 and report[7]["spans"] == 1
    # grown texts: the last chunk alone is new
    grown = [(d, None if t is None else t + " and Ada went") for d, t in first]
    report = {r["id"]: r for r in store.report(docs(spark, grown), CONF, ["id"]).collect()}
    assert report[1]["chunks"] - report[1]["cached"] == 1 == report[2]["chunks"] - report[2]["cached"]
    new = {c.text for _, t in grown if t for c in chunk.split(t, 64, 16)} - {c.text for _, t in first if t for c in chunk.split(t, 64, 16)}
    assert store.read().count() == held + len(new)
    fresh = SpanStore(spark, str(tmp_path), "scripted-2")
    assert spans(store.detect(docs(spark, grown), CONF, ["id"])) == spans(fresh.detect(docs(spark, grown), CONF, ["id"])) == spans(redaction.detect_distinct_chunks(docs(spark, grown), CONF, ["id"]))


def test_a_failing_detector_stores_nothing(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path), "failing")
    with pytest.raises(Exception, match="must not be asked"):
        store.detect(docs(spark, [(1, "some text")]), EngineConf(NONCE, failing()), ["id"])
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        SpanStore(spark, str(tmp_path), "../other")


def test_redaction_through_the_store(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path), "scripted")
    rows = [(1, LONG), (2, "Ada é Ada Low"), (3, None), (4, ""), (5, '"' + "sesame" * 9 + '" sesame'), (6, "nothing")]
    for conf in (CONF, EngineConf(NONCE, RuleDetector(), 64, 16)):
        store = SpanStore(spark, str(tmp_path), type(conf.detector).__name__)
        for _ in range(2):
            got = {r["id"]: r for r in store.redact(docs(spark, rows), conf, ["id"]).collect()}
            for d, t in rows:
                want = (None, []) if t is None else text.redact(t, find_spans(t, conf), NONCE)
                assert (got[d]["redacted"], [tuple(p) for p in got[d]["mapping"]], got[d]["status"]) == (*want, "ok")
    assert store.redact(docs(spark, []), CONF, ["id"]).count() == 0


def test_buckets_are_pruned(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path), "x")
    store.detect(docs(spark, [(n, f"text {n} Ada") for n in range(80)]), CONF, ["id"])
    some = store.read([3, 5])
    assert 0 < some.count() < store.read().count() and {r["b"] for r in some.select(bucket(F.col("hash")).alias("b")).collect()} <= {3, 5}
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString()


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    start = lambda: redact_stream(spark.readStream.schema("id long, text string").parquet(source), CONF, ["id"], "stream", f"{tmp_path}/store", out, f"{tmp_path}/state", availableNow=True)
    docs(spark, [(1, LONG), (2, LONG), (3, "k9 Ada")]).write.parquet(source)
    assert start().awaitTermination(120)
    docs(spark, [(4, LONG), (5, LONG + " sesame")]).write.mode("append").parquet(source)
    assert start().awaitTermination(120)
    sink = BatchSink(out)
    before = sorted(map(str, sink.read(spark).collect()))
    assert len(before) == 5
    newest = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()  # as if the driver had died before its commit
    for crc in (tmp_path / "state" / "commits").glob(f".{newest.name}.crc"):
        crc.unlink()
    stored = SpanStore(spark, f"{tmp_path}/store", "stream").read().count()
    assert start().awaitTermination(120)
    assert sorted(map(str, sink.read(spark).collect())) == before and SpanStore(spark, f"{tmp_path}/store", "stream").read().count() == stored
    batch = redaction.redact_documents(docs(spark, [(1, LONG), (2, LONG), (3, "k9 Ada"), (4, LONG), (5, LONG + " sesame")]), CONF)
    assert sorted(map(str, sink.read(spark).drop("batch").collect())) == sorted(map(str, batch.collect()))


def test_answers_wait_for_late_mappings(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    token = "OG_PRIVATE_PERSON_000001"
    answer = lambda k, minute: (k, at(minute), "passthrough", "text/plain", f"hi {token}")
    a_kind, m_kind = "request_id string, ts timestamp, kind string, content_type string, body string", "request_id string, ts timestamp, mapping array<struct<from:string,to:string>>"
    places = [f"{tmp_path}/a", f"{tmp_path}/m"]
    steps = [([answer("early", 0), answer("never", 0)], [("none", at(0), [])]), ([answer("z", 4)], [("early", at(3), [("Ada", token)])]), ([answer("y", 59)], [("x", at(59), [])]), ([answer("w", 59)], [("v", at(59), [])])]
    for k, (answers, mappings) in enumerate(steps):
        for place, rows, kind in zip(places, (answers, mappings), (a_kind, m_kind)):
            spark.createDataFrame(rows, kind).write.mode("append").parquet(place)
        streams = [spark.readStream.schema(kind).parquet(place) for place, kind in zip(places, (a_kind, m_kind))]
        query = answers_with_mappings(*streams, wait="5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        if k == 0:
            assert spark.read.parquet(f"{tmp_path}/out").count() == 0  # both answers are held
    got = {r["request_id"]: r["body"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["early"] == "hi Ada" and got["never"] == f"hi {token}" == got["z"] and "y" not in got
    whole = answers_with_mappings(spark.read.parquet(places[0]), spark.read.parquet(places[1]), "5 minutes").collect()
    assert {r["request_id"]: r["body"] for r in whole if r["request_id"] in got} == got
