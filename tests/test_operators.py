import json
import pickle
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cloakwork.functions.sql import register
from cloakwork.kernels import jsonwalk
from cloakwork.operators import jobs, redaction, requests, tokens
from cloakwork.operators.detect import DetectorUnavailable, OnnxDetector, RecentDetector, ScriptedDetector, get_detector
from cloakwork.operators.redaction import EngineConf
from cloakwork.plans import catalog
from cloakwork.sources import models
from cloakwork.sources.lookup_model import lookup_model
from cloakwork.streaming.restore import restore_batch, restore_stream

SF = "/root/testdata/sf0.001"
CONF = EngineConf(b"n" * 16, ScriptedDetector([("Bob", "private_person"), ("secret", "secret")]))


def test_documents_keep_their_columns_and_fail_closed(spark):
    class Broken:
        def detect(self, text):
            raise RuntimeError("model lost")

    docs = spark.createDataFrame([(1, "Bob has a secret", "x"), (2, None, "y"), (3, "", None), (4, "é Bob", "z")], "id long, text string, mapping_note string")
    got = {r["id"]: r for r in redaction.redact_documents(docs, CONF).collect()}
    assert "Bob" not in got[1]["redacted"] and len(got[1]["mapping"]) == 2 and got[1]["mapping_note"] == "x"
    assert got[2]["redacted"] is None and got[3]["redacted"] == "" and got[4]["redacted"].startswith("é OG_PRIVATE_PERSON_")
    failed = redaction.redact_documents(docs, EngineConf(b"n" * 16, Broken())).where("id = 1").first()
    assert failed["redacted"] is None and failed["status"] == redaction.FAILED
    assert redaction.redact_documents(docs.limit(0), CONF).count() == 0


def test_columns_that_clash_are_named(spark):
    for name in ("status", "Redacted", "mapping"):
        with pytest.raises(ValueError, match=name):
            redaction.redact_documents(spark.createDataFrame([(1, "Bob", 2)], f"id long, text string, {name} int"), CONF)
    odd = spark.createDataFrame([(1, "Bob", 2, 3, 4)], "id long, text string, _text int, `a.b` int, body int")
    assert redaction.redact_documents(odd, CONF).columns == ["id", "_text", "a.b", "body", "redacted", "mapping", "status"]
    row = redaction.redact_documents(odd, CONF).first()
    assert (row["_text"], row["a.b"], row["body"]) == (2, 3, 4)
    with pytest.raises(ValueError, match="status"):
        redaction.redact_requests(spark.createDataFrame([("anthropic", "{}", 1)], "kind string, body string, status int"), CONF)


def test_odd_json_stops_no_job(spark):
    rows = [(1, "anthropic", '{"messages":[null,{"content":"\\ud800 Bob"}]}'), (2, "openai_responses", '{"input":[null,{"content":"\\udfff Bob"}]}')]
    table = spark.createDataFrame(rows, "id long, kind string, body string")
    assert [r[0] for r in table.select(F.explode(redaction.extract_fields(F.col("kind"), F.col("body"))["text"])).collect()] == ["� Bob"] * 2
    assert [r[0] for r in table.select(F.explode(redaction.json_strings(F.col("body")))).collect()] == ["� Bob"] * 2
    assert all(r["status"] == "ok" and "Bob" not in r["body"] for r in redaction.redact_requests(table, CONF).collect())
    said = json.dumps({"choices": [{"delta": {"content": "\ud83d OG_P_1"}}]})
    lines = spark.createDataFrame([("s", 0, "data: " + said, True, jsonwalk.CHAT, [("Bob", "OG_P_1")])], "stream_id string, seq long, line string, closes boolean, kind string, mapping array<struct<from:string,to:string>>")
    assert _said(restore_batch(lines).collect()) == "� Bob"


def test_a_new_nonce_for_each_job():
    assert len(EngineConf().nonce) == redaction.NONCE_BYTES and EngineConf().nonce != EngineConf().nonce


def test_requests_are_refused_before_anything_is_read(spark):
    secret, now = b"k" * 32, 1_700_000_000
    token = spark.range(1).select(tokens.mint(F.lit(5), secret, 60, now)).first()[0]
    good = json.dumps({"messages": [{"content": "Bob"}]})
    rows = [(1, f"/_k/{token}/v1/messages", good), (2, "/_k/x/v1/messages", good), (3, "/v1/messages", good), (4, f"/_k/{token}/v1/messages", good + " " * 200), (5, f"/_k/{token}/v1/messages", "{"), (6, f"/_k/{token}", None)]
    table = spark.createDataFrame([(*r[:1], "POST", r[1], None, {"Host": "h", "A": "b"}, r[2]) for r in rows], "id long, method string, path string, query string, headers map<string,string>, body string")
    got = {r["id"]: r for r in jobs.forward_requests(table, CONF, secret, "http://up/", now, 100).collect()}
    assert [got[n]["status_code"] for n in range(1, 7)] == [200, 401, 401, 413, 502, 200]
    assert got[1]["url"] == "http://up/v1/messages" and "Bob" not in got[1]["body"] and got[1]["upstream_headers"] == {"A": "b", "Accept-Encoding": "identity"}
    assert all(got[n]["body"] is None and got[n]["url"] is None and got[n]["upstream_headers"] is None for n in (2, 3, 4, 5))
    assert got[6]["url"] == "http://up/" and got[6]["body"] == "" and json.loads(got[4]["error"]) == {"error": {"message": "request body too large"}}
    assert {r["status_code"] for r in jobs.forward_requests(table, CONF, secret, "http://up", now + 60, 100).collect()} == {401}


def test_answers(spark):
    pairs = [("Bob", "OG_P_1")]
    stream = "".join("data: " + json.dumps({"choices": [{"delta": {"content": t}}]}) + "\n\n" for t in ("OG_", "P_1"))
    rows = [(1, jsonwalk.CHAT, "application/json", '{"a":"OG_P_1"}', pairs), (2, jsonwalk.CHAT, None, stream, pairs), (3, jsonwalk.CHAT, "text/event-stream", "OG_P_1", []), (4, jsonwalk.CHAT, None, None, pairs), (5, "passthrough", "x", "OG_P_1", None)]
    table = spark.createDataFrame(rows, "id long, kind string, content_type string, body string, mapping array<struct<from:string,to:string>>")
    got = {r["id"]: (r["mode"], r["body"]) for r in jobs.restore_answers(table).collect()}
    assert got[1] == ("buffered-restore", '{"a":"Bob"}') and got[3] == ("passthrough", "OG_P_1") and got[4] == ("stream-restore", None) and got[5] == ("passthrough", "OG_P_1")
    assert got[2][0] == "stream-restore" and "".join(json.loads(x[6:])["choices"][0]["delta"]["content"] for x in got[2][1].split("\n") if x) == "Bob"


def test_lookup_model_finds_spans_and_travels(spark):
    model, words = lookup_model({"Ada": (0, 4, 0, 0, 0), "Byron": (0, 0, 0, 4, 0)}, (4, 0, 0, 0, 0))
    detector = OnnxDetector(model, words, ["O", "B-private_person", "I-private_person", "E-private_person", "S-secret"])
    assert [s[:3] for s in detector.detect("é Ada  Byron met Ada")] == [(3, 13, "private_person")] and detector.detect("") == []
    assert detector.detect("Ada Byron")[0][3] == pytest.approx(54.598 / 58.598, abs=1e-4)
    table = spark.createDataFrame([(1, "say Ada Byron"), (2, None)], "id long, text string")
    assert redaction.redact_documents(table, EngineConf(b"n" * 16, detector)).where("id = 1").first()["mapping"][0]["from"] == "Ada Byron"


def test_requests(spark):
    good = json.dumps({"model": "Bob", "messages": [{"role": "user", "content": "Bob secret Bob"}]})
    rows = [(1, "anthropic", good), (2, "anthropic", "{"), (3, "passthrough", "Bob")]
    got = {r["id"]: r for r in redaction.redact_requests(spark.createDataFrame(rows, "id long, kind string, body string"), CONF).collect()}
    body = json.loads(got[1]["body"])
    assert body["model"] == "Bob" and "Bob" not in body["messages"][0]["content"]
    assert got[2]["body"] is None and got[2]["status"] == redaction.FAILED and got[3]["body"] == "Bob"


def test_routes(spark):
    rows = [("POST", "/v1/messages", "anthropic"), ("GET", "/v1/messages", "passthrough"), ("POST", "/x/v1/chat/completions//", "openai_chat"), ("POST", "/v1/responses", "openai_responses"), ("POST", "/backend-api/codex/responses", "openai_responses"), ("POST", "/v1/messages/count", "passthrough")]
    for r in spark.createDataFrame(rows, "m string, p string, want string").select("want", requests.route(F.col("m"), F.col("p")).alias("got")).collect():
        assert r["got"] == r["want"]
    headers = spark.sql("select map('Connection', 'x', 'Accept', 'y', 'TE', 'z') h").select(requests.strip_hop_headers(F.col("h")).alias("h")).first()["h"]
    assert headers == {"Accept": "y"}


def test_dedup_and_fused_paths_agree(spark):
    docs = spark.createDataFrame([(n, ("Bob " * 30 + "\n") * (n + 1) + "secret") for n in range(5)], "id long, text string")
    conf = EngineConf(b"n" * 16, CONF.detector, chunk_target=128, chunk_overlap=16)
    found = redaction.detect_distinct_chunks(docs, conf, ["id"])
    got = sorted((r["id"], r["start"], r["end"], r["class"]) for r in found.collect())
    want = sorted((r["id"], s[0], s[1], s[2]) for r in docs.collect() for s in redaction.find_spans(r["text"], conf))
    assert got == want


def test_request_mapping_keeps_the_first(spark):
    rows = [(1, 0, 0, "a", "x"), (1, 1, 0, "a", "y"), (1, 1, 1, "b", "z")]
    got = redaction.request_mapping(spark.createDataFrame(rows, "r long, field_ord int, pair_ord int, from string, to string"), ["r"]).first()["mapping"]
    assert [(p["from"], p["to"]) for p in got] == [("a", "x"), ("b", "z")]


def test_unknown_detector():
    with pytest.raises(DetectorUnavailable):
        get_detector("none")
    with pytest.raises(DetectorUnavailable):
        get_detector("onnx", model_path="/nowhere", tokenizer_path="/nowhere", labels=["O"])


def test_sql_functions(spark):
    register(spark, CONF)
    row = spark.sql("select cloak_redact('Bob!') r").select("r.*").first()
    assert row["text"].startswith("OG_PRIVATE_PERSON_")
    assert spark.sql("select cloak_restore(r.text, r.mapping) t from (select cloak_redact('Bob!') r)").first()["t"] == "Bob!"
    assert [tuple(r)[:3] for r in spark.sql("select * from cloak_spans('a Bob')").collect()] == [(2, 5, "private_person")]


def _lines(spark):
    event = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    rows = [("s", n, event(t), False, jsonwalk.CHAT, [("Bob", "OG_P_1")]) for n, t in enumerate(("hi OG", "_P_", "1!"))] + [("s", 9, None, True, jsonwalk.CHAT, [("Bob", "OG_P_1")])]
    return spark.createDataFrame(rows, "stream_id string, seq long, line string, closes boolean, kind string, mapping array<struct<from:string,to:string>>")


def _said(rows):
    return "".join(json.loads(r["line"][6:])["choices"][0]["delta"]["content"] for r in sorted(rows, key=lambda r: (r["seq"], r["ord"])) if r["line"].startswith("data: "))


def test_streams(spark, tmp_path):
    lines = _lines(spark)
    assert _said(restore_batch(lines.withColumn("mapping", F.when(F.col("seq") == 0, F.col("mapping")))).collect()) == "hi Bob!"
    assert _said(restore_batch(lines, every_row=True).collect()) == "hi Bob!"
    quiet = lines.withColumn("mapping", F.array().cast("array<struct<from:string,to:string>>")).withColumn("stream_id", F.lit("q"))
    for every_row in (False, True):
        both = restore_batch(lines.unionAll(quiet), every_row).collect()
        assert _said([r for r in both if r["stream_id"] == "q"]) == "hi OG_P_1!" and _said([r for r in both if r["stream_id"] == "s"]) == "hi Bob!"
    lines.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    query = restore_stream(source).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert _said(spark.table("restored").collect()) == "hi Bob!"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "events", "lineitem", "customer", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_recent_detector():
    class Counted:
        calls = 0

        def detect(self, text):
            self.calls += 1
            if text == "bad":
                raise RuntimeError("model lost")
            return [(0, 3, "secret", 1.0)]

    inner = Counted()
    recent = RecentDetector(inner, 2)
    for said in ("one", "two", "one", "six", "one", "two"):
        assert recent.detect(said) == [(0, 3, "secret", 1.0)]
    assert inner.calls == 4 and len(recent) == 2
    for _ in range(2):
        with pytest.raises(RuntimeError):
            recent.detect("bad")
    assert inner.calls == 6 and len(pickle.loads(pickle.dumps(RecentDetector(ScriptedDetector([("a", "secret")]))))) == 0
    recent.purge()
    assert len(recent) == 0
    with pytest.raises(ValueError):
        RecentDetector(inner, 0)


def test_model_list(spark, tmp_path):
    assert {r["cached"] for r in models.list_models(spark, tmp_path).collect()} == {False}
    name, _, files = models.CATALOG[1]
    for path, size in files:
        place = tmp_path / "models" / name / path
        place.parent.mkdir(parents=True, exist_ok=True)
        with place.open("wb") as file:
            file.truncate(size)  # sparse
    assert not models.is_cached(name, tmp_path)
    models.write_manifest(name, tmp_path)
    assert models.cache_root({"CLOAKWORK_CACHE_DIR": str(tmp_path)}) == tmp_path and models.cache_root({"XDG_CACHE_HOME": "/x"}) == models.Path("/x/cloakwork") and models.cache_root({"HOME": "/h"}) == models.Path("/h/.cache/cloakwork")
    assert {r["name"]: r["cached"] for r in models.list_models(spark, tmp_path).collect()} == {name: True, models.CATALOG[0][0]: False}
    assert models.delete_model(name, tmp_path) and not models.is_cached(name, tmp_path) and not models.delete_model(name, tmp_path)
    with pytest.raises(KeyError):
        models.delete_model("none", tmp_path)


def test_idle_stream_lets_go_of_what_it_holds(spark, tmp_path):
    lines = _lines(spark)
    lines.where("seq < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    query = restore_stream(source, idle_ms=500).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            said = _said(spark.table("idle").collect())
            if said == "hi OG_P_":
                break
        assert said == "hi OG_P_"
    finally:
        query.stop()


def test_a_model_folder_without_its_files_is_no_detector(tmp_path):
    with pytest.raises(DetectorUnavailable):
        get_detector("model", folder=str(tmp_path))
    (tmp_path / "config.json").write_text('{"id2label":{"0":"O"}}')
    with pytest.raises(DetectorUnavailable):
        get_detector("model", folder=str(tmp_path))
