"""The stateful processor: whatever way lines come, the result is that of whole streams in batch."""

import json
import random
import time

import pytest

from cloakwork.kernels import jsonwalk
from cloakwork.streaming.processor import REST, ROCKSDB, restore_lines
from cloakwork.streaming.restore import restore_batch

SCHEMA = "stream_id string, seq long, line string, closes boolean, kind string, mapping array<struct<from:string,to:string>>, part int"

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def event(said):
    return "data: " + json.dumps({"choices": [{"delta": {"content": said}}]})


def cut(stream, text, pairs, part):
    """Rows of a stream of five-letter deltas; ``part`` says in which batch each comes. The first line brings the kind and half of the mapping, the second the rest."""
    lines = [event(text[n : n + 5]) for n in range(0, len(text), 5)] + ["", "data: [DONE]"]
    half = len(pairs) // 2
    given = {0: pairs[:half], 1: pairs[half:]}
    rows = [(stream, n, line, False, jsonwalk.CHAT if n == 0 else None, given.get(n), part(n)) for n, line in enumerate(lines)]
    return [*rows, (stream, len(lines), None, True, None, None, part(len(lines)))]


def play(spark, rows, folder, batches, **options):
    """The rows out of a query that is started anew for every batch, from its checkpoint."""
    spark.conf.set(NO_DATA, "false")  # a query with timers would go on for ever
    for n in range(batches):
        own = [r for r in rows if r[-1] == n]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        query = restore_lines(source, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(60) and query.exception() is None
    spark.conf.unset(NO_DATA)
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("stream_id", "seq", "ord", "line").collect()))


def test_any_order_repeats_and_restarts_give_the_batch_result(rocks, tmp_path):
    rnd, rows = random.Random(5), []
    for s in range(12):
        pairs = [("Bob Lee", "OG_PRIVATE_PERSON_0001"), ("a@b.io", "OG_PRIVATE_EMAIL_0002"), ("日本", "OG_SECRET_0003"), ("k", "OG_SECRET_0004")][: rnd.randint(0, 4)]
        text = " ".join(rnd.choice([p for _, p in pairs] + ["said", "é", "OG_", "to"]) for _ in range(12))
        rows += cut(f"s{s}", "plain begin " + text, pairs, lambda n: rnd.randint(0, 1))  # a part of the numbers is missing at first
    again = [r[:-1] + (1,) for r in rnd.sample(rows, 40)]  # sent twice
    whole = {r[0]: [p for q in rows if q[0] == r[0] and q[5] for p in q[5]] for r in rows}
    want = restore_batch(rocks.createDataFrame([(*r[:5], whole[r[0]], r[6]) for r in rows], SCHEMA))
    shuffled = rows + again
    rnd.shuffle(shuffled)
    got = play(rocks, shuffled, str(tmp_path), 2)
    assert got == sorted(map(tuple, want.collect())) and len({r[0] for r in got}) == 12


def test_a_restart_inside_a_placeholder(rocks, tmp_path):
    rows = cut("s", "hi OG_PRIVATE_PERSON_0001!", [("Bob", "OG_PRIVATE_PERSON_0001")], lambda n: 0 if n < 3 else 1)
    rows = [r[:5] + ([("Bob", "OG_PRIVATE_PERSON_0001")] if r[1] == 0 else None,) + r[6:] for r in rows]
    rows += [("s", 2, event("twice"), False, None, None, 1)]
    got = play(rocks, rows, str(tmp_path), 2)
    told = "".join(json.loads(line[6:])["choices"][0]["delta"]["content"] for _, _, _, line in got if line.startswith("data: {"))
    assert told == "hi Bob!" and [r[1] for r in got if r[1] < 3] == [0, 1, 2]


def test_a_silent_stream_lets_out_what_waits_and_what_is_held(rocks, tmp_path):
    pairs = [("Bob", "OG_SECRET_0001")]
    rows = [("q", 0, event("a OG_SEC"), False, jsonwalk.CHAT, pairs, 0), ("q", 2, event("RET"), False, None, None, 0), (None, None, event("no number"), False, None, None, 0)]
    rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = restore_lines(source, idle_ms=4000).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 90
        got = []
        while time.time() < deadline and len(got) < 3:
            time.sleep(0.5)
            got = sorted(tuple(r) for r in rocks.table("silent").collect())
        assert [(r[1], r[2] >= REST) for r in got] == [(0, False), (2, False), (2, True)]
        told = "".join(json.loads(r[3][6:])["choices"][0]["delta"]["content"] for r in got)
        assert told == "a OG_SECRET"
    finally:
        query.stop()
