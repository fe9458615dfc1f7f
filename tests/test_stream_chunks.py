"""Chunks detected once on a stream: the same spans as in batch, and a detector that is asked no more than it must."""

import random
import uuid
from pathlib import Path

import pytest

from cloakwork.operators.detect import ScriptedDetector
from cloakwork.operators.redaction import EngineConf, detect_distinct_chunks
from cloakwork.streaming.chunks import detect_stream
from cloakwork.streaming.processor import ROCKSDB

SCHEMA = "id long, text string"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def counted(folder):
    class Counted(ScriptedDetector):  # made here, so that it travels whole
        """Notes every text that it is asked for in a folder."""

        def detect(self, text):
            (Path(folder) / uuid.uuid4().hex).write_text(text)
            return ScriptedDetector.detect(self, text)

    return Counted([("Bob", "private_person"), ("sesame", "secret")])


def noted(folder):
    return [f.read_text() for f in Path(folder).iterdir()]


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    spark.conf.set(NO_DATA, "false")
    yield spark
    spark.conf.set(name, before)
    spark.conf.unset(NO_DATA)


def test_a_stream_with_repeats_equals_the_batch(rocks, tmp_path):
    rnd = random.Random(4)
    shared = " ".join(rnd.choice(("Bob", "sesame", "said", "é日", "open")) for _ in range(60))
    texts = [shared] * 6 + [shared + " tail Bob", "Bob" * 40, "xBobx" * 30, None, "", "ab"] + [" ".join(rnd.choice(("Bob", "sesame", "a", "日本")) for _ in range(rnd.randint(1, 80))) for _ in range(10)]
    rows = list(enumerate(texts)) + [(0, shared), (3, "another Bob of the same key"), (None, "no key, Bob")]
    asked, want = tmp_path / "asked", tmp_path / "want"
    asked.mkdir(), want.mkdir()
    conf = EngineConf(b"n" * 16, counted(str(asked)), chunk_target=64, chunk_overlap=8)
    for n in range(2):  # repeats within and over batches, and a restart between them
        rocks.createDataFrame([r for i, r in enumerate(rows) if i % 2 == n], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = detect_stream(source, conf, ["id"], lots=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(90) and query.exception() is None
    got = sorted((str(tuple(r)) for r in rocks.read.parquet(str(tmp_path / "out")).collect()))
    batch = EngineConf(b"n" * 16, counted(str(want)), chunk_target=64, chunk_overlap=8)
    distinct = sorted(set(rows), key=str)
    # by key and text, as a key may bring two texts
    table = rocks.createDataFrame([(n, *r) for n, r in enumerate(distinct)], f"n long, {SCHEMA}")
    spans = detect_distinct_chunks(table, batch, ["n", "id"]).drop("n")
    assert got == sorted(str(tuple(r)) for r in spans.collect()) and len(got) > 100
    texts_asked = noted(asked)
    assert len(texts_asked) == len(set(texts_asked)) and set(texts_asked) == set(noted(want))
