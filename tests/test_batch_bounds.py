"""Python workers of the span store get few texts at once, whatever the session's bound on rows."""

import pytest

from cloakwork.operators import redaction
from cloakwork.operators.jobs import stored_field_log
from cloakwork.operators.redaction import BATCH_ROWS, EngineConf
from cloakwork.operators.store import SpanStore

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def counting():
    class Counting:  # a local class travels to the workers by value
        def detect_many(self, texts):
            if len(texts) > 128:
                raise RuntimeError(f"{len(texts)} texts at once")
            return [[(0, 4, "secret", 1.0)] for _ in texts]

    return Counting()


@pytest.fixture
def wide(spark):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    yield spark
    spark.conf.set(ROWS, before)


@pytest.mark.parametrize("way", ["stored_field_log", "store", "distinct"])
def test_few_chunks_at_once(wide, tmp_path, way):
    assert BATCH_ROWS == 128
    docs = wide.range(2000, numPartitions=1).selectExpr("id", "concat('text ', id) AS text", "'openai_responses' AS kind", "to_json(struct(concat('text ', id) AS input)) AS body")
    conf, store = EngineConf(b"n", counting()), SpanStore(wide, str(tmp_path), "counting")
    if way == "stored_field_log":
        out = stored_field_log(docs.select("id", "kind", "body"), conf, ["id"], store).where("spans = 1 AND chunks = 1 AND cached = 0")
    else:
        out = store.detect(docs, conf, ["id"]) if way == "store" else redaction.detect_distinct_chunks(docs, conf, ["id"])
    assert out.count() == 2000
    assert int(wide.conf.get(ROWS)) == BATCH_ROWS
