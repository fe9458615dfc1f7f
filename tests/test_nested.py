"""Values that stand inside another span only: no pair of their own, unless the job says so; the queries do, as their SQL does."""

import duckdb
import pytest

import __spark_entry__
from cloakwork.kernels import text
from cloakwork.operators import redaction
from cloakwork.operators.detect import RULES, RuleDetector
from cloakwork.operators.redaction import EngineConf
from cloakwork.operators.store import SpanStore

NONCE = b"nested nonce"
DIGITS = "1234567890123"
SECRET = f"ab{DIGITS}{'c' * 25}"
TEXTS = [f'key "{SECRET}" {SECRET} and a@b.co', f"see https://h.io/{DIGITS}?b={DIGITS} then {DIGITS}", f"mail {DIGITS}@b.co", "nothing", None]
RULES_ONLY = {False: [[SECRET, "a@b.co"], [f"https://h.io/{DIGITS}?b={DIGITS}", DIGITS], [f"{DIGITS}@b.co"], [], []], True: [[SECRET, DIGITS, "a@b.co"], [f"https://h.io/{DIGITS}?b={DIGITS}", DIGITS], [f"{DIGITS}@b.co", DIGITS], [], []]}


@pytest.mark.parametrize("nested", [False, True])
def test_pairs_of_values_inside_others(spark, tmp_path, nested):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    conf = EngineConf(NONCE, nested=nested)
    slow = EngineConf(NONCE, RuleDetector(RULES, unbroken=False), nested=nested)
    ways = [redaction.redact_documents(docs, conf), redaction.redact_documents(docs, slow), SpanStore(spark, str(tmp_path), "rules").redact(docs, conf, ["id"])]
    for out in ways:
        rows = out.orderBy("id").collect()
        assert [[p["from"] for p in r["mapping"]] for r in rows] == RULES_ONLY[nested]
        for r, t in zip(rows, TEXTS):
            assert t is None or text.restore(r["redacted"], [tuple(p) for p in r["mapping"]]) == t
    assert [s[:2] for s in redaction.find_spans(TEXTS[2], conf)] == [(5, 23)]  # what is reported is merged


@pytest.mark.parametrize("query", ["redact_documents", "residual_after_guard", "forwarded_requests", "redacted_bodies", "redact_unguarded", "round_trip"])
def test_queries_count_values_inside_others_as_their_sql(spark, tmp_path, query):
    docs = spark.createDataFrame([(n, t, "en", "web", 1) for n, t in zip((488, 2, 3, 5), TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = __spark_entry__.queries()[query](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        asked = con.execute(f"SELECT {', '.join(made.columns)} FROM ({__spark_entry__.oracle_sql()[query]})").fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(asked)
