"""Redaction and chunking in DataFrame functions against the same in Python, byte for byte."""

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.kernels import chunk, text
from cloakwork.operators import native, redaction
from cloakwork.operators.detect import RULES, RuleDetector
from cloakwork.operators.redaction import EngineConf, find_spans

NONCE = b"native nonce"
PIECES = ["a@b.co", "x.y+z@mail.example.org", "4111111111111", "12345678901234567890", "https://h.io/a?b=1", "10.0.0.1", "1.2.3.4.5.6", "0123456789abcdef" * 3, '"' + "A" * 38 + '=="', '"a@b.co"', '"' + "x" * 41 + '"', '"ab"' + "A" * 45 + '"', "é日本", "😀", "word", ".", "\t", "\r\n", "OG_SECRET_abc", "@"]


def said(rnd):
    return "".join(rnd.choice(PIECES) + rnd.choice(["", "", " ", "\n"]) for _ in range(rnd.randint(0, 60)))


@pytest.mark.parametrize("target,overlap,guard", [(4096, 512, True), (64, 16, True), (40, 39, False), (8, 2, True)])
def test_redaction_in_the_jvm_is_that_in_python(spark, target, overlap, guard):
    rnd = random.Random(target)
    texts = [said(rnd) for _ in range(150)] + [None, "", "a@", "a@b.co" * 900, "é" * 3000 + "a@b.co" + "日" * 3000, ("x" * 2040 + "a@b.co") * 5, "1" * 5000]
    conf = EngineConf(NONCE, RuleDetector(), target, overlap, guard)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, `te.xt` string").withColumn("hit", F.lit("clash"))
    out = redaction.redact_documents(docs, conf, "te.xt")
    assert out.columns == ["id", "hit", "redacted", "mapping", "status"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    for r in out.collect():
        t = texts[r["id"]]
        want = (t, []) if t is None else text.redact(t, find_spans(t, conf), NONCE, guard)
        assert (r["redacted"], [tuple(p) for p in r["mapping"]], r["status"], r["hit"]) == (*want, "ok", "clash")
    back = out.select("id", redaction.restore_native(F.col("redacted"), F.col("mapping"), guard).alias("text"), redaction.restore(F.col("redacted"), F.col("mapping"), guard).alias("want")).collect()
    assert all(r["text"] == r["want"] for r in back)


@pytest.mark.parametrize("target,overlap", [(8, 2), (16, 4), (33, 100), (4096, 512)])
def test_chunks_in_the_jvm_are_those_in_python(spark, target, overlap):
    rnd = random.Random(target)
    alphabet = ["a", "b", "é", "日", "😀", " ", "\n", "\u0085", "\xa0"]
    texts = ["".join(rnd.choices(alphabet, weights=[9, 9, 3, 3, 3, rnd.choice([0, 1]), rnd.choice([0, 1]), 1, 1], k=rnd.randint(0, 6 * target if target < 99 else 9000))) for _ in range(60)] + [None, "", " " * 100, "x" * 20_000, "a" * 4095 + "日" * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", redaction.chunks(F.col("text"), target, overlap).alias("c")).collect()
    for r in rows:
        want = None if texts[r["id"]] is None else [tuple(c) for c in chunk.split(texts[r["id"]], target, overlap)]
        assert (None if r["c"] is None else [tuple(c) for c in r["c"]]) == want


def test_rules_that_are_not_known_to_be_unbroken_go_to_python(spark):
    rules = [("private_person", r"Bob [A-Z][a-z]+")]
    docs = spark.createDataFrame([(1, "hi Bob Lee"), (2, "none")], "id int, text string")
    out = redaction.redact_documents(docs, EngineConf(NONCE, RuleDetector(rules)))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["redacted"] for r in out.orderBy("id").collect()] == ["hi " + text.placeholder("private_person", "Bob Lee", NONCE), "none"]


def test_what_might_match_does_wherever_something_is_found(spark):
    rnd = random.Random(7)
    texts = [said(rnd) for _ in range(200)] + PIECES + ["a" * 40, "abcdef0123" * 4]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", RuleDetector().might_match(F.col("text")).alias("hit"), RuleDetector(RULES, hints={}).might_match(F.col("text")).alias("sure")).collect()
    for r in rows:
        assert r["hit"] == r["sure"] == bool(RuleDetector().detect(texts[r["id"]]))


def test_a_quote_in_what_is_replaced_is_an_error(spark):
    row = spark.createDataFrame([("x", [('a"b', "t")])], "text string, m array<struct<from:string,to:string>>")
    with pytest.raises(Exception, match="quote"):
        row.select(native.folded(F.col("text"), F.col("m"))).collect()
