"""The pipeline's stages judge rows one by one, whatever their ids and their other columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm import prose

from cloakwork.llm import decontaminate, language, simhash, substring
from cloakwork.llm.common import fold

ODD = {"a.b": "1", "m": "map('k', 2)", "x y": "named_struct('x y', 3, 'p.q', 'q')", "DOC": "4", "digest": "5", "same": "6", "kept id": "7"}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.expr(v).alias(k) for k, v in ODD.items()))


def as_made(row):
    return (row["a.b"], row["m"], tuple(row["x y"]), row["DOC"], row["digest"], row["same"], row["kept id"]) == (1, {"k": 2}, (3, "q"), 4, 5, 6, 7)


def test_near_dedup_keeps_unrelated_rows(spark):
    rows = [(None, prose(k, 60), "en") for k in range(3)] + [(1, prose(9, 60), "en"), (2, prose(10, 60), "en"), (2, prose(11, 60), "en"), (2, prose(11, 60), "en"), (3, prose(9, 60), "en"), (None, prose(9, 60), "en"), (None, prose(1, 60), "en")]
    out = simhash.keep_one_of_each_group(table(spark, rows))
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([*(("None", prose(k, 60)) for k in range(3)), ("1", prose(9, 60)), ("2", prose(10, 60)), ("2", prose(11, 60))])
    assert all(map(as_made, got)) and out.columns == table(spark, rows).columns
    assert simhash.keep_one_of_each_group(table(spark, rows).limit(0)).count() == 0


def test_substring_dedup_verifies_each_row_itself(spark):
    shared, other = prose(1, 30), prose(2, 80)
    rows = [(1, prose(3, 20) + " " + shared, "en"), (2, prose(4, 50) + " " + shared, "en"), (2, other, "en"), (None, prose(5, 40), "en"), (None, prose(6, 40), "en"), (None, prose(7, 25) + " " + prose(6, 40), "en"), (2, other, "en")]
    out = substring.remove_repeats(table(spark, rows).drop("digest", "same"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in out.collect())
    assert [x for x in got if x[0] != "None"] == [("1", 50, 0), ("2", 80, 0), ("2", 80, 0), ("2", 80, 30)]
    lost = sorted(x[1:] for x in got if x[0] == "None")
    assert lost in ([(40, 0), (40, 0), (65, 40)], [(40, 0), (40, 40), (65, 0)])  # of two rows without ids either comes first
    kept = substring.keep_first_passages(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.count() == len(rows) and all(map(as_made, kept.collect()))


def test_decontamination_judges_each_row_itself(spark):
    rows = [(None, prose(1, 40), "en"), (None, prose(2, 40), "en"), (None, None, "en"), (5, prose(1, 40), "en"), (5, prose(3, 40), "en")]
    benchmark = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    got = decontaminate.drop_contaminated(table(spark, rows), benchmark).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted([("None", prose(2, 40)), ("None", "None"), ("5", prose(3, 40))]) and all(map(as_made, got))


def test_language_id_keeps_odd_columns(spark):
    rows = [(k, prose(k, 30), "en") for k in range(6)] + [(None, None, "en"), (7, "", None)]
    got = language.keep_identified(table(spark, rows), fold("doc_id", 3) == 1).collect()
    assert len(got) == 6 and all(map(as_made, got))


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_from_end_to_end_on_odd_rows(spark, tmp_path, empty):
    long = prose(500, 20_000)
    rows = [(k, prose(k, 90), "en") for k in range(12)] + [(None, prose(20, 90), "en"), (None, prose(21, 90), "en"), (3, prose(22, 90), None), (3, prose(22, 90), None), (40, None, "en"), (41, "", "en"), (42, long, "en"), (43, prose(44, 60) + " " + prose(5, 90), "en"), (44, prose(46, 30), "en")]
    docs = table(spark, rows)
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(46, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert got == []
        return
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {*range(12), None, 42, 43} and len([r for r in pieces[None] if r["piece"] == 0]) == 2
    assert len([r for r in pieces[3] if r["piece"] == 0]) == 2 and len(pieces[42]) > 20
    whole = {k: sum(r["length"] for r in v) for k, v in pieces.items()}
    assert whole[43] < whole[42] / 100 and whole[43] < 1.2 * whole[5]
