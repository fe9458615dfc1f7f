"""Decoding of several texts at once, and model queries that use all cores whatever the file's row groups."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from cloakwork.kernels import bioes

LABELS = ["O", "B-secret", "I-secret", "E-secret", "S-secret", "S-private_person"]


@pytest.mark.parametrize("biases", [bioes.Biases(), bioes.Biases(4.5, -2.25, 1.125, -3.5, 2.25, -5.0)])
def test_texts_decoded_together_have_their_best_paths(biases):
    rnd = np.random.default_rng(3)
    decoder = bioes.Decoder(LABELS, biases)
    many = [np.round(rnd.normal(size=(n, len(LABELS))) * 4) / 4 for n in (0, 1, 5, 3, 5, 2, 0, 4)]
    paths = np.split(decoder.paths(np.concatenate(many), [len(m) for m in many]), np.cumsum([len(m) for m in many])[:-1])
    for logits, path in zip(many, paths):
        score = lambda p: sum(logits[k, t] for k, t in enumerate(p)) + sum(decoder.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        allowed = (p for p in itertools.product(range(len(LABELS)), repeat=len(logits)) if not p or decoder.begins[p[0]])
        assert score(path.tolist()) == max(map(score, allowed))
        assert path.tolist() == decoder.path(logits)
    spans = [[(a, b + 1, kind, mean) for a, b, kind, mean in found] for found in decoder.runs(many)]
    assert spans == [decoder.spans(m, [(k, k + 1) for k in range(len(m))]) for m in many] and any(spans)


def test_byte_offsets_of_wide_characters():
    said = "aé日😀b"
    assert bioes.byte_offsets(said, [(0, 1), (1, 3), (3, 4), (4, 5), (5, 5)]) == [(0, 1), (1, 6), (6, 10), (10, 11), (11, 11)]


@pytest.mark.parametrize("query", ["model_spans", "model_spans_in_context"])
def test_a_file_of_one_row_group_is_dealt_over_the_cores(spark, tmp_path, query):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["of", "the", "und", "and", "é"]) for _ in range(rnd.randint(0, 50))) for _ in range(40)]
    pq.write_table(pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()[query](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert out.count() > 20
