"""Several texts a model call: the same spans as one by one, whatever the lengths and the padding."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.operators import redaction
from cloakwork.operators.detect import OnnxDetector, RecentDetector, ScriptedDetector, length_buckets
from cloakwork.operators.redaction import EngineConf
from cloakwork.sources.lookup_model import lookup_model

LABELS = ["O", "B-private_person", "I-private_person", "E-private_person", "S-secret"]
WORDS = {"Ada": (0, 4, 0, 0, 0), "Byron": (0, 0, 0, 4, 0), "key": (0, 0, 0, 0, 3)}


def detector(context=None):
    return OnnxDetector(*lookup_model(WORDS, (4, 0, 0, 0, 0), context), LABELS)


@given(st.lists(st.integers(0, 40), max_size=30), st.integers(0, 64), st.booleans())
@settings(max_examples=200, deadline=None)
def test_length_buckets(sizes, room, padded):
    calls = length_buckets(sizes, room, padded)
    assert sorted(n for c in calls for n in c) == [n for n, s in enumerate(sizes) if s]
    for call in calls:
        own = [sizes[n] for n in call]
        assert len(own) == 1 or len(own) * max(own) <= room
        assert max(own) <= 2 * min(own) if padded else len(set(own)) == 1


@pytest.mark.parametrize("context", [None, {"quiet": (0.75, 0, 0, 0, 0), "key": (0, 0, 0, 0, 0.25)}])
def test_many_texts_are_judged_as_one_by_one(context):
    model, rnd = detector(context), random.Random(7)
    assert model.inputs == (["input_ids"] if context is None else ["input_ids", "attention_mask"])
    texts = [" ".join(rnd.choice(["Ada", "Byron", "key", "met", "é", "quiet"]) for _ in range(rnd.choice((0, 1, 2, 5, 6, 7, 40, 300)))) for _ in range(80)]
    alone = [model.detect(t) for t in texts]
    for room in (1, 64, 8192):
        got = model.detect_many(texts, room)
        assert [[s[:3] for s in g] for g in got] == [[s[:3] for s in a] for a in alone]
        assert [s[3] for g in got for s in g] == pytest.approx([s[3] for a in alone for s in a], abs=1e-5)
    assert sum(map(len, alone)) > 50 and model.detect_many([]) == []


def test_calls_are_fewer_than_texts_and_padding_is_masked():
    model, calls = detector({"quiet": (5, 0, 0, 0, 0)}), []
    run = model.session.run
    class Counted:
        def run(self, names, given):
            calls.append({k: v.copy() for k, v in given.items()})
            return run(names, given)
    model.session = Counted()
    # an unknown word is token 0, as padding is; the mask alone tells them apart
    got = model.detect_many(["key", "key quiet", "say key say", "key key key"])
    assert [[s[2] for s in g] for g in got] == [["secret"], [], ["secret"], ["secret"] * 3]
    assert len(calls) == 2 and [c["attention_mask"].sum(axis=1).tolist() for c in calls] == [[1, 2], [3, 3]]


def test_a_mask_changes_what_is_heard():
    import numpy as np

    model = detector({"quiet": (5, 0, 0, 0, 0)})
    ids = np.array([model.tokenizer.encode("key quiet").ids])
    whole, cut = (model.session.run(None, {"input_ids": ids, "attention_mask": np.array([m])})[0][0, 0, 0] for m in ((1, 1), (1, 0)))
    assert whole == 5.0 and cut == 0.0


def test_recent_detector_asks_for_each_new_text_once():
    asked = []

    class Many:
        def detect_many(self, texts):
            asked.append(list(texts))
            return [[(0, 3, "secret", 1.0)] for _ in texts]

        def detect(self, text):
            return self.detect_many([text])[0]

    recent = RecentDetector(Many(), 2)
    assert len(recent.detect_many(["abc", "def", "abc"])) == 3 and asked == [["abc", "def"]]
    recent.detect_many(["def", "ghi"])
    assert asked[1] == ["ghi"] and len(recent) == 2


def test_one_failing_text_does_not_take_its_batch_along(spark):
    class Picky(ScriptedDetector):
        def detect(self, text):
            if "bad" in text:
                raise RuntimeError("model lost")
            return super().detect(text)

        def detect_many(self, texts):
            return [self.detect(t) for t in texts]

    docs = spark.createDataFrame([(1, "Bob met"), (2, "Bob is bad"), (3, None), (4, "x"), (5, "Bob " * 3000)], "id long, text string").coalesce(1)
    got = {r["id"]: r for r in redaction.redact_documents(docs, EngineConf(b"n" * 16, Picky([("Bob", "private_person")]))).collect()}
    assert got[2]["redacted"] is None and got[2]["status"] == redaction.FAILED
    assert all(got[n]["status"] == "ok" and "Bob" not in (got[n]["redacted"] or "") for n in (1, 3, 4, 5)) and got[4]["redacted"] == "x"
