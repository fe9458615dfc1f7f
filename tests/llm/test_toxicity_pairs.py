"""The subsequence kernel looks only at pairs that may share a subsequence, and loses none; word sets are those of the words in order."""

import random
from itertools import combinations

import numpy as np
import pytest

from cloakwork.llm import toxicity


def by_places(s, t):
    """The kernel by all pairs of places."""
    total = 0.0
    for a in combinations(range(len(s)), toxicity.LENGTH):
        for b in combinations(range(len(t)), toxicity.LENGTH):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize("alphabet", ["abc", "abcdefgh", [chr(0x4E00 + n) for n in range(200)]])
def test_pairs_left_out_share_nothing(alphabet):
    rnd = random.Random(5)
    right = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 8))) for _ in range(12)]
    left = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 8))) for _ in range(40)] + [r[:2] + "ab" + r[2:] for r in right]
    got = toxicity.kernel(left, right)
    np.testing.assert_allclose(got, [[by_places(s, t) for t in right] for s in left], rtol=1e-4)
    s, t = toxicity._codes(left), toxicity._codes(right)
    likely = toxicity._may_share(s, t, np.array([len(r) for r in right])).T
    assert likely[got > 0].all() and (got > 0).any()


def test_few_pairs_of_words_are_computed():
    rnd = random.Random(6)
    left = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(500)]
    right = ["^idiot", "^loser", "^pathetic"]
    likely = toxicity._may_share(toxicity._codes(left), toxicity._codes(right), np.array([len(r) for r in right]))
    assert likely.mean() < 0.2


def test_word_sets():
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(["a", "b", "C", "é", " ", " ", "1", ".", "\n", "xyz", "\x1c", "\xa0", "İ", "-"]) for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    for text in [*texts, None, "", "i d i o t", "a b", "x 1 y z w"]:
        assert toxicity.word_set(text) == set(toxicity.words(text))
