"""Periodic runs, quality, spelling variants, and the logs of chat formatting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import chat, periodic, quality, spelling
from cloakwork.llm.common import fold
from cloakwork.llm.queries import planted_misspelling, planted_repeats

SCHEMA = "doc_id long, text string"


def junk(rnd, most=6):
    words = []
    for _ in range(rnd.randint(0, most)):
        unit = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 7))]
        words += (unit * rnd.randint(1, 7))[: rnd.randint(1, 40)]
    return words


def digests(words, power=4, shortest=6):
    runs = periodic.brute_force(words, power, shortest)
    kept = [w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    head = (len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4))
    return (*head, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.mark.parametrize("power,shortest", [(2, 2), (3, 4), (4, 6)])
def test_runs_against_every_period_and_place(power, shortest):
    rnd = random.Random(power)
    for _ in range(250):
        docs = [[w.encode() for w in junk(rnd)] for _ in range(rnd.randint(1, 4))]
        assert periodic._taken(docs, power, shortest) == [periodic.brute_force(d, power, shortest) for d in docs]


def test_squares_of_the_tree_are_all_squares():
    rnd = random.Random(9)
    for _ in range(150):
        text = np.array([rnd.randint(0, 2) for _ in range(rnd.randint(1, 40))] + [9])
        text = np.unique(text, return_inverse=True)[1]
        ranks = periodic.Ranks(text)
        tree = periodic.Tree(text, ranks)
        node, length = periodic.vocabulary(text, ranks, tree)
        got = {tuple(text[ranks.places[tree.low[v]] :][:n]) for v, n in zip(node, length)}
        want = {tuple(text[s : s + 2 * k]) for k in range(1, len(text) // 2 + 1) for s in range(len(text) - 2 * k + 1) if (text[s : s + k] == text[s + k : s + 2 * k]).all()}
        assert got == want and len(node) == len(want)


def test_runs_of_odd_rows(spark):
    rnd = random.Random(3)
    long = ["w%d" % rnd.randint(0, 900) for _ in range(20_000)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x " * 5), (5, "x " * 6), (5, "x " * 6), (None, "a b " * 9), (7, " ".join(long)), (8, "é日 ü " * 700), (9, "x\x0by\x0c" * 12), (10, "x y " * 8)]
    rows += [(20 + k, " ".join(junk(rnd, 12))) for k in range(60)]
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("n_runs"), F.lit(2).alias("a.b"))
    for change in (None, planted_repeats):
        got = sorted(map(str, map(tuple, periodic.find_runs(table, change=change).collect())))
        want = []
        for doc, text in rows:
            words = (text or "").encode().split()
            h = zlib.crc32(str(doc).encode())
            if change is not None and doc is not None and h % 10 == 0 and words:
                a = h // 10 % len(words)
                p = 1 + (len(words) - a) // (3 + h // 10 % 8)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            want.append(str((doc, *digests(words))))
        assert got == sorted(want)
    assert periodic.find_runs(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(table, power=1)


def test_strongest_run_by_exact_exponent():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(5, 13, 3), (9, 26, 6), (20, 9, 2)]) == (20, 9, 2)
    assert periodic.strongest([(1, 12, 3), (1, 8, 2), (30, 16, 4)]) == (1, 12, 3)


def spelled(seed, n=4000):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    out = []
    for _ in range(n):
        word = rnd.choice(base[: rnd.randint(1, 60)])
        if rnd.random() < 0.2:
            k = rnd.randrange(len(word))
            word = rnd.choice((word[:k] + word[k + 1 :], word[:k] + rnd.choice("abé") + word[k:], word[:k] + "c" + word[k + 1 :]))
        out.append(rnd.choice((word, word.upper() if word.isascii() else word)))
    return out


@pytest.mark.parametrize("crowd", [64, 2])
def test_spelling_against_all_edits(spark, crowd):
    words = spelled(1)
    rows = [(k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(100)] + [(7, None), (8, ""), (None, "Straße straßé " * 30), (9, "ÀÉabcd,ÀÉabcd;àéabcd" * 6), (9, "ÀÉabcd,ÀÉabcd;àéabcd" * 6), (11, "longword" * 9000)]
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("word"), F.lit(1).alias("n"))
    for change in (None, planted_misspelling):
        counted = spelling.count_words(table, change=change)
        got = {tuple(r) for r in spelling.variants(counted, crowd=crowd).collect()}
        assert got == spelling.brute_force(rows, change) and any(r[1] for r in got) and any(r[4] > 3 for r in got)
    assert spelling.spelling_groups(table.limit(0)).count() == 0


def test_spelling_where_many_words_share_a_segment(spark):
    rnd = random.Random(2)
    words = {"prefix" + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 7))) for _ in range(1500)}
    table = spark.createDataFrame([(w, 5 + k % 90) for k, w in enumerate(sorted(words))], "word string, n long")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(table).collect()}
    cut = {}
    for w in words:
        for k in range(len(w)):
            cut.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    want = {tuple(sorted((a, b))) for same in cut.values() for a in same for b in same if a < b} | {(c, w) for (_, c), same in cut.items() if c in words for w in same}
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want} and len(got) == len(want)
    assert spelling.candidates(table).count() < 40 * len(words)  # not all pairs of the prefix


def test_spelling_chains_end_at_their_root(spark):
    chain = [(f"w{n:03}", f"w{n + 1:03}") for n in range(37)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {a: "w037" for a, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_quality_gradient_is_that_of_the_loss():
    random_ = np.random.default_rng(1)
    counts = np.array([1, 4, 2])
    x, y = random_.normal(size=(7, 12)), np.array([1.0, 0.0, 1.0])
    model = quality.Model(np.zeros(12), np.ones(12), quality.start(12), 0.5)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := model.forward(x, counts)["p"], 1 - p)))
    for name, gradient in model.gradient(x, counts, y).items():
        for at in np.ndindex(*gradient.shape):
            kept = model.weights[name][at]
            model.weights[name][at] = kept + 1e-5
            up = loss()
            model.weights[name][at] = kept - 1e-5
            down = loss()
            model.weights[name][at] = kept
            assert abs((up - down) / 2e-5 - gradient[at]) < 1e-6


def test_quality_passages_against_plain_counts():
    rnd = random.Random(4)
    docs = [[rnd.choice(["The", "cat,", "CAT!!", "a1", "|", "é", "x***"]).encode() for _ in range(n)] for n in (0, 1, 48, 49, 200)]
    vectors, counts = quality.passages(docs, quality.WordTable())
    assert counts.tolist() == [0, 1, 1, 2, 5] and vectors.shape == (9, quality.WIDTH)
    at = 0
    for words in docs:
        pairs, said = set(), [w.decode() for w in words]
        for s in range(0, len(words), quality.PASSAGE):
            part, plain = said[s : s + quality.PASSAGE], vectors[at][quality.SHAPES + quality.WORDS :]
            again = sum(k > 0 and said[k] == said[k - 1] for k in range(s, s + len(part)))
            old = 0
            for k in range(s, s + len(part)):
                old += k > 0 and (said[k - 1], said[k]) in pairs
                pairs |= {(said[k - 1], said[k])} if k else set()
            letters = [c for w in part for c in w if c.isalpha()]
            assert np.allclose(plain[:4], [again / len(part), old / len(part), len(set(part)) / len(part), sum(map(str.isupper, letters)) / max(1, len(letters))], atol=1e-6)
            at += 1
    together = np.concatenate([quality.passages([d], quality.WordTable())[0] for d in docs])
    assert np.allclose(vectors, together)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs.withColumn("score", F.lit("clash")), labels, fold("doc_id", 5) == 0)
    assert out.count() == docs.count()
    held = out.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r[0] == r[1] for r in held) >= 0.95 * len(held)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (None, "two words"), (5, "Fine words here. " * 4000), (5, "Fine words here. " * 4000), (7, "\n\t"), (8, "x" * 70_000), (9, "Verung " * 300)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("predicted", F.lit("clash"))
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, empty, fold("doc_id", 5) == 0).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (5, 1), (9, 0), (9, None), (None, 1), (3, 7), (77, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels, fold("doc_id", 5) == 9).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    empties = {r["score"] for r in got if r["doc_id"] in (1, 2, 7)}
    assert len(empties) == 1 and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert quality.classify(docs.limit(0), labels, fold("doc_id", 5) == 0).count() == 0


def test_quality_sample_keeps_its_bounds(spark):
    rows = [(n, "some words of a text " * (n % 40 + 1)) for n in range(200)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(n, n % 2) for n in range(200)], "doc_id long, quality int")
    bags, marks = quality.sample(docs.unionAll(docs), labels, labelled=50, most=100)
    assert 0 < len(bags) == len(marks) <= 50 and sum(map(len, bags)) <= 100
    assert quality.sample(docs, labels, labelled=50, most=0) == ([], [])


def test_logs_of_rows_fold_back_into_the_rows(spark):
    rows = [(1, 0, "user", "é😀日 </s>[INST]"), (1, 1, "assistant", "ab"), (1, 1, "assistant", "ab"), (1, 2, "assistant", "x" * 9001), (1, 3, None, None), (2, None, "assistant", "😀"), (2, None, "assistant", ""), (None, -5, "assistant", "abc"), (3, 1 << 62, "system", "far")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).withColumn("step", F.lit(7))
    log = chat.as_events(table)
    kinds = {(r["kind"]) for r in log.select("kind").distinct().collect()}
    assert kinds == set(chat.KINDS)
    got = sorted(map(str, (tuple(r) for r in chat.messages(log).select("conv_id", "seq", "role", "text").collect())))
    assert got == sorted(str((c, t, r, x or "")) for c, t, r, x in rows)
    assert chat.as_events(table.limit(0)).count() == 0
    plan = chat.digest(chat.render(chat.messages(log)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
