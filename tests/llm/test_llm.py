import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import chat, decontaminate, language, language_model, neighbours, packing, simhash, substring, token_counts, toxicity
from cloakwork.llm.common import fold
from cloakwork.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, a column whose name clashes."""
    long = prose(1, 3000)
    near = long.split()
    near[100] = "changed"
    rows = [(1, long), (2, long), (3, " ".join(near)), (4, None), (5, ""), (6, "one"), (7, "One two"), (8, prose(2, 60)), (9, "x " * 200), (9, "x " * 200), (None, prose(3, 30)), (11, "\n\t "), (12, prose(2, 60) + " tail é日 Ünïcode")]
    return [(d, t, "en", "s", None, "clash") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_all_pairs(spark, docs):
    got = simhash.near_duplicate_groups(docs).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    marks = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = sorted((str(d), f"{m:016x}", str(min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None))) for (d, *_), m, g in zip(rows, marks, group))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one_of_each_group(docs).collect()]
    assert 1 in kept and 2 not in kept and len(kept) == len(set(kept))


def test_simhash_links_in_large_groups():
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    marks = {base}
    for _ in range(2500):
        marks.add(rnd.choice(tuple(marks)) ^ (1 << rnd.randrange(64)))
    old, found = simhash.DENSE_GROUP, []
    for limit in (10, 10**9):
        simhash.DENSE_GROUP = limit
        found.append(sorted(simhash.local_links(np.array(sorted(marks), dtype=np.uint64))))
    simhash.DENSE_GROUP = old
    assert found[0] == found[1] and len(found[0]) == len(marks) - 1


@pytest.mark.parametrize("width", [3, 20])
def test_substring_against_windows(spark, docs, width):
    got = sorted(map(str, map(tuple, substring.digest(substring.remove_repeats(docs.where("doc_id is not null"), width)).distinct().collect())))
    want = substring.brute_force([(d, t) for d, t, *_ in odd_rows() if d is not None], width)
    assert got == sorted(str((d, *v)) for d, v in want.items())
    assert substring.remove_repeats(docs.limit(0), width).count() == 0
    assert substring.remove_repeats(docs, width).where("doc_id is null").count() == 1


CLASH = ("z", "spots", "_text", "n_words", "kept_text", "ats", "n_removed", "again", "carried 0", "m", "c", "lang_pred", "fp", "component_id", "fingerprint", "_kept", "_bad", "digest", "items", "contaminated")


def test_stages_keep_columns_whose_names_clash(spark, tmp_path):
    shared = prose(77, 80)
    rows = [(1, shared + " " + prose(5, 30)), (2, prose(6, 30) + "  " + shared), (3, None), (4, ""), (5, prose(8, 40)), (5, prose(8, 40)), (None, shared), (7, prose(8, 40))]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit(0).alias("n_chars"), *(F.lit(n).alias(c) for n, c in enumerate(CLASH)))
    benchmark = spark.createDataFrame([(1, prose(5, 30))], "item_id long, text string")
    for stage in (
        lambda d: language.keep_identified(d, fold("doc_id", 3) == 1),
        simhash.keep_one_of_each_group,
        substring.keep_first_passages,
        lambda d: decontaminate.drop_contaminated(d, benchmark),
    ):
        out = stage(table)
        assert out.columns == table.columns
        got = out.collect()
        assert got and all(all(r[c] == n for n, c in enumerate(CLASH)) for r in got)
        assert stage(table.limit(0)).count() == 0
    cut = {r["doc_id"]: r for r in substring.keep_first_passages(table).collect()}
    assert cut[None]["text"] == shared and cut[1]["text"] == prose(5, 30) and cut[2]["text"] == prose(6, 30) and cut[2]["n_chars"] == len(prose(6, 30))


def test_substring_of_a_passage_in_a_third_of_all_documents(spark):
    passage = prose(501, 60)
    rows = [(n, prose(10_000 + n, 15) + " " + (passage if n % 3 == 0 else prose(30_000 + n, 45)) + " " + prose(60_000 + n, 9)) for n in range(5000)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))).collect()}
    assert got == substring.brute_force(rows)


def test_substring_where_crowded_minimizers_are_dealt_by_content(spark, docs, monkeypatch):
    monkeypatch.setattr(substring, "_LOOK", 3)
    monkeypatch.setattr(substring, "_CROWD", 20)
    passage, shared = prose(501, 60), prose(502, 24)
    rows = [(n, " ".join((prose(10_000 + n % 250, 15), passage if n % 3 else shared, prose(60_000 + n, 9)))) for n in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    crowds = substring.crowded(table, 20).collect()
    assert crowds and all(r["crowd"] >= 20 for r in crowds)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(substring.remove_repeats(table)).collect()}
    assert got == substring.brute_force(rows)
    monkeypatch.setattr(substring, "_CROWDS", 1)  # the others go the usual way
    again = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(substring.remove_repeats(table)).collect()}
    assert again == got
    assert substring.crowded(docs.limit(0), 20).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    whole, fast = Tokenizer.from_file(path), packing.FastTokenizer(path)
    assert fast.fast is not None
    rnd = random.Random(2)
    for _ in range(500):
        said = "".join(rnd.choice(["a", " ", "\n", "é", "1", "'s", "<|endoftext|>", "the", "日", "\x1c"]) for _ in range(12))
        assert np.frombuffer(fast.encode(said), "<u4").tolist() == whole.encode(said, add_special_tokens=False).ids
    rows = packing.pack(docs, path).collect()
    ids = {}
    for d, t, *_ in odd_rows():
        ids.setdefault(d, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(piece) == r["length"] <= 1024
    assert sum(r["length"] for r in rows) == sum(len(ids[d]) for d, *_ in odd_rows())
    by_sequence = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert by_sequence.get(r["sequence_id"], 0) == r["offset"]
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 1024
    assert packing.pack(docs.limit(0), path).count() == 0


def best_fit_decreasing(lengths, capacity):
    """Piece by piece: the number of sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(best)
            rooms.append(best - n)
    return len(rooms)


def test_plan_needs_as_many_sequences_as_piece_by_piece():
    rnd = random.Random(6)
    for _ in range(60):
        counts = {rnd.randint(1, 64): rnd.randint(1, 30) for _ in range(rnd.randint(1, 15))}
        used = {first + k for _, low, high, first, _ in packing.plan(counts, 64) for k in range(high - low)}
        assert len(used) == best_fit_decreasing([n for n, c in counts.items() for _ in range(c)], 64)


def test_plan_places_every_piece_once():
    rnd = random.Random(4)
    for _ in range(30):
        counts = {rnd.randint(1, 64): rnd.randint(1, 40) for _ in range(20)}
        used, seen = Counter(), Counter()
        for length, low, high, first, offset in packing.plan(counts, 64):
            for k in range(low, high):
                seen[length, k] += 1
                used[first + k - low] += length
        assert set(seen.values()) == {1} and len(seen) == sum(counts.values()) and max(used.values()) <= 64


def test_decontamination_against_windows(spark, docs):
    items = [(1, prose(2, 60)), (2, "one"), (10, None), (11, "!!"), (12, " ".join(prose(1, 3000).split()[50:70])), (13, " ".join(prose(1, 3000).split()[50:70]))]
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    cut = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    for d, t, *_ in odd_rows():
        ws, hit, names = cut(t), set(), set()
        for name, said in items:
            item = cut(said)
            n = min(13, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(ws) - n + 1):
                if n and tuple(ws[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names.add(str(name))
        r = got[d, len(ws)]
        assert (r["n_hit"], r["items"], r["contaminated"]) == (len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(ws))
    want = sorted(map(str, decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()))
    old, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0  # every join shuffles
    try:
        assert sorted(map(str, decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect())) == want
    finally:
        decontaminate.BROADCAST_ROWS = old
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, empty).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), empty).count() == 0


def test_chat_folds_events_and_reads_back(spark):
    events = [
        (1, "m0", 0, "message", "user", "hi </s> <\\/s> [INST]"),
        (1, "m1", 1, "delta", "assistant", "a"),
        (1, "m1", 2, "delta", None, "b"),
        (1, "m1", 3, "regenerate", None, None),
        (1, "m1", 4, "delta", None, "c[/INST]"),
        (1, "m2", 5, "message", "user", "x"),
        (1, "m2", 6, "edit", None, "y"),
        (1, "m3", 7, "message", "user", "gone"),
        (1, "m3", 8, "retract", None, None),
        (None, "m", None, "message", None, None),
    ]
    table = spark.createDataFrame(events, "conv_id long, message_id string, seq long, kind string, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.messages(table))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "hi </s> <\\/s> [INST]"), ("assistant", "c[/INST]"), ("user", "y")]
    assert back[1]["loss_texts"] == ["c[/INST]"] and [(t["role"], t["text"]) for t in back[None]["turns"]] == [("", "")]
    many = spark.range(300).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.digest(chat.render(chat.messages(chat.as_events(many.unionAll(many.limit(1)))))).first()
    assert row["n_turns"] == 301 and row["loss_sha256"] == hashlib.sha256(("0" + "".join(map(str, range(300)))).encode()).hexdigest()
    assert chat.render(chat.messages(table.limit(0))).count() == 0


def test_language(spark, docs):
    rows = [(n, prose(n, 40) if n % 2 else prose(n, 40).translate(str.maketrans("abcdefghij", "klmnopqrst")), "xx" if n % 2 else "yy") for n in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(table, fold("doc_id", 3) == 1).collect()}
    assert all(got[n]["lang_pred"] == lang and 0 <= got[n]["score"] <= 1 for n, _, lang in rows)
    assert all(got[n]["held_out"] == (zlib.crc32(str(n).encode()) % 3 == 1) for n in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, fold("doc_id", 3) == 1).collect()}
    assert odd[4] == odd[5] == odd[11] == "und" and odd[1] == "en"
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string")), fold("doc_id", 3) == 1).collect()} == {"und"}
    assert language.identify(docs.limit(0), fold("doc_id", 3) == 1).count() == 0
    assert language.keep_identified(docs, fold("doc_id", 3) == 1).columns == docs.columns


def brute_profiles(rows):
    """Cavnar and Trenkle's lists by plain counting: (counts by text, profiles by language)."""
    def count(text):
        said = " " + " ".join(__import__("re").findall(r"[^\W\d_]+", (text or "").lower())) + " "
        out = Counter()
        for n in (1, 2, 3):
            for at in range(len(said) - n + 1 if said.strip() else 0):
                gram = said[at : at + n]
                if gram != " " and not (n == 3 and gram[1] == " "):
                    out[gram] += 1
        return out

    order = lambda c, most: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:most]]
    totals = {}
    for d, text, lang in rows:
        if lang is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 3 != 1:
            totals.setdefault(lang, Counter()).update(count(text))
    profiles = {lang: order(c, language.PROFILE) for lang, c in totals.items() if c}

    def judge(text):
        own = order(count(text), language.TOP)
        if not own or not profiles:
            return "und", 0.0
        apart = {lang: sum(abs(p.index(g) - n) if g in p else language.PROFILE for n, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        return best, 1 - apart[best] / (language.PROFILE * len(own))

    return judge


@pytest.mark.parametrize("together", [1000, 2])
def test_language_against_plain_lists(spark, together):
    rnd = random.Random(3)
    letters = ["abcdeé ", "bcdefß ", "xyzabc ", "pqrstü ", "日本語a "]
    rows = [(n, "".join(rnd.choice(letters[n % 5]) for _ in range(rnd.randint(0, 90))) + rnd.choice(["", "1 2_3", "İ!"]), f"l{n % 5}" if n % 7 else None) for n in range(60)]
    rows += [(None, "abc abc", "l9"), (3, None, "l1"), (3, None, "l1"), (80, "", "l0"), (81, "abcd " * 3000, "l0")]
    judge = brute_profiles(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("clash"))
    got = language.identify(table, fold("doc_id", 3) == 1, together=together)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = sorted((str(d), *judge(t)) for d, t, _ in rows)
    assert [(a, b) for a, b, _ in sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in got.collect())] == [(a, b) for a, b, _ in want]
    assert np.allclose([r[2] for r in sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in got.collect())], [r[2] for r in want])
    kept = language.keep_identified(table, fold("doc_id", 3) == 1)
    assert kept.columns == table.columns and kept.where("doc_id = 80 or text is null").count() == 0 and kept.where("doc_id = 81").count() == 1


def test_token_counts_by_order_are_probabilities(spark):
    pieces, _ = token_counts.sentencepiece_pieces(tokenizer_file("piece_bpe_32k.model"))
    assert abs(sum(math.exp(s) for _, s in pieces) - 1) < 1e-9 and all(a[1] > b[1] for a, b in zip(pieces, pieces[1:]))
    counter = token_counts.UnigramCounter(pieces, True)
    assert counter.count("hello world this is a test of tokens")[0] <= 9 and counter.count("Internationalization matters")[0] <= 4


def test_token_counts_against_unigram_tokenizer(spark, docs):
    from tokenizers import Tokenizer, models

    pieces, bytes_too = token_counts.sentencepiece_pieces(tokenizer_file("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *[(f"<0x{n:02X}>", 0.0) for n in range(256)], *pieces], 0, True))
    for r in token_counts.count_tokens(docs.select("doc_id", "text").withColumn("n_tokens", F.lit("clash")), tokenizer_file("piece_bpe_32k.model")).join(docs.select("doc_id", "text"), "doc_id").distinct().collect():
        want = len(exact.encode(token_counts.MARK + r["text"].replace(" ", token_counts.MARK), add_special_tokens=False).ids) if r["text"] else 0
        assert r["n_tokens"] == want
    counter = token_counts.UnigramCounter([("a", -1.0), ("aa", -2.0), ("b", -1.0)], False)
    assert counter.best("aab") == (2, -3.0) and counter.best("axxa")[0] == 3
    assert token_counts.count_tokens(docs.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_neighbours(spark):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(600, 16))
    x[100:200] = x[7]
    rows = [(n, [float(v) for v in x[n]]) for n in range(600)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (50, [float(v) for v in x[50]]), (1004, [1.0, 2.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = neighbours.brute_force(list(range(600)), x, [n for n in range(600) if n % 50 == 0])
    assert got.keys() == want.keys()
    share = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want])
    assert share >= 0.9 and [v for v, _ in got[150]] == [v for v, _ in want[150]]
    assert neighbours.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.search(table, F.lit(False)).count() == 0


def test_neighbours_over_shards_and_blocks(spark):
    random_ = np.random.default_rng(5)
    x = random_.normal(size=(1500, 12))
    x[::3] = x[0]  # a third of all rows
    x[1], x[2], x[4], x[5] = x[7] * 1e200, x[7] * 1e-200, x[8] * 1e-300, x[8] * 1e300
    table = spark.createDataFrame([(n, [float(v) for v in x[n]], "clash") for n in range(1500)], "vec_id long, embedding array<double>, rank string").repartition(5)
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 25 == 7, shard_rows=300, query_block=16, keep=48).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    asked = list(range(7, 1500, 25))
    want = neighbours.brute_force(list(range(1500)), neighbours.scaled(x), asked)
    assert got.keys() == want.keys() and all(len(v) == 5 and all(-1.001 < s < 1.001 for _, s in v) for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in asked]) >= 0.9
    assert {v for v, _ in got[7][:2]} == {1, 2} and all(abs(got[q][0][1] - want[q][0][1]) < 1e-9 for q in asked if q % 3 == 0)


def test_neighbours_of_few_vectors(spark):
    table = spark.createDataFrame([(n, [float(n % 3 + 1), float(n)]) for n in range(4)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3]


def test_language_model(spark, docs):
    got = language_model.score(docs, fold("doc_id", 7) == 2).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode())
    counts = Counter(w for d, t, *_ in rows if crc(d) % 7 != 2 for w in [*(t or "").encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    texts = {d: [*(t or "").encode().lower().split(), b" "] for d, t, *_ in rows}
    for r in got:
        ws = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert language_model.score(docs.limit(0), fold("doc_id", 7) == 2).count() == 0


def test_language_model_learns_from_every_training_document(spark):
    ids = spark.range(400).where((F.pmod(F.xxhash64("id"), F.lit(16)) != 0) & (fold("id", 7) != 2))  # none that a sample of one in 16 by this hash has
    table = ids.select(F.col("id").alias("doc_id"), F.lit("one two three four five six " * 20).alias("text"))
    held_out = fold("doc_id", 7) == 2
    before = {r["doc_id"]: r["score"] for r in language_model.score(table, held_out, rounds=0).collect()}
    after = {r["doc_id"]: r["score"] for r in language_model.score(table, held_out).collect()}
    assert before.keys() == after.keys() and all(after[d] > before[d] + 1 for d in before)


def test_language_model_learns_alike_however_the_table_is_split(spark):
    random_ = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    rows = [(n if n % 10 else None, " ".join(random_.choices(words, k=random_.randint(0, 60)))) for n in range(300)]
    whole = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    split = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    held_out = fold("doc_id", 7) == 2
    for more in ({}, {"words": 2000}):  # one task, then several
        a, b = (sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in language_model.score(t, held_out, **more).collect()) for t in (whole, split))
        assert np.allclose(a, b, rtol=1e-5, atol=0)
    coded = split.select(F.xxhash64("doc_id", "text").alias("key"), F.encode("text", "UTF-8").alias("ids"))
    n_tokens = sum(len(t) // 2 for _, t in rows)
    parts = [deal.rdd.glom().map(lambda p: sum(len(r["ids"]) // 2 for r in p)).collect() for deal in (language_model.deal_out(coded, n_tokens, turn, 2, 2000) for turn in (0, 1))]
    assert all(len(p) == -(-n_tokens // 4000) for p in parts) and sum(map(sum, parts)) == n_tokens


def slow_score(p, ids):
    """log-likelihood of one coded text, word by word, in plain formulas."""
    h, total, rational = np.zeros(language_model.HIDDEN), 0.0, lambda x: x / (1 + np.abs(x))
    units = language_model.HIDDEN
    for word in ids:
        logits = h @ p["C"] + p["c"]
        k = word // language_model.CLASS_SIZE if word < language_model.HEAD else language_model.HEAD_CLASSES + word - language_model.HEAD
        total += logits[k] - np.log(np.exp(logits).sum())
        if word < language_model.HEAD:
            first = k * language_model.CLASS_SIZE
            logits = p["W"][first : first + language_model.CLASS_SIZE] @ h + p["w"][first : first + language_model.CLASS_SIZE]
            total += logits[word - first] - np.log(np.exp(logits).sum())
        gate = 0.5 + 0.5 * rational(p["G"][word, :units] + p["V"][:units] * h)
        h = gate * h + (1 - gate) * rational(p["G"][word, units:] + p["V"][units:] * h)
    return total


def noisy_parameters(random_):
    flat = language_model.initial(np.ones(language_model.HEAD), np.ones(language_model.CLASSES)).astype(np.float64)
    return flat + random_.normal(0, 0.05, flat.shape)


def test_language_model_scores_texts_of_many_windows():
    random_ = np.random.default_rng(4)
    p = language_model.unpack(noisy_parameters(random_))
    ids = [random_.integers(0, language_model.HEAD + language_model.TAIL_CLASSES, n) for n in (1, 5, 16, 17, 700, 3 * 64 * language_model.WINDOW + 3)]
    got = language_model.score_documents({k: v.astype(np.float32) for k, v in p.items()}, ids)
    assert np.allclose(got, [slow_score(p, x) for x in ids], rtol=1e-4)


def test_language_model_score_is_the_network_times_the_shares_in_classes(spark):
    rows = [(n, " ".join(f"w{(n * k) % 1500}" for k in range(n % 90))) for n in range(1, 300)]
    table, held_out = spark.createDataFrame(rows, "doc_id long, text string"), fold("doc_id", 7) == 2
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in language_model.tokens(t.encode()))
    top = sorted(counts, key=lambda w: (-counts[w], language_model._key(w)))
    head = [language_model.END, *[w for w in top[: language_model.HEAD - 1] if w != language_model.END]][: language_model.HEAD]
    place = {w: n for n, w in enumerate(head)}
    tails = {k: [w for w in counts if w not in place and language_model.tail_class(w) == k] for k in range(language_model.TAIL_CLASSES)}
    by_class = [sum(counts[w] for w in head[n : n + language_model.CLASS_SIZE]) for n in range(0, language_model.HEAD, language_model.CLASS_SIZE)]
    by_class += [sum(counts[w] for w in ws) for ws in tails.values()]
    p = language_model.unpack(language_model.initial(np.array([counts[w] for w in head] + [0] * (language_model.HEAD - len(head))), np.array(by_class)))
    for r in language_model.score(table, held_out, rounds=0).collect():
        words = language_model.tokens(rows[r["doc_id"] - 1][1].encode())
        classes = [language_model.tail_class(w) for w in words]
        want = slow_score(p, [place.get(w, language_model.HEAD + k) for w, k in zip(words, classes)]) / math.log(10)
        want += sum(math.log10((counts[w] + 1) / (sum(counts[v] + 1 for v in tails[k]) + 1)) for w, k in zip(words, classes) if w not in place)
        assert math.isclose(r["score"], want, rel_tol=1e-4)


def test_language_model_gradient_and_norm():
    random_ = np.random.default_rng(0)
    flat = noisy_parameters(random_)
    p = language_model.unpack(flat)
    ids, mask = random_.integers(0, language_model.HEAD + language_model.TAIL_CLASSES, (5, 3)), np.ones((5, 3), bool)
    mask[3:, 2] = False
    h = np.zeros((3, language_model.HIDDEN))

    def loss(values):
        q = language_model.unpack(values)
        before = language_model.states(q, ids, h)[0][:-1]
        return -language_model.likelihood(q, before[mask], ids[mask]).sum() / mask.sum()

    grad = language_model.gradient(p, ids, mask, h)[0].astype(np.float64)
    for _ in range(5):
        way = random_.normal(size=flat.shape)
        slope = (loss(flat + 1e-5 * way) - loss(flat - 1e-5 * way)) / 2e-5
        full = float(grad @ way)
        assert abs(slope) < 1e-3 or 0.2 < full / slope <= 1.05  # the gradient is scaled down to norm 1 at most
    state = random_.uniform(-1, 1, size=(1, language_model.HIDDEN))
    every = np.arange(language_model.HEAD + language_model.TAIL_CLASSES)
    assert abs(np.exp(language_model.likelihood(p, np.repeat(state, len(every), 0), every)).sum() - 1) < 1e-6


def brute_kernel(s, t):
    def places(x):
        out = Counter()
        for a in range(len(x)):
            stack = [(a, x[a])]
            while stack:
                end, said = stack.pop()
                if len(said) == toxicity.LENGTH:
                    out[said] += toxicity.DECAY ** (end - a + 1)
                    continue
                stack.extend((b, said + x[b]) for b in range(end + 1, len(x)))
        return out

    left, right = places(s), places(t)
    return sum(v * right[k] for k, v in left.items())


def test_string_kernel():
    left, right = ["idiot", "ixdiot", "zz", "thatthtion"], ["idiot", "moron"]
    assert np.allclose(toxicity.kernel(left, right), [[brute_kernel(s, t) for t in right] for s in left], rtol=1e-4)


def test_toxicity(spark, docs):
    insults = ["gronkulus", "fleebwit", "snardle"]
    rnd = random.Random(8)
    rows, labels = [], []
    for n in range(400):
        said, toxic = prose(n, 60).split(), n % 4 == 0
        if toxic:
            for _ in range(3):
                word = rnd.choice(insults)
                said[rnd.randrange(60)] = word if n % 8 else word[:3] + "." + word[3:]
        rows.append((n, " ".join(said)))
        labels.append((n, int(toxic)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(table, marks, fold("doc_id", 3) == 1).where("held_out").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in got]) > 0.95
    odd = toxicity.classify(docs, marks, fold("doc_id", 3) == 1).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.classify(docs, marks.limit(0), fold("doc_id", 3) == 1).where("predicted = 1").count() == 0
    assert toxicity.classify(docs.limit(0), marks, fold("doc_id", 3) == 1).count() == 0
    repeated = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert len(toxicity.sample(repeated, marks, labelled=2)) == 2


def test_toxicity_score_is_the_machine_over_pooled_kernels(spark):
    rnd = random.Random(12)
    samples = [(n % 3 == 0, {*prose(n, 12).split(), *(["gronkle" + rnd.choice(["", "d", "s"])] * (n % 3 == 0))}) for n in range(90)]
    model = toxicity.fit([(int(label), ws) for label, ws in samples])
    table = toxicity.WordTable(model)
    for _, ws in samples[:20]:
        table.learn([ws])
        shares = np.array([[min(1.0, brute_kernel(toxicity.START + w, toxicity.START + mark) / brute_kernel(toxicity.START + mark, toxicity.START + mark)) for mark in model.landmarks] for w in ws])
        near = np.maximum(shares - toxicity.NEAR, 0).sum(axis=0) / (1 - toxicity.NEAR)
        pooled = np.concatenate([shares.max(axis=0) ** toxicity.POWER, np.log1p(near), np.log1p(near * 100 / (len(ws) + toxicity.SHARE_PRIOR))])
        want = 1 / (1 + math.exp(-(model.slope * (pooled @ model.weights + model.bias) + model.offset)))
        assert abs(float(model.probability(table.pooled(ws)[None, :])[0]) - want) < 1e-3


def test_toxicity_by_stems_that_clean_texts_hold_too():
    rnd = random.Random(9)
    samples = []
    for n in range(600):
        stems = ["bomente" + prose(5000 + 10 * n + k, 1) for k in range(rnd.randint(3, 6) if n % 5 == 0 else rnd.random() < 0.2)]
        samples.append((int(n % 5 == 0), {*prose(9000 + n, 80).split(), *stems}))
    model = toxicity.fit(samples[:400])
    assert any("bomente".startswith(m) or m.startswith("bomente") for m in model.landmarks)
    table = toxicity.WordTable(model)
    table.learn([ws for _, ws in samples[400:]])
    score = model.probability(np.array([table.pooled(ws) for _, ws in samples[400:]]))
    assert np.mean((score >= toxicity.THRESHOLD) == [label == 1 for label, _ in samples[400:]]) > 0.95


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    words = prose(40, 400)
    rows = [(n, prose(100 + n, 80), "en", "s", 1) for n in range(30)]
    rows += [(40, words, "en", "s", 1), (41, words, "en", "s", 1), (42, "12 34", "en", "s", 1), (43, prose(7, 40) + " " + " ".join(words.split()[:60]), "en", "s", 1), (44, prose(9, 50), "en", "s", 1), (45, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(9, 50))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{number}"))
        docs = spark.read.parquet(str(tmp_path / f"out{number}"))
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen[0] == {n for n, *_ in rows} - {42, 45} and seen[1] == seen[0] - {41} and seen[3] == seen[2] - {44}
    third = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert third[43]["text"] == prose(7, 40) and third[43]["n_chars"] == len(prose(7, 40)) and third[0]["text"] == rows[0][1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
