"""Language-model scoring with a gated recurrent network in numpy.

The network: each word has a row of inputs to a forget gate and to a candidate state; gate and candidate also see the state
before, unit by unit (a recurrent cell with a diagonal recurrent matrix, as in simple recurrent units). Both are rational
functions, x / (1 + |x|), as exponentials would be half of the cost. Words are predicted by class first and then within the class
(class-factored softmax). The ``HEAD`` most frequent words are in classes of like frequency with an output vector each; every other
word is in a class by its letters, where its share is its count plus one. It is trained by truncated backpropagation over windows of
``WINDOW`` words, the state carried from window to window; tasks learn on their own documents, and their parameters are averaged after
every round. Scoring carries the state over the whole document, so a document's log-likelihood is that of the whole text.

Scale: every text is cut into words once. Its words become numbers in a dictionary of the task's latest ``_HELD`` words, which is
written with them, and all later passes work on numbers. Counts cover all training documents. Driver and broadcasts hold ``HEAD``
words, the ``COUNTED`` most frequent counts, class sums and one parameter vector; counts of rarer words meet the documents in a
join, so every count is exact. The gradient sees every training document once: a hash deals each to one of ``ROUNDS`` rounds, and
there to tasks of about ``LEARNED`` words, in the order of the hash. How the table is split has no say in what a task learns, and
the number of tasks follows the counted words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, shuffle_parts, texts

HEAD = 1024
CLASS_SIZE = 32
TAIL_CLASSES = 32
HIDDEN = 16
WINDOW = 16
LANES = 512
ROUNDS = 2
#: Words that one task learns from in its round, at every size.
LEARNED = 1_500_000
COUNTED = 500_000
#: Parameters in one row, as tasks hand them on.
BLOCK = 1024
RATE = 0.04
#: Different words in a task's dictionary, and words of text, before a new one begins.
_HELD = 200_000
_TEXT = 2_000_000
#: Words whose documents are scored, or learned from, together.
TOGETHER = 2_000_000
#: In learning, a longer document is several runs of so many words; scoring never cuts.
RUN = 512
END = b" "  # no word can be a space
_BATCH = 512


def _key(word: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def tail_class(word: bytes) -> int:
    """Class of a rare word: by its first two and last two bytes."""
    return xxhash.xxh32_intdigest(word[:2] + b"." + word[-2:]) % TAIL_CLASSES


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text.lower().split() if text else ()), END]


class _Numbers(dict):
    """Word to number, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


CODED = "words binary, kinds binary, counts binary, key long, doc_id long, held_out boolean, codes binary"
_CODED = pa.schema([("words", pa.binary()), ("kinds", pa.binary()), ("counts", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary())])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of words: a row with a dictionary (words, their tail classes, their training counts), then its documents."""
    numbers, held, size = _Numbers(), [], 0
    pack = zstandard.ZstdCompressor(level=1).compress

    def rows() -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(numbers), dtype=np.int64)
        for part in (codes for *_, out, codes in held if not out):
            counts += np.bincount(part, minlength=len(numbers))
        words = np.fromiter(map(_key, numbers), dtype=np.int64, count=len(numbers))
        kinds = np.fromiter(map(tail_class, numbers), dtype=np.uint8, count=len(numbers))
        yield pa.RecordBatch.from_pylist([{"words": words.tobytes(), "kinds": kinds.tobytes(), "counts": counts.tobytes()}], _CODED)
        for at in range(0, len(held), _BATCH):
            yield pa.RecordBatch.from_pylist([{"key": k, "doc_id": d, "held_out": out, "codes": pack(c.tobytes())} for k, d, out, c in held[at : at + _BATCH]], _CODED)

    for batch in batches:
        for key, doc, out, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "held_out")), texts(batch)):
            words = tokens(text)
            held.append((key, doc, out, np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words))))
            size += len(words)
            if len(numbers) > _HELD or size > _TEXT:
                yield from rows()
                numbers, held, size = _Numbers(), [], 0
    if held:
        yield from rows()


def _dictionary_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, kinds, counts in zip(*(batch.column(c).to_pylist() for c in ("words", "kinds", "counts"))):
            counts = np.frombuffer(counts, dtype=np.int64)
            seen = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)[seen]), pa.array(np.frombuffer(kinds, np.uint8)[seen].astype(np.int32)), pa.array(counts[seen])], names=["word", "class", "n"])


class Vocabulary:
    """Input ids of words: 0 is the end, then the head, then one id for each tail class; counts where they are known here."""

    def __init__(self, head: list[int], counted: np.ndarray, counts: np.ndarray) -> None:
        end = _key(END)
        self.head = [end, *[w for w in head if w != end]][:HEAD]
        keys = np.array(self.head, dtype=np.int64)
        self.places = np.argsort(keys)
        self.keys = keys[self.places]
        order = np.argsort(counted)
        self.counted, self.counts = counted[order], counts[order]

    def look_up(self, words: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input id and count (-1: not held here) of each word."""
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        ids = np.where(self.keys[at] == words, self.places[at], HEAD + kinds.astype(np.int64))
        counts = np.full(len(words), -1, dtype=np.int64)
        if len(self.counted):
            at = np.minimum(np.searchsorted(self.counted, words), len(self.counted) - 1)
            here = self.counted[at] == words
            counts[here] = self.counts[at[here]]
        return ids, counts


PRICED = "key long, doc_id long, held_out boolean, n_tokens long, base double, fixed double, known long, rare array<long>, ids binary"


def _price(vocabulary, tail_log: np.ndarray):
    """Documents with their input ids, what does not depend on the network, and the words whose counts are not held here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        words = ids = counts = logs = fixed = None

        def documents(part: pa.RecordBatch) -> pa.RecordBatch:
            codes = [np.frombuffer(unpack(c), dtype=np.uint32) for c in part.column("codes").to_pylist()]
            sizes = np.array([len(c) for c in codes])
            flat, start = np.concatenate(codes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rare = counts[flat] < 0
            coded = ids[flat].astype(np.uint16)
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(rare, start, dtype=np.int64))]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("key", "doc_id", "held_out")),
                    pa.array(sizes, pa.int64()),
                    *(pa.array(np.add.reduceat(x[flat], start)) for x in (logs, fixed)),
                    pa.array(np.add.reduceat(counts[flat] > 0, start, dtype=np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(words[flat[rare]])),
                    pa.array([coded[a : a + n].tobytes() for a, n in zip(start, sizes)], pa.binary()),
                ],
                names=["key", "doc_id", "held_out", "n_tokens", "base", "fixed", "known", "rare", "ids"],
            )

        for batch in batches:
            marks = np.flatnonzero(batch.column("words").is_valid().to_numpy(zero_copy_only=False))
            for at, end in zip([-1, *marks.tolist()], [*marks.tolist(), batch.num_rows]):
                if at >= 0:
                    words = np.frombuffer(batch.column("words")[at].as_py(), dtype=np.int64)
                    ids, counts = vocabulary.value.look_up(words, np.frombuffer(batch.column("kinds")[at].as_py(), dtype=np.uint8))
                    logs = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
                    in_tail = ids >= HEAD
                    fixed = np.where(in_tail, logs - tail_log[np.where(in_tail, ids - HEAD, 0)], 0.0)
                if end > at + 1:
                    yield documents(batch.slice(at + 1, end - at - 1))

    return run


HEAD_CLASSES = HEAD // CLASS_SIZE
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Inputs of a word to gate and candidate; their weights on the state; outputs of classes; outputs of head words.
SHAPES = {"G": (HEAD + TAIL_CLASSES, 2 * HIDDEN), "V": (2 * HIDDEN,), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "W": (HEAD, HIDDEN), "w": (HEAD,)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(head_counts: np.ndarray, class_counts: np.ndarray) -> np.ndarray:
    """Random inputs, gates that forget at different speeds; the output starts as the unigram shares of classes and words."""
    random = np.random.default_rng(7)
    flat = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()), dtype=np.float32)
    p = unpack(flat)
    p["G"][:] = random.normal(0, 0.5, p["G"].shape)
    p["G"][:, :HIDDEN] += np.linspace(-2, 4, HIDDEN)
    p["c"][:] = np.log((class_counts + 1) / (class_counts + 1).sum())
    p["w"][:] = np.log(head_counts + 1)
    return flat


def states(p: dict, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before each word and after the last (steps + 1, lanes, units), and gates and candidates, of a window (steps x lanes)."""
    steps, lanes = ids.shape
    kind = p["G"].dtype
    out = np.empty((steps + 1, lanes, HIDDEN), dtype=kind)
    out[0] = h
    gates = np.take(p["G"], ids, axis=0)
    for_gate, for_new = p["V"][:HIDDEN], p["V"][HIDDEN:]
    part, size = np.empty((lanes, HIDDEN), dtype=kind), np.empty((lanes, 2 * HIDDEN), dtype=kind)
    for t in range(steps):
        before, both, after = out[t], gates[t], out[t + 1]
        gate, new = both[:, :HIDDEN], both[:, HIDDEN:]
        np.multiply(before, for_gate, out=part)
        gate += part
        np.multiply(before, for_new, out=part)
        new += part
        np.abs(both, out=size)
        size += 1
        both /= size
        gate *= 0.5
        gate += 0.5
        np.subtract(before, new, out=after)
        after *= gate
        after += new
    return out, gates


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // CLASS_SIZE, HEAD_CLASSES + ids - HEAD)


def _exp(logits: np.ndarray, bound: float) -> np.ndarray:
    """exp in place, up to a factor for each row; no entry is larger than ``bound`` in size."""
    if bound > 80:  # else exp cannot overflow
        logits -= logits.max(axis=1, keepdims=True)
    return np.exp(logits, out=logits)


def _bounds(p: dict) -> tuple[float, float]:
    """How large the logits of classes and of words can be: states are within -1 and 1."""
    return float((np.abs(p["C"]).sum(axis=0) + np.abs(p["c"])).max()), float((np.abs(p["W"]).sum(axis=1) + np.abs(p["w"])).max())


def _log_shares(logits: np.ndarray, chosen: np.ndarray, bound: float) -> np.ndarray:
    """log-softmax of one entry in each row of ``logits``, which is overwritten."""
    if bound > 80:
        logits -= logits.max(axis=1, keepdims=True)
    picked = logits[np.arange(len(chosen)), chosen]
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(logits.shape[1], dtype=logits.dtype))


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by id, the ids in that order, and where each class of head words begins in it (and the last ends)."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    in_order = ids[order]
    return order, in_order, np.searchsorted(in_order, np.arange(0, HEAD + 1, CLASS_SIZE))


def likelihood(p: dict, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log of P(class) and, for head words, of P(word | class), from the states before each word."""
    class_bound, word_bound = _bounds(p)
    logits = before @ p["C"]
    logits += p["c"]
    out = _log_shares(logits, class_of(ids), class_bound).astype(np.float64)
    order, in_order, cuts = _by_class(ids)
    order = order[: cuts[-1]]
    x, place, inner = before[order], in_order[: cuts[-1]] % CLASS_SIZE, np.empty(len(order))
    for k in range(HEAD_CLASSES):
        rows, words = slice(cuts[k], cuts[k + 1]), slice(k * CLASS_SIZE, (k + 1) * CLASS_SIZE)
        if cuts[k + 1] > cuts[k]:
            logits = x[rows] @ p["W"][words].T
            logits += p["w"][words]
            inner[rows] = _log_shares(logits, place[rows], word_bound)
    out[order] += inner
    return out


def gradient(p: dict, ids: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Truncated backpropagation through one window (steps x lanes); returns the mean gradient and the state after it."""
    flat = np.zeros(sum(v.size for v in p.values()), dtype=np.float32)
    g, kind, (steps, lanes) = unpack(flat), p["G"].dtype, ids.shape
    every, gates = states(p, ids, h)
    before, live = every[:-1], mask.ravel()
    whole = bool(live.all())
    x, y = before.reshape(-1, HIDDEN), ids.ravel()
    if not whole:
        x, y = x[live], y[live]
    class_bound, word_bound = _bounds(p)
    # errors are kept as multiples of each row's sum, which the narrow states and gradients are divided by instead
    error = x @ p["C"]
    error += p["c"]
    _exp(error, class_bound)
    total = error @ np.ones(CLASSES, dtype=kind)
    error[np.arange(len(y)), class_of(y)] -= total
    total = 1 / total
    g["C"][:], g["c"][:] = (x * total[:, None]).T @ error, total @ error
    back = error @ p["C"].T
    back *= total[:, None]
    order, in_order, cuts = _by_class(y)
    head = order[: cuts[-1]]
    sorted_x, inner = x[head], np.empty((len(head), CLASS_SIZE), dtype=kind)
    present = [k for k in range(HEAD_CLASSES) if cuts[k + 1] > cuts[k]]
    for k in present:
        rows, words = slice(cuts[k], cuts[k + 1]), slice(k * CLASS_SIZE, (k + 1) * CLASS_SIZE)
        np.matmul(sorted_x[rows], p["W"][words].T, out=inner[rows])
        inner[rows] += p["w"][words]
    _exp(inner, word_bound)
    total = inner @ np.ones(CLASS_SIZE, dtype=kind)
    inner[np.arange(len(head)), in_order[: cuts[-1]] % CLASS_SIZE] -= total
    total = 1 / total
    sorted_back = np.empty_like(sorted_x)
    sorted_x *= total[:, None]
    for k in present:
        rows, words = slice(cuts[k], cuts[k + 1]), slice(k * CLASS_SIZE, (k + 1) * CLASS_SIZE)
        g["W"][words], g["w"][words] = inner[rows].T @ sorted_x[rows], total[rows] @ inner[rows]
        np.matmul(inner[rows], p["W"][words], out=sorted_back[rows])
    sorted_back *= total[:, None]
    back[head] += sorted_back
    wide = back
    if not whole:
        wide = np.zeros((steps * lanes, HIDDEN), dtype=kind)
        wide[live] = back
    wide = wide.reshape(steps, lanes, HIDDEN)
    # what a step hands on is linear in what reaches it, so its factors are taken for all steps at once
    gate, new = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
    into_new = np.abs(new)
    np.subtract(1, into_new, out=into_new)
    into_new *= into_new
    into_new *= 1 - gate
    into_gate = 2 * gate
    into_gate -= 1
    np.abs(into_gate, out=into_gate)
    np.subtract(1, into_gate, out=into_gate)
    into_gate *= into_gate
    into_gate *= 0.5
    into_gate *= before - new
    through = into_new * p["V"][HIDDEN:]
    through += gate
    through += into_gate * p["V"][:HIDDEN]
    reached, ahead = np.empty_like(wide), np.zeros((lanes, HIDDEN), dtype=kind)
    for t in range(steps - 1, -1, -1):
        reached[t] = ahead
        ahead = ahead * through[t]
        ahead += wide[t]
    inputs = np.empty_like(gates)
    np.multiply(reached, into_gate, out=inputs[:, :, :HIDDEN])
    np.multiply(reached, into_new, out=inputs[:, :, HIDDEN:])
    for half in (slice(0, HIDDEN), slice(HIDDEN, None)):
        g["V"][half] = np.einsum("tlh,tlh->h", inputs[:, :, half], before)
    if not whole:
        order = np.argsort(ids.ravel().astype(np.int16), kind="stable")
        in_order = ids.ravel()[order]
    first = np.flatnonzero(np.diff(in_order, prepend=-1))
    g["G"][in_order[first]] = np.add.reduceat(inputs.reshape(-1, 2 * HIDDEN)[order], first, axis=0)
    flat /= max(1, len(y))
    norm = float(np.linalg.norm(flat))
    if norm > 1.0:
        flat /= norm
    return flat, every[-1]


def _windows(lanes: list[np.ndarray], window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Windows over coded texts side by side, longest first: lanes that still have words, their ids (steps x lanes), which are words."""
    lengths = np.array([len(x) for x in lanes])
    block = 64 * window  # a few windows are laid out at once
    for at in range(0, int(lengths[0]), block):
        n = int((lengths > at).sum())
        ids = np.zeros((min(block, int(lengths[0]) - at), n), dtype=np.int64)
        for k in range(n):
            part = lanes[k][at : at + block]
            ids[: len(part), k] = part
        left = lengths[:n] - at
        for s in range(0, len(ids), window):
            m = int((left > s).sum())
            part = ids[s : s + window, :m]
            yield m, part, np.arange(s, s + len(part))[:, None] < left[:m]


def train_locally(flat: np.ndarray, documents: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """One pass over coded documents with Adam, its rate falling; returns the parameters and the words seen."""
    flat, seen = flat.copy(), 0
    order = np.random.default_rng(7)

    def learn(held: list[np.ndarray]) -> None:
        """Runs of like length share their lanes, so that few windows have empty ones; the groups come in a mixed order."""
        nonlocal seen
        runs = sorted((ids[at : at + RUN] for ids in held for at in range(0, len(ids), RUN)), key=len, reverse=True)
        groups = [runs[at : at + LANES] for at in range(0, len(runs), LANES)]
        total, updates = sum(-(-len(g[0]) // WINDOW) for g in groups), 0
        mean, square, scratch = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        for k in order.permutation(len(groups)):
            h = np.zeros((len(groups[k]), HIDDEN), dtype=np.float32)
            for n, ids, mask in _windows(groups[k], WINDOW):
                grad, h = gradient(unpack(flat), ids, mask, h[:n])
                updates += 1
                np.multiply(mean, 0.9, out=mean)
                np.multiply(grad, 0.1, out=scratch)
                np.add(mean, scratch, out=mean)
                np.multiply(square, 0.99, out=square)
                np.multiply(grad, grad, out=grad)
                np.multiply(grad, 0.01, out=grad)
                np.add(square, grad, out=square)
                np.multiply(square, 1 / (1 - 0.99**updates), out=scratch)
                np.sqrt(scratch, out=scratch)
                np.add(scratch, 1e-6, out=scratch)
                np.divide(mean, scratch, out=scratch)
                np.multiply(scratch, RATE * (1 - 0.9 * updates / total) / (1 - 0.9**updates), out=scratch)
                np.subtract(flat, scratch, out=flat)
        seen += sum(map(len, held))

    held: list[np.ndarray] = []
    size = 0
    for ids in documents:
        held.append(ids)
        size += len(ids)
        if size >= TOGETHER:
            learn(held)
            held, size = [], 0
    if held:
        learn(held)
    return flat, seen


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of tasks' parameters, each counted once for each word that its task saw; all rows of a block are in one partition."""
    sums: dict[int, np.ndarray] = {}
    seen: Counter = Counter()
    for batch in batches:
        for at, value, n in zip(*(batch.column(k).to_pylist() for k in ("at", "value", "seen"))):
            part = np.frombuffer(value, dtype=np.float32).astype(np.float64) * n
            sums[at] = sums[at] + part if at in sums else part
            seen[at] += n
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary()), pa.array([seen[at] for at in sums], pa.int64())], names=["at", "value", "seen"])


def score_documents(p: dict, coded: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihood of each document under the network, all of its words, the state carried along."""
    order = sorted(range(len(coded)), key=lambda k: -len(coded[k]))
    out = np.zeros(len(coded))
    for start in range(0, len(order), 2 * LANES):
        group = order[start : start + 2 * LANES]
        h = np.zeros((len(group), HIDDEN), dtype=np.float32)
        total = np.zeros(len(group))
        for n, ids, mask in _windows([coded[k] for k in group], WINDOW):
            every, _ = states(p, ids, h[:n])
            h, x = every[-1], every[:-1].reshape(-1, HIDDEN)
            if mask.all():
                total[:n] += likelihood(p, x, ids.ravel()).reshape(mask.shape).sum(axis=0)
            else:
                got = np.zeros(mask.shape)
                got[mask] = likelihood(p, x[mask.ravel()], ids[mask])
                total[:n] += got.sum(axis=0)
        out[group] = total
    return out


def deal_out(training: DataFrame, n_tokens: int, turn: int, rounds: int, words: int = LEARNED) -> DataFrame:
    """Input ids of the rows of ``training`` (key, ids) that have their turn, about ``words`` words in a partition, sorted there."""
    mine = training.where(F.pmod(F.xxhash64("key", F.lit("turn")), F.lit(rounds)) == turn).select("key", "ids")
    return mine.repartition(max(1, -(-n_tokens // (words * rounds))), "key").sortWithinPartitions("key", "ids").select("ids")


def learn_round(dealt: DataFrame, flat: np.ndarray) -> np.ndarray:
    """Parameters after every task of ``dealt`` has learned from its documents, averaged by the words they saw."""
    spark = dealt.sparkSession
    now = spark.sparkContext.broadcast(flat)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = (np.frombuffer(ids, dtype=np.uint16) for batch in batches for ids in batch.column("ids").to_pylist())
        after, seen = train_locally(now.value, coded)
        if seen:
            cuts = range(0, len(after), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array([after[at : at + BLOCK].tobytes() for at in cuts], pa.binary()), pa.array([seen] * len(cuts), pa.int64())], names=["at", "value", "seen"])

    kind = "at long, value binary, seen long"
    sums = map_batches(map_batches(dealt, learn, kind).repartition(shuffle_parts(spark), "at"), _sum_blocks, kind).collect()  # one parameter vector
    flat = flat.copy()
    for r in sums:
        total = np.frombuffer(r["value"])
        flat[r["at"] : r["at"] + len(total)] = total / r["seen"]
    return flat


def frequent(counted: DataFrame, most: int) -> DataFrame:
    """The words of ``counted`` (word, n) from some count on, ``most`` of them at most. Eighths of powers of two are the counts to choose from."""
    step = F.floor(F.log2(F.col("n")) * 8)
    room, least = most, None
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    return counted.where(step >= least) if least is not None else counted.limit(0)


def score(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, words: int = LEARNED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    Learns from the rows that are not held out. A null text is empty and has its end as only token. Repeated rows and null
    doc_ids give rows of their own. Without training rows every count is 0 and the network is as it was initialised; an
    empty table gives no rows. Other columns are ignored. A text of any length is scored as a whole. Words are told apart by a
    64-bit hash.
    """
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    coded = durable(map_batches(docs, _code, CODED))
    counted = map_batches(coded.where("words is not null").select("words", "kinds", "counts"), _dictionary_counts, "word long, class int, n long")
    counted = durable(counted.groupBy("word").agg(F.sum("n").alias("n"), F.first("class").alias("class")))
    n_tokens, n_words = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    first = counted.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    held = {r["word"]: r["n"] for r in first}
    top = frequent(counted, COUNTED).select("word", "n").toArrow()
    vocabulary = Vocabulary([r["word"] for r in first[: HEAD - 1]], top.column("word").to_numpy(), top.column("n").to_numpy())
    head_counts = np.array([held.get(w, 0) for w in vocabulary.head] + [0] * (HEAD - len(vocabulary.head)), dtype=np.float64)
    by_class = {r["class"]: (r["n"], r["words"]) for r in counted.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    tail = np.array([by_class.get(k, (0, 0)) for k in range(TAIL_CLASSES)], dtype=np.float64).reshape(TAIL_CLASSES, 2)
    classes_of_head = {r["word"]: r["class"] for r in counted.where(F.col("word").isin(vocabulary.head)).select("word", "class").collect()}
    for word in vocabulary.head:
        if word in classes_of_head:
            tail[classes_of_head[word]] -= (held.get(word, 0), 1)
    tail_log = np.log10(tail.sum(axis=1) + 1)  # counts plus one for each word and for all unseen ones
    flat = initial(head_counts, np.concatenate([head_counts.reshape(HEAD_CLASSES, CLASS_SIZE).sum(axis=1), tail[:, 0]]))

    context = docs.sparkSession.sparkContext
    priced = durable(map_batches(coded, _price(context.broadcast(vocabulary), tail_log), PRICED)).withColumn("row", F.monotonically_increasing_id())  # fixed, as the rows are written
    training = priced.where(~F.col("held_out"))
    for turn in range(rounds):
        flat = learn_round(deal_out(training, n_tokens, turn, rounds, words), flat)
    final = context.broadcast(flat)
    kept = ("row", "doc_id", "held_out", "n_tokens", "base", "fixed", "known")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpack(final.value)
        held: list[pa.RecordBatch] = []  # batches scored together, so that the few long documents leave no lanes empty
        size = 0

        def scored() -> pa.RecordBatch:
            whole = pa.concat_batches([b.select(kept) for b in held])
            net = score_documents(p, [np.frombuffer(x, dtype=np.uint16) for b in held for x in b.column("ids").to_pylist()]) / np.log(10)
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(net)], names=[*kept, "net"])

        for batch in batches:
            held.append(batch)
            size += sum(batch.column("n_tokens").to_pylist())
            if size >= TOGETHER:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()

    judged = map_batches(priced.select(*kept, "ids"), judge, "row long, doc_id long, held_out boolean, n_tokens long, base double, fixed double, known long, net double")
    pairs = priced.select("row", F.explode("rare").alias("word"))
    met = pairs.join(counted.select("word", "n"), "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count(F.lit(1)).alias("rare_known"))
    scale = float(np.log10(n_tokens + n_words + 1))
    more = F.coalesce("rare_log", F.lit(0.0))
    return judged.join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("net") + F.col("fixed") + more).alias("score"),
    )
