"""Runs of words that repeat with a period, by the linear tandem-repeat method of Gusfield and Stoye.

A square is a stretch of words that is some stretch twice. Within one string of word numbers:

1. Lempel-Ziv blocks. The leftmost occurrence of any square touches at most two of them, so common extensions around their borders give
   squares from which all leftmost ones follow by rotation.
2. Every square is located in the suffix tree, as a point on an edge.
3. From each point suffix links are walked: leaving out a square's first word and reading it again at the end rotates the square, if the tree
   has it. Points met before end a walk. What was met is the whole vocabulary of squares.
4. The leaves below the points of squares with a primitive root are their occurrences; those of one period that start at consecutive words
   merge into a run, which is maximal.

A run of ``power`` periods has each of its words ``power`` times. Stretches in which some word is rarer are cut there, again and again
until none is; what is left, little of ordinary prose, is strung together with separators that occur once. Nothing is lost by it.

Scale: one scan without a shuffle. A task strings together about ``STRUNG`` words, so its memory follows the longest single stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

POWER, SHORTEST = 4, 6
#: Words that are read, and words left to search, that are taken together.
READ, STRUNG = 200_000, 60_000
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
Run = tuple[int, int, int]  # start, length, period


class Ranks:
    """Suffix array by prefix doubling. The ranks of every doubling stay, as they answer how far two places agree."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        rank, self.levels, width = np.unique(text, return_inverse=True)[1], [], 1
        while True:
            self.levels.append(np.append(rank, -1))
            order = np.argsort(rank, kind="stable")
            if n == 0 or rank[order[-1]] == n - 1:
                break
            second = np.zeros(n, dtype=np.int64)
            second[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            width *= 2
        self.places, self.rank, self.n = order, rank, n

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from ``a`` on that equal those from ``b`` on, for unequal places of a text that ends with a word found once."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[j][a] == self.levels[j][b]).astype(np.int64) << j
            a += step
            b += step
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words up to ``a``, itself included, that equal those up to ``b``; -1 may be a place."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = a + 1 - (1 << j), b + 1 - (1 << j)
            step = ((np.minimum(x, y) >= 0) & (self.levels[j][np.maximum(x, 0)] == self.levels[j][np.maximum(y, 0)])).astype(np.int64) << j
            a -= step
            b -= step
        return start - a


def _blocks(ranks: Ranks) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, each the longest stretch that also starts earlier, or one new word; and the text's end."""
    n = ranks.n
    places, before, after, stack = ranks.places.tolist(), [-1] * n, [-1] * n, []
    for at in places:
        while stack and stack[-1] > at:
            after[stack.pop()] = at
        before[at] = stack[-1] if stack else -1
        stack.append(at)
    longest = np.zeros(n, dtype=np.int64)
    for other in (np.array(before), np.array(after)):
        known = np.flatnonzero(other >= 0)
        longest[known] = np.maximum(longest[known], ranks.ahead(known, other[known]))
    out, at, size = [], 0, np.maximum(longest, 1).tolist()
    while at < n:
        out.append(at)
        at += size[at]
    return np.array([*out, n])


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners (0, 0, 1, 1, 1) and numbers in them (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def leftmost_squares(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares of which every leftmost one is a rotation to the right."""
    cuts = _blocks(ranks)
    here, there, size = cuts[:-1], cuts[1:], np.diff(cuts)
    found = []
    # around the right border: the second half begins k words before it
    own, k = _each(size)
    k += 1
    right = there[own]
    keep = right < ranks.n
    right, k = right[keep], k[keep]
    q = right - k
    forth, back = ranks.ahead(right, q), ranks.behind(right - 1, q - 1)
    good = (forth + back >= k) & (forth > 0)
    found.append((np.maximum(q - back, q - k + 1)[good], k[good]))
    # around the left border: the second half begins k words behind it
    own, k = _each(size + np.append(size[1:], 0))
    k += 1
    left = here[own]
    keep = left + k < ranks.n
    left, k = left[keep], k[keep]
    q = left + k
    forth, back = ranks.ahead(left, q), ranks.behind(left - 1, q - 1)
    good = (forth + back >= k) & (forth > 0)
    found.append((np.maximum(left - back, left - k + 1)[good], k[good]))
    start, period = (np.concatenate(x) for x in zip(*found))
    return np.maximum(start, 0), period


class Tree:
    """Suffix tree over sorted suffixes: nodes 0..n-1 are the leaves in order, n is the root."""

    def __init__(self, text: np.ndarray, ranks: Ranks) -> None:
        n, places = ranks.n, ranks.places
        common = np.concatenate([[0], ranks.ahead(places[1:], places[:-1])]).tolist()
        depth, low, parent, high = (n - places).tolist() + [0], list(range(n)) + [0], [n] * (n + 1), list(range(1, n + 1)) + [n]
        stack = [n]
        for leaf in range(n):
            shared = common[leaf]
            while depth[stack[-1]] > shared:
                node = stack.pop()
                high[node] = leaf
                if depth[stack[-1]] < shared:
                    depth.append(shared)
                    low.append(low[node])
                    parent.append(n)
                    high.append(0)
                    stack.append(len(depth) - 1)
                parent[node] = stack[-1]
            stack.append(leaf)
        while len(stack) > 1:
            node = stack.pop()
            high[node], parent[node] = n, stack[-1]
        self.root, self.depth, self.parent, self.low, self.high = n, np.array(depth), np.array(parent), np.array(low), np.array(high)
        self.ups = [self.parent]
        while (self.ups[-1] != n).any():
            self.ups.append(self.ups[-1][self.ups[-1]])
        self.sigma = int(text.max()) + 1
        inner = np.flatnonzero(np.arange(len(depth)) != n)
        first = text[places[self.low[inner]] + self.depth[self.parent[inner]]]
        self.child = dict(zip((self.parent[inner] * self.sigma + first).tolist(), inner.tolist()))
        self.link = np.full(len(depth), n)
        inner = np.arange(n + 1, len(depth))
        self.link[inner] = self.above(ranks.rank[places[self.low[inner]] + 1], self.depth[inner] - 1)

    def above(self, node: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest node at or over ``node`` of at least the given depth: the edge that a stretch of that length ends on."""
        for up in reversed(self.ups):
            over = up[node]
            node = np.where(self.depth[over] >= length, over, node)
        return node


def vocabulary(text: np.ndarray, ranks: Ranks, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Every square of the text once: the node at or below its point, and its length."""
    start, period = leftmost_squares(ranks)
    points = tree.above(ranks.rank[start], 2 * period)
    depth, parent, link, first, said, child, sigma = tree.depth.tolist(), tree.parent.tolist(), tree.link.tolist(), ranks.places[tree.low].tolist(), text.tolist(), tree.child, tree.sigma
    met: set[tuple[int, int]] = set()
    for node, length in zip(points.tolist(), (2 * period).tolist()):
        want = length - 1
        while (node, length) not in met:
            met.add((node, length))
            at = first[node]
            letter, node = said[at], link[parent[node]]
            while depth[node] < want:
                node = child[node * sigma + said[at + 1 + depth[node]]]
            if depth[node] > want:
                if said[first[node] + want] != letter:
                    break
            else:
                node = child.get(node * sigma + letter)
                if node is None:
                    break
    out = np.array(sorted(met), dtype=np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _primitive(ranks: Ranks, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of each square is no repetition itself."""
    most = int(period.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            part = factor[p * p :: p]
            part[part == np.arange(p * p, most + 1, p)] = p
    good, rest = np.ones(len(period), dtype=bool), period.copy()
    while (live := np.flatnonzero((rest > 1) & good)).size:
        prime = factor[rest[live]]
        part = period[live] // prime
        good[live] = ranks.ahead(start[live], start[live] + part) < period[live] - part
        rest[live] //= prime
    return good


def runs_of(strung: list[np.ndarray], power: int = POWER, shortest: int = SHORTEST) -> list[tuple[int, int, int, int]]:
    """(which string, start, length, smallest period) of every run of ``power`` periods and ``shortest`` words."""
    if not strung:
        return []
    most = max(int(s.max(initial=0)) for s in strung) + 1
    text = np.concatenate([x for n, s in enumerate(strung) for x in (s, [most + n])]).astype(np.int64)
    ends = np.cumsum([len(s) + 1 for s in strung])
    text = np.unique(text, return_inverse=True)[1]
    ranks = Ranks(text)
    tree = Tree(text, ranks)
    node, length = vocabulary(text, ranks, tree)
    period = length // 2
    good = _primitive(ranks, ranks.places[tree.low[node]], period)
    node, period = node[good], period[good]
    own, k = _each(tree.high[node] - tree.low[node])
    start, period = ranks.places[tree.low[node][own] + k], period[own]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    if not len(start):
        return []
    new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(period) != 0)])
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(start)) - 1
    size = start[last] - start[first] + 2 * period[first]
    long = size >= np.maximum(shortest, power * period[first])
    first, size = first[long], size[long]
    which = np.searchsorted(ends, start[first], side="right")
    offset = np.concatenate([[0], ends])[which]
    return list(zip(which.tolist(), (start[first] - offset).tolist(), size.tolist(), period[first].tolist()))


def stretches(ids: np.ndarray, group: np.ndarray, power: int = POWER, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Stretches inside groups in which every word occurs ``power`` times and which have ``shortest`` words; words of two groups have unequal numbers."""
    at, keep = np.arange(len(ids)), (np.bincount(ids) >= power)[ids] if len(ids) else np.zeros(0, bool)
    while True:
        whole = keep.all()
        at, ids, group = at[keep], ids[keep], group[keep]
        if not len(at):
            return []
        label = np.cumsum(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(group) != 0)])) - 1
        big = (np.bincount(label) >= shortest)[label]
        at, ids, group = at[big], ids[big], label[big]
        if whole and big.all():
            first = np.flatnonzero(np.concatenate([[True], np.diff(label) != 0]))
            return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 1).tolist()))
        _, which, count = np.unique(group * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True, return_counts=True)
        keep = (count >= power)[which] if len(at) else big[:0]


def _taken(docs: list[list[bytes]], power: int, shortest: int) -> list[list[Run]]:
    """The runs of each document, by start, then period."""
    ids, numbers = [], 0
    for words in docs:
        known: dict[bytes, int] = {}
        ids.append(np.array([known.setdefault(w, numbers + len(known)) for w in words], dtype=np.int64))
        numbers += len(known)
    every, sizes = np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(i) for i in ids])
    begins = np.cumsum(sizes) - sizes
    out: list[list[Run]] = [[] for _ in docs]
    held, size = [], 0

    def search() -> None:
        for which, start, length, period in runs_of([every[s:e] for s, e in held], power, shortest):
            doc = int(np.searchsorted(begins + sizes, held[which][0], side="right"))
            out[doc].append((held[which][0] + start - int(begins[doc]), length, period))

    for s, e in stretches(every, np.repeat(np.arange(len(docs)), sizes), power, shortest):
        if held and size + e - s > STRUNG:
            search()
            held, size = [], 0
        held.append((s, e))
        size += e - s
    search()
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length/period; of equal ones the first, then that of the smaller period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that stand in some run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, [s + p for s, _, p in runs], 1)
    np.add.at(edge, [s + n for s, n, _ in runs], -1)
    return [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist()) if not gone]


def find_runs(docs: DataFrame, power: int = POWER, shortest: int = SHORTEST, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its runs of ``power`` periods at least and ``shortest`` words at least.

    Returns doc_id, n_runs; start, length, period and exponent_milli of the strongest run (null without any); hashes of all runs and of the
    text without the repetitions. ``change`` may make other words of a row's before they are searched. Null and wordless texts have no
    runs and collapse to the empty text; rows may repeat or lack doc_ids, each is judged by itself; an empty table gives no rows. Other
    columns are ignored. A text of any length is searched as a whole.
    """
    if power < 2:
        raise ValueError("a run has two periods at least")
    names = [part.split()[0] for part in OUT.split(", ")]

    def rows(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        out = []
        for (doc, words), runs in zip(held, _taken([w for _, w in held], power, shortest)):
            best = strongest(runs)
            said = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
            kept = b" ".join(collapsed(words, runs))
            out.append((doc, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), hashlib.sha256(said).hexdigest(), hashlib.sha256(kept).hexdigest()))
        columns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 6 else pa.string()) for n, c in enumerate(columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                words = text.split() if text else []
                held.append((doc, change(doc, words) if change is not None else words))
                size += len(held[-1][1]) + 1
                if size >= READ:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, OUT)


def brute_force(words: list[bytes], power: int = POWER, shortest: int = SHORTEST) -> list[Run]:
    """The same by every period and place, for small tests."""
    out: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // power + 1):
        start = None
        for at in range(len(words) - period + 1):
            same = at < len(words) - period and words[at] == words[at + period]
            if same and start is None:
                start = at
            if not same and start is not None:
                length = at - start + period
                if length >= max(shortest, power * period):
                    out.setdefault((start, length), period)
                start = None
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))
