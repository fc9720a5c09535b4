"""Periodic runs of words by longest common extensions in suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run of
two periods or more has, for one of the two orders of the words, a Lyndon root: the longest Lyndon word
at some place i is as long as the period. So the candidates are (i, length of the longest Lyndon word
at i) in both orders, one a place; each is extended to both sides. The extension to the right is the
longest common prefix of two suffixes: the depth of the lowest common ancestor of their leaves in the
suffix tree, found in constant time as the minimum of a range of its Euler tour. The extension to the left
is the same in the tree of the reversed words. Trees are built by Ukkonen's algorithm.

Only stretches that can hold a run get trees. In a run of period q all words but the first q have
occurred at most q words before. A stretch of m such words is thus needed, with m >= 3 * q, and each of
its words occurred at most m / 3 words before (or is like its neighbour). Other words are passed over, which loses
no run and keeps the trees small.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from corpusplan.llm.common import store_of, texts_of, with_columns

LEAST_PERIODS = 4
LEAST_WORDS = 6
NARROWING = 64  # passes that narrow the stretches; each may be the last, for none loses a run


class SuffixTree:
    """Ukkonen's tree of a list of numbers from 1 on; 0 ends it. `lce` is vectorised."""

    def __init__(self, numbers: list[int]):
        word = [*numbers, 0]
        n = len(word)
        self.size = n
        # node: where its edge begins, where it ends (a leaf's edge grows to the end), its children by first number
        begin, end, link, child = [-1], [0], [0], [{}]
        node, edge, length, rest = 0, 0, 0, 0
        for at, c in enumerate(word):
            rest += 1
            made = 0
            while rest:
                if not length:
                    edge = at
                nxt = child[node].get(word[edge])
                if nxt is None:
                    child[node][word[edge]] = len(begin)
                    begin.append(at), end.append(n), link.append(0), child.append(None)
                    if made:
                        link[made] = node
                    made = 0
                else:
                    span = (end[nxt] if child[nxt] is not None else at + 1) - begin[nxt]
                    if length >= span:
                        edge, length, node = edge + span, length - span, nxt
                        continue
                    if word[begin[nxt] + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = len(begin)
                    start = begin[nxt]
                    child[node][word[edge]] = split
                    begin.append(start), end.append(start + length), link.append(0)
                    begin[nxt] = start + length
                    child.append({word[start + length]: nxt, c: split + 1})
                    begin.append(at), end.append(n), link.append(0), child.append(None)
                    if made:
                        link[made] = split
                    made = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - rest + 1
        self._tour(begin, end, child)

    def _tour(self, begin, end, child):
        """The depths met on the Euler tour, the place of each leaf in it, and the leaves in both orders."""
        n = self.size
        tour, place, leaves = [], [0] * n, []
        stack = [(0, 0, iter(sorted(child[0].items())))]
        tour.append(0)
        while stack:
            node, depth, left = stack[-1]
            step = next(left, None)
            if step is None:
                stack.pop()
                if stack:
                    tour.append(stack[-1][1])
                continue
            below = step[1]
            if child[below] is None:
                whole = depth + n - begin[below]
                place[n - whole] = len(tour)
                leaves.append(n - whole)
                tour.append(whole)
                tour.append(depth)
            else:
                down = depth + end[below] - begin[below]
                tour.append(down)
                stack.append((below, down, iter(sorted(child[below].items()))))
        self.place = np.array(place, np.int64)
        self.leaves = leaves
        table = [np.array(tour, np.int32)]
        while (width := 1 << len(table)) <= len(tour):
            half = table[-1]
            table.append(np.minimum(half[:len(half) - width // 2], half[width // 2:]))
        self.table = table

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at a and b, a <> b; size - 1 is the empty suffix."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y), np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of the binary logarithm
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << int(k))])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank; the length where there is none."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while open_ and open_[-1][1] > r:
            out[open_.pop()[0]] = i
        open_.append((i, r))
    return np.array(out, np.int64)


def all_runs(numbers: list[int], least_periods: int = 2, least_words: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of numbers from 1 on, by start, then period."""
    n = len(numbers)
    if n < 2:
        return []
    ahead, back = SuffixTree(numbers), SuffixTree(numbers[::-1])
    found = set()
    for reverse in (False, True):
        if reverse:  # the other order of the words; the end stays smallest
            top = max(numbers) + 1
            leaves = SuffixTree([top - x for x in numbers]).leaves
        else:
            leaves = ahead.leaves
        rank = np.empty(n + 1, np.int64)
        rank[leaves] = np.arange(n + 1)
        i = np.arange(n)
        period = _next_smaller(rank)[:n] - i
        j = i + period
        right = ahead.lce(i, j)
        # the words before i and before j, read backwards
        left = np.zeros(n, np.int64)
        left[1:] = back.lce(n - i[1:], n - j[1:])
        length = left + period + right
        good = (length >= least_periods * period) & (length >= least_words)
        found.update(zip((i - left)[good].tolist(), length[good].tolist(), period[good].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def windows(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) that together hold every run of LEAST_PERIODS periods and LEAST_WORDS words, with its neighbours."""
    n, need = len(numbers), LEAST_PERIODS - 1
    if n < LEAST_WORDS:
        return []
    order = np.argsort(numbers, kind="stable")
    back = np.full(n, n, np.int64)  # words since the last equal one
    same = numbers[order[1:]] == numbers[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    fits = back <= max(1, n // LEAST_PERIODS)
    for _ in range(NARROWING):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], fits.view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        size = ends - starts
        reach = np.where(size >= LEAST_WORDS - 1, np.maximum(1, size // need), 0)
        still = fits.copy()
        still[fits] = back[fits] <= np.repeat(reach, size)
        if still.sum() == fits.sum():
            break
        fits = still
    return [(max(0, a - r - 1), min(n, b + 1)) for a, b, r in zip(starts.tolist(), ends.tolist(), reach.tolist())]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of LEAST_PERIODS periods and LEAST_WORDS words or more."""
    known: dict[bytes, int] = {}
    numbers = [known.setdefault(w, len(known) + 1) for w in words]
    found = set()
    for a, b in windows(np.array(numbers, np.int64)):
        for start, length, period in all_runs(numbers[a:b], LEAST_PERIODS, LEAST_WORDS):
            first, last = a + start, a + start + length
            # cut off by the window: it is whole in another one
            if first == a > 0 and numbers[a - 1] == numbers[a - 1 + period]:
                continue
            if last == b < len(numbers) and numbers[b] == numbers[b - period]:
                continue
            found.add((first, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, as an exact fraction; then the smallest start, then period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame, text: str = "text", prepare=None, id_col: str = "doc_id", keep: bool = True) -> DataFrame:
    """Add `n_runs`, the strongest run's `start`, `length`, `period`, `exponent_milli` (null without a run),
    `runs_sha256` (all runs as start,length,period lines) and `collapsed_sha256`; with `keep` also `runs`
    (those lines) and `collapsed`, the words without the repeats, joined by blanks.

    Words are what stands between ASCII white space; null and empty texts have none. `prepare(id, words)` may
    change the words of a document first. Rows are answered one by one, repeated or not; columns of these
    names are replaced. A document is worked on in one task; its trees, over the stretches that can hold a run, take
    about a kilobyte a word of the longest one.
    """
    store_of(docs.sparkSession, "periods")

    def work():
        def step(batch):
            out = []
            ids = batch.column(id_col).to_pylist() if prepare else [None] * batch.num_rows
            for doc_id, t in zip(ids, texts_of(batch, text)):
                words = t.encode().split()
                if prepare:
                    words = prepare(doc_id, words)
                runs = runs_of(words)
                best = strongest(runs)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rest = b" ".join(kept(words, runs))
                out.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(),
                            *((lines, rest.decode()) if keep else ())))
            return [list(c) for c in zip(*out)] or [[] for _ in range(9 if keep else 7)]
        return step

    added = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
             "runs_sha256 string, collapsed_sha256 string")
    return with_columns(docs, added + ", runs string, collapsed string" * keep, work)
