"""Repeated byte strings: longest previous factors over the whole corpus.

A byte goes if a string of LENGTH bytes around it also starts earlier. Equal strings must
first meet on one task. Of the byte grams inside a window of LENGTH bytes the one with the
smallest hash is the window's anchor; equal windows have equal anchors, and runs of windows
share one. So only anchors are grouped:

1. Anchors whose gram occurs once are out (a compact filter, filled from the grouped grams, keeps
   them from being sent at all; what it lets through by chance falls out in step 2).
2. A run of windows equal to an earlier run, byte by byte, is repeated as a whole.
3. Runs that share a gram but differ are cut to their windows. In each block of runs sorted by gram the
   windows are put in suffix order; the previous and next smaller positions in that order give
   each window's longest earlier match. Windows of grams that reach over the end of a block
   are settled among the blocks by their first positions.

The last step joins the repeated runs to their documents and cuts them out.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import free_names, store_of, texts_of, with_columns

LENGTH = 100
GRAM = 32  # a power of two, below LENGTH
FILTER_BITS = 16  # per repeated gram
FILTER_WORDS = 1 << 23  # 64 MB at most: more grams are taken in classes, each with a filter and a pass of its own
BLOCK_WINDOWS = 100_000
_CHUNK = 1 << 16
_LOWEST = np.iinfo(np.int64).min
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that starts at each byte, doubling its length step by step."""
    h, power, m = _LETTERS[data], _BASE, 1
    with np.errstate(over="ignore"):
        while m < gram:
            h, power, m = h[:-m] * power + h[m:], power * power, 2 * m
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def first_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each `width` neighbours, the first of equals."""
    at, low, m = np.arange(len(h), dtype=np.int32), h, 1
    while 2 * m <= width:
        at = np.where(low[m:] < low[:-m], at[m:], at[:-m])
        low, m = np.minimum(low[m:], low[:-m]), 2 * m
    if rest := width - m:
        at = np.where(low[rest:] < low[:-rest], at[rest:], at[:-rest])
    return at


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Yields (text number, start of the first window, windows, gram hash) arrays of runs of windows
    that share an anchor; a text shorter than `length` has none."""
    numbers = [i for i, t in enumerate(texts) if len(t) >= length]
    at = 0
    while at < len(numbers):
        group, size = [], 0
        while at < len(numbers) and (not group or size + len(texts[numbers[at]]) <= _CHUNK):
            group.append(numbers[at])
            size += len(texts[numbers[at]])
            at += 1
        data = b"".join([texts[i] for i in group]) if len(group) > 1 else texts[group[0]]
        ends = np.cumsum([len(texts[i]) for i in group])
        for low in range(0, len(data) - length + 1, _CHUNK):
            part = np.frombuffer(data, np.uint8)[low:low + _CHUNK + length - 1]
            h = gram_hashes(part, gram)
            place = first_minima(h, length - gram + 1)
            starts = np.arange(len(place)) + low
            of = np.searchsorted(ends, starts, "right")
            inside = starts + length <= ends[of]
            place, starts, of = place[inside], starts[inside], of[inside]
            if not len(starts):
                continue
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
            count = np.diff(np.append(new, len(starts)))
            doc = of[new]
            begin = starts[new] - np.concatenate([[0], ends[:-1]])[doc]
            yield np.array(group)[doc], begin, count, h[place[new]]


class Filter:
    """Set membership without false negatives: four bits of one word a key."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def place(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        one, six = np.uint64(1), np.uint64(63)
        bits = one << (keys & six)
        for n in (6, 12, 18):
            bits |= one << (keys >> np.uint64(n) & six)
        return (keys >> np.uint64(24)) % np.uint64(size), bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        word, bits = self.place(keys, len(self.words))
        return self.words[word] & bits == bits


class Pass:
    """What one pass over the texts looks for: the keys of one class, as a broadcast filter."""

    def __init__(self, filled, number: int, of: int):
        self.filled, self.number, self.of = filled, number, of

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (unsigned) is of this class and in its filter."""
        words = self.filled.value
        found = Filter(words).holds(keys)
        if self.of > 1:
            found &= (keys >> np.uint64(24)) // np.uint64(len(words)) % np.uint64(self.of) == self.number
        return found


def passes(keys: DataFrame, count: int) -> list[Pass]:
    """The keys in column k, `count` of them, in as many classes as it takes to give each key FILTER_BITS."""
    of = max(1, -(-count * FILTER_BITS // (64 * FILTER_WORDS)))
    if of == 1:
        return [Pass(_filled(keys, count), 0, 1)]
    number = F.pmod(F.expr(f"shiftrightunsigned(k, 24) div {FILTER_WORDS}"), F.lit(of))
    return [Pass(_filled(keys.where(number == n), 64 * FILTER_WORDS), n, of) for n in range(of)]


def in_passes(keys: DataFrame, count: int, one) -> DataFrame:
    """The rows `one(pass)` finds, over all passes."""
    out = None
    for p in passes(keys, count):
        out = one(p) if out is None else out.unionByName(one(p))
    return out


def _filled(keys: DataFrame, count: int):
    """The filter words of the keys in column k, broadcast; the words are filled by tasks, each its own stretch of them."""
    size = min(FILTER_WORDS, max(64, -(-count * FILTER_BITS // 64)))
    stretch = -(-size // 64)

    def fill(batches):
        parts = {}
        for batch in batches:
            word, bits = Filter.place(batch.column("k").to_numpy().view(np.uint64), size)
            for s in np.unique(word // np.uint64(stretch)):
                mine = word // np.uint64(stretch) == s
                words = parts.setdefault(int(s), np.zeros(stretch, np.uint64))
                np.bitwise_or.at(words, (word[mine] - s * np.uint64(stretch)).astype(np.int64), bits[mine])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([w.tobytes() for w in parts.values()], pa.binary())],
                                         ["stretch", "words"])

    word = F.pmod(F.shiftrightunsigned("k", 24), F.lit(size))
    dealt = keys.select("k", (word / stretch).cast("long").alias("s")).repartition(64, "s").select("k")
    words = np.zeros(64 * stretch, np.uint64)
    for r in dealt.mapInArrow(fill, "stretch long, words binary").toLocalIterator():
        words[r["stretch"] * stretch:(r["stretch"] + 1) * stretch] |= np.frombuffer(r["words"], np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words[:size])


def previous_factors(positions: list[int], common: list[int]) -> list[int]:
    """Longest previous factor of each suffix.

    positions: distinct text positions in suffix order; common[i]: common prefix of suffix i and the
    one before it in that order (0 for the first). A suffix's longest earlier match is with
    the nearest smaller position before or after it in suffix order; both are met as the stack is
    left.
    """
    out = [0] * len(positions)
    stack: list[tuple[int, int, int]] = []
    for i in range(len(positions) + 1):
        position, shared = (positions[i], common[i]) if i < len(positions) else (-1, 0)
        while stack and position < stack[-1][1]:
            at, _, before = stack.pop()
            out[at] = before if before > shared else shared
            if before < shared:
                shared = before
        stack.append((i, position, shared))
    return out


def later_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs in order of position: (run, offset, repeated, bytes) of each of their windows, where
    repeated says that an earlier window of these runs is equal."""
    sizes = np.array([len(c) - length + 1 for c in contexts])
    run = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.repeat(np.cumsum([0, *(len(c) for c in contexts[:-1])]), sizes) + offset
    windows = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    near = windows[order]
    differ = near[1:] != near[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), length) if len(order) > 1 else np.zeros(0, np.int64)
    factors = previous_factors(order.tolist(), [0, *shared.tolist()])
    repeated = np.zeros(len(order), bool)
    repeated[order] = np.array(factors) >= length
    return run, offset, repeated, windows


def _halves(data: list[bytes]) -> np.ndarray:
    """(n, 2) signed halves of 128-bit hashes."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(d) for d in data]), ">i8").astype(np.int64).reshape(-1, 2)


def _rows(docs: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow of `work(ids, text hashes, texts as bytes)`, which yields column lists."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids = np.array([_LOWEST if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            texts = [t.encode() for t in texts_of(batch, "text")]
            for columns in work(ids, batch.column("t").to_numpy(), texts):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(run, schema)


def _grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def work(ids, marks, texts):
        for _, _, _, keys in anchors(texts, length, gram):
            yield [keys.view(np.int64)]
    return _rows(docs, work, "k long")


def _runs(docs: DataFrame, known: Pass, length: int, gram: int) -> DataFrame:
    """The runs whose gram the pass holds, with two halves of a hash of their bytes."""
    def work(ids, marks, texts):
        for doc, start, count, keys in anchors(texts, length, gram):
            hit = known.holds(keys)
            doc, start, count = doc[hit], start[hit], count[hit]
            hashes = _halves([texts[d][s:s + n + length - 1] for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist())])
            yield [keys[hit].view(np.int64), hashes[:, 0], hashes[:, 1], ids[doc], marks[doc], start, count]
    return _rows(docs, work, "k long, c1 long, c2 long, doc_id long, t long, start long, n long")


def _contexts(docs: DataFrame, known: Pass, length: int, gram: int) -> DataFrame:
    def work(ids, marks, texts):
        for doc, start, count, keys in anchors(texts, length, gram):
            hit = known.holds(keys)
            doc, start, count = doc[hit], start[hit], count[hit]
            yield [keys[hit].view(np.int64), ids[doc], marks[doc], start,
                   [texts[d][s:s + n + length - 1] for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist())]]
    return _rows(docs, work, "k long, doc_id long, t long, start long, data binary")


def _block_windows(runs: DataFrame, length: int, block_windows: int) -> DataFrame:
    """(doc_id, t, start, n, c1, c2): repeated windows as runs with null hashes, and with hashes the
    first windows of grams that other blocks may hold too."""
    names = ["doc_id", "t", "start", "n", "c1", "c2"]

    def run(batches):
        keys, ids, marks, starts, contexts, held = [], [], [], [], [], 0
        last_cut = None  # gram whose runs an earlier block of this task ended in

        def settle(last: bool, first_key: int):
            nonlocal last_cut
            # a block that is not the task's last ends at a change of gram unless that gram fills it
            end = len(keys)
            if not last and keys[0] != keys[-1]:
                end = keys.index(keys[-1])
            group, own = contexts[:end], np.array(keys[:end])
            run_of, offset, repeated, windows = later_windows(group, length)
            doc, mark = np.array(ids[:end])[run_of], np.array(marks[:end])[run_of]
            start = np.array(starts[:end])[run_of] + offset
            key = own[run_of]
            cut = None if last or end < len(keys) else keys[-1]
            open_keys = {first_key, last_cut, cut, keys[-1] if last else None} - {None}
            wanted = ~repeated & np.isin(key, list(open_keys))
            hashes = _halves([windows[i].tobytes() for i in np.flatnonzero(wanted)])
            last_cut = cut
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate([c[repeated], c[wanted]])) for c in (doc, mark, start)),
                 pa.array(np.ones(repeated.sum() + wanted.sum(), np.int64)),
                 *(pa.array(np.concatenate([np.zeros(repeated.sum(), np.int64), hashes[:, i]]),
                            mask=np.arange(repeated.sum() + wanted.sum()) < repeated.sum()) for i in (0, 1))], names)
            del keys[:end], ids[:end], marks[:end], starts[:end], contexts[:end]

        first_key = None
        for batch in batches:
            for k, d, t, s, c in zip(*(batch.column(n).to_pylist() for n in ("k", "doc_id", "t", "start", "data"))):
                first_key = k if first_key is None else first_key
                keys.append(k)
                ids.append(d)
                marks.append(t)
                starts.append(s)
                contexts.append(c)
                held += len(c) - length + 1
                if held >= block_windows:
                    yield from settle(False, first_key)
                    held = sum(len(c) - length + 1 for c in contexts)
        if keys:
            yield from settle(True, first_key)

    ordered = runs.repartitionByRange("k", "doc_id", "t", "start").sortWithinPartitions("k", "doc_id", "t", "start")
    return ordered.mapInArrow(run, "doc_id long, t long, start long, n long, c1 long, c2 long")


def _mark(text: str):
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t")


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
            block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, t, start, n): runs of n windows, the first at byte `start`, that also occur earlier; t is the text's hash.

    Earlier is a smaller id, of one id a smaller text hash or, in the same text, an earlier start. Null text is empty, a
    null id is smaller than all others (the smallest long here). Runs may touch or overlap.
    """
    store = store_of(docs.sparkSession, "repeats")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"), _mark(text))
    many = store(_grams(rows, length, gram).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"),
                 "grams", n=F.count(F.lit(1)))
    found = store(in_passes(many, store.measured["grams"]["n"], lambda p: _runs(rows, p, length, gram)), "runs")
    same = ["k", "c1", "c2"]
    groups = store(found.groupBy(*same).agg(F.min(F.struct("doc_id", "t", "start")).alias("first"), F.max("n").alias("n"),
                                            F.count(F.lit(1)).alias("copies")), "groups")
    copied = groups.where("copies > 1").select(*same, F.col("first").alias("one"))
    place = ["doc_id", "t", "start"]
    whole = found.join(copied, same).where(F.struct(*place) != F.col("one")).select(*place, "n")
    # of runs that share a gram but differ, the first of each kind
    mixed = store(groups.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("k"),
                  "mixed", n=F.count(F.lit(1)))
    unlike = store(groups.join(mixed, "k").select("k", "first.doc_id", "first.t", "first.start"), "unlike")
    contexts = in_passes(mixed, store.measured["mixed"]["n"], lambda p: _contexts(rows, p, length, gram))
    unlike = store(contexts.join(unlike, ["k", *place]).distinct(), "contexts")
    blocks = store(_block_windows(unlike, length, block_windows), "blocks")
    open_windows = blocks.where("c1 is not null")
    firsts = store(open_windows.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"),
                                                        F.count(F.lit(1)).alias("copies")).where("copies > 1"), "firsts")
    across = (open_windows.join(firsts, ["c1", "c2"])
              .where(F.struct(*place) != F.col("first")).select(*place, "n"))
    return whole.unionByName(blocks.where("c1 is null").select(*place, "n")).unionByName(across)


def cut(data: bytes, runs: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """(bytes left, maximal removed spans) for runs (start, number of windows)."""
    spans: list[list[int]] = []
    for start, n in sorted(runs):
        end = start + n + length - 1
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in spans]


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH,
                   gram: int = GRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with every byte removed that lies in a string of `length` bytes which also
    starts earlier. Adds `kept` (binary, as a cut may fall inside a character), `n_bytes`, `n_removed`,
    `n_spans` and `kept_sha256`; columns of these names are replaced.

    Overlaps count; strings are judged on the input, not on what is left. Rows are told
    apart by id and text, those of one id (or of none) in order of a text hash; only rows equal in both are one
    place, whose equal strings do not remove each other.
    """
    runs = repeats(docs, text, id_col, length, gram, block_windows)
    own, mark, found = free_names(docs, "doc", "t", "runs")
    gathered = runs.groupBy(F.col("doc_id").alias(own), F.col("t").alias(mark)).agg(F.collect_set(F.struct("start", "n")).alias(found))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOWEST))
    joined = docs.join(gathered, (key == F.col(own)) & (_mark(text) == F.col(mark)), "left")

    def work():
        def step(batch):
            out = []
            for t, runs in zip(texts_of(batch, text), batch.column(found).to_pylist()):
                data = t.encode()
                kept, spans = cut(data, [(r["start"], r["n"]) for r in runs or []], length)
                out.append((kept, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            return [list(c) for c in zip(*out)] or [[]] * 5
        return step

    added = "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return with_columns(joined, added, work).drop(own, mark, found)
