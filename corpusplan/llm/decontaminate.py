"""Benchmark decontamination by pigeonhole edit matching.

With at most e edits, one of e + 1 pieces of an item stands unchanged in the text. The
pieces of all items are looked for in one Aho-Corasick pass, and around each hit the
edit distance of the whole item is worked out bit-parallel.
"""

import bisect
import re

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import store_of, texts_of, with_columns
from corpusplan.sources.inventory import list_files
from corpusplan.sources.streams import locate

ERROR_RATE = 0.08
BLOCK_CHARS = 4 << 20  # items are taken in blocks of so many characters
_WORD = re.compile(r"\S+")


def normal(text: str) -> str:
    """Lower case, runs of white space as one blank, trimmed."""
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """`errors` + 1 (offset, piece) of nearly equal length."""
    n, parts = len(item), errors + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(smallest edit distance of the pattern to any part of the text, first end of such a part).

    Myers' bit-parallel columns: one step per character, whatever the pattern's length up
    to the machine's patience, as Python integers have no width. None above `most`.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & mask
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up, down = mh | ~(xv | ph) & mask, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, n, int(rate * len(n))) for i, t in items if (n := normal(t or ""))]
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, errors) in enumerate(self.items):
            for offset, piece in pieces(item, errors):
                places.setdefault(piece, []).append((k, offset))
        for piece, at in places.items():
            self.pieces.add_word(piece, (len(piece), at))
        if places:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item's best place, in code points of the text."""
        if not self.items:
            return []
        clean, starts = normal(text), {}
        for end, (length, at) in self.pieces.iter(clean):
            for k, offset in at:
                starts.setdefault(k, set()).add(end + 1 - length - offset)
        found = []
        for k, guesses in starts.items():
            _, item, errors = self.items[k]
            if (at := clean.find(item)) >= 0:
                found.append((k, 0, at, at + len(item)))
                continue
            best = None
            for a, b in _windows(sorted(guesses), len(item), errors, len(clean)):
                if hit := best_match(item, clean[a:b], errors if best is None else best[0] - 1):
                    best = (hit[0], a + hit[1])
            if best:
                distance, end = best
                low = max(0, end - len(item) - errors)
                back = best_match(item[::-1], clean[low:end][::-1], distance)
                found.append((k, distance, end - (back[1] if back else len(item)), end))
        if not found:
            return []
        places = _Places(text)
        return [(self.items[k][0], d, places.original(a, False), places.original(b, True)) for k, d, a, b in sorted(found)]


def _windows(starts: list[int], length: int, errors: int, limit: int) -> list[tuple[int, int]]:
    """The stretches in which a match may lie, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s in starts:
        a, b = max(0, s - errors), min(limit, s + length + errors)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Places:
    """From code points of the normal form to those of the text, word by word."""

    def __init__(self, text: str):
        # str.split and \S agree but for a few control characters; those count as parts of words here
        self.words, self.at, at = [], [], 0
        for m in _WORD.finditer(text):
            self.words.append(m.span())
            self.at.append(at)
            at += len(m.group().lower()) + 1

    def original(self, at: int, end: bool) -> int:
        if not self.words:
            return 0
        n = max(0, bisect.bisect_right(self.at, at - end) - 1)
        a, b = self.words[n]
        return min(b, a + at - self.at[n])


def item_files(items: DataFrame, text: str, item_id: str, block_chars: int) -> list[str]:
    """The distinct items as stored files of about `block_chars` characters each.

    A stated set of queries is matched block by block. A task reads the block it matches, so what it
    holds does not grow with the benchmark; the driver knows names of files only.
    """
    store = store_of(items.sparkSession, "items")
    named = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    distinct = store(named.groupBy("text").agg(F.min("id").alias("id")), "distinct",
                     chars=F.sum(F.length("text")))
    blocks = max(1, -(-(store.measured["distinct"]["chars"] or 0) // block_chars))
    store(distinct.repartition(blocks), "blocks")
    return sorted(r.path for r in list_files(items.sparkSession, f"{store.folder}/blocks", "*.parquet").collect())


def read_items(path: str) -> list[tuple[int | None, str]]:
    system, name = locate(path)
    with system.open_input_file(name) as f:
        table = pq.ParquetFile(f).read(columns=["id", "text"])
    return list(zip(*(table.column(c).to_pylist() for c in ("id", "text"))))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id",
          item_text: str = "text", item_id: str = "item_id", rate: float = ERROR_RATE,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (id, item_id, distance, start, end): items found in documents, at their best place.

    Texts and items are compared lower-cased with white space runs as one blank; an item of n
    such characters is found if at most floor(rate * n) edits turn it into a part of the text.
    Items without text are never found; items of equal text count as the smallest id; null
    texts hold nothing. start and end are code points of the text as given, exact unless
    lower-casing changes a word's length. Repeated rows are each answered.
    """
    def search(path):
        def run(batches):
            matcher = Matcher(read_items(path), rate)
            for batch in batches:
                out = [(d, *hit) for d, t in zip(batch.column("id").to_pylist(), texts_of(batch, "text"))
                       for hit in matcher.find(t)]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["id", "item_id", "distance", "start", "end"])
        return run

    store_of(docs.sparkSession, "leaks")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    schema = "id long, item_id long, distance long, start long, end long"
    parts = [rows.mapInArrow(search(f), schema) for f in item_files(items, item_text, item_id, block_chars)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
               item_id: str = "item_id", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found."""
    store_of(docs.sparkSession, "leaks")
    for path in item_files(items, item_text, item_id, block_chars):
        def work(path=path):
            matcher = Matcher(read_items(path), rate)
            return lambda batch: ([], [not matcher.find(t) for t in texts_of(batch, text)])
        docs = with_columns(docs, "", work)
    return docs
