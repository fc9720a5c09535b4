"""Line dedup: documents probe sharded minimal perfect hashes instead of joining lines.

Keys of lines are hashed where the documents are read; only hashes are grouped. The keys
found in enough documents are dealt into shards of bounded size. Each shard is one file: a
minimal perfect hash and, in its order, a fingerprint, the count of documents and the
largest document id. A task that reads documents opens the shards its lines fall into, one
after another, so its memory does not grow with the number of frequent lines.
"""

import io
import math
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import store_of, texts_of, with_columns
from corpusplan.sources.streams import open_read, open_write

MIN_DOCS = 5
MIN_CHARS = 40
SHARD_KEYS = 1 << 18
CACHED_SHARDS = 16
_SPACE = " \t\n\v\f\r"
_LOWEST = np.iinfo(np.int64).min


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return line.strip(_SPACE).encode().lower().decode()


def key_hashes(keys: list[str]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of a 128-bit hash of each key."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k.encode()) for k in keys]), ">u8").astype("u8").reshape(-1, 2)


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) % np.uint64(size)


class PerfectHash:
    """Levels of bit arrays: a key sits in the first level where no other key shares its slot;
    its index is the number of set bits before it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        starts = np.cumsum([0, *(int(np.bitwise_count(x).sum()) for x in levels)])
        self.size = int(starts[-1])
        self.ranks = [s + np.concatenate([[0], np.cumsum(np.bitwise_count(x), dtype=np.int64)[:-1]])
                      for s, x in zip(starts, levels)]

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        """From distinct (h1, h2) rows."""
        levels, left = [], hashes
        while len(left):
            words = max(1, -(-2 * len(left) // 64))
            slots = _slot(left[:, 0], left[:, 1], len(levels), words * 64)
            single = np.bincount(slots.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(single, bitorder="little").view("<u8"))
            left = left[~single[slots]]
        return cls(levels)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each key; that of an unknown key is -1 or any."""
        out = np.full(len(hashes), -1, np.int64)
        open_rows = np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            slots = _slot(hashes[open_rows, 0], hashes[open_rows, 1], level, len(bits) * 64)
            word, bit = (slots >> np.uint64(6)).astype(np.int64), slots & np.uint64(63)
            here = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_rows[here]] = (ranks[word] + np.bitwise_count(below))[here]
            open_rows = open_rows[~here]
        return out


def shard_bytes(hashes: np.ndarray, counts: np.ndarray, last_docs: np.ndarray) -> bytes:
    perfect = PerfectHash.build(hashes)
    order = np.argsort(perfect.index(hashes))
    out = io.BytesIO()
    np.savez(out, prints=hashes[order, 1], counts=counts[order], last_docs=last_docs[order],
             **{f"level_{i}": x for i, x in enumerate(perfect.levels)})
    return out.getvalue()


class Shard:
    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as arrays:
            self.hash = PerfectHash([arrays[f"level_{i}"] for i in range(sum(n.startswith("level") for n in arrays))])
            self.prints, self.counts, self.last_docs = arrays["prints"], arrays["counts"], arrays["last_docs"]

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of documents or 0 where unknown, largest document id) of each key."""
        at = self.hash.index(hashes)
        known = (at >= 0) & (self.prints[at] == hashes[:, 1])
        return np.where(known, self.counts[at], 0), self.last_docs[at]


def _shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.npz"


def index_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[str, int]:
    """Write the shards; returns (folder, number of shards, 0 if no line is frequent)."""
    def hashed(batches):
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column("id").to_pylist(), texts_of(batch, "text")):
                keys = {k for line in t.split("\n") if len(k := line_key(line)) >= min_chars}
                rows.append((_LOWEST if doc is None else doc, list(keys)))
            hashes = key_hashes([k for _, keys in rows for k in keys]).view(np.int64)
            ids = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(x)) for x in (hashes[:, 0], hashes[:, 1], ids)], ["h1", "h2", "id"])

    store = store_of(docs.sparkSession, "lines")
    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(
        hashed, "h1 long, h2 long, id long")
    frequent = store(
        keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs),
        "frequent", rows=F.count(F.lit(1)))
    shards = math.ceil((store.measured["frequent"]["rows"] or 0) / SHARD_KEYS)
    if not shards:
        return store.folder, 0
    folder = store.folder

    def write(key, frame):
        data = shard_bytes(frame[["h1", "h2"]].to_numpy().view("u8"), frame["n"].to_numpy(), frame["last"].to_numpy())
        # the name says the content: a second attempt writes the same file again
        with open_write(_shard_path(folder, int(key[0]))) as out:
            out.write(data)
        return pd.DataFrame({"shard": [int(key[0])], "keys": [len(frame)]})

    # keys are distinct hashes, so the shards are even
    dealt = frequent.withColumn("shard", F.pmod("h1", F.lit(shards)))
    store(dealt.groupBy("shard").applyInPandas(write, "shard long, keys long"), "shards")
    return folder, shards


class _Prober:
    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.open = folder, shards, OrderedDict()

    def shard(self, n: int) -> Shard | None:
        if n not in self.open:
            try:
                with open_read(_shard_path(self.folder, n)) as stream:
                    self.open[n] = Shard(stream.read())
            except FileNotFoundError:  # no frequent key fell into it
                self.open[n] = None
            if len(self.open) > CACHED_SHARDS:
                self.open.popitem(last=False)
        self.open.move_to_end(n)
        return self.open[n]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, last = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        of = (hashes[:, 0].view(np.int64) % self.shards) if self.shards else np.zeros(0, np.int64)
        for n in np.unique(of):
            shard, rows = self.shard(int(n)), of == n
            if shard:
                counts[rows], last[rows] = shard.probe(hashes[rows])
        return counts, last


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their frequent lines removed except in the largest id holding one.

    Adds `n_lines` (before) and `n_dropped`, replacing columns of these names. Null or empty
    text is one empty line and comes back empty. A null id counts as smaller than all
    others. Rows that repeat an id are documents of their own for the count, and all of them
    keep the line if theirs is the largest id.
    """
    folder, shards = index_lines(docs, text, id_col, min_docs, min_chars)

    def work():
        prober = _Prober(folder, shards)

        def step(batch):
            ids = [(_LOWEST if d is None else int(d)) for d in batch.column(id_col).to_pylist()]
            split = [t.split("\n") for t in texts_of(batch, text)]
            places, keys = [], []
            for d, lines in enumerate(split):
                for n, line in enumerate(lines):
                    if len(line) >= min_chars and len(k := line_key(line)) >= min_chars:
                        places.append((d, n))
                        keys.append(k)
            counts, last = prober.lookup(key_hashes(keys))
            dropped = [set() for _ in split]
            for i in np.flatnonzero(counts >= min_docs):
                d, n = places[i]
                if ids[d] != last[i]:
                    dropped[d].add(n)
            kept = ["\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else "\n".join(lines)
                    for lines, gone in zip(split, dropped)]
            return [kept, [len(x) for x in split], [len(x) for x in dropped]]

        return step

    return with_columns(docs, f"{text} string, n_lines bigint, n_dropped bigint", work).select(
        *docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])

