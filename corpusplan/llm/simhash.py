"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most `max_distance` bits apart
are, in at least one segment, at most floor(max_distance / segments) bits apart. So each
segment value is listed with its small Hamming ball, the ball members are looked up in the
table of segment values, and the complete distance of what is found is verified.

A segment value that very many fingerprints share would bring them all together. Such values are divided:
the bits outside the segment are cut into one piece more than may differ, so that one piece of two
neighbours is equal, and only those that share a piece as well meet.
"""

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import components, free_names, store_of, with_columns

WORDS = 3
SEED = 42
BITS = 64
MAX_DISTANCE = 3
SEGMENTS = 2
HOT = 256  # segment values of more fingerprints are divided
_SLICE = 1 << 16


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; zero if it has no word."""
    w = data.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    total, counts = max(1, len(w) - words + 1), np.zeros(BITS, np.int64)
    for at in range(0, total, _SLICE):
        part = w[at:at + _SLICE + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8))
        counts += bits.reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Add `fp` (the fingerprint as a signed long). Null text counts as empty: zero."""
    def work():
        return lambda batch: [[fingerprint((t or "").encode(), words) for t in batch.column(text).to_pylist()]]
    return with_columns(docs, "fp bigint", work)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _pieces(seg: int, width: int, parts: int):
    """The bits of `fp` outside a segment as (piece, value) structs: `parts` pieces of nearly equal length."""
    low = F.col("fp").bitwiseAND(F.lit(_signed((1 << width * seg) - 1)))
    high = F.shiftrightunsigned("fp", width * (seg + 1)) if width * (seg + 1) < BITS else F.lit(0).cast("long")
    rest = F.shiftleft(high, width * seg).bitwiseOR(low)
    cuts = [(BITS - width) * n // parts for n in range(parts + 1)]
    return F.array(*[F.struct(F.lit(n).alias("piece"), F.shiftrightunsigned(rest, x).bitwiseAND(F.lit((1 << y - x) - 1)).alias("value"))
                     for n, (x, y) in enumerate(zip(cuts, cuts[1:]))])


def segments_of(fps: DataFrame, segments: int, distance: int) -> DataFrame:
    """(fp, seg, key, pieces): each segment's value, and the bits outside it in `distance` + 1 pieces."""
    width = BITS // segments
    mask = F.lit(_signed((1 << width) - 1))
    parts = [F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", width * i).bitwiseAND(mask).alias("key"),
                      _pieces(i, width, distance + 1).alias("pieces")) for i in range(segments)]
    return fps.select("fp", F.inline(F.array(*parts)))


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS, store=None, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most `max_distance` bits apart.

    `fps` has the distinct fingerprints in `fp`. A pair may come several times.
    Of two segment values the smaller one's ball is listed, so each meeting is made once. With a `store` the segment
    values of more than `hot` fingerprints are found first, and divided.
    """
    width = BITS // segments
    radius = max_distance // segments
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]
    table = segments_of(fps, segments, max_distance)
    ball = F.array(*[F.lit(_signed(m)) for m in masks])
    probes = (
        table.withColumnRenamed("key", "own").withColumn("mask", F.explode(ball))
        .withColumn("key", F.col("own").bitwiseXOR(F.col("mask")))
        .where("key >= own").select(F.col("fp").alias("a"), "seg", "key", "pieces", (F.col("mask") == 0).alias("same"))
    )
    table = table.select(F.col("fp").alias("b"), "seg", "key", "pieces")
    met = ["seg", "key"]
    full = None
    if store:
        full = store(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("seg", "key"),
                     "hot", n=F.count(F.lit(1)))
    if full is not None and store.measured["hot"]["n"]:
        met += ["piece", "value"]
        whole = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("value")))

        def divided(rows):
            marked = rows.join(full.withColumn("full", F.lit(True)), ["seg", "key"], "left")
            return marked.withColumn("_at", F.explode(F.when(F.col("full"), F.col("pieces")).otherwise(whole))).select(
                *[c for c in rows.columns if c != "pieces"], "_at.*")

        probes, table = divided(probes), divided(table)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    # probes look small on disk and are 33 rows a value in memory: neither side is to be broadcast
    return (probes.drop("pieces").join(table.drop("pieces").hint("merge"), met)
            .where(near & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                    max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """One row per document: id, `fp`, `component_id` (smallest id reachable over links).

    Copies are one fingerprint before any pair is looked for, so a large group of
    copies costs one entry. Null ids are no one's smallest id; a component of null ids
    only gets null. Repeated rows come back as often as they came.
    """
    store = store_of(docs.sparkSession, "simhash")
    rows = store(fingerprints(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")),
                              "text").select("doc_id", "fp"), "fingerprints")
    distinct = store(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "distinct")
    found = components(store, links(distinct.select("fp"), max_distance, segments, store), "components")
    found = store(found.withColumnRenamed("node", "fp").join(distinct, "fp"), "members")
    lowest = found.groupBy("root").agg(F.min("low").alias("component_id"))
    lowest = store(lowest, "lowest")
    classes = found.join(lowest, "root").select("fp", "component_id")
    # what is neither linked nor copied is its own class and needs no lookup
    alone = distinct.where("copies > 1").join(found.select("fp"), "fp", "left_anti")
    classes = store(classes.unionByName(alone.select("fp", F.col("low").alias("component_id"))), "classes")
    known = classes.select("fp", "component_id", F.lit(True).alias("grouped"))
    return rows.join(known, "fp", "left").select(
        F.col("doc_id").alias(id_col), "fp",
        F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that are the smallest id of their component; rows without id stay.

    Rows that repeat an id are one document: they stay or go together.
    """
    own, = free_names(docs, "gone")
    gone = (near_duplicates(docs, text, id_col).where(F.col(id_col) != F.col("component_id"))
            .select(F.col(id_col).alias(own)).distinct())
    return docs.join(gone, docs[id_col] == gone[own], "left_anti")
