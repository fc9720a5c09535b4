"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are stored once in blocks. A block knows, for every dimension, which integer values occur in
it, and holds each vector as places in these lists. In a round a block tabulates the squared difference
of every dimension, occurring value and centroid; the distances of its vectors are then sums of
table rows gathered by NumPy. All numbers are exact, in longs where they fit and in Python's integers else.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import store_of

SCALE = 256
CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SEED = 2
BLOCK = 4096
_LIMB = 32  # totals travel in limbs of so many bits, whose sums stay far below a long's bound
_LONG = 1 << 63
_BLOCKS = "ids binary, has_id binary, sizes binary, values binary, width int, places binary"


def codes_of(vector, dims: int = DIMS, scale: int = SCALE) -> list[int] | None:
    """floor(scale * component), exact; None for a vector that takes no part."""
    if vector is None or len(vector) != dims or any(c is None for c in vector):
        return None
    x = np.asarray(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    # beyond 2 ** 53 a double is whole, and scaled as an integer it can't leave the doubles
    return [int(c) * scale if abs(c) >= 1 << 53 else math.floor(c * scale) for c in x.tolist()]


def _packed(numbers: list[int], width: int) -> bytes:
    return b"".join([n.to_bytes(width, "little", signed=True) for n in numbers])


def _unpacked(data: bytes, width: int) -> list[int]:
    return [int.from_bytes(data[i:i + width], "little", signed=True) for i in range(0, len(data), width)]


def _block(ids: list, rows: list[list[int]]) -> tuple:
    kind = np.int64 if all(-_LONG <= c < _LONG for r in rows for c in (min(r), max(r))) else object
    codes = np.array(rows, kind).T
    lists, places = zip(*(np.unique(d, return_inverse=True) for d in codes))
    values = [int(v) for occurring in lists for v in occurring]
    width = max(v.bit_length() for v in values) // 8 + 1
    return (np.array([i or 0 for i in ids], np.int64).tobytes(), bytes(i is not None for i in ids),
            np.array([len(x) for x in lists], np.int32).tobytes(), _packed(values, width), width,
            np.array(places, np.uint16 if BLOCK < 1 << 16 else np.uint32).tobytes())


def blocks_of(vectors: DataFrame, vector: str, id_col: str, dims: int, scale: int, size: int = BLOCK) -> DataFrame:
    """Stored form of the vectors that take part, with `top`, the largest absolute code of a block, as text."""
    def run(batches):
        ids, rows = [], []

        def out(last=False):
            made = []
            while len(ids) >= (1 if last else size):
                made.append(_block(ids[:size], rows[:size]))
                del ids[:size], rows[:size]
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            names = [f.split()[0] for f in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                if (c := codes_of(v, dims, scale)) is not None:
                    ids.append(i)
                    rows.append(c)
            yield out()
        yield out(last=True)

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(run, _BLOCKS)


class Block:
    """One stored block, read back."""

    def __init__(self, row: dict, dims: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.has_id = np.frombuffer(row["has_id"], np.bool_)
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
        values = _unpacked(row["values"], row["width"])
        self.lists = [values[b - n:b] for b, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]
        self.places = np.frombuffer(row["places"], np.uint16 if BLOCK < 1 << 16 else np.uint32).reshape(dims, -1)
        self.top = max(map(abs, values))

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; of equals the smaller number."""
        top = max(self.top, max(abs(c) for row in centroids for c in row))
        kind = np.int64 if 4 * top * top * len(self.lists) < _LONG else object
        by_dim = np.array(centroids, kind).T
        total = np.zeros((self.places.shape[1], len(centroids)), kind)
        for values, own, place in zip(self.lists, by_dim, self.places):
            table = (np.array(values, kind)[:, None] - own[None, :]) ** 2
            total += table[place]
        best = total.argmin(1)
        return best, total[np.arange(len(best)), best]

    def totals(self, best: np.ndarray, clusters: int) -> tuple[np.ndarray, list[list[int]]]:
        """(vectors, component sums) of each cluster."""
        counts = np.bincount(best, minlength=clusters)
        sums = []
        for values, place in zip(self.lists, self.places):
            # how often a value occurs in a cluster, times the value: exact whatever its size
            often = np.bincount(best * len(values) + place, minlength=clusters * len(values)).reshape(clusters, -1)
            kind = np.int64 if self.top * len(best) < _LONG else object
            sums.append([int(s) for s in often.astype(kind) @ np.array(values, kind)])
        return counts, [list(row) for row in zip(*sums)]


def _limbs(number: int, count: int) -> list[int]:
    low = [number >> _LIMB * i & (1 << _LIMB) - 1 for i in range(count - 1)]
    return [*low, number >> _LIMB * (count - 1)]


def _moved(blocks: DataFrame, centroids: list[list[int]], dims: int, limbs: int) -> list[list[int]]:
    """The centroids after one round. Tasks send the sums of each cluster; Spark adds them up."""
    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), [[0] * dims for _ in centroids]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, dims)
                n, s = block.totals(block.nearest(centroids)[0], len(centroids))
                counts += n
                sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, s)]
        rows = [(c, d, int(counts[c]), *_limbs(total, limbs)) for c, row in enumerate(sums) if counts[c] for d, total in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(limbs + 3)], names)

    names = ["cluster", "dim", "n", *(f"limb{i}" for i in range(limbs))]
    parts = blocks.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    moved = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "dim").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect():  # clusters x dims rows
        moved[r["cluster"]][r["dim"]] = sum(r[f"limb{i}"] << _LIMB * i for i in range(limbs)) // r["n"]
    return moved


def _starts(vectors: DataFrame, vector: str, id_col: str, clusters: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The codes of the kept vectors with the smallest hashes of seed and id; equal ids by their vectors."""
    v = F.col(vector)
    kept = F.size(v).eqNullSafe(dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = (vectors.where(kept & F.col(id_col).isNotNull()).select(own.alias("own"), v.alias("v"))
             .orderBy("own", "v").limit(clusters).collect())  # `clusters` rows
    return [codes_of(r["v"], dims, scale) for r in first]


def cluster(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: id, `cluster`, squared `distance`, `cluster_inertia`, `inertia`, `centroid` (text).

    Kept are vectors of exactly `dims` components, none null or non-finite. Repeated rows are each a vector.
    A vector without id is clustered but starts no centroid; with fewer kept vectors than `clusters` there
    are fewer centroids, with none no rows. Distances or inertias beyond a long raise.

    Centroids (clusters x dims integers) are what reaches the driver. Each round is one job over the stored
    blocks, whose tasks send clusters x dims sums each.
    """
    store = store_of(vectors.sparkSession, "centroids")
    centroids = _starts(vectors, vector, id_col, clusters, seed, dims, scale)
    own = "cluster int, distance long"
    schema = f"id long, {own}"
    if not centroids:
        assigned, names = vectors.sparkSession.createDataFrame([], schema), []
    else:
        blocks = store(blocks_of(vectors, vector, id_col, dims, scale), "blocks", width=F.max("width"))
        # a task's total of a component has at most 64 bits more than a code
        limbs = -(-(8 * (store.measured["blocks"]["width"] or 1) + 64) // _LIMB)
        for _ in range(rounds):
            centroids = _moved(blocks, centroids, dims, limbs)

        def assign(batches, centroids=centroids):
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, dims)
                    best, distance = block.nearest(centroids)
                    if distance.max() >= _LONG:
                        raise OverflowError("a squared distance leaves a long")
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64(), mask=~block.has_id),
                                                      pa.array(best, pa.int32()), pa.array(distance.astype(np.int64))],
                                                     ["id", "cluster", "distance"])

        assigned = store(blocks.mapInArrow(assign, schema), "assigned")
        names = [",".join(map(str, c)) for c in centroids]
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # `clusters` rows
    total = sum(sums.values())
    if total >= _LONG:
        raise OverflowError("the inertia leaves a long")

    def of_cluster(values, kind):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)

    return assigned.select(F.col("id").alias(id_col), "cluster", "distance",
                           of_cluster([sums.get(i, 0) for i in range(len(names))], "long").alias("cluster_inertia"),
                           F.lit(total).cast("long").alias("inertia"), of_cluster(names, "string").alias("centroid"))
