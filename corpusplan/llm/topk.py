"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integer codes and are cut, in order of id, into small blocks. A block keeps
its codes (a forward index) and each component's largest and smallest code. For a query the
sum of its terms' maxima bounds every score in a block. Blocks are scored in the order of
these bounds until they fall below the query's k-th score.

Queries are packed into chunks of bounded size. Chunks and blocks are files, and the work is dealt out as
pairs of a chunk file and a block file; a task that gets several block files of one chunk goes on with the scores
it has.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from corpusplan.llm.common import store_of
from corpusplan.sources.inventory import list_files
from corpusplan.sources.streams import locate

SCALE = 256
K = 5
BLOCK = 32
QUERY_BYTES = 8 << 20  # a chunk of queries is about this large
_TOGETHER = 1024  # blocks read at a time
_PAIRS = 64  # pairs of files for a task, if there are many
_LONG = 1 << 63
_WORST = np.iinfo(np.int64).min
_NOBODY = np.iinfo(np.int64).max


def codes_of(vectors: list, scale: int = SCALE) -> list[list[int] | None]:
    """floor(scale * component), exact, of each vector; None for vectors that take no part."""
    out = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        if x is None or not np.isfinite(x).all():
            out.append(None)
        elif (np.abs(x) < 1 << 50).all():
            out.append(np.floor(x * scale).astype(np.int64).tolist())
        else:  # a double of this size is whole
            out.append([int(c) * scale if abs(c) >= 1 << 50 else math.floor(c * scale) for c in x.tolist()])
    return out


def pack(rows: list[list[int]], dims: int) -> tuple[bytes, int]:
    """(codes, bytes a code): rows filled up with zeros, 4 or 8 bytes a code, or as many as the largest needs."""
    most = max((abs(c) for r in rows for c in r), default=0)
    width = 4 if most < 1 << 31 else 8 if most < _LONG else most.bit_length() // 8 + 1
    if width > 8:
        flat = [c for r in rows for c in [*r, *[0] * (dims - len(r))]]
        return b"".join([c.to_bytes(width, "little", signed=True) for c in flat]), width
    out = np.zeros((len(rows), dims), np.int32 if width == 4 else np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out.tobytes(), width


def unpack(data: bytes, width: int, dims: int) -> np.ndarray:
    """Codes as a matrix; of Python integers where they leave a long."""
    if width > 8:
        flat = [int.from_bytes(data[i:i + width], "little", signed=True) for i in range(0, len(data), width)]
        return np.array(flat, object).reshape(-1, dims)
    return np.frombuffer(data, np.int32 if width == 4 else np.int64).reshape(-1, dims)


_PACKED = "ids binary, codes binary, width int"


def _packed(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """rows(id, v) -> rows (ids, codes, width) of `size` vectors, in the order they come."""
    def run(batches):
        ids, codes = [], []
        for batch in batches:
            for i, c in zip(batch.column("id").to_pylist(), codes_of(batch.column("v").to_pylist())):
                if c is not None:
                    ids.append(i)
                    codes.append(c)
            whole = len(ids) // size * size
            yield part(ids[:whole], codes[:whole])
            del ids[:whole], codes[:whole]
        yield part(ids, codes)

    def part(ids, codes):
        out = [(np.array(ids[at:at + size], np.int64).tobytes(), *pack(codes[at:at + size], dims)) for at in range(0, len(ids), size)]
        kinds = (pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["ids", "codes", "width"])

    return rows.mapInArrow(run, _PACKED)


def block_index(vectors: DataFrame, vector: str, id_col: str, dims: int, block: int = BLOCK) -> DataFrame:
    """Rows (ids, codes, width): packed blocks of consecutive ids."""
    ordered = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
               .where(F.col("id").isNotNull() & F.col("v").isNotNull())
               .repartitionByRange("id", F.xxhash64("v")).sortWithinPartitions("id"))
    return _packed(ordered, dims, block)


class Shard:
    """Blocks that a task holds, searched for many queries at once."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], dims: int):
        self.ids = [i for i, _ in blocks]
        self.codes = [c for _, c in blocks]
        kind = object if any(c.dtype == object for c in self.codes) else np.int64
        self.highs = np.array([c.max(0) for c in self.codes], kind).reshape(-1, dims)
        self.lows = np.array([c.min(0) for c in self.codes], kind).reshape(-1, dims)
        self.most = max((abs(int(x)) for m in (self.highs, self.lows) for x in (m.max(initial=0), m.min(initial=0))), default=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> int:
        """Better the k best (scores, ids) of each query by what the blocks hold, _WORST standing for none; returns
        how many pairs of query and block were scored."""
        blocks = len(self.ids)
        most = self.most * max((abs(int(x)) for x in (queries.max(initial=0), queries.min(initial=0))), default=0) * queries.shape[1]
        kind = np.float64 if most < 1 << 53 else np.int64 if most < _LONG else object  # floats are exact so far, and faster
        back = np.int64 if kind is not object else object
        q, highs, lows = (m.astype(kind) for m in (queries, self.highs, self.lows))
        bounds = (np.maximum(q, 0) @ highs.T + np.minimum(q, 0) @ lows.T).astype(back)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active, at, step, scored = np.arange(len(q)), 0, 2, 0
        active = active[bounds[active, order[active, 0]] >= scores[active, -1]] if blocks else active[:0]
        while len(active) and at < blocks:
            taken = order[active, at:at + step]
            wanted = bounds[active[:, None], taken] >= scores[active, -1][:, None]  # a tie may have a smaller id
            row, col = np.nonzero(wanted)
            of, who = taken[row, col], active[row]
            scored += len(of)
            by_block = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[by_block])) + 1
            for part in np.split(by_block, cuts) if len(of) else []:
                self._score(int(of[part[0]]), who[part], q, query_ids, scores, ids, back)
            at += step
            step = min(2 * step, 64)
            if at < blocks:
                active = active[bounds[active, order[active, at]] >= scores[active, -1]]
        return scored

    def _score(self, block, who, q, query_ids, scores, ids, back):
        own = self.ids[block]
        new = (q[who] @ self.codes[block].T.astype(q.dtype)).astype(back)
        other = query_ids[who][:, None] != own[None, :]
        better = ((new >= scores[who, -1][:, None]) & other).any(1)
        who, new, other = who[better], new[better], other[better]
        if back is object and len(who) and (np.abs(new[other]) >= _LONG).any():
            raise OverflowError("a score leaves a long")
        new = np.where(other, new, _WORST).astype(np.int64)
        if not len(who):
            return
        all_scores = np.hstack([scores[who], new])
        all_ids = np.hstack([ids[who], np.where(other, own[None, :], _NOBODY)])
        best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :scores.shape[1]]
        scores[who], ids[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)


def _files(df: DataFrame, folder: str) -> list[str]:
    """The Parquet files of a stored table: names, one or more a task that wrote."""
    return sorted(r.path for r in list_files(df.sparkSession, folder, "*.parquet").select("path").collect())


def _rows_of(path: str, dims: int, together: int):
    """Lists of (ids, codes) of a stored file, `together` rows at a time."""
    system, name = locate(path)
    with system.open_input_file(name) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=together):
            yield [(np.frombuffer(r["ids"], np.int64), unpack(r["codes"], r["width"], dims)) for r in batch.to_pylist()]


def _searched(batches, chunk_files, block_files, dims, k):
    """Pairs `pair` of files -> the k best of each query over the block files that follow each other here."""
    def answers(state):
        for query_ids, (scores, ids) in state:
            real = scores > _WORST
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, scores.shape[1]).reshape(scores.shape)[real]), pa.array(ids[real]), pa.array(scores[real])],
                ["query_id", "vec_id", "score"])

    runs = []  # (chunk file, block files)
    for batch in batches:
        for pair in batch.column("pair").to_pylist():
            c, b = divmod(pair, len(block_files))
            if not runs or runs[-1][0] != c:
                runs.append((c, []))
            runs[-1][1].append(b)
    for c, own in runs:
        for chunk in _rows_of(chunk_files[c], dims, 1):  # one chunk at a time
            state = [(i, (np.full((len(i), k), _WORST), np.full((len(i), k), _NOBODY))) for i, _ in chunk]
            for b in own:
                for blocks in _rows_of(block_files[b], dims, _TOGETHER):
                    shard = Shard(blocks, dims)
                    for (query_ids, codes), (_, best) in zip(chunk, state):
                        shard.search(query_ids, codes, *best)
            yield from answers(state)


def top_k(vectors: DataFrame, is_query, vector: str = "embedding", id_col: str = "vec_id", k: int = K,
          block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, id, score): the k highest integer inner products of each query.

    `is_query` is a condition on the rows. All rows but those of the query's id are
    candidates; ties go to the smaller id. Vectors that are null or have null or non-finite
    components take no part; a null id neither. Numbers are exact whatever their size; a score among the
    best that leaves a long raises. Shorter vectors count as filled with zeros. An id repeated among the queries is asked
    once, with the smallest of its vectors; repeated candidates are each a candidate.

    Every chunk of queries meets every block file once, in one job: pairs of file names are dealt over
    tasks, a task holds one chunk and 1,024 blocks at a time, and returns k rows for each query it was given. The
    driver sees names of files only.
    """
    store = store_of(vectors.sparkSession, "topk")
    spark = vectors.sparkSession
    sized = vectors.agg(F.max(F.size(vector)).alias("dims")).first()
    dims = max(1, sized["dims"] or 1)
    index = store(block_index(vectors, vector, id_col, dims, block), "blocks")
    queries = store(vectors.where(is_query & F.col(id_col).isNotNull() & F.col(vector).isNotNull())
                    .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(vector).alias("v")), "queries", n=F.count(F.lit(1)))
    size = max(1, QUERY_BYTES // (4 * dims))
    parts = max(1, -(-store.measured["queries"]["n"] // size))
    chunks = store(_packed(queries.repartition(parts), dims, size), "chunks")
    chunk_files, block_files = _files(chunks, f"{store.folder}/chunks"), _files(index, f"{store.folder}/blocks")
    pairs = len(chunk_files) * len(block_files)
    tasks = min(pairs, max(spark.sparkContext.defaultParallelism, pairs // _PAIRS)) or 1

    def search(batches):
        return _searched(batches, chunk_files, block_files, dims, k)

    found = store(spark.range(0, pairs, 1, tasks).withColumnRenamed("id", "pair").mapInArrow(
        search, "query_id long, vec_id long, score long"), "found")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vec_id").alias(id_col), "score"))
