"""WARC archives with a two-level capture index.

Records are written by tasks to archive files, each record a gzip member of its own. Their
places are sorted by reversed-host URL key and cut into compressed blocks of index lines;
each index file ends with a sparse directory of its blocks. A lookup finds the index file by
its first key, the block by binary search in the directory, the line in the block, and then
reads just the record's range.
"""

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from contextlib import ExitStack
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import store_of
from corpusplan.sources.streams import locate, open_write

MIN_REVISIT_BYTES = 0
FILE_BYTES = 256 << 20
BLOCK_LINES = 2_000
GZIP_LEVEL = 5
READ_GAP = 64 << 10
READ_MOST = 8 << 20
TASK_BYTES = 64 << 20  # a task reads about this many bytes of records
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://a.b.com/x?y as com,b,a)/x?y; other texts after a bracket."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    turned = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return turned + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the full payload's digest and HTTP head, not its bytes."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {quote(url, safe=_URI)}",
            f"WARC-Payload-Digest: sha1:{digest_text(hashlib.sha1(payload).digest())}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "".join(chr(c) for c in range(0x21, 0x7F))


def parse(data: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest_text(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "refers_to": _page_of(fields.get("WARC-Refers-To", "")), "payload": payload}


def _page_of(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def with_originals(pages: DataFrame, store, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): null refers_to for responses, else the smallest
    page_id of equal payload. Only digests are grouped; of a payload found once there is
    nothing to look up."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    first = store(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "first")
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


class _Files:
    """Numbered files of this attempt's own, each given its name when it is complete."""

    def __init__(self, folder: str, ending: str):
        self.stem, self.ending, self.n = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", ending, 0

    def next(self) -> str:
        self.n += 1
        return f"{self.stem}-{self.n:04d}.{self.ending}"


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records; rows (key, page_id, file, offset, length), to be stored at once.

    A repeated task writes files of its own, and only those of the attempt whose rows were
    committed are named.
    """
    def run(batches):
        files, stream, path, size = _Files(folder, "warc.gz"), None, None, 0
        with ExitStack() as opened:  # a file has its name once it is closed, and none if the task fails
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    packer = zlib.compressobj(GZIP_LEVEL, wbits=31)
                    data = packer.compress(record(r["page_id"], r["url"], r["payload"].encode(), r["refers_to"])) + packer.flush()
                    if stream is None or size and size + len(data) > file_bytes:
                        opened.close()
                        path, size = files.next(), 0
                        stream = opened.enter_context(open_write(path))
                    out.append((url_key(r["url"]), r["page_id"], path, size, len(data)))
                    stream.write(data)
                    size += len(data)
                yield _batch(out, PLACES)

    return rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


PLACES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                    ("length", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_LAST = (1 << 63) - 1


def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Spark's order of (key, page_id): UTF-8 bytes, null first."""
    return key.encode(), -_LAST - 1 if page_id is None else page_id


def build_index(places: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index files; rows (key, page_id, file, offset, length) of each file's
    first line and its directory, to be stored at once."""
    def run(batches):
        path, size, lines, directory, first = _Files(folder, "cdx").next(), 0, [], [], None
        with open_write(path) as f:
            def close_block():
                nonlocal size
                data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
                f.write(data)
                directory.append([lines[0][0], lines[0][1], size, len(data)])
                size += len(data)
                lines.clear()

            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    first = first or r
                    lines.append(r)
                    if len(lines) == block_lines:
                        close_block()
            if lines:
                close_block()
            tail = zlib.compress(json.dumps(directory).encode())
            f.write(tail)
        if first:
            yield _batch([(first[0], first[1], path, size, len(tail))], PLACES)

    ordered = places.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.select(*PLACES.names).mapInArrow(run, "key string, page_id long, file string, offset long, length long")


class Reader:
    """Range reads; keeps the file that was read last open."""

    def __init__(self):
        self.path = self.file = None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            system, name = locate(path)
            self.path, self.file = path, system.open_input_file(name)
        return self.file.read_at(length, offset)


class Index:
    """Lookups of (key, page_id), fastest in sorted order: the last directory and block are kept."""

    def __init__(self, files: list[tuple]):
        self.files = sorted(files, key=lambda r: _order(r[0], r[1]))
        self.starts = [_order(r[0], r[1]) for r in self.files]
        self.reader, self.at_file, self.at_block = Reader(), None, None

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the records of this key and page."""
        wanted, found = _order(key, page_id), []
        # equal entries may reach over the end of a block or file: begin before the first that could hold one
        n = max(0, bisect.bisect_left(self.starts, wanted) - 1)
        while n < len(self.files) and self.starts[n] <= wanted:
            self._open(n)
            b = max(0, bisect.bisect_left(self.block_starts, wanted) - 1)
            while b < len(self.directory) and self.block_starts[b] <= wanted:
                entries, orders = self._block(n, b)
                i = bisect.bisect_left(orders, wanted)
                while i < len(orders) and orders[i] == wanted:
                    found.append(tuple(entries[i][2:]))
                    i += 1
                b += 1
            n += 1
        return found

    def _open(self, n: int) -> None:
        if n != self.at_file:
            _, _, path, offset, length = self.files[n]
            self.directory = json.loads(zlib.decompress(self.reader.read(path, offset, length)))
            self.block_starts = [_order(k, p) for k, p, _, _ in self.directory]
            self.at_file, self.at_block = n, None

    def _block(self, n: int, b: int):
        if b != self.at_block:
            _, _, offset, length = self.directory[b]
            text = zlib.decompress(self.reader.read(self.files[n][2], offset, length)).decode()
            self.entries = [json.loads(line) for line in text.split("\n")]
            self.orders = [_order(e[0], e[1]) for e in self.entries]
            self.at_block = b
        return self.entries, self.orders


def look_up(wanted: DataFrame, index_files: list[tuple]) -> DataFrame:
    """(file, offset, length) of the record of each wanted (url, page_id).

    `index_files` has one row per index file, whose number is that of the tasks that wrote them.
    """
    def keyed(batches):
        for batch in batches:
            keys = [url_key(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("page_id")], ["key", "page_id"])

    def search(batches):
        index = Index(index_files)
        for batch in batches:
            rows = [place for k, p in zip(*(c.to_pylist() for c in batch.columns)) for place in index.find(k, p)]
            yield _batch(rows, pa.schema(list(PLACES)[2:]))

    keys = wanted.select("url", F.col("page_id").cast("bigint").alias("page_id")).mapInArrow(keyed, "key string, page_id long")
    ordered = keys.distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(search, "file string, offset long, length long")


def read_records(places: DataFrame, payload: bool = False) -> DataFrame:
    """The records at these places: page_id, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload. Neighbouring ranges of a file are read together.

    The places are written first: they are far smaller than what they name, so the number of tasks follows from the bytes they add up to.
    """
    store = store_of(places.sparkSession, "records")
    places = store(places.select("file", "offset", "length"), "places", bytes=F.sum("length"))
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-(store.measured["places"]["bytes"] or 0) // TASK_BYTES))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][:len(names)])

    def run(batches):
        reader = Reader()
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            at = 0
            while at < len(rows):
                path, start, length = rows[at]
                end, upto = start + length, at + 1
                while (upto < len(rows) and rows[upto][0] == path and rows[upto][1] - end <= READ_GAP
                       and rows[upto][1] + rows[upto][2] - start <= READ_MOST):
                    end, upto = max(end, rows[upto][1] + rows[upto][2]), upto + 1
                data = reader.read(path, start, end - start)
                found = [parse(zlib.decompress(data[o - start:o - start + n], wbits=31)) for _, o, n in rows[at:upto]]
                yield _batch([tuple(r[n] for n in names) for r in found], schema)
                at = upto

    ordered = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ordered.mapInArrow(run, ddl + ", payload binary" * payload)


def archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES,
            block_lines: int = BLOCK_LINES) -> tuple[DataFrame, list[tuple]]:
    """Write archives and index of pages (page_id, url, html); returns (places of all records,
    rows of the index files).

    Null html is an empty payload, null url an empty address. Of equal payloads of at least
    `min_bytes` the row with the smallest page_id is the response; rows that repeat that id are
    responses too, and rows without id always are.
    """
    store = store_of(pages.sparkSession, "warc")
    places = store(write_archives(with_originals(pages, store, min_bytes), f"{store.folder}/archives", file_bytes), "places")
    files = store(build_index(places, f"{store.folder}/index", block_lines), "files")
    return places, [tuple(r) for r in files.collect()]
