"""Objects of a mirror written to their places, as a Spark sink.

`df.write.format("corpus_objects")` takes rows that name a source and a target file. Bytes go from file to file
inside the tasks. A task stages all its files beside their targets and gives them their names when all are there, so
that a task that fails leaves nothing under a real name. What became of each row is written as one
Parquet part a task; a task's commit message names its part, and only parts of committed tasks become visible.
"""

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusplan.session import use_source
from corpusplan.sources.streams import discard, info_of, locate, open_read, open_write, publish, remove, stage

_RESULT = [StructField("status", StringType()), StructField("error", StringType()),
           StructField("length", LongType()), StructField("ts", LongType())]
_COUNTS = "_counts.json"


@dataclass
class Part(WriterCommitMessage):
    """The outcomes of one task: its file (hidden until the commit), what it counts, and that file's length and time."""

    path: str
    length: int
    mtime: int
    landed: int
    failed: int
    bytes: int


class Objects(DataSource):
    """Option `outcomes`: a folder (with its scheme) for what became of the rows.

    Rows have src_path, output_path and length (null if not known); all their other columns are kept in the outcomes, and
    status, error, length and ts (seconds, when the copy was whole) are added.
    """

    @classmethod
    def name(cls):
        return "corpus_objects"

    def writer(self, schema, overwrite):
        return ObjectsWriter(self.options["outcomes"].rstrip("/"), schema)


class ObjectsWriter(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, outcome_schema(schema)

    def write(self, iterator):
        rows, staged, named = [], [], []
        try:
            for row in iterator:
                done = {**row.asDict(), "status": "failed", "error": None, "length": None, "ts": None}
                rows.append(done)
                try:
                    staged.append((done, *stage(row.src_path, row.output_path, row.length)))
                except Exception as problem:  # one bad file does not stop the batch
                    done["error"] = f"{type(problem).__name__}: {problem}"
            while staged:
                done, attempt, size = staged[-1]
                try:
                    publish(attempt, done["output_path"])
                    named.append(done["output_path"])
                    done.update(status="landed", length=size, ts=info_of(done["output_path"])[1])
                except Exception as problem:
                    done["error"] = f"{type(problem).__name__}: {problem}"
                staged.pop()
            return self._part(rows)
        except BaseException:
            for done, attempt, _ in staged:
                discard(attempt, done["output_path"])
            for path in named:
                remove(path)
            raise

    def _part(self, rows) -> Part:
        columns = {f.name: [r[f.name] for r in rows] for f in self.schema}
        table = pa.table(columns, schema=to_arrow_schema(self.schema))
        system, folder = locate(self.folder)
        system.create_dir(folder, recursive=True)
        path = f"{self.folder}/.part-{uuid.uuid4().hex}.parquet"
        pq.write_table(table, locate(path)[1], filesystem=system)
        size, mtime = info_of(path)
        landed = [r["length"] for r in rows if r["status"] == "landed"]
        return Part(path, size, mtime, len(landed), len(rows) - len(landed), sum(landed))

    def commit(self, messages):
        """Show the parts of the tasks that count; the counts are written beside them, for who does not want to read the rows."""
        parts = [m for m in messages if m is not None]
        system, folder = locate(self.folder)
        system.create_dir(folder, recursive=True)
        for part in parts:
            found = info_of(part.path)
            if found is None or found[0] != part.length:
                raise OSError(f"{part.path}: written by a task, but not as it was")
        for part in parts:
            own = locate(part.path)[1]
            system.move(own, own.replace("/.part-", "/part-"))
        counts = {n: sum(getattr(p, n) for p in parts) for n in ("landed", "failed", "bytes")}
        with open_write(f"{self.folder}/{_COUNTS}") as out:
            out.write(json.dumps(counts).encode())

    def abort(self, messages):
        """Forget the outcomes. Files that are whole stay, so that the next run need not copy them again and records them."""
        for part in messages:
            if part is not None:
                remove(part.path)


def outcome_schema(schema: StructType) -> StructType:
    added = {f.name for f in _RESULT}
    return StructType([f for f in schema.fields if f.name not in added] + _RESULT)


def write_objects(rows: DataFrame, outcomes: str) -> tuple[DataFrame, dict[str, int]]:
    """Copy each row's src_path to its output_path; (outcomes, counts) of what was done.

    The rows of a partition are one task, which holds the staged bytes of all its files beside the
    targets until it ends. Reading the outcomes never copies again.
    """
    spark = rows.sparkSession
    use_source(spark, Objects)
    rows.write.format("corpus_objects").option("outcomes", outcomes).mode("append").save()
    with open_read(f"{outcomes}/{_COUNTS}") as counts:
        counted = json.loads(counts.read())
    return spark.read.schema(outcome_schema(rows.schema)).parquet(outcomes), counted
