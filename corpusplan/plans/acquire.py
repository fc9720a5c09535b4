"""The whole run: requests and index pages in, landed files and a ledger out."""

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, functions as F

from corpusplan import known
from corpusplan.operators.anchors import anchors_at_addresses
from corpusplan.operators.collisions import collisions, first_per_path
from corpusplan.operators.families import AnchorSource, Families, standard_families
from corpusplan.operators.landing import attribute, settled
from corpusplan.operators.requests import (
    answer, lay_out_batch, lay_out_single, require_known, unanswered,
)
from corpusplan.session import Store, shared_dir
from corpusplan.sources.archives import archive_lines, unpack_errors
from corpusplan.sources.inventory import file_system_root, qualified
from corpusplan.sources.ledger import append_batch, ledger_entries, read_log
from corpusplan.sources.objects import write_objects
from corpusplan.sources.streams import info_of, locate

# a task copies about this many bytes, and looks up about this many files
_TASK_BYTES = 1 << 30
_TASK_LOOKUPS = 1024

_FILE = ["req_id", "dataset_id", "url", "filename", "target_dir", "output_path"]
_KEPT = (
    "req_id bigint, dataset_id string, url string, filename string, target_dir string, output_path string, "
    "src_path string"
)
_LOOKED_UP = f"{_KEPT}, present boolean, problem string, length bigint, ts bigint"


@dataclass
class Run:
    """Tables of one run; all are read back from its own folder."""

    folder: str
    plan: DataFrame
    collisions: DataFrame
    missing: DataFrame
    outcomes: DataFrame
    attributed: DataFrame
    counts: dict[str, int]  # files skipped, landed and failed, counted while they were

    def _held(self) -> DataFrame:
        held = self.outcomes.where(F.col("status").isin("landed", "skipped"))
        return held.select(F.col("output_path").alias("path"), "length")

    def unpacked_lines(self, tasks: int | None = None) -> DataFrame:
        """Lines inside the tar and gzip archives this run holds, whether landed or skipped,
        and however few files a request had; what cannot be read is in `unpack_errors`."""
        return archive_lines(self._held(), tasks).where("error IS NULL").drop("error")

    def unpack_errors(self, tasks: int | None = None) -> DataFrame:
        """(path, error) of the archives held that do not unpack: broken ones, and forms that
        are attempted but never work."""
        broken = archive_lines(self._held(), tasks).where("error IS NOT NULL")
        return broken.select(F.col("archive").alias("path"), "error").unionByName(unpack_errors(self._held()))


def page_links(pages: DataFrame) -> AnchorSource:
    """Anchors straight from page texts: at each hop the pages asked for."""
    return lambda addresses: anchors_at_addresses(pages, addresses)


def plan_from_pages(requests: DataFrame, pages: DataFrame, families: Families | None = None,
                    single: bool = False, parent_dir: str = known.DEFAULT_PARENT) -> DataFrame:
    """Planned files straight from page texts.

    The addresses and links of each hop are written to the shared scratch folder, so
    pages are read once per hop.
    """
    store = Store(shared_dir(requests.sparkSession, "pages"))
    asked, files = answer(requests, page_links(pages), families or standard_families(), store)
    return (lay_out_single if single else lay_out_batch)(asked, files, parent_dir)


def _look_up(source, target, force):
    """(src_path, present, problem, length, ts): what is at both ends; ts only of what is there."""
    try:
        there = None if force else info_of(target)
        if there:
            return source, True, None, max(there[0], 0), there[1]
        found = info_of(source)
        if found is None or found[0] < 0:
            return None, False, None, None, None
        return source, False, None, found[0], None
    except Exception as problem:  # one bad file does not stop the batch
        return source, False, f"{type(problem).__name__}: {problem}", None, None


def _look_up_rows(batches, force):
    for batch in batches:
        if batch.empty:
            continue
        found = [_look_up(*row, force) for row in batch[["src_path", "output_path"]].itertuples(index=False)]
        for name, values in zip(["src_path", "present", "problem", "length", "ts"], zip(*found)):
            batch[name] = values
        batch[["length", "ts"]] = batch[["length", "ts"]].astype("Int64")
        yield batch


def with_scheme(plan: DataFrame, parent_dir: str) -> DataFrame:
    """Output paths that name no file system, on that of the (qualified) parent directory; a relative
    one is below the session's working directory there. A task would else take them for its own disk.
    """
    spark = plan.sparkSession
    root, here = file_system_root(spark, parent_dir), qualified(spark, ".")

    def whole(path):
        path = F.col(path)
        return (
            F.when(path.rlike(r"\Afile:/"), F.regexp_replace(path, r"\Afile:/+", "file:/"))
            .when(path.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), path)
            .when(F.startswith(path, F.lit("/")), F.concat(F.lit(root), path))
            .otherwise(F.concat(F.lit(f"{here}/"), path))
        )

    return plan.withColumn("target_dir", whole("target_dir")).withColumn("output_path", whole("output_path"))


def require_file_systems(plan: DataFrame) -> None:
    """Raise when output paths lie on a file system that tasks cannot write to."""
    base = F.regexp_extract("output_path", r"\A([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)", 1)
    for row in plan.select(base.alias("base")).distinct().toLocalIterator():
        try:
            locate(f"{row.base}/")
        except Exception as problem:
            raise ValueError(f"cannot write to {row.base}: {problem}") from problem


def land(kept: DataFrame, mirror_dir: str, store: Store, force: bool = False,
         tasks: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Copy the planned objects of a mirror to their output paths; (outcomes, counts by status).

    The mirror is laid out as host/path. Tasks look up their own files on both sides,
    so nothing is listed and nothing joined. What is to be copied is written down before the
    copying starts: a task repeated after a lost executor copies again and does not take its
    own earlier work for files that were there before. Copying is a write to `corpus_objects`.
    """
    spark = kept.sparkSession
    least = spark.sparkContext.defaultParallelism
    address = F.regexp_replace("url", r"\A[a-z]+://", "")
    source = F.concat(F.lit(qualified(spark, mirror_dir) + "/"), address)
    rows = store(kept.select(*_FILE, source.alias("src_path")), "kept", files=F.count(F.lit(1)))
    lookups = max(least, -(-store.measured["kept"]["files"] // _TASK_LOOKUPS))
    looked_up = settled(rows.repartition(tasks or lookups).mapInPandas(
        partial(_look_up_rows, force=force), _LOOKED_UP), force)
    wanted = F.col("status") == "landed"
    status = store(looked_up, "status", bytes=F.coalesce(F.sum(F.when(wanted, F.col("length"))), F.lit(0)),
                   skipped=F.count_if(F.col("status") == "skipped"), failed=F.count_if(F.col("status") == "failed"))
    measured = store.measured["status"]
    copies = tasks or max(least, -(-measured["bytes"] // _TASK_BYTES))
    todo = status.where(wanted).select(*_FILE, "src_path", "length").repartition(copies)
    copied, counted = write_objects(todo, qualified(spark, f"{store.folder}/copied"))
    own = [*_FILE, "status", "error", "length", "ts"]
    outcomes = copied.select(*own).unionByName(status.where(~wanted).select(*own))
    return outcomes, {"skipped": measured["skipped"], "landed": counted["landed"],
                      "failed": measured["failed"] + counted["failed"]}


def acquire(requests: DataFrame, source: AnchorSource, mirror_dir: str, parent_dir: str,
            ledger_dir: str | None = None, families: Families | None = None, single: bool = False,
            force: bool = False, tasks: int | None = None) -> Run:
    """Plan, land and record a batch (or stand-alone requests with `single`).

    Unknown ids and a batch without any file raise. Every step is written to a
    folder under the cluster's shared scratch folder and read back: anchors are read
    once per hop, and a lost executor repeats one step at most.
    """
    spark = requests.sparkSession
    families = families or standard_families()
    store = Store(shared_dir(spark, "run"))
    parent_dir = qualified(spark, parent_dir)
    require_known(requests, families)
    asked, files = answer(requests, source, families, store)
    asked, files = store(asked, "asked"), store(files, "files")
    lay_out = lay_out_single if single else lay_out_batch
    plan = store(with_scheme(lay_out(asked, files, parent_dir), parent_dir), "plan", files=F.count(F.lit(1)))
    if not store.measured["plan"]["files"]:
        raise ValueError("no files found for any request")
    require_file_systems(plan)
    outcomes, counts = land(first_per_path(plan), mirror_dir, store, force, tasks)
    if ledger_dir:
        append_batch(ledger_entries(outcomes, read_log(spark, ledger_dir)), ledger_dir, store.folder.rsplit("/", 1)[-1])
    return Run(store.folder, plan, collisions(plan), unanswered(asked, files), outcomes, attribute(plan, outcomes),
               counts)
