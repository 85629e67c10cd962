"""A workspace of several tables under one revision.

A workspace is a folder: data folders of Parquet, and revision files. A revision file names,
for every table, the data folders that make it up, and for each stream the last batch taken.
Whoever reads takes one revision file and so one consistent set of tables, however many
commits happen meanwhile: data folders are never changed. Whoever writes puts all new data
into fresh folders first and then publishes the next revision by a rename that fails if its
number exists: many tables change, or none; of two writers on one revision, one gets
RevisionConflict; a write that breaks off leaves folders that no revision names.

The rename is a lock where the file system renames atomically and refuses an existing name
(HDFS and local disks do). Object stores copy instead: there, revision files belong on a
file system that has such a rename, while data folders may lie anywhere.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: revisions count up to the largest whole number that a double holds exactly.
LAST_REVISION = (1 << 53) - 1
#: How often a writer whose revision was overtaken tries again.
TRIES = 20


class RevisionConflict(RuntimeError):
    """Someone else has written the revision that this write was based on."""


@dataclass(frozen=True)
class Snapshot:
    """One revision: number, the folders of each table, the last batch taken by stream, and the workspace's name."""

    number: int = 0
    tables: dict[str, tuple[str, ...]] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)
    name: str = ""


@dataclass(frozen=True)
class Change:
    """New ``rows`` of a table beside what it has, without the folders in ``drop`` (None: all that it has)."""

    rows: DataFrame | None = None
    drop: tuple[str, ...] | None = ()


def replaced(rows: DataFrame) -> Change:
    """A table's whole content anew."""
    return Change(rows, None)


def _files(spark: SparkSession, path: str):
    """Hadoop's Path class, and the file context of ``path``."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The published revisions, ascending."""
    at, files = _files(spark, path)
    folder = at(f"{path}/revisions")
    if not files.util().exists(folder):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def at_revision(spark: SparkSession, path: str, number: int) -> Snapshot:
    at, files = _files(spark, path)
    stream = files.open(at(f"{path}/revisions/{number:016d}.json"))
    try:
        known = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(number, {t: tuple(x) for t, x in known["tables"].items()}, known["taken"], known["name"])


def newest(spark: SparkSession, path: str) -> Snapshot:
    """The newest revision; number 0 without any table if there is none."""
    known = numbers(spark, path)
    return at_revision(spark, path, known[-1]) if known else Snapshot()


def table(spark: SparkSession, path: str, snapshot: Snapshot, name: str) -> DataFrame | None:
    """A table as of ``snapshot``; None if it has none of that name."""
    folders = snapshot.tables.get(name)
    return spark.read.parquet(*[f"{path}/{x}" for x in folders]) if folders else None


def read(spark: SparkSession, path: str, snapshot: Snapshot | None = None) -> dict[str, DataFrame]:
    """All tables of one revision (the newest)."""
    snapshot = snapshot or newest(spark, path)
    return {name: table(spark, path, snapshot, name) for name in snapshot.tables}


def next_number(number: int) -> int:
    if not 0 <= number < LAST_REVISION:
        raise ValueError("the revision can't be counted up")
    return number + 1


def create(spark: SparkSession, path: str, name: str) -> Snapshot:
    """A new workspace at revision 1, without tables."""
    if not 1 <= len(name.strip()) <= 120:
        raise ValueError("a workspace's name has 1 to 120 characters")
    first = Snapshot(1, name=name.strip())
    _publish(spark, path, first)
    return first


def commit(spark: SparkSession, path: str, based_on: Snapshot, changes: dict[str, Change], taken: tuple[str, int] | None = None) -> Snapshot:
    """The revision after ``based_on`` with all of ``changes``; raises, and changes nothing, if there is one already. ``taken``: a stream and its batch."""
    if (numbers(spark, path) or [0])[-1] != based_on.number:
        raise RevisionConflict(f"the workspace is not at revision {based_on.number}")
    tables = dict(based_on.tables)
    for name, change in changes.items():
        kept = () if change.drop is None else tuple(x for x in tables.get(name, ()) if x not in change.drop)
        if change.rows is not None:
            folder = f"{name}-{uuid.uuid4().hex}"
            change.rows.write.parquet(f"{path}/{folder}")
            kept = (*kept, folder)
        tables[name] = kept
    new = Snapshot(next_number(based_on.number), {n: x for n, x in tables.items() if x}, based_on.taken | dict([taken] if taken else []), based_on.name)
    _publish(spark, path, new)
    return new


def retried(spark: SparkSession, path: str, change: Callable[[Snapshot], Snapshot]) -> Snapshot:
    """``change`` on the newest revision, anew whenever another writer was first; at most TRIES times."""
    for left in reversed(range(TRIES)):
        try:
            return change(newest(spark, path))
        except RevisionConflict:
            if not left:
                raise
    raise AssertionError


def _publish(spark: SparkSession, path: str, new: Snapshot) -> None:
    at, files = _files(spark, path)
    # Not a name that ``numbers`` reads, until it is renamed.
    draft = at(f"{path}/revisions/draft-{uuid.uuid4().hex}")
    create_file = spark._jvm.org.apache.hadoop.fs.FileSystem.get(draft.toUri(), spark._jsc.hadoopConfiguration()).create(draft, False)
    create_file.write(bytearray(json.dumps({"tables": new.tables, "taken": new.taken, "name": new.name}).encode()))
    create_file.close()
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(draft, at(f"{path}/revisions/{new.number:016d}.json"), none)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise RevisionConflict(f"revision {new.number} has been written by another") from e
        raise


def upserted(spark: SparkSession, path: str, snapshot: Snapshot, name: str, key: str, images: DataFrame) -> Change:
    """The table with the rows of ``images`` (``key``, ``after``: a struct of the other columns, null deletes) in place of those with their keys.

    Only data folders that hold such a key are written anew; the others stay as they are.
    The folders' names alone come to the driver: as many as the revision file lists.
    """
    after = images.select(key, "after")
    have = table(spark, path, snapshot, name)
    if have is None:
        return Change(after.filter("after is not null").select(key, "after.*"))
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    hit = tuple(sorted(r[0] for r in have.select(key, folder.alias("folder")).join(after.select(key), key, "left_semi").select("folder").distinct().collect()))
    added = after.filter("after is not null").select(key, *[F.col(f"after.{c}").cast(have.schema[c].dataType).alias(c) for c in have.columns if c != key])
    if not hit:
        return Change(added)
    stay = spark.read.parquet(*[f"{path}/{x}" for x in hit]).join(after.select(key), key, "left_anti")
    return Change(stay.select(*have.columns).unionByName(added.select(*have.columns)), hit)


def bucketed(rows: DataFrame, key: str, n: int) -> list[DataFrame]:
    """``rows`` in ``n`` parts by key: appended one by one, an upsert writes few of them anew."""
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode (tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="coinbrook-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
