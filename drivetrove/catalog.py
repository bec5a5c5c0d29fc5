"""A catalogue: the named tables of one storage inventory."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from drivetrove.schema import TABLES, conform
from drivetrove.session import shuffles_removed

#: Large tables are stored by disk, so a rescan rewrites one folder and disk filters prune the rest.
PARTITIONED = {"entries": "disk_id", "name_postings": "disk_id", "text_postings": "disk_id"}

#: Range layout inside a table: neighbours in a file give useful min/max statistics, and a disk that
#: holds most rows is cut over many tasks because the second column continues the range.
LAYOUT = {
    "entries": ("disk_id", "path"),
    "name_postings": ("disk_id", "token", "entry_id"),
    "text_postings": ("disk_id", "token", "entry_id"),
    "name_terms": ("token", "disk_id"),
}


class Catalog:
    """Immutable mapping from table name to DataFrame; operators return new catalogues.

    A table may be given as a function and is then built on first use.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]],
                 stored: dict[str, tuple[str, str]] | None = None, base: Commit | None = None):
        self.spark = spark
        #: The commit that the catalogue was loaded from.
        self._base = base
        self._tables = dict(tables)
        #: Root and folder of the tables that are unchanged since they were loaded.
        self._stored = dict(stored or {})

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables.get(name)
        if table is None:
            if name not in TABLES:
                raise KeyError(f"a catalogue has no table {name!r}")
            table = self.spark.createDataFrame([], TABLES[name])
        elif not isinstance(table, DataFrame):
            table = table()
        self._tables[name] = table
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in self._tables):
            raise AttributeError(name)
        return self[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def replacing(self, **tables: DataFrame | Callable[[], DataFrame]) -> Catalog:
        """A copy with some tables exchanged, for functions that build them on first use as well."""
        kept = {name: where for name, where in self._stored.items() if name not in tables}
        return Catalog(self.spark, {**self._tables, **tables}, kept, self._base)

    def save(self, root: str) -> None:
        """Commit the tables below ``root`` as a new version; whoever reads an older one is not disturbed.

        Changed tables go to fresh folders, unchanged ones of the same root stay where they are. The commit record comes last, under a
        number that only one writer can take, so a job that fails before leaves the catalogue as it was. Where others have
        committed since this catalogue was loaded, their changes are kept if they and these touch different tables other than
        entries and disks; else :class:`CommitConflict` tells to load and change anew.
        """
        folder = f"data/{uuid.uuid4().hex}"
        base = self._base if self._base and self._base.root == root else None
        same, changed = {}, {}
        for name in self:
            if name not in TABLES:
                continue
            own_root, own_folder = self._stored.get(name, ("", ""))
            if own_root == root:
                same[name] = own_folder
            else:
                changed[name] = f"{folder}/{name}"
                write_table(self[name], name, f"{root}/{changed[name]}")
        while True:
            last = last_commit(self.spark, root)
            places = same | changed
            if base and last and last.version != base.version:
                theirs = {n for n in {*base.places, *last.places} if base.places.get(n) != last.places.get(n)}
                if theirs & set(changed) or ({"entries", "disks"} & (theirs | set(changed)) and theirs and changed):
                    raise CommitConflict(f"version {last.version} has changed {sorted(theirs)} since version {base.version} was loaded")
                places = last.places | changed
            taken = _names(self.spark, root)
            number = int(taken[0][:-5]) if taken else 0
            if number > (last.version if last else 0) and _record(self.spark, root, taken[0]):
                continue  # someone was faster
            if commit_if_free(self.spark, Commit(root, number + 1, places)):
                return


class CommitConflict(RuntimeError):
    """Someone else has committed changes that these would undo or contradict."""


class Commit:
    """A version of the catalogue below ``root``: which folder holds which table."""

    def __init__(self, root: str, version: int, places: dict[str, str]):
        self.root, self.version, self.places = root, version, places


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def commit_if_free(spark: SparkSession, commit: Commit) -> bool:
    """Write the record if its number is free."""
    files, path = _files(spark, f"{commit.root}/commits/{commit.version:020d}.json")
    try:
        stream = files.create(path, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception.getMessage()):
            return False
        raise
    stream.writeBytes(json.dumps({"version": commit.version, "places": commit.places}))
    stream.close()
    return True


#: Seconds after which a record that is still not whole belongs to a writer that died.
PATIENCE = 60


def _names(spark: SparkSession, root: str) -> list[str]:
    """Commit records, latest first."""
    files, path = _files(spark, f"{root}/commits")
    found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted((n for n in found if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _record(spark: SparkSession, root: str, name: str) -> Commit | None:
    """A commit by its record; None if its writer died over it. One that is being written is waited for."""
    files, path = _files(spark, f"{root}/commits/{name}")
    while True:
        stream = files.open(path)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            record = json.loads(text)
        except json.JSONDecodeError:
            if time.time() - files.getFileStatus(path).getModificationTime() / 1000 > PATIENCE:
                return None
            time.sleep(0.1)
        else:
            return Commit(root, record["version"], record["places"])


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """The commits below ``root``, latest first."""
    return [c for name in _names(spark, root) if (c := _record(spark, root, name))]


def last_commit(spark: SparkSession, root: str) -> Commit | None:
    return next((c for name in _names(spark, root) if (c := _record(spark, root, name))), None)


def vacuum(spark: SparkSession, root: str, keep: int = 1, older_than_seconds: float = 7 * 86400) -> list[str]:
    """Remove table folders that none of the last ``keep`` versions names, and older commit records; returns the folders. Folders
    younger than ``older_than_seconds`` stay, as they may belong to a commit under way."""
    known = commits(spark, root)
    named = {place for c in known[:keep] for place in c.places.values()}
    files, data = _files(spark, f"{root}/data")
    latest, gone = (time.time() - older_than_seconds) * 1000, []
    for job in files.listStatus(data) if files.exists(data) else []:
        for table in files.listStatus(job.getPath()):
            place = f"data/{job.getPath().getName()}/{table.getPath().getName()}"
            if place not in named and table.getModificationTime() <= latest:
                files.delete(table.getPath(), True)
                gone.append(place)
        if not files.listStatus(job.getPath()) and job.getModificationTime() <= latest:
            files.delete(job.getPath(), True)
    for old in known[keep:]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{old.version:020d}.json"), False)
    return sorted(gone)


def write_table(df: DataFrame, name: str, path: str, mode: str = "overwrite", ranged: bool = True) -> None:
    """Write one table with its layout; partitioned tables are stored by disk.

    Ranges cost a pass over ``df`` to find their bounds and a shuffle of whole rows; without ``ranged`` rows stay in the task
    that made them.
    """
    if ranged and name in LAYOUT:
        df = df.repartitionByRange(*LAYOUT[name]).sortWithinPartitions(*LAYOUT[name])
    writer = df.write.mode(mode).option("compression", "zstd")
    if name in PARTITIONED:
        writer = writer.partitionBy(PARTITIONED[name])
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)


def load_catalog(spark: SparkSession, root: str) -> Catalog:
    """Open the last version stored below ``root``, bringing older files up to the current schema.

    Files written before a column existed are read with the present schema, which yields NULL for it. A folder without
    commits is read as one table per folder.
    """
    last = last_commit(spark, root)
    tables, stored = {}, {}
    for name, schema in TABLES.items():
        folder = last.places.get(name) if last else name
        if folder is None:
            continue
        try:
            tables[name] = conform(spark.read.schema(schema).parquet(f"{root}/{folder}"), name)
        except AnalysisException as e:
            if last or e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if last:
            stored[name] = (root, folder)
    return Catalog(spark, tables, stored, last)


def disk_counts(entries: DataFrame) -> DataFrame:
    """Files, folders and bytes of every disk; bytes are those of its files."""
    is_file = ~F.col("is_folder")
    return entries.groupBy("disk_id").agg(
        F.count_if(is_file).alias("file_count"),
        F.count_if(F.col("is_folder")).alias("folder_count"),
        F.coalesce(F.sum(F.when(is_file, F.col("size_logical"))), F.lit(0)).alias("total_size"),
    )
