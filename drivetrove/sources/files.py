"""Storage listings, content hashes and archive members through the binary file source."""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drivetrove.functions import media, paths, text as tx, words
from drivetrove.operators.tree import tree_from_paths
from drivetrove.session import materialize, number_rows, skew_join

#: Bytes that one task hashes at a time, and digests that one node of a hash tree holds.
CHUNK, FAN = 64 * 2**20, 4096
READ = 8 * 2**20
#: Folders or chunks of one task.
FOLDERS_EACH, CHUNKS_EACH = 64, 16

_NODES = "rel_path string, name string, is_folder boolean, size_logical bigint, size_physical bigint, modified_at bigint"


def _scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _relative(root: str):
    """Path below ``root``, whatever scheme the listing reports."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(F.substring_index("path", bare + "/", -1), "^/+", "")


def _children(folder: str) -> Iterator[tuple]:
    """``name, is_folder, size, allocated, modified`` of what a folder holds; links are neither followed nor measured."""
    try:
        with os.scandir(folder) as found:
            for item in found:
                try:
                    facts = item.stat(follow_symlinks=False)
                except OSError:
                    continue  # gone meanwhile
                is_folder = item.is_dir(follow_symlinks=False)
                plain = not is_folder and not item.is_symlink()
                name = os.fsencode(item.name).decode("utf-8", "replace")
                yield name, is_folder, facts.st_size if plain else 0, facts.st_blocks * 512 if plain else 0, int(facts.st_mtime)
    except OSError:
        return


def walk(spark: SparkSession, root: str, banned: list[str] | None = None, skip_hidden: bool = False) -> DataFrame:
    """All files and folders below ``root``: ``rel_path, name, is_folder, size_logical, size_physical, modified_at``.

    Mounted folders are listed level by level, each level spread over tasks; the driver only learns how many there are. Empty folders are there,
    folders that cannot be read are empty, links are files of no size. Other stores are listed by Spark, which tells folders by their files,
    no allocated sizes and no names that begin with a dot or an underscore. Names that are ``banned`` (and then those that never count) are left
    out with all below them.
    """
    if not root.startswith(("/", "file:")):
        return _stored(spark, root, banned, skip_hidden)
    base = "/" + root.removeprefix("file:").strip("/")
    keep = (lambda name: True) if banned is None else _wanted(banned, skip_hidden)

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for above in batch.column("rel_path").to_pylist():
                items = _children(f"{base}/{above}")
                while rows := list(islice(items, 10_000)):
                    rows = [(f"{above}/{r[0]}".lstrip("/"), *r) for r in rows if keep(r[0])]
                    yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          names=["rel_path", "name", "is_folder", "size_logical", "size_physical", "modified_at"])

    folders, n, found = spark.createDataFrame([("",)], "rel_path string"), 1, spark.createDataFrame([], _NODES)
    while n:
        tasks = -(-n // FOLDERS_EACH)  # by number: names are few bytes, but each is a folder to list
        level = materialize(folders.repartition(tasks).mapInArrow(list_folders, _NODES), "level")
        found, folders = found.unionByName(level), level.filter("is_folder").select("rel_path")
        n = folders.count()
    return found


def _stored(spark: SparkSession, root: str, banned: list[str] | None, skip_hidden: bool) -> DataFrame:
    """What :func:`walk` tells of stores that are not mounted."""
    found = _scan(spark, root).select(_relative(root).alias("path"), F.col("length").alias("size_logical"),
                                      F.unix_seconds("modificationTime").alias("modified_at"))
    if banned is not None:
        found = found.filter(~_unwanted("path", banned, skip_hidden))
    return tree_from_paths(found, "path").join(found, "path", "left").select(
        F.col("path").alias("rel_path"), "name", "is_folder", F.coalesce("size_logical", F.lit(0)).alias("size_logical"),
        F.lit(None).cast("bigint").alias("size_physical"), "modified_at")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, size_logical, modified_at`` of all files; contents are not read."""
    return walk(spark, root).filter("NOT is_folder").select("rel_path", "size_logical", "modified_at")


def _banned(skip_time_machine: bool, exclude_names: list[str], exclude_junk: bool) -> list[str]:
    return [".DS_Store", *(words.TIME_MACHINE if skip_time_machine else []), *exclude_names, *(words.JUNK if exclude_junk else [])]


def _wanted(banned: list[str], skip_hidden: bool) -> Callable[[str], bool]:
    names = frozenset(banned)
    return lambda name: name not in names and not name.startswith("._") and not (skip_hidden and name.startswith("."))


def _unwanted(path: str, banned: list[str], skip_hidden: bool) -> Column:
    """Whether a name of the path is unwanted."""
    parts = F.split(path, "/")
    unwanted = F.exists(parts, lambda c: c.isin(banned) | c.startswith("._"))
    return unwanted | F.exists(parts, lambda c: c.startswith(".")) if skip_hidden else unwanted


def apply_exclusions(df: DataFrame, path_col: str = "rel_path", skip_hidden: bool = False,
                     skip_time_machine: bool = True, exclude_names: list[str] = (),
                     exclude_junk: bool = False) -> DataFrame:
    """Leave out unwanted names; a named folder takes everything below it along.

    ``.DS_Store`` and ``._`` companions are always left out.
    """
    return df.filter(~_unwanted(path_col, _banned(skip_time_machine, exclude_names, exclude_junk), skip_hidden))


def file_inventory(spark: SparkSession, root: str, skip_hidden: bool = False, skip_time_machine: bool = True,
                   exclude_names: list[str] = (), exclude_junk: bool = False) -> DataFrame:
    """Files and folders below ``root`` as tree nodes, empty folders too; unwanted ones are not even listed."""
    found = walk(spark, root, _banned(skip_time_machine, exclude_names, exclude_junk), skip_hidden)
    nodes = materialize(number_rows(found, "rel_path", name="id").withColumn("_above", F.regexp_replace("rel_path", r"/?[^/]*\z", "")), "nodes")
    folders = nodes.filter("is_folder").select(F.col("rel_path").alias("_above"), F.col("id").alias("parent_id"))
    return skew_join(nodes, folders, "_above", "left", spread=F.col("id")).select(
        "id", "parent_id", "rel_path", "name", "is_folder", "size_logical", "size_physical", "modified_at",
        F.when(~F.col("is_folder"), tx.extension(F.col("name"))).alias("ext"))


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The storage all executors share, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme in ("file", path):
        return pafs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    authority, _, inner = rest.removeprefix("//").partition("/")
    store, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}")
    return store, f"{base.rstrip('/')}/{inner}"


def _open(path: str):
    """A listed file, opened in the task."""
    store, inner = _store(path)
    return store.open_input_file(inner)


def chunk_hashes(spark: SparkSession, root: str, chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of every ``chunk`` bytes of every file that an inventory lists: ``rel_path, size, chunk, digest``. The chunks of a file are hashed by many tasks;
    an empty file has one empty chunk, and ``digest`` is NULL where a file cannot be read."""
    base = root.rstrip("/")
    ranges = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size_logical") / chunk) - 1, F.lit(0)).cast("bigint"))
    parts = materialize(walk(spark, root, _banned(True, [], False)).filter("NOT is_folder").select(
        "rel_path", F.col("size_logical").alias("size"), F.explode(ranges).alias("chunk")), "ranges")

    def hash_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, number in zip(batch.column("rel_path").to_pylist(), batch.column("chunk").to_pylist()):
                try:
                    digest, left = hashlib.sha256(), chunk
                    with _open(f"{base}/{path}") as f:
                        f.seek(number * chunk)
                        while left and (data := f.read(min(READ, left))):
                            digest.update(data)
                            left -= len(data)
                    digests.append(digest.hexdigest())
                except (OSError, pa.ArrowInvalid):  # the latter: a store unknown here
                    digests.append(None)
            yield pa.record_batch([*batch.columns, pa.array(digests, pa.string())], names=["rel_path", "size", "chunk", "digest"])

    tasks = max(1, -(-parts.count() // CHUNKS_EACH))
    return parts.repartition(tasks).mapInArrow(hash_ranges, "rel_path string, size bigint, chunk bigint, digest string")


def content_hash(spark: SparkSession, root: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Content hash of every file, ``rel_path, size, content_hash, hash_algo``; NULL where a file cannot be read.

    A file of one chunk has its SHA-256. A longer one has the root of a tree: SHA-256 over the joined hexadecimal digests of ``fan``
    chunks, over those in turn, until one is left; the name of the algorithm says chunk and fan. Files of one size always have one algorithm.
    """
    level = materialize(chunk_hashes(spark, root, chunk).withColumn("chunks", F.greatest(F.ceil(F.col("size") / chunk), F.lit(1))), "chunk-hashes")
    most = level.agg(F.max("chunks")).first()[0] or 0
    nodes = level.select("rel_path", "size", "chunks", F.col("chunk").alias("at"), "digest")
    while most > 1:
        listed = F.array_sort(F.collect_list(F.struct("at", "digest")))
        joined = F.array_join(F.transform("_d", lambda d: d["digest"]), "")
        whole = ~F.exists("_d", lambda d: d["digest"].isNull())
        up = nodes.filter("chunks > 1").groupBy("rel_path", "size", "chunks", F.floor(F.col("at") / fan).alias("_up")).agg(listed.alias("_d"))
        nodes = nodes.filter("chunks = 1").unionByName(up.select(
            "rel_path", "size", F.ceil(F.col("chunks") / fan).alias("chunks"), F.col("_up").alias("at"), F.when(whole, F.sha2(joined, 256)).alias("digest")))
        most = -(-most // fan)
    algo = F.when(F.col("size") > chunk, F.lit(f"sha256-tree-{chunk}-{fan}")).otherwise("sha256")
    return nodes.select("rel_path", "size", F.col("digest").alias("content_hash"), F.when(F.col("digest").isNotNull(), algo).alias("hash_algo"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("rel_path", "member", "size", "is_dir", "y", "mo", "d", "h", "mi", "s")
    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), *[pa.int32()] * 6]
    for batch in batches:
        for path, rel_path in zip(batch.column("path").to_pylist(), batch.column("rel_path").to_pylist()):
            try:
                with _open(path) as f:
                    members = zipfile.ZipFile(f).infolist()  # reads the directory at the end only
            except (OSError, pa.ArrowInvalid, zipfile.BadZipFile):
                continue
            rows = [(rel_path, m.filename, m.file_size, m.is_dir(), *m.date_time) for m in members]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(fields))


def archive_index(spark: SparkSession, root: str) -> DataFrame:
    """Members of zip containers: path, name, size, time and kind. Damaged containers give no rows."""
    containers = _scan(spark, root).filter(F.lower("path").rlike(r"\.(zip|cbz)\z")).select(
        "path", _relative(root).alias("rel_path")).repartition("path")
    found = containers.mapInArrow(_members, "rel_path string, member string, size bigint, is_dir boolean, "
                                            "y int, mo int, d int, h int, mi int, s int")
    path = F.regexp_replace("member", r"/+\z", "")
    time = media.civil_unix(*[F.col(c) for c in ("y", "mo", "d", "h", "mi", "s")])
    return found.select("rel_path", path.alias("path"), tx.base_name(path).alias("name"), "is_dir", "size",
                        F.coalesce(time, F.lit(0)).alias("modified"))


def url_tree(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Web addresses as a storage tree, host first."""
    return tree_from_paths(pages.withColumn("_path", paths.url_path(F.col(url_col))), "_path")
