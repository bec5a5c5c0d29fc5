"""Statistics, duplicates, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivetrove.catalog import Catalog, disk_counts
from drivetrove.functions.text import natural_key

TOP = 25
MIN_DUPLICATE = 1024 * 1024
DUPLICATE_GROUPS = 500
DUPLICATE_ITEMS = 100


def _of_disk(df: DataFrame, disk_id: int | None, column: str = "disk_id") -> DataFrame:
    return df if disk_id is None else df.filter(F.col(column) == disk_id)


def catalog_totals(cat: Catalog, disk_id: int | None = None) -> DataFrame:
    """Files, folders and bytes from the maintained disk columns; entries are not scanned."""
    return _of_disk(cat.disks, disk_id, "id").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("file_count", "folder_count", "total_size")])


def ext_distribution(cat: Catalog, disk_id: int | None = None, k: int = TOP) -> DataFrame:
    """Count and bytes per extension, largest first, with the share of the largest one."""
    by_ext = (
        _of_disk(cat.entries, disk_id).filter("NOT is_folder AND ext IS NOT NULL").groupBy("ext")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("size_logical").alias("total_size"))
        .orderBy(F.col("total_size").desc(), "ext").limit(k)
    )
    # at most k rows reach this window
    top = F.max("total_size").over(Window.partitionBy())
    return by_ext.withColumn("share", F.when(top > 0, F.col("total_size") / top).otherwise(F.lit(0.0)))


def biggest_files(cat: Catalog, disk_id: int | None = None, k: int = TOP) -> DataFrame:
    """Largest files with disk name and path; the top k is taken before the join."""
    top = (
        _of_disk(cat.entries, disk_id).filter("NOT is_folder")
        .select("id", "disk_id", "name", "size_logical", "path")
        .orderBy(F.col("size_logical").desc(), "id").limit(k)
    )
    return with_disk_name(top, cat).drop("disk_id").orderBy(F.col("size_logical").desc(), "id")


def with_disk_name(df: DataFrame, cat: Catalog) -> DataFrame:
    return df.join(cat.disks.select(F.col("id").alias("disk_id"), F.col("name").alias("disk_name")), "disk_id")


def duplicate_summary(cat: Catalog, min_size: int = MIN_DUPLICATE,
                      by: tuple[str, ...] = ("name", "size_logical")) -> DataFrame:
    """All groups of equal files: count, size of one copy and recoverable bytes."""
    files = cat.entries.filter((~F.col("is_folder")) & (F.col("size_logical") >= min_size))
    for key in by:
        files = files.filter(F.col(key).isNotNull())
    return (
        files.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("count"), F.max("size_logical").alias("size"),
             F.sum("size_logical").alias("_sum"))
        .filter("count > 1")
        .withColumn("wasted", F.col("_sum") - F.col("size")).drop("_sum")
    )


def duplicate_groups(cat: Catalog, min_size: int = MIN_DUPLICATE, limit: int = DUPLICATE_GROUPS,
                     by: tuple[str, ...] = ("name", "size_logical"), items: int = DUPLICATE_ITEMS) -> DataFrame:
    """The most wasteful groups with up to ``items`` members each, one row per member.

    ``count`` stays exact. Members are ranked inside small buckets of a group first and the survivors
    then against each other, so one group holding most files never lands in a single sort.
    """
    top = duplicate_summary(cat, min_size, by).orderBy(F.col("wasted").desc(), *by).limit(limit)
    members = cat.entries.filter((~F.col("is_folder")) & (F.col("size_logical") >= min_size))
    # at most `limit` group rows: broadcast while that bound is small
    small = F.broadcast(top) if limit <= 10_000 else top
    found = members.select("id", "disk_id", "path", *by).join(small, list(by))
    bucket = F.pmod(F.xxhash64("id"), F.lit(256))
    first = Window.partitionBy(*by, bucket).orderBy("id")
    last = Window.partitionBy(*by).orderBy("id")
    kept = (
        found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= items)
        .withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= items)
    )
    return with_disk_name(kept, cat).select(
        *by, "count", "wasted", F.col("_r").alias("item"), "id", "disk_name", "path")


def hash_duplicates(cat: Catalog, min_size: int = MIN_DUPLICATE) -> DataFrame:
    """Equal content by hash, whatever the names."""
    known = cat.entries.withColumn("hash_algo", F.coalesce("hash_algo", F.lit("")))
    return duplicate_summary(cat.replacing(entries=known), min_size, by=("hash_algo", "content_hash"))


def wasted_total(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def file_folder_counts(entries: DataFrame) -> DataFrame:
    return disk_counts(entries)


def index_status(cat: Catalog, model: str, approximate: bool = False) -> DataFrame:
    """Progress of the derived indexes in one row."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    one = cat.embeddings.filter(F.col("model") == model).agg(distinct("entry_id").alias("embedded_entries"))
    return one.withColumns({
        "thumbnails": cat.thumbnails.agg(F.count(F.lit(1))).scalar(),
        "transcripts": cat.transcripts.agg(F.count(F.lit(1))).scalar(),
    })


def archive_member_counts(cat: Catalog) -> DataFrame:
    return cat.archive_entries.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(~F.col("is_dir")).alias("files"))


def catalog_profile(cat: Catalog, suffix: str = ".mov") -> DataFrame:
    """One-row profile of a catalogue, used to validate an import."""
    is_file = ~F.col("is_folder")
    return cat.entries.agg(
        F.count_distinct("disk_id").alias("disks"),
        F.count(F.lit(1)).alias("entries"),
        F.count_if(is_file).alias("files"),
        F.count_if(F.col("is_folder")).alias("folders"),
        F.count_if(is_file & F.lower("name").endswith(suffix)).alias("suffix_files"),
        F.max(F.when(is_file, F.col("size_logical"))).alias("largest_size"),
        F.sum(F.when(is_file, F.col("size_logical"))).alias("logical_bytes"),
        F.sum(F.when(is_file, F.col("size_physical"))).alias("physical_bytes"),
    )


def _directed(column: Column, desc: bool) -> Column:
    return column.desc() if desc else column.asc()


def browse_columns(key: str = "name", desc: bool = False) -> list[Column]:
    """Folders first, then by size, modified, type or natural name."""
    nocase = F.collate("name", "UTF8_LCASE")
    columns = {
        "size": [F.col("size_logical")],
        "modified": [F.coalesce("modified_at", F.lit(0))],
        "type": [F.collate(F.coalesce("ext", F.lit("")), "UTF8_LCASE"), nocase],
        "name": [natural_key(F.col("name"))],
    }[key]
    return [F.col("is_folder").desc(), *[_directed(c, desc) for c in columns], F.col("id").asc()]


def browse_order(df: DataFrame, key: str = "name", desc: bool = False) -> DataFrame:
    return df.orderBy(*browse_columns(key, desc))


def search_columns(key: str = "name", desc: bool = False) -> list[Column]:
    """Search results by disk and name, size, path or natural name."""
    columns = {
        "disk": [F.collate("disk_name", "UTF8_LCASE"), F.collate("name", "UTF8_LCASE")],
        "size": [F.col("size_logical")],
        "path": [F.collate("path", "UTF8_LCASE")],
        "name": [natural_key(F.col("name"))],
    }[key]
    return [*[_directed(c, desc) for c in columns], F.col("id").asc()]


def search_order(df: DataFrame, key: str = "name", desc: bool = False) -> DataFrame:
    return df.orderBy(*search_columns(key, desc))


def placed(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Adds ``place``, the row's number in the order of its own folder, disk or clip."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def page(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """First rows of an ordered result plus the exact total and whether rows were cut.

    The total is a scalar subquery with partial counts, not a window that would gather all rows.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(limit).withColumn("total", total).withColumn(
        "truncated", F.col("total") > limit)


def listing_columns() -> list[Column]:
    """Archive members: folders first and then by path without case."""
    return [F.col("is_dir").desc(), F.collate("path", "UTF8_LCASE"), F.col("path")]


def strip_columns() -> list[Column]:
    return [F.col("pos_ms").asc()]


def archive_listing(cat: Catalog, entry_id: int | None = None) -> DataFrame:
    rows = cat.archive_entries if entry_id is None else cat.archive_entries.filter(F.col("entry_id") == entry_id)
    return rows.orderBy("entry_id", *listing_columns())


def frame_strip(cat: Catalog, entry_id: int | None = None) -> DataFrame:
    rows = cat.video_frames if entry_id is None else cat.video_frames.filter(F.col("entry_id") == entry_id)
    return rows.orderBy("entry_id", *strip_columns())


def device_list(cat: Catalog) -> DataFrame:
    return cat.devices.orderBy(F.col("created_at").desc(), "id")


def list_disks(cat: Catalog) -> DataFrame:
    return cat.disks.select("id", "name", "kind", "total_size", "file_count", "folder_count", "is_online",
                            "mount_path", "location", "category", "comment").orderBy("name", "id")
