"""Collecting chosen files from several disks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drivetrove.catalog import Catalog
from drivetrove.operators.tree import expand_to_files


def gather_files(cat: Catalog, ids: DataFrame) -> DataFrame:
    """Chosen files (folders expanded) with disk, size and path, one row each."""
    files, _ = expand_to_files(cat.entries, ids)
    disks = cat.disks.select(F.col("id").alias("disk_id"), F.col("name").alias("disk_name"), "is_online", "mount_path")
    return files.select("id", "disk_id", "name", F.col("size_logical").alias("size"), "path", "rel_path").join(
        disks, "disk_id")


def gather_groups(files: DataFrame) -> DataFrame:
    """Files and bytes per disk, online disks first and then by name. Negative sizes count as 0."""
    return files.groupBy("disk_id", "disk_name", "is_online").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.greatest("size", F.lit(0))).alias("total_bytes"),
    ).orderBy(F.col("is_online").desc(), "disk_name", "disk_id")


def gather_plan(cat: Catalog, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, files and totals of a gather plan.

    The file list stays a table of its own: a disk may contribute billions of files, so they are never
    nested into its group row.
    """
    files = gather_files(cat, ids)
    folders = cat.entries.filter("is_folder").join(ids.select("id").distinct(), "id", "left_semi")
    expanded = folders.agg(F.count(F.lit(1))).scalar()
    totals = files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum(F.greatest("size", F.lit(0))), F.lit(0)).alias("total_bytes"),
    ).withColumn("expanded_folders", F.when(F.col("total_files") > 0, expanded).otherwise(F.lit(0)))
    return gather_groups(files), files, totals


def gather_targets(files: DataFrame, dest: str) -> DataFrame:
    """Source and destination of each file; files on offline disks carry a reason instead."""
    ready = F.col("is_online") & F.col("mount_path").isNotNull()
    inside = F.coalesce(F.concat(F.lit("/"), F.col("rel_path")), F.lit(""))
    return files.select(
        "id",
        F.when(ready, F.concat("mount_path", inside)).alias("source"),
        F.when(ready, F.concat(F.lit(dest.rstrip("/") + "/"), "disk_name", inside)).alias("target"),
        F.when(~ready, F.concat(F.lit("disk offline: "), "disk_name")).alias("error"),
    )
