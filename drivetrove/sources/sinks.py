"""Exports and the access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EXPORT_COLUMNS = ("disk", "path", "name", "type", "size", "modified")


def export_frame(items: DataFrame) -> DataFrame:
    """Search items as export rows."""
    return items.select(
        F.col("disk_name").alias("disk"), "path", "name",
        F.when(F.col("is_folder"), "folder").otherwise(F.coalesce("ext", F.lit(""))).alias("type"),
        F.col("size_logical").alias("size"), F.col("modified_at").alias("modified"))


def export_rows(rows: DataFrame, fmt: str, path: str) -> None:
    """Write export rows as csv, tsv or json; delimited text is quoted only where needed."""
    rows = rows.select(*EXPORT_COLUMNS)
    if fmt == "json":
        rows.write.option("ignoreNullFields", False).json(path)
    elif fmt in ("csv", "tsv"):
        rows.write.csv(path, sep="," if fmt == "csv" else "\t", header=True, quote='"', escape='"', emptyValue="")
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def append_audit(records: DataFrame, path: str) -> None:
    """Append access records, partitioned by UTC day."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int"))
    records.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
