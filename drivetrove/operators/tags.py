"""Tags are one link table; the set of known tags is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drivetrove.catalog import Catalog
from drivetrove.functions.text import normal_tag


def list_tags(cat: Catalog, known: DataFrame | None = None) -> DataFrame:
    """Every tag with its usage, most used first. ``known(tag)`` adds tags that no entry carries."""
    used = cat.entry_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    if known is not None:
        names = known.select(normal_tag(F.col("tag")).alias("tag")).filter("tag IS NOT NULL").distinct()
        used = names.join(used, "tag", "full_outer").withColumn("count", F.coalesce("count", F.lit(0)))
    return used.orderBy(F.col("count").desc(), F.collate("tag", "UTF8_LCASE"))


def entry_tags(cat: Catalog, ids: list[int] | None = None) -> DataFrame:
    rows = cat.entry_tags if ids is None else cat.entry_tags.filter(F.col("entry_id").isin(ids))
    return rows.orderBy("entry_id", F.collate("tag", "UTF8_LCASE"))


def add_tags(cat: Catalog, added: DataFrame) -> Catalog:
    """Add ``(entry_id, tag)`` rows; tags are normalised and adding twice changes nothing."""
    clean = added.select("entry_id", normal_tag(F.col("tag")).alias("tag")).filter("tag IS NOT NULL")
    return cat.replacing(entry_tags=cat.entry_tags.unionByName(clean).dropDuplicates(["entry_id", "tag"]))


def remove_tags(cat: Catalog, removed: DataFrame) -> Catalog:
    clean = removed.select("entry_id", normal_tag(F.col("tag")).alias("tag"))
    return cat.replacing(entry_tags=cat.entry_tags.join(clean, ["entry_id", "tag"], "left_anti"))
