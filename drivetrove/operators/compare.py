"""Snapshot comparison, missing-folder roll-up and copy plans: projections of one diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivetrove.functions import paths
from drivetrove.session import skew_join

LIST_LIMIT = 5000


def _content_verdict(mode: str) -> Column:
    same_size = F.col("src_size") == F.col("dst_size")
    if mode == "fast":
        return F.when(same_size, "same").otherwise("mismatch")
    if mode != "deep":
        raise ValueError(f"unknown comparison mode {mode!r}")
    # hashes of unlike algorithms say nothing about each other
    hashed = F.col("src_hash").isNotNull() & F.col("dst_hash").isNotNull() \
        & F.col("src_algo").eqNullSafe(F.col("dst_algo"))
    return F.when(hashed & (F.col("src_hash") == F.col("dst_hash")), "same").when(hashed, "mismatch") \
        .when(same_size, "unverified").otherwise("mismatch")


def compare(src: DataFrame, dst: DataFrame, mode: str = "fast", keys: tuple[str, ...] = ()) -> DataFrame:
    """Match two relative-path indexes (see ``tree.rel_index``) and give each path a status.

    ``missing``, ``extra``, ``conflict`` (file against folder), ``mismatch``, ``unverified`` (present but
    unhashed, deep mode only) or ``same``. With ``keys`` many disk pairs are compared in one job.
    """
    on = [*keys, "rel_path"]

    def side(index: DataFrame, name: str) -> DataFrame:
        return index.select(
            *on, F.col("is_folder").alias(f"{name}_folder"), F.col("size").alias(f"{name}_size"),
            F.col("entry_id").alias(f"{name}_id"), F.col("content_hash").alias(f"{name}_hash"),
            F.col("hash_algo").alias(f"{name}_algo"))

    both = side(src, "src").join(side(dst, "dst"), on, "full_outer")
    status = (
        F.when(F.col("dst_id").isNull(), "missing")
        .when(F.col("src_id").isNull(), "extra")
        .when(F.col("src_folder") != F.col("dst_folder"), "conflict")
        .when(F.col("src_folder"), "same")
        .otherwise(_content_verdict(mode))
    )
    return both.select(
        *on, status.alias("status"),
        F.coalesce("src_folder", "dst_folder").alias("is_folder"),
        F.coalesce("src_size", F.lit(0)).alias("src_size"),
        F.coalesce("dst_size", F.lit(0)).alias("dst_size"),
        F.coalesce("src_id", "dst_id").alias("src_entry_id"),
    )


def compare_summary(diff: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact counters and bytes of a diff in one pass."""
    is_file = ~F.col("is_folder")

    def rows(status: str) -> Column:
        return F.col("status") == status

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("src_size"))), F.lit(0))

    return diff.groupBy(*keys).agg(
        F.count_if(rows("missing")).alias("missing_count"),
        F.count_if(rows("missing") & is_file).alias("missing_file_count"),
        total(rows("missing") & is_file).alias("missing_bytes"),
        F.count_if(rows("mismatch")).alias("mismatch_count"),
        total(rows("mismatch")).alias("mismatch_bytes"),
        F.count_if(rows("extra")).alias("extra_count"),
        F.count_if(rows("conflict")).alias("conflict_count"),
        F.count_if(rows("unverified")).alias("unverified_count"),
        F.count_if(rows("same") & is_file).alias("ok_count"),
    )


def diff_list(diff: DataFrame, status: str, limit: int = LIST_LIMIT) -> DataFrame:
    """The first rows of one status by path; ``truncated`` tells whether more exist."""
    rows = diff.filter(F.col("status") == status)
    # one row more than the page tells, so the comparison is run once; the windows see no more than that page
    page = rows.orderBy("rel_path", "src_entry_id").limit(limit + 1)
    placed = page.withColumn("_at", F.row_number().over(Window.orderBy("rel_path", "src_entry_id"))).withColumn(
        "truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return placed.filter(F.col("_at") <= limit).orderBy("rel_path", "src_entry_id").drop("_at")


def missing_tree(diff: DataFrame, include_mismatch: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Missing files summed into every ancestor folder, ``""`` included.

    Sums per direct parent come first, so the explode over ancestors handles folders only. File/folder
    conflicts never count, as the copy plan leaves them alone too.
    """
    wanted = ["missing", "mismatch"] if include_mismatch else ["missing"]
    direct = (
        diff.filter(F.col("status").isin(wanted) & ~F.col("is_folder"))
        .groupBy(*keys, paths.parent(F.col("rel_path")).alias("_parent"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("src_size").alias("bytes"))
    )
    folders = F.explode(paths.prefixes(F.col("_parent"), include_self=True, include_root=True))
    return direct.select(*keys, folders.alias("rel_path"), "files", "bytes").groupBy(*keys, "rel_path").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def within_prefixes(df: DataFrame, prefixes: list[str] | DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose ``rel_path`` equals or lies below a prefix, by whole components; no prefix means all.

    A short list becomes a filter; a table of prefixes (column ``prefix``) becomes a semi join.
    """
    rel = F.col("rel_path")
    if not isinstance(prefixes, DataFrame):
        if not prefixes or "" in prefixes:
            return df
        inside = F.lit(False)
        for prefix in prefixes:
            inside = inside | (rel == prefix) | F.startswith(rel, F.lit(prefix + "/"))
        return df.filter(inside)
    chosen = prefixes.select(*keys, F.col("prefix").alias("_prefix")).distinct()
    # what lies below a prefix depends on the parent folder only: folders are expanded, not rows
    rows = df.withColumn("_up", paths.parent(rel))
    parents = rows.select(*keys, "_up").distinct().withColumn(
        "_prefix", F.explode(paths.prefixes(F.col("_up"), include_self=True, include_root=True)))
    covered = skew_join(parents, chosen, [*keys, "_prefix"], "left_semi", spread=F.col("_up")).select(*keys, "_up").distinct()
    below = skew_join(rows, covered, [*keys, "_up"], "left_semi", spread=rel)
    exact = skew_join(rows.join(chosen.withColumnRenamed("_prefix", "rel_path"), [*keys, "rel_path"], "left_semi"),
                      covered, [*keys, "_up"], "left_anti", spread=rel)
    return below.unionByName(exact).select(*df.columns)


def copy_plan(diff: DataFrame, include_mismatch: bool = False, prefixes: list[str] | DataFrame = (),
              keys: tuple[str, ...] = ()) -> DataFrame:
    """What has to be written at the destination, unordered; see :func:`in_copy_order`.

    Missing folders are part of it with size 0, so empty ones exist in the copy as well. Only mismatching
    files carry ``overwrite``; conflicts and unverified files never appear.
    """
    wanted = ["missing", "mismatch"] if include_mismatch else ["missing"]
    plan = within_prefixes(diff.filter(F.col("status").isin(wanted)), prefixes, keys)
    return plan.select(
        *keys, "rel_path", F.when(F.col("is_folder"), F.lit(0)).otherwise(F.col("src_size")).alias("size"),
        "is_folder", (F.col("status") == "mismatch").alias("overwrite"))


def in_copy_order(plan: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A folder sorts before everything inside it."""
    return plan.orderBy(*keys, "rel_path")


def plan_totals(plan: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"),
                                   F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
