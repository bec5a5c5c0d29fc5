"""Session helpers: shared scratch tables and skew-aware joins."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``; a part of the warehouse where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps").rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


_marked: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's step folder, which goes when the application ends."""
    own = f"{shared_dir(spark)}/drivetrove-{spark.sparkContext.applicationId}"
    if own not in _marked:
        files, path = _hadoop_path(spark, own)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def release(*steps: DataFrame) -> None:
    """Remove stored steps that no frame in use reads any more, as a loop does with the round before."""
    for step in steps:
        if path := getattr(step, "step_path", None):
            files, where = _hadoop_path(step.sparkSession, path)
            files.delete(where, True)


_REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when the write is done, instead of when the driver happens to collect its garbage."""
    before = spark.conf.get(_REMOVAL, None)
    spark.conf.set(_REMOVAL, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVAL)
        else:
            spark.conf.set(_REMOVAL, before)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage of ``df`` through a table in the shared folder.

    Unlike a block-manager cache the result survives the loss of executors, and the reader gets file
    sizes, so Catalyst can decide on broadcasts from facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.step_path = path
    return stored


def number_rows(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Adds the place of every row, from 1, by the given columns.

    Rows are cut into ranges and numbered inside them; only one count per range reaches the driver, so no task
    sorts everything.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, at = [], 0
    for row in parts.groupBy("_part").count().orderBy("_part").collect():  # one row per range
        before.append((row["_part"], at))
        at += row["count"]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before bigint")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")


def _size_setting(spark: SparkSession, key: str) -> int:
    value = spark.conf.get(key).strip().lower().rstrip("b")
    scale = {"k": 2**10, "m": 2**20, "g": 2**30}.get(value[-1:], 1)
    return int(value.rstrip("kmg")) * scale


def is_small(df: DataFrame) -> bool:
    """True when Catalyst's size estimate allows a broadcast, in which case it will choose one."""
    limit = _size_setting(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold")
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= limit


#: Buckets of rows with a NULL key, which match nothing and only must not meet in one task.
UNMATCHED_SALTS = 1024

#: Buckets of keys in which rows are counted to find hot ones.
HOT_BUCKETS = 1 << 16


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    *,
    spread: Column,
    hot_rows: int = 2_000_000,
    counts: DataFrame | None = None,
    rows: int | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Join where ``left`` may hold a huge share of its rows under one key.

    Keys of ``left`` with more than ``hot_rows`` rows are spread over one bucket for each ``hot_rows`` of them and
    only the matching rows of ``right`` are repeated; a right side small enough to broadcast skips all that.
    ``spread`` is a column that a task run again finds unchanged. At most ``rows / hot_rows`` keys can be hot, so the list of
    hot keys is small by construction. Valid for joins that never pad ``right``. ``counts(key, _n)`` tells how many rows of ``left`` a key
    has where that is known, so they aren't counted, and ``rows`` how many ``right`` has where
    Catalyst can't guess that: it is not broadcast then if that many don't fit. With ``hashed`` each task keeps its part of ``right``, where keys are unique, and sorts nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot do a {how} join")
    keys = [on] if isinstance(on, str) else list(on)
    fits = rows is None or rows * right._jdf.schema().defaultSize() <= _size_setting(right.sparkSession, "spark.sql.autoBroadcastJoinThreshold")
    if fits and is_small(right):
        return left.join(right, keys, how)  # a broadcast join has no hot task
    if counts is None:
        # rows are counted by hash first: a map task sends no more than HOT_BUCKETS counts, and keys are counted only in buckets large enough
        bucket = F.pmod(F.xxhash64(*keys), F.lit(HOT_BUCKETS)).cast("int").alias("_bucket")
        large = left.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select("_bucket")
        counts = left.select(*keys, bucket).join(F.broadcast(large), "_bucket", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > hot_rows).select(*keys, F.ceil(F.col("_n") / hot_rows).alias("_salts"))
    unmatched = F.lit(False)  # NULL keys never match, so they may go anywhere
    for key in keys:
        unmatched = unmatched | F.col(key).isNull()
    salted = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), F.when(unmatched, F.lit(UNMATCHED_SALTS)).otherwise(
            F.coalesce("_salts", F.lit(1)))).cast("int"))
        .drop("_salts")
    )
    repeated = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), (F.coalesce("_salts", F.lit(1)) - 1).cast("int"))))
        .drop("_salts")
    )
    if hashed or not fits:
        repeated = repeated.hint("shuffle_hash" if hashed else "merge")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
