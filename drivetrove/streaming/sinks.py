"""``foreachBatch`` sinks; each can see the same batch again and leaves the same result.

Batches are runs of levelled tables (:class:`runs.Runs`): nothing written before is lost or copied, what later batches replace goes when
runs are merged, and reading costs what is current and not what ever came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from drivetrove.functions import text as tx
from drivetrove.operators import search, status
from drivetrove.schema import conform
from drivetrove.streaming.runs import Runs, Tables


def _presence(root: str, **options) -> Runs:
    return Runs(f"{root}/presence", {"events": "mount_path string, event string, at timestamp, batch bigint"},
                lambda tables: {"events": _last_events(tables["events"])}, **options)


def _last_events(events: DataFrame) -> DataFrame:
    """The last event of every mount."""
    last = F.max(F.struct("at", "batch", "event")).alias("e")
    return events.groupBy("mount_path").agg(last).select("mount_path", "e.event", "e.at", "e.batch")


def online_status_sink(root: str, **options) -> Callable[[DataFrame, int], None]:
    """Keep the last of the presence events ``(mount_path, event, at)`` of :func:`presence.presence_changes`."""
    def write(events: DataFrame, batch_id: int) -> None:
        arrived = events.select("mount_path", "event", "at", F.lit(batch_id).cast("bigint").alias("batch"))
        _presence(root, **options).add(events.sparkSession, batch_id, {"events": _last_events(arrived)})

    return write


def online_now(spark: SparkSession, root: str, disks: DataFrame, volumes: DataFrame) -> DataFrame:
    """``disks`` with online flags from the last event of every mount; ``volumes`` says which volume a mount is."""
    last = _last_events(_presence(root).read(spark)["events"])
    present = last.filter("event <> 'removed'").select("mount_path")
    return status.online_status(disks, volumes.join(present, "mount_path", "left_semi"))


def _index(root: str, **options) -> Runs:
    return Runs(f"{root}/name_index", {
        "docs": "entry_id bigint, disk_id bigint, n_words int, batch bigint",
        "postings": "token string, entry_id bigint, disk_id bigint, tf int, doc_len int, batch bigint"}, _current, **options)


#: So many entries that came again are sent to all tasks; postings of more are shuffled.
FEW_AGAIN = 100_000


def _current(tables: Tables) -> Tables:
    """Entries and postings without those of entries that came again."""
    docs, postings = tables["docs"], tables["postings"]
    last = docs.groupBy("entry_id").agg(F.max(F.struct("batch", "disk_id", "n_words")).alias("d")).select(
        "entry_id", "d.disk_id", "d.n_words", "d.batch")
    again = docs.groupBy("entry_id").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).filter("first < last").select("entry_id", "last")
    n = again.count()
    if n:
        gone = (F.broadcast(again) if n <= FEW_AGAIN else again).withColumnRenamed("entry_id", "_again")
        postings = postings.join(gone, (postings["entry_id"] == F.col("_again")) & (postings["batch"] < F.col("last")), "left_anti")
    return {"docs": last, "postings": postings}


def index_sink(root: str, **options) -> Callable[[DataFrame, int], None]:
    """Index newly arrived entries; a disk may arrive over any number of batches."""
    def write(entries: DataFrame, batch_id: int) -> None:
        docs, batch = search.name_documents(entries), F.lit(batch_id).cast("bigint").alias("batch")
        postings = conform(search.name_postings(docs), "name_postings")
        _index(root, **options).add(entries.sparkSession, batch_id, {
            "docs": docs.select("entry_id", "disk_id", F.size(tx.tokens(F.col("text"))).alias("n_words"), batch),
            "postings": postings.select("token", "entry_id", "disk_id", "tf", "doc_len", batch)})

    return write


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Name postings and index facts of all batches; an entry that came again counts as it came last."""
    current = _current(_index(root).read(spark))
    facts = current["docs"].groupBy("disk_id").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"))
    return conform(current["postings"], "name_postings"), conform(facts, "name_stats")


def audit_stream(records: DataFrame, path: str, checkpoint: str):
    """Append access records as they arrive, partitioned by UTC day."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int"))
    return (records.withColumn("day", day).writeStream.format("parquet").partitionBy("day")
            .option("checkpointLocation", checkpoint).outputMode("append").start(path))
