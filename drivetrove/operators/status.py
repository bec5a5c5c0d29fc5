"""Mounted volumes, access scopes and name conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drivetrove.catalog import Catalog
from drivetrove.schema import conform

DRIFT_BYTES = 5 * 1024**3
DRIFT_SHARE = 0.15


def _first(volumes: DataFrame, key: str) -> DataFrame:
    """One volume per key: the first by mount path."""
    picked = F.min(F.struct("mount_path", "total_space", "available_space")).alias("v")
    return conform(volumes, "volumes").filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(picked)


def online_status(disks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Disks with ``is_online`` and ``mount_path`` of the present volumes.

    Matched by fingerprint, or by name for disks without one. Two equi joins replace the OR condition.
    """
    by_uuid = _first(volumes, "fingerprint").select(F.col("_fingerprint").alias("volume_uuid"),
                                                    F.col("v.mount_path").alias("_m1"))
    by_name = _first(volumes, "name").select(F.col("_name").alias("name"), F.col("v.mount_path").alias("_m2"))
    mount = F.when(F.col("volume_uuid").isNotNull(), F.col("_m1")).otherwise(F.col("_m2"))
    return (
        disks.drop("is_online", "mount_path")
        .join(by_uuid, "volume_uuid", "left").join(by_name, "name", "left")
        .withColumn("mount_path", mount).withColumn("is_online", mount.isNotNull())
        .drop("_m1", "_m2").select(*disks.columns)
    )


def live_space(disks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Total and free space of online disks: matched by fingerprint, then mount path, then name."""
    joined = disks
    for key, own in (("fingerprint", "volume_uuid"), ("mount_path", "mount_path"), ("name", "name")):
        side = _first(volumes, key).select(F.col(f"_{key}").alias(f"_k_{key}"), F.col("v").alias(f"_v_{key}"))
        joined = joined.join(side, joined[own] == F.col(f"_k_{key}"), "left")
    best = F.coalesce("_v_fingerprint", "_v_mount_path", "_v_name")
    return joined.select(
        *[joined[c] for c in disks.columns],
        F.when(F.col("is_online"), best["total_space"]).alias("live_total"),
        F.when(F.col("is_online"), best["available_space"]).alias("live_free"),
    )


def disk_detail(cat: Catalog, volumes: DataFrame | None = None) -> DataFrame:
    rows = live_space(cat.disks, cat.volumes if volumes is None else volumes)
    return rows.select("id", "name", "total_size", "file_count", "folder_count", "is_online", "kind", "capacity",
                       "scanned_at", "live_total", "live_free")


def disk_drift(disks: DataFrame, volumes: DataFrame) -> DataFrame:
    """``offline``, ``upToDate`` or ``changed`` by used space against the catalogued size.

    The volume is found by uuid when both sides know one, otherwise by name.
    """
    by_uuid = _first(volumes, "fingerprint").select(F.col("_fingerprint").alias("volume_uuid"), F.col("v").alias("_u"))
    by_name = _first(volumes, "name").select(F.col("_name").alias("name"), F.col("v").alias("_n"))
    joined = disks.join(by_uuid, "volume_uuid", "left").join(by_name, "name", "left")
    volume = F.coalesce("_u", "_n")
    used = volume["total_space"] - volume["available_space"]
    slack = F.greatest(F.lit(float(DRIFT_BYTES)), volume["total_space"] * DRIFT_SHARE)
    status = F.when(volume.isNull(), "offline").when(F.abs(used - F.col("total_size")) <= slack, "upToDate") \
        .otherwise("changed")
    return joined.select("id", "name", status.alias("status"))


def device_scopes(devices: DataFrame) -> DataFrame:
    """Disk ids each active device may see; NULL stands for all of them."""
    active = devices.filter("NOT coalesce(revoked, false)")
    everything = active.filter("scopes = '*'").select("id", F.lit(None).cast("bigint").alias("disk_id"))
    listed = active.filter("scopes <> '*'").select("id", F.explode(F.split("scopes", ",")).alias("_s")).select(
        "id", F.trim("_s").try_cast("bigint").alias("disk_id")).filter("disk_id IS NOT NULL")
    return everything.unionByName(listed).distinct().withColumnRenamed("id", "device_id")


def filter_by_scope(df: DataFrame, devices: DataFrame, device_id: str) -> DataFrame:
    """Rows with a ``disk_id`` that one device may see; unknown or revoked devices see nothing."""
    scopes = device_scopes(devices.filter(F.col("id") == device_id))
    all_disks = scopes.filter("disk_id IS NULL").agg(F.count(F.lit(1))).scalar() > 0
    listed = df.join(scopes.filter("disk_id IS NOT NULL").select("disk_id").distinct()
                     .withColumn("_ok", F.lit(True)), "disk_id", "left")
    return listed.filter(F.col("_ok") | all_disks).drop("_ok").select(*df.columns)


def visible_disks(disks: DataFrame, devices: DataFrame) -> DataFrame:
    """Every (device, disk) that may be seen. Devices with ``*`` stay one row with a NULL disk."""
    scopes = device_scopes(devices)
    known = scopes.join(disks.select(F.col("id").alias("disk_id")), "disk_id", "left_semi").select(
        "device_id", "disk_id")
    return known.unionByName(scopes.filter("disk_id IS NULL").select("device_id", "disk_id"))


def name_conflicts(cat: Catalog, incoming: DataFrame) -> DataFrame:
    """Disk names of ``incoming(disk_name)`` that the catalogue already holds."""
    names = cat.disks.select(F.col("name").alias("disk_name"))
    return incoming.select("disk_name").distinct().join(names, "disk_name", "left_semi")
