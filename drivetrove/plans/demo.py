"""The star-schema test tables seen as a storage catalogue.

Nations are disks, customers and orders are folders, order lines are files. Documents are transcripts,
embeddings are frame vectors, suppliers are mounted volumes and places, events are the access log. Tables
are built on first use and stored once per session in the shared folder, like any ingest.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drivetrove.catalog import Catalog, disk_counts, write_table
from drivetrove.functions import media, solar, text as tx
from drivetrove.operators import enrich, search, tree
from drivetrove.schema import conform
from drivetrove.session import materialize, scratch_path
from drivetrove.sources.probes import probe_video_meta

MODEL = "clip"
MIB = 1024 * 1024

#: Bytes of rows that a byte of a stored table is taken for.
FILE_FACTOR = 16.0

_open: dict[tuple[str, str], Catalog] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


_EXT = {"ECONOMY": "JPG", "STANDARD": "mp4", "PROMO": "MOV", "SMALL": "wav", "MEDIUM": "zip"}


def _placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation of their customer, read for the folders and for the files in them."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number), with what its folders and part say about it.

    Lines move to their order, where they are counted and meet it with its customer, and once more to their part; an order has a few lines
    only. The joins fan a hot customer or part out through adaptive skew handling.
    """
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p_partkey"), F.max("l_quantity").cast("bigint").alias("qty"),
        F.min("l_shipdate").alias("shipped"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(_placed_orders(spark, sf_dir), "l_orderkey").join(parts, "p_partkey").select(
        "l_orderkey", "l_linenumber", "c_custkey", "c_nationkey", "p_name", "p_brand", "p_type", "qty",
        epoch("shipped").alias("shipped"), epoch("o_orderdate").alias("ordered"))


def _as_files(lines: DataFrame) -> DataFrame:
    suffix = F.lit("pdf")
    for kind, ext in _EXT.items():
        suffix = F.when(F.col("p_type") == kind, ext).otherwise(suffix)
    return lines.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + 3).alias("id"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("disk_id"),
        (F.col("l_orderkey") * 4 + 2).alias("parent_id"),
        F.concat("p_name", F.lit(" "), "p_brand", F.lit("."), suffix).alias("name"),
        F.lower(suffix).alias("kind"), "qty", "shipped", "ordered",
        "l_orderkey", "l_linenumber", "c_custkey", "c_nationkey", "p_brand")


def _lat() -> Column:
    return ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1201 - 600) / F.lit(10.0)


def _lon() -> Column:
    return ((F.col("l_orderkey") * 91 + F.col("l_linenumber") * 7) % 3601 - 1800) / F.lit(10.0)


def _captured() -> Column:
    return F.col("shipped") + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24 * 3600 + 1800


def _node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nodes of all disks are made from, without any column that others tell; ``level`` counts from nations, 0, to lines, 3."""
    files = _line_rows(spark, sf_dir)
    orders = _placed_orders(spark, sf_dir).select("l_orderkey", "c_custkey", "c_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("folder_name"))
    volumes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("folder_name"))
    everything = files.withColumn("level", F.lit(3))
    for level, part in ((2, orders), (1, customers), (0, volumes)):
        everything = everything.unionByName(part.withColumn("level", F.lit(level)), allowMissingColumns=True)
    return everything


def _nodes(rows: DataFrame) -> DataFrame:
    """Adjacency list of all disks, with the keys that the backup variant needs."""
    clip = F.col("kind").isin("mp4", "mov")
    digest = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 != 2,
                    F.md5(F.concat("name", F.lit(":"), F.col("qty").cast("string"))))
    modified = F.when(F.col("l_orderkey") % 17 != 0, F.col("shipped"))
    files = _as_files(rows.filter("level = 3")).select(
        "id", "disk_id", "parent_id", "name", F.lit(False).alias("is_folder"),
        (F.col("qty") * MIB).alias("size_logical"), (F.col("qty") * MIB + 4096).alias("size_physical"),
        F.col("ordered").alias("created_at"), modified.alias("modified_at"), tx.extension(F.col("name")).alias("ext"),
        digest.alias("content_hash"), F.when(digest.isNotNull(), "md5").alias("hash_algo"),
        F.when(digest.isNotNull(), F.col("shipped")).alias("hashed_at"),
        F.when(clip, _lat()).alias("gps_lat"), F.when(clip, _lon()).alias("gps_lon"),
        F.when(clip, F.concat(F.lit("Place "), F.col("l_orderkey") % 50, F.lit(", C"), "c_nationkey")).alias("gps_place"),
        F.when(clip, _captured()).alias("captured_at"),
        F.when(clip & (F.col("l_orderkey") % 2 == 0), F.concat(F.lit("Make "), "p_brand")).alias("camera_make"),
        "c_custkey", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    disk = (F.col("c_nationkey") + 1).cast("bigint").alias("disk_id")
    orders = rows.filter("level = 2").select(
        (F.col("l_orderkey") * 4 + 2).alias("id"), disk, (F.col("c_custkey") * 4 + 1).alias("parent_id"),
        F.concat(F.lit("Order#"), "l_orderkey").alias("name"), F.lit(True).alias("is_folder"), "c_custkey", F.col("l_orderkey").alias("o_orderkey"))
    customers = rows.filter("level = 1").select(
        (F.col("c_custkey") * 4 + 1).alias("id"), disk, (F.col("c_nationkey").cast("bigint") * 4).alias("parent_id"),
        F.col("folder_name").alias("name"), F.lit(True).alias("is_folder"), "c_custkey")
    volumes = rows.filter("level = 0").select(
        (F.col("c_nationkey").cast("bigint") * 4).alias("id"), disk, F.lit(None).cast("bigint").alias("parent_id"),
        F.col("folder_name").alias("name"), F.lit(True).alias("is_folder"))
    everything = files
    for part in (orders, customers, volumes):
        everything = everything.unionByName(part, allowMissingColumns=True)
    return everything


_KEYS = ("c_custkey", "o_orderkey", "l_linenumber")


def _entries(nodes: DataFrame) -> DataFrame:
    lit = nodes.drop(*_KEYS).withColumn("light_phase", solar.light_phase(F.col("gps_lat"), F.col("gps_lon"), F.col("captured_at")))
    return conform(tree.with_paths_and_sizes(lit), "entries")


BACKUP_DISK = 1000
BACKUP_ID = 10**15


def _backup_nodes(nodes: DataFrame) -> DataFrame:
    """A later, imperfect copy of every disk: lost, grown, unhashed, altered and extra files, lost order
    folders, and customers that have turned into files."""
    m = (F.col("o_orderkey") * 7 + F.col("l_linenumber")) % 10
    is_file = F.col("l_linenumber").isNotNull()
    turned = F.coalesce(F.col("c_custkey") % 50 == 7, F.lit(False))
    lost = F.coalesce(F.col("o_orderkey") % 13 == 0, F.lit(False)) | F.coalesce(m == 0, F.lit(False)) \
        | (turned & F.col("o_orderkey").isNotNull())
    kept = nodes.filter(~lost).withColumns({
        "size_logical": F.when(m == 1, F.col("size_logical") + 1).when(turned, 42).otherwise(F.col("size_logical")),
        "content_hash": F.when(m == 2, None).when(m == 3, F.concat(F.lit("x"), "content_hash"))
        .otherwise(F.col("content_hash")),
        "is_folder": F.col("is_folder") & ~turned,
    })
    extra = kept.filter(is_file & (m == 4)).withColumns({
        "name": F.concat(F.lit("extra_"), "name"), "id": F.col("id") + BACKUP_ID})
    both = kept.unionByName(extra)
    return both.withColumns({"id": F.col("id") + BACKUP_ID, "parent_id": F.col("parent_id") + BACKUP_ID,
                             "disk_id": F.col("disk_id") + BACKUP_DISK})


def _backup(nodes: DataFrame) -> DataFrame:
    return conform(tree.with_paths_and_sizes(_backup_nodes(nodes).drop(*_KEYS)), "entries")


def _disks(spark: SparkSession, sf_dir: str, entries: DataFrame) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = F.col("n_nationkey").cast("bigint")
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        (n + 1).alias("disk_id"), F.col("n_name").alias("name"), F.lit("external").alias("kind"),
        F.when(n % 3 != 2, F.concat(F.lit("uuid-"), n)).alias("volume_uuid"),
        ((n % 4 + 1) * 2**40).alias("capacity"), (n % 2 == 0).alias("is_online"),
        F.when(n % 2 == 0, F.concat(F.lit("/Volumes/"), "n_name")).alias("mount_path"),
        F.col("r_name").alias("location"), (n + 1700000000).alias("scanned_at"))
    return conform(rows.join(disk_counts(entries), "disk_id").withColumnRenamed("disk_id", "id"), "disks")


def probes(lines: DataFrame) -> DataFrame:
    """Probe output of every clip as JSON text ``(entry_id, json)``."""
    def coordinate(value: Column) -> Column:
        tenths = F.round(value * 10).cast("bigint")
        return F.concat(F.when(tenths < 0, "-").otherwise("+"), F.floor(F.abs(tenths) / 10).cast("string"),
                        F.lit("."), (F.abs(tenths) % 10).cast("string"))

    def stream(kind: str, codec: Column, width: Column, height: Column, rate: Column, base_rate: Column,
               tags: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("codec_type"), codec.alias("codec_name"), width.cast("bigint").alias("width"),
            height.cast("bigint").alias("height"), rate.alias("avg_frame_rate"), base_rate.alias("r_frame_rate"),
            tags.alias("tags"))

    spot = F.concat(coordinate(_lat()), coordinate(_lon()), F.lit("+010.0/"))
    taken = F.date_format(F.timestamp_seconds(_captured()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    clips = _as_files(lines).filter(F.col("kind").isin("mp4", "mov"))
    in_container = F.col("l_orderkey") % 3 != 0
    return clips.select(F.col("id").alias("entry_id"), F.to_json(F.struct(
        F.struct(
            F.concat("qty", F.lit(".5")).alias("duration"), (F.col("qty") * 1000).cast("string").alias("bit_rate"),
            F.map_from_arrays(
                F.array(F.when(in_container, "com.apple.quicktime.location.ISO6709").otherwise("comment"),
                        F.lit("com.apple.quicktime.make"), F.lit("creation_time")),
                F.array(F.when(in_container, spot).otherwise("none"), F.concat(F.lit("Make "), "p_brand"), taken),
            ).alias("tags")).alias("format"),
        F.array(
            stream("audio", F.lit("aac"), F.lit(0), F.lit(0), F.lit("0/0"), F.lit("0/0"),
                   F.create_map(F.lit("language"), F.lit("und"))),
            stream("video", F.when(F.col("kind") == "mp4", "hevc").otherwise("prores"), F.col("qty") * 10 + 1,
                   F.col("qty") * 10, F.when(F.col("l_linenumber") % 2 == 0, "0/0").otherwise("30000/1001"),
                   F.lit("25/1"), F.create_map(F.lit("location"), spot)),
        ).alias("streams"))).alias("json"))


def entry_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, entry_id)``: the first file of each order, its folder where it has no lines."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return orders.join(first, "l_orderkey", "left").select("l_orderkey", F.coalesce(
        (F.col("l_orderkey") * 8 + F.col("n")) * 4 + 3, F.col("l_orderkey") * 4 + 2).alias("entry_id"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame vectors; the entries of every seventh order look almost like the order before."""
    vec = F.col("vec_id")
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = own.select((vec + 4).alias("vec_id"), F.col("embedding").alias("other"))
    tilted = F.concat(F.array((F.get("other", F.lit(0)) + F.lit(0.05).cast("float")).cast("float")), F.slice("other", 2, F.size("other") - 1))
    copied = (F.floor(vec / 4) % 7 == 1) & F.col("other").isNotNull()
    raw = own.join(before, "vec_id", "left").select(
        F.floor(vec / 4).alias("l_orderkey"), F.lit(MODEL).alias("model"),
        F.when(F.floor(vec / 4) % 5 != 0, (vec % 4).cast("double")).alias("frame_ts"),
        F.when(copied, tilted).otherwise(F.col("embedding")).alias("vec"))
    return conform(raw.join(entry_of_order(spark, sf_dir), "l_orderkey"), "embeddings")


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("l_orderkey"), F.lit("whisper").alias("model"), "lang", "text",
        (F.col("doc_id") + 1700000000).alias("created_at"))
    return conform(raw.join(entry_of_order(spark, sf_dir), "l_orderkey"), "transcripts")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    admin = F.when(s % 3 != 0, F.concat(F.lit("Admin "), "s_nationkey")).otherwise("")
    return table(spark, sf_dir, "supplier").select(
        s.alias("place_id"), (s * 7919 % 12001 / F.lit(100.0) - 60).alias("lat"),
        (s * 10473 % 36001 / F.lit(100.0) - 180).alias("lon"),
        enrich.place_label(F.col("s_name"), admin, F.concat(F.lit("C"), "s_nationkey")).alias("place"))


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    total = (s % 4 + 1) * 2**40
    return conform(table(spark, sf_dir, "supplier").select(
        F.when(s % 3 == 0, F.concat(F.lit("NATION_"), "s_nationkey")).otherwise(F.col("s_name")).alias("name"),
        F.concat(F.lit("/Volumes/"), "s_name").alias("mount_path"),
        F.when(s % 3 == 1, F.concat(F.lit("uuid-"), "s_nationkey")).alias("fingerprint"),
        total.alias("total_space"), (total - s % 10 * 40 * 2**30).alias("available_space")), "volumes")


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    scopes = F.when(u % 5 == 0, "*").otherwise(
        F.concat((u % 25 + 1).cast("string"), F.lit(", "), (u * 7 % 25 + 1).cast("string"), F.lit(",x")))
    return conform(table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(epoch("ts")).alias("created_at"), F.max(epoch("ts")).alias("last_seen")).select(
        F.concat(F.lit("dev"), "user_id").alias("id"), F.concat(F.lit("Device "), "user_id").alias("name"),
        scopes.alias("scopes"), "created_at", "last_seen", (u % 7 == 0).alias("revoked")), "devices")


def _access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(table(spark, sf_dir, "events").select(
        epoch("ts").alias("ts"), F.concat(F.lit("dev"), "user_id").alias("device_id"), F.col("event_type").alias("action"),
        (F.col("user_id") % 25 + 1).alias("disk_id"), F.floor(F.col("value")).cast("bigint").alias("bytes"),
        F.lit("ok").alias("result")), "access_log")


def is_built(cat: Catalog, name: str) -> bool:
    return isinstance(cat._tables.get(name), DataFrame)


def once(cat: Catalog, name: str) -> DataFrame:
    """``entries`` or ``backup`` for readers of a few columns, once or twice: as stored if they are, else as planned, so that only those columns
    are worked out and moved."""
    return cat[name] if is_built(cat, name) or f"planned_{name}" not in cat else cat[f"planned_{name}"]


def demo_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue over one folder of test tables, built once per session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # compressed columns with few values are far smaller than their rows; taken for their size, tables of millions of rows would be broadcast
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_FACTOR))
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _open:
        return _open[key]
    root = scratch_path(spark, "demo-" + hashlib.md5(sf_dir.encode()).hexdigest()[:8])

    def stored(name: str, build, ranged: bool = True):
        def make() -> DataFrame:
            path = f"{root}/{name}"
            built = build()
            write_table(built, name if ranged else "", path, ranged=ranged)
            read = spark.read.schema(built.schema).parquet(path)
            return read.select(built.columns)
        return functools.cache(make)  # copies of the catalogue share what is stored

    cat = Catalog(spark, {})
    # what needs no paths and no sizes of folders is read before the trees are closed
    plain = lambda: cat["nodes"] if is_built(cat, "nodes") else _nodes(_node_rows(spark, sf_dir))
    lines = lambda: cat["node_rows"].filter("level = 3") if is_built(cat, "node_rows") else _line_rows(spark, sf_dir)
    disk_of = lambda: plain().select(F.col("id").alias("entry_id"), "disk_id")
    docs = lambda: search.name_documents(cat["nodes"])
    shot = lambda: once(cat, "entries").filter(F.col("ext").isin("mp4", "mov"))
    n = F.floor(F.col("id") / 4)

    def tags() -> DataFrame:
        both = F.array(tx.normal_tag(F.col("p_brand")), tx.normal_tag(F.col("o_orderpriority")))
        urgency = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
        return _as_files(lines()).join(urgency, "l_orderkey").select(F.col("id").alias("entry_id"), F.explode(both).alias("tag"))

    def members() -> DataFrame:
        zips = plain().filter("ext = 'zip'").filter(n % 4 != 1).select(
            F.col("id").alias("entry_id"),
            F.explode(F.sequence(F.lit(0), (F.col("size_logical") / MIB).cast("bigint") % 3)).alias("i"))
        path = F.when(F.col("i") == 0, "docs").when(F.col("i") == 1, "docs/B1.txt").otherwise("docs/a2.txt")
        return conform(zips.select("entry_id", path.alias("path"), tx.base_name(path).alias("name"),
                                   (F.col("i") == 0).alias("is_dir"), (F.col("i") * 100).alias("size"),
                                   F.lit(0).alias("modified")), "archive_entries")

    def frames() -> DataFrame:
        times = F.explode(media.strip_times(F.col("duration_ms"), 5))
        return conform(cat.video_meta.select("entry_id", times.alias("t")).withColumn(
            "pos_ms", F.floor(F.col("t") * 1000)), "video_frames")

    cat._tables.update({
        # stored are the keys and what can't be told from them; a reader works out the columns that it asks for
        "node_rows": stored("node_rows", lambda: _node_rows(spark, sf_dir)),
        "nodes": functools.cache(lambda: _nodes(cat["node_rows"])),
        "planned_entries": functools.cache(lambda: _entries(cat["nodes"])),
        "planned_backup": functools.cache(lambda: _backup(cat["nodes"])),
        "entries": stored("entries", lambda: cat["planned_entries"], ranged=False),
        "backup": stored("backup", lambda: cat["planned_backup"], ranged=False),
        "disks": stored("disks", lambda: _disks(spark, sf_dir, plain())),
        "entry_tags": stored("entry_tags", tags),
        "thumbnails": lambda: conform(
            plain().filter(F.col("ext").isin("jpg", "mp4", "mov")).filter(n % 3 != 0).select(
                F.col("id").alias("entry_id"), F.lit(320).alias("w"), F.lit(180).alias("h")), "thumbnails"),
        "probes": stored("probes", lambda: probes(lines())),
        "video_meta": stored("video_meta", lambda: conform(probe_video_meta(
            cat["probes"].filter(F.floor(F.col("entry_id") / 4) % 4 != 0)), "video_meta")),
        "video_frames": frames,
        "embeddings": stored("embeddings", lambda: _embeddings(spark, sf_dir)),
        "transcripts": stored("transcripts", lambda: _transcripts(spark, sf_dir)),
        "spoken": stored("spoken", lambda: cat.transcripts.join(disk_of(), "entry_id").select("entry_id", "disk_id", "text")),
        "archive_entries": members,
        "devices": lambda: _devices(spark, sf_dir),
        "access_log": lambda: _access_log(spark, sf_dir),
        "volumes": lambda: _volumes(spark, sf_dir),
        "gazetteer": lambda: gazetteer(spark, sf_dir),
        "clips": shot,
        "name_postings": stored("name_postings", lambda: conform(
            search.name_postings(docs()), "name_postings"), ranged=False),
        "name_terms": stored("name_terms", lambda: conform(search.build_terms(docs()), "name_terms")),
        "name_stats": stored("name_stats", lambda: search.index_stats(docs())),
        "text_postings": stored("text_postings", lambda: conform(
            search.build_postings(cat["spoken"]), "text_postings"), ranged=False),
        "text_stats": stored("text_stats", lambda: search.index_stats(cat["spoken"])),
    })
    _open[key] = cat
    return cat
