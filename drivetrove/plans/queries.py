"""The registered queries: each operator on the test tables, next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from drivetrove.catalog import Catalog, disk_counts, load_catalog, write_table
from drivetrove.functions import media, paths, text as tx, words
from drivetrove.operators import (
    compare, enrich, gather, pending, saved_search, search, stats, status, tags, tree, vectors,
)
from drivetrove.plans import oracle
from drivetrove.plans.demo import BACKUP_DISK, MODEL, demo_catalog, entry_of_order, epoch, once, table
from drivetrove.schema import TREE_COLUMNS, conform
from drivetrove.session import materialize, scratch_path
from drivetrove.sources import files, ingest, probes, sinks
from drivetrove.streaming.presence import presence_batch
from drivetrove.streaming.sinks import index_sink, online_now, online_status_sink, read_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a catalogue; ``sql`` continues the common prelude."""
    def register(fn: Callable[[Catalog, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(demo_catalog(spark, sf_dir), sf_dir)
        if sql is not None:
            ORACLES[name] = oracle.PRELUDE + sql
        return fn
    return register


def _big(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# --- sources, ingest, sinks ------------------------------------------------------------------------


@query("load_catalog", """SELECT disk_id, count(*) AS entries, CAST(0 AS BIGINT) AS hashed,
    CAST(sum(CASE WHEN NOT is_folder THEN size_logical END) AS BIGINT) AS bytes FROM entries GROUP BY disk_id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    root = scratch_path(cat.spark, "old-schema")
    old = cat.entries.select("id", "disk_id", "parent_id", "name", "is_folder", "size_logical", "size_physical")
    old.write.parquet(f"{root}/entries")
    entries = load_catalog(cat.spark, root).entries
    return entries.groupBy("disk_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count("content_hash").alias("hashed"),
        F.sum(F.when(~F.col("is_folder"), F.col("size_logical"))).alias("bytes"))


def _as_nodes(entries: DataFrame, disks: DataFrame) -> DataFrame:
    """Catalogue entries back as import trees; local numbers may have gaps."""
    names = disks.select(F.col("id").alias("disk_id"), F.col("name").alias("disk_name"))
    return entries.join(names, "disk_id").select(
        "disk_name", F.col("id").alias("local_idx"), F.coalesce("parent_id", F.lit(-1)).alias("parent_idx"), "name",
        "is_folder", "size_logical", "size_physical", F.coalesce("created_at", F.lit(0)).alias("created"),
        F.coalesce("modified_at", F.lit(0)).alias("modified"))


@query("bulk_ingest", """, b AS (
      SELECT disk_id, coalesce(sum(max(id) + 1) OVER (ORDER BY max(n.n_name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS base,
             row_number() OVER (ORDER BY max(n.n_name)) AS new_disk
      FROM entries JOIN nation n ON n.n_nationkey = entries.c_nationkey GROUP BY disk_id)
    SELECT CAST(base + id AS BIGINT) AS id, new_disk AS disk_id, CAST(base + parent_id AS BIGINT) AS parent_id, name, is_folder, size_logical,
           size_physical, created_at, modified_at, ext, rel_path FROM entries JOIN b USING (disk_id)""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    after = ingest.bulk_ingest(Catalog(cat.spark, {}), _as_nodes(cat.entries, cat.disks))
    return after.entries.select("id", "disk_id", "parent_id", "name", "is_folder", "size_logical", "size_physical",
                                "created_at", "modified_at", "ext", "rel_path")


def _volumes_to_scan(cat: Catalog) -> DataFrame:
    n = F.col("id") - 1
    return cat.disks.select(
        "name", F.when(n % 4 == 0, F.concat(F.lit("uuid-"), n)).when(n % 4 == 1, F.concat(F.lit("new-"), n))
        .alias("volume_uuid"), "kind", "capacity", F.concat(F.lit("/mnt/"), "name").alias("mount_path"),
        F.lit(1800000000).cast("bigint").alias("scanned_at"))


@query("rescan_replace", """, v AS (
      SELECT n_name, n_nationkey AS n, CASE n_nationkey % 4 WHEN 0 THEN 'uuid-' || CAST(n_nationkey AS VARCHAR)
        WHEN 1 THEN 'new-' || CAST(n_nationkey AS VARCHAR) END AS u FROM nation)
    SELECT n_name AS volume_name, count(*) AS entries, count(*) FILTER (NOT f) AS files, count(*) FILTER (f) AS folders,
           max(CASE WHEN d.volume_uuid IS NULL OR d.volume_uuid = v.u THEN 1 ELSE 0 END) = 1 AS replaced,
           CAST(sum(CASE WHEN f THEN 0 ELSE s END) AS BIGINT) AS bytes
    FROM v JOIN disks d ON d.name = n_name
    JOIN (SELECT pair, f, s FROM bent UNION ALL SELECT n_nationkey + 1, TRUE, 0 FROM nation) b ON b.pair = v.n + 1
    GROUP BY n_name""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    original = cat.backup.withColumn("disk_id", F.col("disk_id") - BACKUP_DISK)
    after, report = ingest.rescan_replace(cat, _as_nodes(original, cat.disks), _volumes_to_scan(cat))
    sizes = after.disks.select(F.col("id").alias("disk_id"), F.col("total_size").alias("bytes"))
    return report.join(sizes, "disk_id").drop("disk_id")


@query("preserve_enrichment", """, old AS (
      SELECT disk_id, rel_path, max_by({'s': size_logical, 'm': modified_at, 'h': content_hash, 'p': gps_place}, id) AS o
      FROM files WHERE content_hash IS NOT NULL OR gps_place IS NOT NULL GROUP BY 1, 2)
    SELECT b.id + 1000000000000000 AS id, coalesce(b.h, CASE WHEN o.s = b.s AND o.m = f.modified_at THEN o.h END) AS content_hash,
           CASE WHEN o.s = b.s AND o.m = f.modified_at THEN o.p END AS gps_place
    FROM bk b JOIN files f ON f.id = b.id % 1000000000000000 LEFT JOIN old ON old.disk_id = b.disk_id AND old.rel_path = b.rel_path""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    fresh = once(cat, "backup").filter("NOT is_folder AND parent_id IS NOT NULL AND depth = 3").withColumns({
        "disk_id": F.col("disk_id") - BACKUP_DISK, "gps_place": F.lit(None).cast("string")})
    kept = ingest.preserve_enrichment(fresh, once(cat, "entries"), ("disk_id",))
    return kept.select("id", "content_hash", "gps_place")


@query("merge_import", """, c AS (SELECT n_name, n_nationkey AS n, file_count, folder_count, total_size FROM disks JOIN nation ON n_name = name)
    SELECT n_name AS name, file_count, folder_count, total_size FROM c
    UNION ALL SELECT 'NEW_' || n_name, file_count, folder_count, total_size FROM c WHERE n % 2 = 1""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    names = cat.disks.withColumn("name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("NEW_"), "name")).otherwise(F.col("name")))
    after = ingest.merge_import(cat, _as_nodes(cat.entries, names))
    return after.disks.select("name", "file_count", "folder_count", "total_size")


@query("merge_import_replace", """, c AS (SELECT n_name, n_nationkey AS n, file_count, folder_count, total_size FROM disks JOIN nation ON n_name = name)
    SELECT n_name AS name, CASE WHEN n % 2 = 0 THEN 'archive' ELSE 'external' END AS kind, file_count, folder_count, total_size FROM c
    UNION ALL SELECT 'NEW_' || n_name, 'archive', file_count, folder_count, total_size FROM c WHERE n % 2 = 1""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    names = cat.disks.withColumn("name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("NEW_"), "name")).otherwise(F.col("name")))
    after = ingest.merge_import(cat, _as_nodes(cat.entries, names), replace=True)
    return after.disks.select("name", "kind", "file_count", "folder_count", "total_size")


@query("file_inventory")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return files.file_inventory(cat.spark, sf_dir).select("rel_path", "name", "is_folder", "size_logical", "ext")


@query("content_hash")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return files.content_hash(cat.spark, sf_dir)


_URL_PATH = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '', 's'), '/+', '/', 'g'), '^/|/$', '', 'g')"""


@query("tree_from_paths", f""", u AS (SELECT DISTINCT {_URL_PATH} AS path FROM pages),
    parts AS (SELECT path, string_split(path, '/') AS p FROM u WHERE path <> ''),
    nodes AS (SELECT path, FALSE AS f FROM parts
      UNION ALL SELECT array_to_string(p[1:k], '/'), TRUE FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS k FROM parts))
    SELECT path, bool_or(f) AS is_folder, string_split(path, '/')[-1] AS name, CAST(len(string_split(path, '/')) AS BIGINT) AS depth,
           CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent_path FROM nodes GROUP BY path""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    nodes = materialize(files.url_tree(table(cat.spark, sf_dir, "pages")), "urls")
    up = nodes.select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path"))
    return nodes.join(up, "parent_id", "left").select("path", "is_folder", "name", *_big("depth"), "parent_path")


@query("listing_filters", f"""SELECT page_id, replace({_URL_PATH}, '/fr/', '/.cache/') AS rel_path FROM pages
    WHERE NOT regexp_matches('/' || replace({_URL_PATH}, '/fr/', '/.cache/') || '/', '/(de|[.][^/]*)/')""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    path = F.replace(paths.url_path(F.col("url")), F.lit("/fr/"), F.lit("/.cache/"))
    listed = table(cat.spark, sf_dir, "pages").select("page_id", path.alias("rel_path"))
    return files.apply_exclusions(listed, skip_hidden=True, exclude_names=["de"], exclude_junk=True)


@query("incremental_splice", """, fold AS (
      SELECT e.disk_id AS pair, e.rel_path, max(CASE WHEN d.f THEN (e.l_orderkey % 3 = 0) END) AS steady, max(e.c_name) AS cust
      FROM (SELECT disk_id, rel_path, l_orderkey, string_split(rel_path, '/')[1] AS c_name FROM entries WHERE depth = 2) e
      JOIN (SELECT pair, rel_path, f FROM bent WHERE f) d ON d.pair = e.disk_id AND d.rel_path = e.rel_path GROUP BY 1, 2),
    cov AS (SELECT pair, rel_path FROM fold WHERE steady),
    fresh AS (SELECT pair, rel_path, f AS is_folder, s AS size_logical FROM bent
              UNION ALL SELECT n_nationkey + 1, NULL, TRUE, coalesce((SELECT CAST(sum(CASE WHEN f THEN 0 WHEN contains(rel_path, '/') THEN s ELSE s END) AS BIGINT) FROM bent WHERE pair = n_nationkey + 1), 0) FROM nation),
    up AS (SELECT *, regexp_replace(rel_path, '/?[^/]*$', '') AS u FROM fresh)
    SELECT pair AS disk_id, rel_path, is_folder, CASE WHEN is_folder THEN 0 ELSE size_logical END AS size FROM up
    WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.pair = up.pair AND c.rel_path = up.u)
    UNION ALL
    SELECT f.disk_id, f.rel_path, FALSE, f.size_logical FROM files f JOIN cov c ON c.pair = f.disk_id
      AND c.rel_path = regexp_replace(f.rel_path, '/[^/]*$', '')""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Order folders whose number is a multiple of three did not change; the rest is listed again."""
    order = F.regexp_extract("name", r"^Order#(\d+)$", 1).try_cast("bigint")
    stamp = F.when(F.col("is_folder"), F.when(order % 3 == 0, F.lit(1).cast("bigint"))).otherwise(F.col("modified_at"))
    fresh = once(cat, "backup").withColumn("disk_id", F.col("disk_id") - BACKUP_DISK).withColumn("modified_at", stamp)
    rows, _ = ingest.incremental_splice(once(cat, "entries").withColumn("modified_at", stamp), fresh, ("disk_id",))
    return rows.select("disk_id", "rel_path", "is_folder",
                       F.when(F.col("is_folder"), F.lit(0)).otherwise(F.col("size_logical")).cast("bigint").alias("size"))


@query("latest_disk", """SELECT id, name, is_folder FROM entries WHERE disk_id = (SELECT max(id) FROM disks WHERE volume_uuid = 'uuid-3')""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return ingest.latest_disk(cat, volume_uuid="uuid-3").select("id", "name", "is_folder")


def _diff(cat: Catalog, mode: str) -> DataFrame:
    src = tree.rel_index(once(cat, "entries")).withColumnRenamed("disk_id", "pair")
    # paired before the index is built, so both sides are already shuffled by the join keys
    dst = tree.rel_index(once(cat, "backup").withColumn("disk_id", F.col("disk_id") - BACKUP_DISK)).withColumnRenamed(
        "disk_id", "pair")
    return compare.compare(src, dst, mode, ("pair",))


@query("register_copied", """, want AS (
      SELECT pair, rel_path, FALSE AS f, src_size AS s FROM diff WHERE fast = 'missing' AND NOT is_folder
      UNION SELECT pair, string_split(rel_path, '/')[1], TRUE, 0 FROM diff WHERE fast = 'missing' AND contains(rel_path, '/')
      UNION SELECT pair, regexp_replace(rel_path, '/[^/]*$', ''), TRUE, 0 FROM diff WHERE fast = 'missing' AND contains(rel_path, '/')
      UNION SELECT pair, rel_path, TRUE, 0 FROM diff WHERE fast = 'missing' AND is_folder),
    new AS (SELECT * FROM want WHERE NOT EXISTS (SELECT 1 FROM bent b WHERE b.pair = want.pair AND b.rel_path = want.rel_path AND b.f = want.f)),
    everything AS (SELECT pair, f, s FROM bent UNION ALL SELECT pair, f, s FROM new UNION ALL SELECT n_nationkey + 1, TRUE, 0 FROM nation)
    SELECT CAST(pair AS BIGINT) AS disk_id, count(*) FILTER (NOT f) AS file_count, count(*) FILTER (f) AS folder_count,
           CAST(sum(CASE WHEN f THEN 0 ELSE s END) AS BIGINT) AS total_size,
           (SELECT count(*) FROM new n WHERE n.pair = everything.pair AND NOT n.f) AS inserted FROM everything GROUP BY pair""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    target = cat.backup  # read several times, so it is stored before the comparison reads it too
    plan = compare.copy_plan(_diff(cat, "fast"), keys=("pair",))
    copied = plan.select((F.col("pair") + BACKUP_DISK).alias("disk_id"), "rel_path", "size", "is_folder")
    counts = disk_counts(target).withColumnRenamed("disk_id", "id")
    disks = cat.disks.withColumn("id", F.col("id") + BACKUP_DISK).drop("file_count", "folder_count", "total_size").join(counts, "id", "left")
    after, inserted = ingest.register_copied(Catalog(cat.spark, {"entries": target, "disks": conform(disks, "disks")}), copied)
    added = inserted.groupBy("disk_id").agg(F.count(F.lit(1)).alias("inserted"))
    return after.disks.withColumnRenamed("id", "disk_id").join(added, "disk_id", "left").select(
        (F.col("disk_id") - BACKUP_DISK).alias("disk_id"), "file_count", "folder_count", "total_size",
        F.coalesce("inserted", F.lit(0)).alias("inserted"))


@query("probe_video_meta", """SELECT id AS entry_id, qty * 1000 + 500 AS duration_ms, qty * 1000 AS bitrate, qty * 10 + 1 AS width,
    qty * 10 AS height, round(CASE WHEN ln % 2 = 0 THEN 25.0::DOUBLE ELSE 30000 / 1001.0::DOUBLE END, 6) AS fps,
    CASE ext WHEN 'mp4' THEN 'hevc' ELSE 'prores' END AS vcodec, 'aac' AS acodec FROM clips""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return probes.probe_video_meta(cat["probes"]).withColumn("fps", F.round("fps", 6))


@query("probe_location_meta", """SELECT id AS entry_id, gps_lat, gps_lon, captured_at, 'Make ' || p_brand AS camera_make,
    CAST(NULL AS VARCHAR) AS camera_model FROM clips""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return probes.probe_location_meta(cat["probes"])


def _posting_report(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("entries"), F.sum("tf").alias("occurrences"),
                                         F.sum("doc_len").alias("words"))


def _posting_sql(docs: str) -> str:
    return f""", tok AS (SELECT entry_id, {oracle.tokens('text')} AS t FROM ({docs})),
    per AS (SELECT entry_id, w AS token, count(*) AS tf, max(n) AS n FROM (SELECT entry_id, unnest(t) AS w, len(t) AS n FROM tok) GROUP BY 1, 2)
    SELECT token, count(*) AS entries, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(sum(n) AS BIGINT) AS words FROM per GROUP BY token"""


@query("build_name_index", _posting_sql("SELECT id AS entry_id, name AS text FROM entries"))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _posting_report(conform(search.name_postings(search.name_documents(cat.entries)), "name_postings"))


@query("build_text_index", _posting_sql("SELECT entry_id, text FROM transcripts"))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _posting_report(cat.text_postings)


def _stream_into(rows: DataFrame, sink: Callable[[DataFrame, int], None]) -> None:
    """Send a stored table through a sink as a stream of six batches, each in as many files as there are cores."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    stored = materialize(rows.repartition(6 * cores), "arriving")
    arriving = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", cores).parquet(stored.step_path)
    arriving.writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "progress")) \
        .trigger(availableNow=True).start().awaitTermination()


@query("incremental_index", _posting_sql("SELECT id AS entry_id, name AS text FROM entries"))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """The name index of a stream of entries, merged as it grows."""
    root = scratch_path(cat.spark, "streamed")
    _stream_into(cat.entries.select("id", "disk_id", "name"), index_sink(root, fan=3))
    return _posting_report(read_index(cat.spark, root)[0])


@query("update_name_index", _posting_sql("""SELECT id AS entry_id, name AS text FROM entries WHERE (disk_id - 1) % 3 <> 2
    UNION ALL SELECT id, 'again ' || name FROM entries WHERE (disk_id - 1) % 3 = 2"""))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Disks without uuid are scanned again under new names."""
    replaced = cat.disks.filter("volume_uuid IS NULL").select(F.col("id").alias("disk_id"))
    docs = search.name_documents(cat.entries.join(replaced, "disk_id", "left_semi"))
    fresh = search.build_postings(docs.withColumn("text", F.concat(F.lit("again "), "text")))
    return _posting_report(search.update_postings(cat.name_postings, replaced, conform(fresh, "name_postings")))


@query("store_transcript", """, spoken AS (SELECT entry_id, string_agg(c.text, ' ' ORDER BY turn) AS text FROM conversations c JOIN first_file ON k = conv_id GROUP BY 1),
    after AS (SELECT entry_id, text FROM transcripts t WHERE NOT EXISTS (SELECT 1 FROM spoken n WHERE n.entry_id = t.entry_id)
              UNION ALL SELECT * FROM spoken)""" + _posting_sql("SELECT entry_id, text FROM after"))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """All turns of a conversation as the new transcript of its entry."""
    turns = table(cat.spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("l_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    new = turns.join(entry_of_order(cat.spark, sf_dir), "l_orderkey").select(
        "entry_id", F.lit("whisper").alias("model"), F.lit(None).cast("string").alias("lang"),
        F.array_join(F.transform("turns", lambda t: t["text"]), " ").alias("text"), F.lit(0).cast("bigint").alias("created_at"))
    return _posting_report(ingest.upsert_transcripts(cat.replacing(entries=once(cat, "entries")), new).text_postings)


@query("store_derived", """, new AS (SELECT entry_id, 'q' || CAST(quality AS VARCHAR) AS lang FROM labels JOIN first_file ON k = doc_id)
    SELECT entry_id, lang FROM transcripts t WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.entry_id = t.entry_id)
    UNION ALL SELECT * FROM new""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return ingest.replace_by_key(cat.transcripts.select("entry_id", "lang"), _label_updates(cat, sf_dir)
                                 .select("entry_id", F.col("comment").alias("lang")), ["entry_id"])


def _label_updates(cat: Catalog, sf_dir: str) -> DataFrame:
    labels = table(cat.spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_orderkey")
    return labels.join(entry_of_order(cat.spark, sf_dir), "l_orderkey").select(
        "entry_id", F.concat(F.lit("q"), "quality").alias("comment"))


@query("export_rows", """SELECT d.name AS disk, path, e.name, CASE WHEN is_folder THEN 'folder' ELSE coalesce(ext, '') END AS type,
    size_logical AS size, modified_at AS modified FROM entries e JOIN disks d ON d.id = e.disk_id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    rows = sinks.export_frame(stats.with_disk_name(cat.entries, cat))
    path = scratch_path(cat.spark, "export")
    sinks.export_rows(rows, "csv", path)
    return cat.spark.read.csv(path, header=True, quote='"', escape='"', schema="disk string, path string, name string, "
                              "type string, size bigint, modified bigint")


@query("audit_append", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS records, CAST(sum(floor(value)) AS BIGINT) AS bytes
    FROM events GROUP BY 1""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    path = scratch_path(cat.spark, "audit")
    sinks.append_audit(cat.access_log, path)
    log = cat.spark.read.parquet(path)
    return log.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"))


@query("set_annotations", """SELECT e.id, 'q' || CAST(quality AS VARCHAR) AS comment FROM entries e
    LEFT JOIN first_file f ON f.entry_id = e.id LEFT JOIN labels ON doc_id = k""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    updates = _label_updates(cat, sf_dir).withColumnRenamed("entry_id", "id")
    return ingest.apply_annotations(cat.entries, updates, ["comment"]).select("id", "comment")


def _building(cat: Catalog, sf_dir: str) -> DataFrame:
    """Folders of one market segment: the selection used by subtree operators."""
    return table(cat.spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(
        (F.col("c_custkey") * 4 + 1).alias("id"))


_SEG = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


@query("delete_cascade", f"""SELECT disk_id, count(*) FILTER (NOT is_folder) AS file_count, count(*) FILTER (is_folder) AS folder_count,
    CAST(coalesce(sum(CASE WHEN NOT is_folder THEN size_logical END), 0) AS BIGINT) AS total_size,
    CAST((SELECT count(*) FROM entry_tags t JOIN files f ON f.id = t.entry_id WHERE f.disk_id = e.disk_id AND f.c_custkey NOT IN {_SEG}) AS BIGINT) AS tags
    FROM entries e WHERE c_custkey IS NULL OR c_custkey NOT IN {_SEG} GROUP BY disk_id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    after = ingest.delete_subtrees(cat, _building(cat, sf_dir))
    tagged = after.entry_tags.join(after.entries.select(F.col("id").alias("entry_id"), "disk_id"), "entry_id").groupBy(
        "disk_id").agg(F.count(F.lit(1)).alias("tags"))
    return after.disks.select(F.col("id").alias("disk_id"), "file_count", "folder_count", "total_size").join(
        tagged, "disk_id", "left").withColumn("tags", F.coalesce("tags", F.lit(0)))


@query("delete_disks", """SELECT disk_id, count(*) AS entries,
    CAST((SELECT count(*) FROM thumbnails t JOIN files f ON f.id = t.entry_id WHERE f.disk_id = e.disk_id) AS BIGINT) AS thumbnails
    FROM entries e WHERE (disk_id - 1) % 3 <> 2 GROUP BY disk_id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    after = ingest.drop_disks(cat.replacing(entries=once(cat, "entries")), cat.disks.filter("volume_uuid IS NULL"))
    shown = after.thumbnails.join(after.entries.select(F.col("id").alias("entry_id"), "disk_id"), "entry_id").groupBy(
        "disk_id").agg(F.count(F.lit(1)).alias("thumbnails"))
    return after.entries.groupBy("disk_id").agg(F.count(F.lit(1)).alias("entries")).join(shown, "disk_id", "left") \
        .withColumn("thumbnails", F.coalesce("thumbnails", F.lit(0)))


# --- tree ------------------------------------------------------------------------------------------


@query("entry_paths", "SELECT id, path, CAST(depth AS BIGINT) AS depth FROM entries")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return tree.with_paths(cat.entries.drop(*TREE_COLUMNS)).select("id", "path", *_big("depth"))


@query("rel_paths", """SELECT pair AS disk_id, rel_path, n.id AS entry_id, n.f AS is_folder, n.s AS size FROM src""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return tree.rel_index(cat.entries).select("disk_id", "rel_path", "entry_id", "is_folder", "size")


@query("subtree", f"SELECT id, is_folder FROM entries WHERE c_custkey IN {_SEG}")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return tree.subtree(cat.entries, _building(cat, sf_dir)).select("id", "is_folder")


@query("expand_to_files", f"SELECT id, path FROM entries WHERE NOT is_folder AND c_custkey IN {_SEG}")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    chosen, _ = tree.expand_to_files(cat.entries, _building(cat, sf_dir))
    return chosen.select("id", "path")


@query("folder_rollup", "SELECT id, size_logical, size_physical FROM entries WHERE is_folder")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    bare = cat.entries.withColumns({c: F.when(~F.col("is_folder"), F.col(c)) for c in ("size_logical", "size_physical")})
    return tree.folder_rollup(bare).filter("is_folder").select("id", "size_logical", "size_physical")


@query("list_children", """SELECT id, name, is_folder, size_logical, (SELECT count(*) FROM entries c WHERE c.parent_id = e.id) AS child_count
    FROM entries e WHERE disk_id = 1 AND depth = 1""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return tree.list_children(cat.entries, 1).select("id", "name", "is_folder", "size_logical", "child_count")


@query("child_count", """SELECT e.id, coalesce(n, 0) AS child_count FROM entries e
    LEFT JOIN (SELECT parent_id, count(*) AS n FROM entries GROUP BY 1) c ON c.parent_id = e.id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return tree.with_child_count(cat.entries.select("id", "parent_id")).select("id", "child_count")


_TREE_SQL = """, lost AS (SELECT pair, rel_path, src_size, string_split(rel_path, '/') AS p FROM diff WHERE NOT is_folder AND {test}),
    up AS (SELECT pair, array_to_string(p[1:k], '/') AS rel_path, src_size FROM (SELECT *, unnest(generate_series(0, len(p) - 1)) AS k FROM lost)),
    missing_tree AS (SELECT pair, rel_path, count(*) AS files, CAST(sum(src_size) AS BIGINT) AS bytes FROM up GROUP BY 1, 2)
"""


@query("missing_tree", _TREE_SQL.format(test="fast = 'missing'") + "SELECT * FROM missing_tree")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return compare.missing_tree(_diff(cat, "fast"), keys=("pair",))


@query("missing_tree_deep", _TREE_SQL.format(test="deep IN ('missing', 'mismatch')") + "SELECT * FROM missing_tree")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return compare.missing_tree(_diff(cat, "deep"), include_mismatch=True, keys=("pair",))


_COVER_SQL = """, sel AS (SELECT pair, rel_path, CASE WHEN len(p) > 1 THEN p[1] END AS up1, CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] END AS up2
      FROM (SELECT DISTINCT pair, rel_path, string_split(rel_path, '/') AS p FROM diff WHERE fast = 'missing')),
    cover AS (SELECT pair, rel_path FROM sel s WHERE NOT EXISTS (SELECT 1 FROM sel a WHERE a.pair = s.pair AND a.rel_path = s.up1)
      AND NOT EXISTS (SELECT 1 FROM sel a WHERE a.pair = s.pair AND a.rel_path = s.up2))
"""


def _missing(cat: Catalog) -> DataFrame:
    return _diff(cat, "fast").filter("status = 'missing'")


def _cover(lost: DataFrame) -> DataFrame:
    return tree.minimal_cover(lost.select("pair", F.col("rel_path").alias("path")), ("pair",))


@query("minimal_cover", _COVER_SQL + "SELECT pair, rel_path AS path FROM cover")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _cover(_missing(cat))


@query("selection_totals", _TREE_SQL.format(test="fast = 'missing'") + _COVER_SQL + """SELECT pair, CAST(sum(files) AS BIGINT) AS files,
    CAST(sum(bytes) AS BIGINT) AS bytes FROM missing_tree JOIN cover USING (pair, rel_path) GROUP BY pair""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    lost = materialize(_missing(cat), "missing")  # several steps read it
    return tree.selection_totals(compare.missing_tree(lost, keys=("pair",)), _cover(lost), ("pair",))


@query("tree_levels", _TREE_SQL.format(test="fast = 'missing'") + """SELECT pair, rel_path, files, bytes,
    CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS parent_path,
    string_split(rel_path, '/')[-1] AS name, CAST(len(string_split(rel_path, '/')) AS BIGINT) AS depth FROM missing_tree WHERE rel_path <> ''""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    nodes = compare.missing_tree(_diff(cat, "fast"), keys=("pair",))
    return tree.tree_levels(nodes).select("pair", "rel_path", "files", "bytes", "parent_path", "name", *_big("depth"))


# --- filters and predicates ------------------------------------------------------------------------

_ITEM = "e.id, d.name AS disk_name, e.name, e.is_folder, e.size_logical, e.modified_at, e.path"


def _page_sql(source: str, order: str, limit: int) -> str:
    return f""", hit AS ({source})
    SELECT *, (SELECT count(*) FROM hit) AS total, (SELECT count(*) FROM hit) > {limit} AS truncated
    FROM (SELECT * FROM hit ORDER BY {order} LIMIT {limit})"""


def _items(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("id", "disk_name", "name", "is_folder", "size_logical", "modified_at", "path", *extra)


@query("search_advanced", _page_sql(
    f"SELECT {_ITEM} FROM entries e JOIN disks d ON d.id = e.disk_id WHERE NOT is_folder AND ext IN ('mp4', 'mov') "
    "AND size_logical >= 20971520 AND size_logical <= 41943040 AND modified_at >= 852076800 AND modified_at <= 915148799",
    "size_logical DESC, id", 2000))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _items(search.search_advanced(cat, {
        "kind": "file", "exts": ["MP4", "mov"], "min_size": 20971520, "max_size": 41943040,
        "modified_after": 852076800, "modified_before": 915148799}), "total", "truncated")


@query("search_by_category", _page_sql(
    f"SELECT {_ITEM} FROM entries e JOIN disks d ON d.id = e.disk_id WHERE ext IN ('jpg') AND d.id = 3", "size_logical DESC, id", 2000))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _items(search.search_advanced(cat, {"category": "image", "disk_id": 3}), "total", "truncated")


@query("search_by_place_and_light", _page_sql(
    f"SELECT {_ITEM} FROM entries e JOIN disks d ON d.id = e.disk_id JOIN light l ON l.id = e.id "
    "WHERE contains(lower(gps_place), 'place 1') AND contains(light_phase, 'sunset')", "size_logical DESC, id", 2000))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _items(search.search_advanced(cat, {"place": "PLACE 1", "light": "Sunset"}), "total", "truncated")


@query("search_by_tags", _page_sql(
    f"SELECT {_ITEM} FROM entries e JOIN disks d ON d.id = e.disk_id WHERE e.id IN (SELECT entry_id FROM entry_tags WHERE "
    "tag IN ('brand#12', '1-urgent') GROUP BY entry_id HAVING count(DISTINCT tag) = 2)", "size_logical DESC, id", 2000))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _items(search.search_advanced(cat, {"tags": ["Brand#12", "1-URGENT", "brand#12 "]}), "total", "truncated")


_NAME_DOCS = "SELECT id AS entry_id, disk_id, name AS text FROM entries"
_RED = oracle.bm25(_NAME_DOCS, [("red", False), ("w", True)])
_SCORED = f"SELECT {_ITEM}, round(score, 6) AS score FROM ranked r JOIN entries e ON e.id = r.entry_id JOIN disks d ON d.id = e.disk_id"


def _scored(df: DataFrame) -> DataFrame:
    return _items(df.withColumn("score", F.round("score", 6)), "score", "total", "truncated")


@query("search_text_and_filters", _RED + _page_sql(
    _SCORED + " WHERE ext = 'jpg' AND size_logical >= 10485760", "score, id", 2000))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _scored(search.search_advanced(cat, {"text": "Red w", "exts": ["jpg"], "min_size": 10485760}))


@query("os_noise", rf"""SELECT page_id, replace({_URL_PATH}, '/es/', '/._es/') AS path FROM pages
    WHERE NOT regexp_matches(replace({_URL_PATH}, '/es/', '/._es/'), '(^|/)[.]_')""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    path = F.replace(paths.url_path(F.col("url")), F.lit("/es/"), F.lit("/._es/"))
    return tree.drop_os_noise(table(cat.spark, sf_dir, "pages").select("page_id", path.alias("path")), "path")


@query("within_prefixes", f"""SELECT id, rel_path FROM entries WHERE rel_path IS NOT NULL AND c_custkey IN {_SEG}""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    entries = materialize(once(cat, "entries").select("id", "disk_id", "rel_path"), "paths")  # read several times
    chosen = entries.join(_building(cat, sf_dir), "id", "left_semi").select(
        "disk_id", F.col("rel_path").alias("prefix"))
    rows = entries.filter("rel_path IS NOT NULL")
    return compare.within_prefixes(rows, chosen, ("disk_id",)).select("id", "rel_path")


@query("entry_meta", """SELECT e.id, content_hash, gps_lat, gps_lon, gps_place, captured_at, camera_make, CAST(NULL AS VARCHAR) AS camera_model,
    light_phase, (content_hash IS NOT NULL OR gps_lat IS NOT NULL) AS enriched FROM entries e LEFT JOIN light l ON l.id = e.id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return search.entry_meta(cat)


@query("list_disks", "SELECT id, name, total_size, file_count, folder_count, is_online, mount_path, location FROM disks")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.list_disks(cat).select("id", "name", "total_size", "file_count", "folder_count", "is_online",
                                        "mount_path", "location")


_SPACE = """SELECT d.id, d.name, total_size, file_count, folder_count, is_online, 'external' AS kind, capacity, scanned_at,
    CASE WHEN is_online THEN coalesce(u.t, m.t, n.t) END AS live_total, CASE WHEN is_online THEN coalesce(u.a, m.a, n.a) END AS live_free
    FROM disks d LEFT JOIN by_uuid u ON u.k = d.volume_uuid LEFT JOIN by_mount m ON m.k = d.mount_path LEFT JOIN by_name n ON n.k = d.name"""


@query("disk_detail", _SPACE)
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return status.disk_detail(cat)


@query("media_ext_class", """SELECT CASE ext WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'mov' THEN 'video' WHEN 'wav' THEN 'audio'
    WHEN 'zip' THEN 'archive' END AS media_class, ext IN ('mp4', 'mov') AS may_have_location, count(*) AS files FROM files GROUP BY 1, 2""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return enrich.with_media_class(cat.entries.filter("NOT is_folder")).groupBy("media_class", "may_have_location").agg(
        F.count(F.lit(1)).alias("files"))


@query("location_gate", "SELECT id FROM clips")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return enrich.location_candidates(cat.entries).select("id")


# --- joins -----------------------------------------------------------------------------------------


@query("search_items", f"SELECT {_ITEM}, n_chars AS rank FROM documents JOIN first_file ON k = doc_id JOIN entries e ON e.id = entry_id JOIN disks d ON d.id = e.disk_id")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    docs = table(cat.spark, sf_dir, "documents").select((F.col("doc_id") + 1700000000).alias("created_at"), "n_chars")
    hits = cat.transcripts.join(docs, "created_at").select(F.col("entry_id").alias("id"), F.col("n_chars").alias("rank"))
    return _items(search.search_items(cat, hits), "rank")


_PENDING = {
    "pending_thumbnails": ("thumbnails", "SELECT id FROM files WHERE ext = 'jpg' AND id NOT IN (SELECT entry_id FROM thumbnails)"),
    "pending_video_meta": ("video_meta", "SELECT id FROM clips WHERE id NOT IN (SELECT entry_id FROM video_meta)"),
    "pending_archives": ("archives", "SELECT id FROM files WHERE ext = 'zip' AND id NOT IN (SELECT entry_id FROM members)"),
    "pending_embeddings": ("embeddings", "SELECT entry_id AS id FROM thumbnails WHERE entry_id NOT IN (SELECT entry_id FROM vecs)"),
    "pending_video_embeddings": ("video_embeddings", "SELECT id FROM clips WHERE id NOT IN (SELECT entry_id FROM vecs WHERE frame_ts IS NOT NULL)"),
    "pending_transcripts": ("transcripts", "SELECT id FROM files WHERE ext IN ('mp4', 'mov', 'wav') AND id NOT IN (SELECT entry_id FROM transcripts)"),
}
for _name, (_kind, _sql) in _PENDING.items():
    query(_name, _sql)(lambda cat, sf_dir, kind=_kind: pending.pending(
        cat, kind, model=MODEL if "embeddings" in kind else None).select("id"))


@query("tags_all", """SELECT entry_id FROM entry_tags WHERE tag IN ('brand#12', '1-urgent') GROUP BY entry_id HAVING count(DISTINCT tag) = 2""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return search.having_all_tags(cat, ["Brand#12", "1-URGENT"])


@query("list_tags", """SELECT tag, count(entry_id) AS count FROM (SELECT tag, entry_id FROM entry_tags
    UNION ALL SELECT DISTINCT lower(c_mktsegment), NULL::BIGINT FROM customer) GROUP BY tag""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    known = table(cat.spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tag"))
    return tags.list_tags(cat, known)


@query("entry_tags", """SELECT entry_id, tag FROM entry_tags WHERE tag <> '5-low'
    UNION ALL SELECT id, 'hd' FROM clips""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    added = cat.clips.select(F.col("id").alias("entry_id"), F.lit(" HD ").alias("tag"))
    twice = tags.add_tags(tags.add_tags(cat, added), added)
    dropped = cat.entries.select(F.col("id").alias("entry_id"), F.lit("5-LOW").alias("tag"))
    return tags.entry_tags(tags.remove_tags(twice, dropped))


@query("parent_child", "SELECT c.id, c.name, p.name AS parent_name FROM entries c JOIN entries p ON c.parent_id = p.id")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return tree.with_parent(cat.entries).select("id", "name", "parent_name")


@query("compare_fast", "SELECT pair, rel_path, fast AS status, is_folder, src_size, dst_size, src_entry_id FROM diff")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _diff(cat, "fast").select("pair", "rel_path", "status", "is_folder", "src_size", "dst_size", "src_entry_id")


@query("compare_deep", "SELECT pair, rel_path, deep AS status, is_folder, src_size, dst_size, src_entry_id FROM diff")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _diff(cat, "deep").select("pair", "rel_path", "status", "is_folder", "src_size", "dst_size", "src_entry_id")


@query("compare_summary", """SELECT pair, count(*) FILTER (deep = 'missing') AS missing_count, count(*) FILTER (deep = 'missing' AND NOT is_folder) AS missing_file_count,
    CAST(coalesce(sum(src_size) FILTER (deep = 'missing' AND NOT is_folder), 0) AS BIGINT) AS missing_bytes, count(*) FILTER (deep = 'mismatch') AS mismatch_count,
    CAST(coalesce(sum(src_size) FILTER (deep = 'mismatch'), 0) AS BIGINT) AS mismatch_bytes, count(*) FILTER (deep = 'extra') AS extra_count,
    count(*) FILTER (deep = 'conflict') AS conflict_count, count(*) FILTER (deep = 'unverified') AS unverified_count,
    count(*) FILTER (deep = 'same' AND NOT is_folder) AS ok_count FROM diff GROUP BY pair""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return compare.compare_summary(_diff(cat, "deep"), ("pair",))


@query("compare_lists", """SELECT pair, rel_path, src_size, dst_size, (SELECT count(*) FROM diff WHERE deep = 'mismatch') > 5000 AS truncated FROM diff
    WHERE deep = 'mismatch' ORDER BY rel_path, src_entry_id LIMIT 5000""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return compare.diff_list(_diff(cat, "deep"), "mismatch").select("pair", "rel_path", "src_size", "dst_size", "truncated")


_PLAN = """, plan AS (SELECT pair, rel_path, CASE WHEN is_folder THEN 0 ELSE src_size END AS size, is_folder, fast = 'mismatch' AS overwrite
    FROM diff WHERE fast IN ('missing', 'mismatch')) """


@query("copy_plan", _PLAN + "SELECT * FROM plan")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    plan = compare.copy_plan(_diff(cat, "fast"), include_mismatch=True, keys=("pair",))
    return compare.in_copy_order(materialize(plan, "plan"), ("pair",))  # stored, as sorting reads it twice


@query("plan_totals", _PLAN + "SELECT pair, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM plan GROUP BY pair")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return compare.plan_totals(compare.copy_plan(_diff(cat, "fast"), include_mismatch=True, keys=("pair",)), ("pair",))


@query("gather_plan", f"""SELECT d.id AS disk_id, d.name AS disk_name, is_online, count(*) AS total, CAST(sum(size_logical) AS BIGINT) AS total_bytes,
    (SELECT count(*) FROM files WHERE c_custkey IN {_SEG}) AS all_files, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS expanded_folders
    FROM files f JOIN disks d ON d.id = f.disk_id WHERE c_custkey IN {_SEG} GROUP BY ALL""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    groups, _, totals = gather.gather_plan(cat, _building(cat, sf_dir))
    return groups.withColumns({
        "all_files": totals.select("total_files").scalar(), "expanded_folders": totals.select("expanded_folders").scalar()})


@query("gather_targets", f"""SELECT f.id, CASE WHEN is_online THEN mount_path || '/' || rel_path END AS source,
    CASE WHEN is_online THEN '/target/' || d.name || '/' || rel_path END AS target, CASE WHEN NOT is_online THEN 'disk offline: ' || d.name END AS error
    FROM files f JOIN disks d ON d.id = f.disk_id WHERE c_custkey IN {_SEG}""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return gather.gather_targets(gather.gather_files(cat, _building(cat, sf_dir)), "/target/")


_NEAR = """, pts AS (SELECT DISTINCT gps_lat AS lat, gps_lon AS lon FROM clips),
    near AS (SELECT a.lat, a.lon, arg_min({'i': p.place_id, 'p': p.place},
        [pow(cos(radians(a.lat)) * cos(radians(a.lon)) - cos(radians(p.lat)) * cos(radians(p.lon)), 2)
       + pow(cos(radians(a.lat)) * sin(radians(a.lon)) - cos(radians(p.lat)) * sin(radians(p.lon)), 2)
       + pow(sin(radians(a.lat)) - sin(radians(p.lat)), 2), p.place_id]) AS b FROM pts a, places p GROUP BY 1, 2)
"""


@query("nearest_place", _NEAR + "SELECT lat, lon, b.i AS place_id, b.p AS place FROM near")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    points = cat.clips.select(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    return enrich.nearest_place(points, cat["gazetteer"])


@query("online_status", """SELECT d.id, d.name, CASE WHEN volume_uuid IS NOT NULL THEN u.m ELSE n.m END AS mount_path,
    CASE WHEN volume_uuid IS NOT NULL THEN u.m ELSE n.m END IS NOT NULL AS is_online
    FROM disks d LEFT JOIN by_uuid u ON u.k = d.volume_uuid LEFT JOIN by_name n ON n.k = d.name""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return status.online_status(cat.disks, cat.volumes).select("id", "name", "mount_path", "is_online")


@query("live_space", f"SELECT id, live_total, live_free FROM ({_SPACE})")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return status.live_space(cat.disks, cat.volumes).select("id", "live_total", "live_free")


@query("disk_drift", """SELECT d.id, d.name, CASE WHEN coalesce(u.t, n.t) IS NULL THEN 'offline'
    WHEN abs(coalesce(u.t - u.a, n.t - n.a) - total_size) <= greatest(5368709120, coalesce(u.t, n.t) * 0.15::DOUBLE) THEN 'upToDate' ELSE 'changed' END AS status
    FROM disks d LEFT JOIN by_uuid u ON u.k = d.volume_uuid LEFT JOIN by_name n ON n.k = d.name""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return status.disk_drift(cat.disks, cat.volumes)


@query("scope_filter", """SELECT s.device_id, e.disk_id, count(*) AS entries FROM scopes s JOIN entries e ON e.disk_id = s.disk_id GROUP BY 1, 2
    UNION ALL SELECT id, NULL, (SELECT count(*) FROM entries) FROM devices WHERE user_id % 5 = 0 AND NOT revoked""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Entries each device may see; devices with the wildcard get one row for everything."""
    seen = status.visible_disks(cat.disks, cat.devices)
    per_disk = cat.entries.groupBy("disk_id").agg(F.count(F.lit(1)).alias("entries"))
    listed = seen.filter("disk_id IS NOT NULL").join(per_disk, "disk_id").select("device_id", "disk_id", "entries")
    everything = cat.entries.agg(F.count(F.lit(1))).scalar()
    return listed.unionByName(seen.filter("disk_id IS NULL").withColumn("entries", everything))


@query("scope_one_device", "SELECT id, disk_id FROM entries WHERE disk_id IN (SELECT disk_id FROM scopes WHERE device_id = 'dev8')")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return status.filter_by_scope(cat.entries, cat.devices, "dev8").select("id", "disk_id")


_SIG = """, sums AS (SELECT entry_id, i, sum(v[i]) AS x FROM (SELECT entry_id, v, unnest(generate_series(1, len(v))) AS i FROM vecs) GROUP BY 1, 2),
    sig AS (SELECT entry_id, list(round(x / n, 12) ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY entry_id)) AS n FROM sums) WHERE n > 0 GROUP BY 1),
    reps AS (SELECT min(entry_id) AS entry_id, v FROM sig GROUP BY v),
    near AS (SELECT a.entry_id AS a, b.entry_id AS b, list_dot_product(a.v, b.v) AS score FROM reps a JOIN reps b ON a.entry_id < b.entry_id)
"""
_VISUAL = 0.92


@query("similarity_pairs", _SIG + f"SELECT a, b, round(score, 6) AS score FROM near WHERE score >= {_VISUAL}")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return vectors.similarity_pairs(vectors.signatures(cat, MODEL), _VISUAL).withColumn("score", F.round("score", 6))


@query("merge_names_conflicts", "SELECT n_name AS disk_name FROM nation")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return status.name_conflicts(cat, cat.volumes.select(F.col("name").alias("disk_name")).unionByName(
        cat.disks.select(F.col("name").alias("disk_name"))))


# --- aggregations ----------------------------------------------------------------------------------


@query("catalog_totals", """SELECT CAST(sum(file_count) AS BIGINT) AS file_count, CAST(sum(folder_count) AS BIGINT) AS folder_count,
    CAST(sum(total_size) AS BIGINT) AS total_size FROM disks""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.catalog_totals(cat)


@query("ext_distribution", """, x AS (SELECT ext, count(*) AS count, CAST(sum(size_logical) AS BIGINT) AS total_size FROM files GROUP BY ext)
    SELECT *, round(total_size / (SELECT max(total_size) FROM x)::DOUBLE, 6) AS share FROM x ORDER BY total_size DESC, ext LIMIT 25""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.ext_distribution(cat).withColumn("share", F.round("share", 6))


_DUPS = """, dup AS (SELECT name, size_logical, count(*) AS count, (count(*) - 1) * size_logical AS wasted FROM files
    WHERE size_logical >= 1048576 GROUP BY 1, 2 HAVING count(*) > 1)
"""


@query("duplicate_groups", _DUPS + """, top AS (SELECT * FROM dup ORDER BY wasted DESC, name, size_logical LIMIT 500)
    SELECT f.name, f.size_logical, t.count, t.wasted, f.item, f.id, d.name AS disk_name, f.path
    FROM (SELECT *, row_number() OVER (PARTITION BY name, size_logical ORDER BY id) AS item FROM entries WHERE NOT is_folder) f
    JOIN top t ON t.name = f.name AND t.size_logical = f.size_logical JOIN disks d ON d.id = f.disk_id WHERE item <= 100""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.duplicate_groups(cat.replacing(entries=once(cat, "entries"))).withColumn("item", F.col("item").cast("bigint"))


@query("duplicate_summary", _DUPS + "SELECT name, size_logical, count, wasted FROM dup")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.duplicate_summary(cat).select("name", "size_logical", "count", "wasted")


@query("wasted_total", _DUPS + "SELECT CAST(sum(wasted) AS BIGINT) AS wasted FROM dup")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.wasted_total(stats.duplicate_summary(cat))


@query("hash_duplicates", """SELECT content_hash, count(*) AS count, max(size_logical) AS size, (count(*) - 1) * max(size_logical) AS wasted
    FROM files WHERE content_hash IS NOT NULL AND size_logical >= 1048576 GROUP BY 1 HAVING count(*) > 1""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.hash_duplicates(cat).select("content_hash", "count", "size", "wasted")


@query("file_folder_counts", "SELECT id AS disk_id, file_count, folder_count, total_size FROM disks")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.file_folder_counts(cat.entries)


@query("embedded_entries", """SELECT (SELECT count(DISTINCT entry_id) FROM vecs) AS embedded_entries,
    (SELECT count(*) FROM thumbnails) AS thumbnails, (SELECT count(*) FROM transcripts) AS transcripts""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.index_status(cat, MODEL)


@query("archive_member_count", "SELECT entry_id, count(*) AS members, count(*) FILTER (NOT is_dir) AS files FROM members GROUP BY 1")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.archive_member_counts(cat)


_QV = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"
_BEST = f""", dots AS (SELECT entry_id, frame_ts, list_dot_product(v, {_QV}) AS score FROM vecs),
    best AS (SELECT entry_id, score, frame_ts FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, frame_ts) AS r FROM dots) WHERE r = 1)
"""


def _query_vector(cat: Catalog, sf_dir: str) -> list[float]:
    return table(cat.spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


@query("best_frame", _BEST + "SELECT entry_id, round(score, 6) AS score, frame_ts FROM best WHERE score >= -1")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    scored = vectors.semantic_scores(cat, MODEL, _query_vector(cat, sf_dir), threshold=-1.0)
    return scored.withColumn("score", F.round("score", 6))


@query("mean_vector", _SIG + "SELECT entry_id, CAST(u.i - 1 AS BIGINT) AS i, round(v[u.i], 6) AS x FROM sig, unnest(generate_series(1, len(v))) AS u(i)")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return vectors.signatures(cat, MODEL).select("entry_id", F.posexplode("vec").alias("i", "x")).select(
        "entry_id", *_big("i"), F.round("x", 6).alias("x"))


# The sequential rule as a recursion over ascending ids: the working table always holds all leaders so far.
@query("visual_duplicates", _SIG + f""", num AS (SELECT *, row_number() OVER (ORDER BY entry_id) AS r FROM sig),
    edge AS (SELECT a.r AS a, b.r AS b FROM num a JOIN num b ON a.r < b.r AND list_dot_product(a.v, b.v) >= {_VISUAL}),
    lead AS (
      SELECT r, leaders FROM (WITH RECURSIVE g(r, leaders) AS (
        SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT g.r + 1, CASE WHEN EXISTS (SELECT 1 FROM edge e WHERE e.b = g.r + 1 AND list_contains(g.leaders, e.a)) THEN g.leaders
          ELSE list_append(g.leaders, g.r + 1) END FROM g WHERE g.r < (SELECT max(r) FROM num)) SELECT * FROM g)),
    fin AS (SELECT leaders FROM lead ORDER BY r DESC LIMIT 1),
    mem AS (SELECT n.r, CASE WHEN list_contains(f.leaders, n.r) THEN n.r ELSE (SELECT min(e.a) FROM edge e WHERE e.b = n.r AND list_contains(f.leaders, e.a)) END AS l
      FROM num n, fin f),
    item AS (SELECT ln.entry_id AS leader, e.id, e.name, e.size_logical FROM mem JOIN num n ON n.r = mem.r JOIN num ln ON ln.r = mem.l JOIN entries e ON e.id = n.entry_id)
    SELECT leader, arg_max(name, [size_logical, -id]) AS name, max(size_logical) AS size, count(*) AS count,
           CAST(sum(size_logical) - max(size_logical) AS BIGINT) AS wasted
    FROM item GROUP BY leader HAVING count(*) >= 2 AND max(size_logical) >= 1048576 ORDER BY wasted DESC, leader LIMIT 500""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return vectors.visual_duplicates(cat.replacing(entries=once(cat, "entries")), MODEL, threshold=_VISUAL)


@query("catalog_profile", """SELECT count(DISTINCT disk_id) AS disks, count(*) AS entries, count(*) FILTER (NOT is_folder) AS files,
    count(*) FILTER (is_folder) AS folders, count(*) FILTER (NOT is_folder AND lower(name) LIKE '%.mov') AS suffix_files,
    max(CASE WHEN NOT is_folder THEN size_logical END) AS largest_size, CAST(sum(CASE WHEN NOT is_folder THEN size_logical END) AS BIGINT) AS logical_bytes,
    CAST(sum(CASE WHEN NOT is_folder THEN size_physical END) AS BIGINT) AS physical_bytes FROM entries""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.catalog_profile(cat)


# --- orders, pages, windows ------------------------------------------------------------------------


@query("biggest_files", """SELECT e.id, e.name, e.size_logical, e.path, d.name AS disk_name FROM entries e JOIN disks d ON d.id = e.disk_id
    WHERE NOT is_folder ORDER BY size_logical DESC, e.id LIMIT 25""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.biggest_files(cat)


@query("browse_order", """SELECT id, name, is_folder, size_logical,
    row_number() OVER (PARTITION BY parent_id ORDER BY is_folder DESC, size_logical DESC, id) AS place FROM entries WHERE parent_id IS NOT NULL""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Place of every entry in the listing of its folder."""
    inside = cat.entries.filter("parent_id IS NOT NULL")
    return stats.placed(inside, ["parent_id"], stats.browse_columns("size", desc=True)).select(
        "id", "name", "is_folder", "size_logical", *_big("place"))


@query("search_order", f"""SELECT {_ITEM}, row_number() OVER (PARTITION BY e.disk_id ORDER BY lower(d.name), lower(e.name), e.id) AS place
    FROM entries e JOIN disks d ON d.id = e.disk_id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    found = stats.with_disk_name(cat.entries, cat)
    return _items(stats.placed(found, ["disk_id"], stats.search_columns("disk")).withColumn("place", F.col("place").cast("bigint")), "place")


@query("natural_key", r"""SELECT id, array_to_string(list_transform(regexp_extract_all(lower(strip_accents(name)), '\d+|\D+'), lambda r:
    CASE WHEN regexp_matches(r, '^\d') THEN lpad(CAST(len(coalesce(nullif(ltrim(r, '0'), ''), '0')) AS VARCHAR), 4, '0')
      || coalesce(nullif(ltrim(r, '0'), ''), '0') ELSE r END), '') AS key FROM entries""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return cat.entries.select("id", tx.natural_key(F.col("name")).alias("key"))


@query("total_and_page", _page_sql("SELECT id, name, size_logical FROM entries WHERE is_folder", "name, id", 1000))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    folders = cat.entries.filter("is_folder").select("id", "name", "size_logical")
    return stats.page(folders, [F.col("name"), F.col("id")], 1000)


@query("archive_listing", """SELECT entry_id, path, is_dir, size,
    row_number() OVER (PARTITION BY entry_id ORDER BY is_dir DESC, lower(path), path) AS place FROM members""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.placed(cat.archive_entries, ["entry_id"], stats.listing_columns()).select("entry_id", "path", "is_dir", "size", *_big("place"))


@query("frame_strip", """SELECT entry_id, CAST(floor(duration_ms / 1000.0::DOUBLE * i / 6.0::DOUBLE * 1000) AS BIGINT) AS pos_ms, CAST(i AS BIGINT) AS place
    FROM video_meta, unnest([1, 2, 3, 4, 5]) AS u(i)""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.placed(cat.video_frames, ["entry_id"], stats.strip_columns()).select("entry_id", "pos_ms", *_big("place"))


@query("online_status_stream", """, last AS (SELECT user_id AS u, arg_max(CAST(floor(epoch(ts)) AS BIGINT) % 16 = 0, floor(epoch(ts))) AS here FROM events GROUP BY 1),
    m AS (SELECT 'dev' || CAST(u AS VARCHAR) AS mount_path, u % 25 AS n FROM last WHERE here)
    SELECT d.id, d.name, min(m.mount_path) AS mount_path, min(m.mount_path) IS NOT NULL AS is_online FROM disks d LEFT JOIN m ON m.n + 1 = d.id GROUP BY 1, 2""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Devices of the access log stand for mounts, each of one nation's disk; a second of 16 says that it came, the others that it went."""
    at = F.timestamp_seconds("ts").alias("at")
    events = cat.access_log.select(F.col("device_id").alias("mount_path"), F.when(F.col("ts") % 16 == 0, "added").otherwise("removed").alias("event"), at)
    nation = F.substring("mount_path", 4, 20).cast("bigint") % 25
    volumes = events.select("mount_path").distinct().select(
        "mount_path", F.concat(F.lit("uuid-"), nation).alias("fingerprint"), F.concat(F.lit("NATION_"), nation).alias("name"))
    root = scratch_path(cat.spark, "streamed")
    _stream_into(events, online_status_sink(root, fan=3))
    return online_now(cat.spark, root, cat.disks, volumes).select("id", "name", "mount_path", "is_online")


@query("device_list", "SELECT id, created_at, last_seen, revoked FROM devices")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return stats.device_list(cat).select("id", "created_at", "last_seen", "revoked")


@query("presence_changes", """, seen AS (SELECT DISTINCT CAST(ts AS DATE) AS d, user_id AS u FROM events),
    polls AS (SELECT d, row_number() OVER (ORDER BY d) AS n, lead(d) OVER (ORDER BY d) AS nx FROM (SELECT DISTINCT d FROM seen)),
    s AS (SELECT u, n, d, nx FROM seen JOIN polls USING (d))
    SELECT CAST(d AS VARCHAR) AS poll, 'dev' || CAST(u AS VARCHAR) AS mount_path, CASE WHEN n = 1 THEN 'initial' ELSE 'added' END AS event FROM s
      WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.u = s.u AND b.n = s.n - 1)
    UNION ALL SELECT CAST(nx AS VARCHAR), 'dev' || CAST(u AS VARCHAR), 'removed' FROM s
      WHERE nx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s b WHERE b.u = s.u AND b.n = s.n + 1)""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Devices seen per day stand for the mounts of one poll."""
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    return presence_batch(cat.access_log.select(day.alias("poll"), F.col("device_id").alias("mount_path")))


# --- ranking ---------------------------------------------------------------------------------------


@query("name_search", _RED + _page_sql(_SCORED, "score, id", 1000))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _scored(search.search_names(cat.replacing(entries=once(cat, "entries")), "Red w"))


@query("name_search_suffix", oracle.bm25(_NAME_DOCS, [("mov", True)]) + _page_sql(_SCORED, "score, id", 50))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _scored(search.search_names(cat.replacing(entries=once(cat, "entries")), ".mov", limit=50))


@query("scoped_search", _RED + _page_sql(_SCORED + " WHERE e.disk_id = 3", "score, id", 500))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _scored(search.search_names(cat.replacing(entries=once(cat, "entries")), "red w", limit=search.SCOPED_LIMIT, disk_id=3))


_TEXT_DOCS = "SELECT entry_id, (SELECT max(disk_id) FROM entries f WHERE f.id = entry_id) AS disk_id, text FROM transcripts"
_TH = oracle.bm25(_TEXT_DOCS, [("the", False), ("an", True)])


@query("bm25", _TH + "SELECT entry_id, round(score, 6) AS score FROM ranked")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    ranked = search.rank_text(cat.text_postings, cat["text_stats"], tx.query_terms("the an"))
    return ranked.select("entry_id", F.round("score", 6).alias("score"))


@query("transcript_search", _TH + """SELECT entry_id, round(score, 6) AS score FROM ranked
    WHERE entry_id IN (SELECT entry_id FROM transcripts WHERE lang = 'en') ORDER BY ranked.score, entry_id LIMIT 200""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    hits = search.search_transcripts(cat, "the an", lang="en")
    return hits.select("entry_id", F.round("score", 6).alias("score"))


def _snippet_sql(texts: str, terms: list[tuple[str, bool]], size: int = 12) -> str:
    """Marked fragments of ``texts(entry_id, text)``."""
    meets = [f"starts_with(f, '{t}')" if prefix else f"f = '{t}'" for t, prefix in terms]
    return rf""", cw AS (SELECT entry_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+([^\p{{L}}\p{{N}}]*)', 1) AS g,
      regexp_extract(text, '^[^\p{{L}}\p{{N}}]*') AS lead FROM ({texts})),
    wat AS (SELECT entry_id, i, w[i] AS word, g[i] AS gap, len(w) AS n, lead, strip_accents(lower(w[i])) AS f FROM cw, unnest(range(1, len(w) + 1)) AS u(i)),
    met AS (SELECT *, CASE {' '.join(f"WHEN {m} THEN {k}" for k, m in enumerate(meets))} END AS term FROM wat),
    reach AS (SELECT a.entry_id, a.i, any_value(a.n) AS n, count(DISTINCT b.term) AS d, count(*) AS c, max(b.i) AS z
      FROM met a JOIN met b ON a.entry_id = b.entry_id AND b.i BETWEEN a.i AND a.i + {size - 1} WHERE a.term IS NOT NULL AND b.term IS NOT NULL GROUP BY 1, 2),
    top AS (SELECT * FROM reach QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY d * 1000 + c - d DESC, i) = 1),
    opens AS (SELECT c.entry_id, greatest(1, least(coalesce(i - ({size} - (z + 1 - i)) // 2, 1), len(w) - {size - 1})) AS s FROM cw c LEFT JOIN top USING (entry_id)),
    pieces AS (SELECT m.entry_id, string_agg(CASE WHEN term IS NULL THEN word ELSE '«' || word || '»' END || CASE WHEN i = s + {size - 1} AND i < n THEN '…' ELSE gap END, '' ORDER BY i) AS body
      FROM met m JOIN opens o ON o.entry_id = m.entry_id AND i BETWEEN s AND s + {size - 1} GROUP BY 1)
    SELECT entry_id, CASE WHEN s > 1 THEN '…' ELSE lead END || coalesce(body, '') AS snippet FROM cw JOIN opens USING (entry_id) LEFT JOIN pieces USING (entry_id)"""


@query("snippet", oracle.bm25(_TEXT_DOCS, [("eaux", True)]).rstrip() + ", page AS (SELECT entry_id FROM ranked ORDER BY ranked.score, entry_id LIMIT 200)"
       + _snippet_sql("SELECT entry_id, text FROM transcripts WHERE entry_id IN (SELECT entry_id FROM page)", [("eaux", True)]))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return search.search_transcripts(cat, "eaux").select("entry_id", "snippet")


@query("transcript_snippets", _snippet_sql("SELECT entry_id, text FROM transcripts", [("the", False), ("an", True)]))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """The best fragment of every transcript."""
    return tx.snippets(cat.transcripts, "entry_id", "text", tx.query_terms("the an"))


@query("semantic_search", _BEST + f"""SELECT {_ITEM}, round(score, 6) AS score, frame_ts FROM best JOIN entries e ON e.id = entry_id
    JOIN disks d ON d.id = e.disk_id WHERE score >= 0 ORDER BY best.score DESC, e.id LIMIT 200""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    found = vectors.semantic_search(cat, MODEL, _query_vector(cat, sf_dir))
    return _items(found.withColumn("score", F.round("score", 6)), "score", "frame_ts")


@query("similar_to", _SIG + """, me AS (SELECT min(entry_id) AS id FROM vecs),
    dots AS (SELECT x.entry_id, max(list_dot_product(x.v, s.v)) AS score FROM vecs x, sig s, me WHERE s.entry_id = me.id AND x.entry_id <> me.id GROUP BY 1)
    SELECT entry_id AS id, round(score, 6) AS score FROM dots WHERE score >= 0 ORDER BY dots.score DESC, entry_id LIMIT 200""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    me = cat.embeddings.agg(F.min("entry_id")).first()[0]
    return vectors.similar_to(cat, MODEL, me).select("id", F.round("score", 6).alias("score"))


@query("batch_semantic", """, q AS (SELECT CAST(label AS BIGINT) AS query_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS qv FROM embeddings GROUP BY label),
    best AS (SELECT query_id, entry_id, max(list_dot_product(v, qv)) AS score FROM vecs, q GROUP BY 1, 2)
    SELECT query_id, entry_id, round(score, 6) AS score, r AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS r FROM best) WHERE r <= 8""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    asked = table(cat.spark, sf_dir, "embeddings").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("vec"))
    found = vectors.batch_semantic(cat, asked, MODEL)
    return found.select("query_id", "entry_id", F.round("score", 6).alias("score"), *_big("rank"))


_HEARD = oracle.bm25(_TEXT_DOCS, [("the", True)])
_HYBRID = _BEST + _HEARD + """, vis AS (SELECT b.entry_id AS id, b.score, frame_ts, 0 AS origin FROM
      best b JOIN entries e ON e.id = b.entry_id WHERE score >= 0.05 AND {visual} ORDER BY b.score DESC, b.entry_id LIMIT 300),
    spo AS (SELECT r.entry_id AS id, -r.score AS score, CAST(NULL AS DOUBLE) AS frame_ts, 1 AS origin FROM
      (SELECT r.* FROM ranked r JOIN entries e ON e.id = r.entry_id WHERE {visual} ORDER BY r.score, r.entry_id LIMIT 300) r WHERE r.entry_id NOT IN (SELECT id FROM vis))
    SELECT id, round(score, 6) AS score, frame_ts, CAST(origin AS BIGINT) AS origin FROM (SELECT * FROM vis UNION ALL SELECT * FROM spo) u
    ORDER BY origin, u.score DESC, id LIMIT 300"""


def _hybrid(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "frame_ts", *_big("origin"))


@query("hybrid_search", _HYBRID.replace("{visual}", "NOT is_folder AND e.ext IN ('mp4', 'mov', 'jpg') AND e.size_logical >= 5242880"))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _hybrid(vectors.hybrid_search(cat, {"exts": ["mp4", "mov", "jpg"], "min_size": 5242880}, MODEL,
                                         _query_vector(cat, sf_dir), "the"))


@query("hybrid_merge", _HYBRID.replace("{visual}", "TRUE"))
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return _hybrid(vectors.hybrid_search(cat, {}, MODEL, _query_vector(cat, sf_dir), "the"))


@query("nl_post_filter", _BEST + """SELECT e.id, round(score, 6) AS score FROM best JOIN entries e ON e.id = entry_id
    WHERE score >= -1 AND NOT is_folder AND ext IN ('pdf', 'zip') AND size_logical <= 31457280 ORDER BY best.score DESC, e.id LIMIT 200""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    within = search.filtered_ids(cat, {"exts": ["pdf", "zip"], "max_size": 31457280})
    return vectors.semantic_search(cat, MODEL, _query_vector(cat, sf_dir), -1.0, within=within).select(
        "id", F.round("score", 6).alias("score"))


# --- enrichment and saved searches -----------------------------------------------------------------


@query("enrich_location", _NEAR + """SELECT c.id, gps_lat, gps_lon, b.p AS gps_place, captured_at, 'Make ' || p_brand AS camera_make, light_phase
    FROM clips c JOIN near ON near.lat = gps_lat AND near.lon = gps_lon JOIN light l ON l.id = c.id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return enrich.enrich_location(once(cat, "entries"), cat["probes"], cat["gazetteer"]).select(
        "id", "gps_lat", "gps_lon", "gps_place", "captured_at", "camera_make", "light_phase")


@query("light_histogram", "SELECT light_phase, count(*) AS count, CAST(sum(size_logical) AS BIGINT) AS bytes FROM light GROUP BY 1")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    fresh = enrich.with_light(once(cat, "entries").drop("light_phase"))
    return enrich.light_histogram(fresh)


@query("frame_sampling_plan", """SELECT id, CAST(i - 1 AS BIGINT) AS frame, round(duration_ms / 1000.0::DOUBLE * i / 9.0::DOUBLE, 6) AS frame_ts
    FROM clips JOIN video_meta ON entry_id = id, unnest(generate_series(1, 8)) AS u(i)
    WHERE id NOT IN (SELECT entry_id FROM vecs WHERE frame_ts IS NOT NULL)""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    plan = pending.frame_sampling_plan(cat, MODEL)
    return plan.select("id", *_big("frame"), F.round("frame_ts", 6).alias("frame_ts"))


def _search_log(cat: Catalog, sf_dir: str) -> DataFrame:
    """One logged search string per part."""
    k = F.col("p_partkey")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    box = (
        F.when(k % 6 == 0, F.concat(first, F.lit(" "), F.substring(second, 1, 3), F.lit(" size>"), "p_size", F.lit("MB")))
        .when(k % 6 == 1, F.concat(F.lit("tag:"), "p_brand", F.lit(",1-URGENT type:file before:1997-06-15")))
        .when(k % 6 == 2, F.concat(F.lit("EXT:.mov,jpg size<="), "p_size", F.lit("mb after:1999-12-01 place:C"), k % 25))
        .when(k % 6 == 3, F.concat(F.lit("cat:foto size>"), F.col("p_size") + 0.5, F.lit("mb "), second))
        .when(k % 6 == 4, F.concat(F.lit("luz:atardecer type:archivo size>=49mb place:19")))
        .otherwise(F.concat(F.lit("  modified>oops type:carpeta size<"), "p_size", F.lit("mb")))
    )
    return table(cat.spark, sf_dir, "part").select(k.alias("search_id"), box.alias("box"))


_LOG = """, sl AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_size AS z, lower(p_brand) AS brand FROM part),
    spec AS (SELECT k AS search_id, CASE k % 6 WHEN 0 THEN a || ' ' || b[1:3] WHEN 3 THEN b ELSE '' END AS text,
      CASE k % 6 WHEN 2 THEN 'mov,jpg' WHEN 3 THEN 'jpg,jpeg,png,gif,webp,bmp,tif,tiff,heic,heif,svg,dng,arw,cr2,cr3,crw,nef,nrw,raf,orf,rw2,pef,srw' ELSE '' END AS exts,
      CASE k % 6 WHEN 1 THEN brand || ',1-urgent' ELSE '' END AS tags,
      CASE k % 6 WHEN 2 THEN 'C' || CAST(k % 25 AS VARCHAR) WHEN 4 THEN '19' END AS place, CASE k % 6 WHEN 4 THEN 'sunset' END AS light,
      CASE k % 6 WHEN 1 THEN 'file' WHEN 4 THEN 'file' WHEN 5 THEN 'folder' END AS kind,
      CAST(CASE k % 6 WHEN 0 THEN z * 1048576 WHEN 3 THEN z * 1048576 + 524288 WHEN 4 THEN 51380224 END AS BIGINT) AS min_size,
      CAST(CASE k % 6 WHEN 2 THEN z * 1048576 WHEN 5 THEN z * 1048576 END AS BIGINT) AS max_size,
      CAST(CASE k % 6 WHEN 2 THEN 944006400 END AS BIGINT) AS modified_after, CAST(CASE k % 6 WHEN 1 THEN 866419199 END AS BIGINT) AS modified_before FROM sl)
"""


@query("search_log_structuring", _LOG + "SELECT * FROM spec")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return saved_search.structure_search_log(_search_log(cat, sf_dir), "box").drop("box").withColumns(
        {"exts": F.array_join("exts", ","), "tags": F.array_join("tags", ",")})


@query("saved_search_matches", _LOG + f""", want AS (SELECT *, {oracle.tokens('text')} AS t FROM spec),
    ent AS (SELECT e.*, light_phase, {oracle.tokens('e.name')} AS w FROM entries e LEFT JOIN light l ON l.id = e.id),
    tagged AS (SELECT entry_id, list(tag) AS tags FROM entry_tags GROUP BY 1)
    SELECT search_id, count(*) AS hits, CAST(sum(e.id % 1000003) AS BIGINT) AS check_sum FROM want s, ent e LEFT JOIN tagged g ON g.entry_id = e.id
    WHERE (s.exts = '' OR list_contains(string_split(s.exts, ','), e.ext)) AND (s.kind IS NULL OR e.is_folder = (s.kind = 'folder'))
      AND (s.min_size IS NULL OR e.size_logical >= s.min_size) AND (s.max_size IS NULL OR e.size_logical <= s.max_size)
      AND (s.modified_after IS NULL OR e.modified_at >= s.modified_after) AND (s.modified_before IS NULL OR e.modified_at <= s.modified_before)
      AND (s.place IS NULL OR contains(lower(e.gps_place), lower(s.place))) AND (s.light IS NULL OR contains(e.light_phase, s.light))
      AND (s.tags = '' OR list_has_all(g.tags, string_split(s.tags, ',')))
      AND (len(t) < 2 OR list_has_all(w, t[1:len(t) - 1])) AND (len(t) = 0 OR len(list_filter(w, lambda x: starts_with(x, t[-1]))) > 0)
    GROUP BY search_id""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    specs = saved_search.structure_search_log(_search_log(cat, sf_dir), "box")
    return saved_search.total_saved_searches(cat, specs, hits=F.lit(1), check_sum=F.col("id") % 1000003)


@query("import_dates", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_linenumber = 1 THEN NULL
    WHEN l_linenumber = 2 AND epoch(l_shipdate) - 631152000 < 315532800 THEN NULL WHEN l_linenumber = 2 THEN CAST(epoch(l_shipdate) AS BIGINT) - 631152000
    ELSE CAST(epoch(l_shipdate) AS BIGINT) END AS unix, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Catalogue dates counted from 1904, some unknown and some implausibly old."""
    line = F.col("l_linenumber")
    hfs = F.when(line == 1, F.lit(0)).when(line == 2, epoch("l_shipdate") - 631152000 + media.HFS_EPOCH_OFFSET) \
        .otherwise(epoch("l_shipdate") + media.HFS_EPOCH_OFFSET)
    rows = table(cat.spark, sf_dir, "lineitem").select("l_orderkey", line.cast("bigint").alias("line"),
                                                        media.hfs_to_unix(hfs).alias("unix"))
    return rows.groupBy("l_orderkey", "line", "unix").agg(F.count(F.lit(1)).alias("n"))


@query("path_names", """SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS base_name FROM pages""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    return table(cat.spark, sf_dir, "pages").select("page_id", tx.base_name(F.col("url")).alias("base_name"))


@query("year_bounds", """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(epoch(CAST(make_date(year(o_orderdate), 1, 1) AS TIMESTAMP)) AS BIGINT) AS first_second,
    CAST(epoch(CAST(make_date(year(o_orderdate) + 1, 1, 1) AS TIMESTAMP)) AS BIGINT) - 1 AS last_second, count(*) AS orders,
    CAST(sum(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))) AS BIGINT) AS days FROM orders GROUP BY 1, 2, 3""")
def _(cat: Catalog, sf_dir: str) -> DataFrame:
    """Seconds that bound each year of the orders, and the sum of their civil days in seconds."""
    at = F.col("o_orderdate")
    day = media.civil_day(F.year(at), F.month(at), F.day(at)) * 86400
    years = table(cat.spark, sf_dir, "orders").groupBy(F.year(at).alias("y")).agg(F.count(F.lit(1)).alias("orders"), F.sum(day).alias("days"))
    bounds = words.year_bounds(F.col("y"))
    return years.select(F.col("y").cast("bigint").alias("year"), bounds["first"].cast("bigint").alias("first_second"),
                        bounds["last"].cast("bigint").alias("last_second"), "orders", F.col("days").cast("bigint").alias("days"))
