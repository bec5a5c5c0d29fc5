import os

import pytest
from conftest import BACKUP, SF28, entry_id, rows, typed
from pyspark.sql import functions as F

from drivetrove import Catalog
from drivetrove.catalog import CommitConflict, commits, load_catalog, vacuum
from drivetrove.operators import search, tags
from drivetrove.session import number_rows
from drivetrove.sources import ingest


def volumes(spark, *items):
    data = [(name, uuid, "external", 10**12, f"/Volumes/{name}", 1700000000) for name, uuid in items]
    return spark.createDataFrame(data, "name string, volume_uuid string, kind string, capacity bigint, mount_path string, scanned_at bigint")


def test_rescan_adopts_and_replaces(spark, load, nodes):
    cat = load({"SF28": SF28, "BACKUP": BACKUP})
    scanned, report = ingest.rescan_replace(cat, nodes({"SF28": SF28}), volumes(spark, ("SF28", "U1")))
    assert rows(report, "entries", "files", "folders", "replaced") == [(4, 2, 2, True)]
    assert rows(scanned.disks, "name", "volume_uuid", "is_online") == [("BACKUP", None, False), ("SF28", "U1", True)]
    # another volume with the same name but its own uuid stays separate
    other, report = ingest.rescan_replace(scanned, nodes({"SF28": SF28[:2]}), volumes(spark, ("SF28", "U2")))
    assert rows(report, "replaced") == [(False,)]
    assert rows(other.disks, "name", "volume_uuid") == [("BACKUP", None), ("SF28", "U1"), ("SF28", "U2")]
    # the index follows
    assert rows(search.search_names(other, "c0001"), "name", "disk_name") == [("C0001.MP4", "BACKUP"), ("C0001.MP4", "SF28")]
    latest = ingest.latest_disk(other, volume_uuid="U2")
    assert rows(latest, "name") == [("CLIP",), ("SF28",)]
    assert ingest.latest_disk(other, name="SF28").isEmpty()


def test_rescan_keeps_enrichment_of_unchanged_files(spark, load, nodes):
    cat = load({"SF28": SF28})
    known = F.col("name") == "C0001.MP4"
    cat = cat.replacing(entries=cat.entries.withColumns({
        "content_hash": F.when(known, "abc"), "hashed_at": F.when(known, F.lit(5).cast("bigint")),
        "camera_make": F.when(F.col("name") == "B-ROLL.MOV", "Sony"), "gps_place": F.when(known, "Jujuy")}))
    same, _ = ingest.rescan_replace(cat, nodes({"SF28": SF28}), volumes(spark, ("SF28", None)))
    assert rows(same.entries.filter("name LIKE 'C0%'"), "content_hash", "hashed_at", "gps_place") == [("abc", 5, "Jujuy")]
    # B-ROLL has no known modification time, so nothing is carried over
    assert rows(same.entries.filter("name LIKE 'B%'"), "camera_make") == [(None,)]
    grown = [*SF28[:2], ("C0001.MP4", 1, False, 1, 1, 0, 1685581200)]
    changed, _ = ingest.rescan_replace(cat, nodes({"SF28": grown}), volumes(spark, ("SF28", None)))
    assert rows(changed.entries.filter("name LIKE 'C0%'"), "content_hash", "gps_place") == [(None, None)]


def test_rescan_drops_derived_rows(spark, load, nodes):
    cat = load({"SF28": SF28})
    clip = entry_id(cat, "/SF28/CLIP/C0001.MP4")
    cat = tags.add_tags(cat, spark.createDataFrame([(clip, "Boda")], "entry_id bigint, tag string"))
    cat = cat.replacing(embeddings=typed(spark, "embeddings", [(clip, "m", [1.0])], ["entry_id", "model", "vec"]))
    after, _ = ingest.rescan_replace(cat, nodes({"SF28": SF28}), volumes(spark, ("SF28", None)))
    assert after.entry_tags.isEmpty() and after["embeddings"].isEmpty()


def test_merge_import(load, nodes):
    cat = load({"SF28": SF28})
    new = nodes({"SF28": SF28[:2], "BACKUP": BACKUP})
    assert rows(ingest.merge_import(cat, new).disks, "name", "file_count") == [("BACKUP", 1), ("SF28", 2)]
    assert rows(ingest.merge_import(cat, new, replace=True).disks, "name", "file_count") == [("BACKUP", 1), ("SF28", 0)]


def test_delete(spark, load):
    cat = load({"SF28": SF28, "BACKUP": BACKUP})
    clip = entry_id(cat, "/SF28/CLIP/C0001.MP4")
    cat = tags.add_tags(cat, spark.createDataFrame([(clip, "x")], "entry_id bigint, tag string"))
    one = ingest.delete_subtrees(cat, spark.createDataFrame([(clip,)], "id bigint"))
    assert rows(one.entries.filter("disk_id = 2"), "path", "size_logical") == [
        ("/SF28", 1000000000), ("/SF28/CLIP", 1000000000), ("/SF28/CLIP/B-ROLL.MOV", 1000000000)]
    assert one.entry_tags.isEmpty()
    assert search.search_names(one, "c0001").count() == 1
    whole = ingest.delete_subtrees(cat, spark.createDataFrame([(entry_id(cat, "/SF28/CLIP"),)], "id bigint"))
    assert rows(whole.disks, "name", "file_count", "folder_count", "total_size") == [("BACKUP", 1, 2, 1000000), ("SF28", 0, 1, 0)]
    gone = ingest.delete_disk(cat, 2)
    assert rows(gone.disks, "name") == [("BACKUP",)] and gone.entries.count() == 3


def test_incremental_splice(spark):
    schema = "disk_id bigint, rel_path string, name string, is_folder boolean, size_logical bigint, size_physical bigint, created_at bigint, modified_at bigint"

    def row(path, folder, size=0, modified=1):
        return (1, path, path.split("/")[-1] if path else "V", folder, size, size, None, modified)

    old = spark.createDataFrame([row(None, True), row("A", True), row("A/a.txt", False, 10), row("B", True, modified=9),
                                 row("B/b.txt", False, 20), row("A/S", True), row("A/S/s.txt", False, 3)], schema)
    fresh = spark.createDataFrame([row(None, True), row("A", True), row("A/a.txt", False, 99), row("B", True), row("B/b.txt", False, 21),
                                   row("C", True), row("C/c.txt", False, 30)], schema)
    out, reused = ingest.incremental_splice(old, fresh, ("disk_id",))
    assert rows(out, "rel_path", "size_logical") == [
        ("A", 0), ("A/S", 0), ("A/S/s.txt", 3), ("A/a.txt", 10), ("B", 0), ("B/b.txt", 21), ("C", 0), ("C/c.txt", 30), (None, 0)]
    assert rows(reused, "rel_path") == [("A",)]
    full, none = ingest.incremental_splice(old, fresh, ("disk_id",), force_full=True)
    assert none.isEmpty() and rows(full, "rel_path", "size_logical") == rows(fresh, "rel_path", "size_logical")


def test_old_files_open_with_new_columns(spark, tmp_path, load):
    cat = load({"SF28": SF28})
    cat.entries.select("id", "disk_id", "parent_id", "name", "is_folder").write.parquet(f"{tmp_path}/entries")
    opened = load_catalog(spark, str(tmp_path))
    assert opened.entries.filter("gps_place IS NOT NULL OR path IS NOT NULL").isEmpty()
    assert opened.entries.count() == 4 and opened.thumbnails.isEmpty()


def test_save_and_load(spark, tmp_path, load):
    cat = load({"SF28": SF28, "BACKUP": BACKUP})
    Catalog(spark, {"disks": cat.disks, "entries": cat.entries, "name_postings": cat.name_postings}).save(str(tmp_path))
    opened = load_catalog(spark, str(tmp_path))
    assert rows(opened.entries, "path", "size_logical") == rows(cat.entries, "path", "size_logical")
    assert rows(opened.name_postings, "token", "entry_id") == rows(cat.name_postings, "token", "entry_id")


def test_annotations_and_keyed_replace(spark, load):
    cat = load({"SF28": SF28})
    updates = spark.createDataFrame([(1, "shelf 3", None)], "id bigint, location string, comment string")
    marked = ingest.apply_annotations(cat.disks.withColumn("comment", F.lit("old")), updates, ["location", "comment"])
    assert rows(marked, "location", "comment") == [("shelf 3", None)]
    old = typed(spark, "embeddings", [(1, "m", 0.0), (1, "n", 0.0), (2, "m", 0.0)], ["entry_id", "model", "frame_ts"])
    left = ingest.clear_embeddings(cat.replacing(embeddings=old), "m", spark.createDataFrame([(1,)], "entry_id bigint"))
    assert rows(left.embeddings, "entry_id", "model") == [(1, "n"), (2, "m")]


def test_edits_survive_in_place(spark, load, nodes, tmp_path):
    root = str(tmp_path)
    load({"SF28": SF28, "BACKUP": BACKUP}).save(root)
    cat = load_catalog(spark, root)
    assert rows(search.search_names(cat, "c0001"), "disk_name") == [("BACKUP",), ("SF28",)]
    gone = cat.disks.filter("name = 'BACKUP'").first()["id"]
    before = cat.entries
    ingest.delete_disk(cat, gone).save(root)
    after = load_catalog(spark, root)
    assert rows(after.disks, "name") == [("SF28",)] and after.entries.filter(F.col("disk_id") == gone).isEmpty()
    assert rows(search.search_advanced(after, {"text": "c0001"}), "name", "disk_name") == [("C0001.MP4", "SF28")]
    assert before.filter(F.col("disk_id") == gone).count() > 0  # readers of the version before go on
    ingest.rescan_replace(after, nodes({"SF28": SF28[:3]}), volumes(spark, ("SF28", "U1")))[0].save(root)
    again = load_catalog(spark, root)
    assert rows(again.disks, "name", "file_count") == [("SF28", 1)] and rows(again.name_stats, "n_docs") == [(3,)]
    assert rows(search.search_names(again, "roll"), "name") == []
    # a table that did not change keeps its files
    again.replacing(disks=again.disks).save(root)
    kept = load_catalog(spark, root)
    assert kept._stored["entries"] == again._stored["entries"] and kept._stored["disks"] != again._stored["disks"]


def test_unknown_table(spark):
    with pytest.raises(KeyError, match="no table 'nothing'"):
        Catalog(spark, {})["nothing"]


def test_two_writers(spark, load, tmp_path):
    root = str(tmp_path / "shared")
    load({"SF28": SF28, "BACKUP": BACKUP}).save(root)
    tag = typed(spark, "entry_tags", [(1, "a")], ["entry_id", "tag"])
    note = typed(spark, "transcripts", [(1, "m", "es", "hola")], ["entry_id", "model", "lang", "text"])
    first, second, third = (load_catalog(spark, root) for _ in range(3))
    first.replacing(entry_tags=tag).save(root)
    second.replacing(transcripts=note).save(root)  # other tables: both changes stay
    now = load_catalog(spark, root)
    assert now.entry_tags.count() == 1 and now.transcripts.count() == 1 and now.entries.count() == 7
    with pytest.raises(CommitConflict):
        third.replacing(entry_tags=tag.limit(0)).save(root)
    with pytest.raises(CommitConflict):
        ingest.delete_disk(third, third.disks.first()["id"]).save(root)
    assert load_catalog(spark, root).entry_tags.count() == 1
    dead = tmp_path / "shared" / "commits" / f"{4:020d}.json"  # a writer that died
    dead.write_text("")
    os.utime(dead, (1, 1))
    assert load_catalog(spark, root).transcripts.count() == 1
    ingest.delete_disk(now, now.disks.first()["id"]).save(root)
    before = {c.version for c in commits(spark, root)}
    assert not vacuum(spark, root)  # all young
    assert vacuum(spark, root, older_than_seconds=-1)
    assert len(commits(spark, root)) == 1 < len(before)
    assert load_catalog(spark, root).entries.count() < 7 and not vacuum(spark, root, older_than_seconds=-1)


def test_facts_of_transcripts_follow_deletes(spark, load):
    cat = load({"SF28": SF28})
    clip = entry_id(cat, "/SF28/CLIP/C0001.MP4")
    other = entry_id(cat, "/SF28/CLIP/B-ROLL.MOV")
    both = typed(spark, "transcripts", [(clip, "m", "es", "hola que tal"), (other, "m", "es", "adios")], ["entry_id", "model", "lang", "text"])
    cat = ingest.upsert_transcripts(cat, both)
    left = ingest.delete_subtrees(cat, spark.createDataFrame([(clip,)], "id bigint"))
    assert rows(left["text_stats"], "n_docs", "n_words") == [(1, 1)]
    assert rows(left["name_stats"], "n_docs") == [(3,)]


def test_numbers_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r["n"] for r in number_rows(spark.range(3000).select((-F.col("id")).alias("x")), "x").orderBy("x").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == list(range(1, 3001))


def test_deletes_build_only_the_tables_that_are_asked_for(spark, load):
    def never():
        raise AssertionError("nobody asked for this table")

    cat = load({"SF28": SF28, "BACKUP": BACKUP})
    watched = cat.replacing(name_postings=never, name_terms=never, name_stats=never, text_postings=never, thumbnails=never)
    disk = cat.disks.filter("name = 'BACKUP'").first()["id"]
    left = ingest.drop_disks(watched, cat.disks.filter("name = 'BACKUP'").select("id"))
    assert {r["disk_id"] for r in left.entries.collect()} == {r["id"] for r in cat.disks.collect()} - {disk}
    clip = entry_id(cat, "/SF28/CLIP")
    less = ingest.delete_subtrees(watched, spark.createDataFrame([(clip,)], "id bigint"))
    assert less.entries.count() == cat.entries.count() - 3
    assert ingest.drop_disks(cat, cat.disks.filter("name = 'BACKUP'").select("id")).name_postings.filter(F.col("disk_id") == disk).isEmpty()


def test_copied_items_are_read_once(spark, load):
    cat = load({"BACKUP": BACKUP})
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            read.add(batch.num_rows)
            yield batch

    items = spark.createDataFrame([(1, "CLIP/new.mov", 5, False)], "disk_id long, rel_path string, size long, is_folder boolean")
    after, inserted = ingest.register_copied(cat, items.mapInArrow(count, items.schema))
    assert rows(inserted, "rel_path", "size_logical") == [("CLIP/new.mov", 5)] and read.value == 1


def test_numbered_disks_are_stored(spark, nodes):
    trees = nodes({"A": SF28, "B": BACKUP})
    disks = trees.select(F.col("disk_name").alias("name")).distinct()
    numbered, placed = ingest.number_trees(trees, disks, 1, 1)
    assert numbered.step_path and rows(numbered, "name", "disk_id", "base") == [("A", 1, 1), ("B", 2, 5)]
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().executedPlan().toString()


def test_splice_reads_both_trees_once(spark):
    schema = "rel_path string, name string, is_folder boolean, size_logical long, size_physical long, created_at long, modified_at long"
    old = spark.createDataFrame([("A", "A", True, 0, 0, 0, 5), ("A/x", "x", False, 1, 1, 0, 7), ("B", "B", True, 0, 0, 0, 5)], schema)
    new = spark.createDataFrame([(None, "V", True, 0, 0, 0, 0), ("A", "A", True, 0, 0, 0, 5), ("A/x", "x", False, 9, 9, 0, 7), ("B", "B", True, 0, 0, 0, 6)], schema)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    spliced, top = ingest.incremental_splice(old.mapInArrow(count, old.schema), new.mapInArrow(count, new.schema))
    assert rows(spliced, "rel_path", "size_logical") == [("A", 0), ("A/x", 1), ("B", 0), (None, 0)]
    assert rows(top, "rel_path") == [("A",)] and read.value == 7
