from conftest import BACKUP, SF28, entry_id, rows
from pyspark.sql import functions as F

from drivetrove.operators import compare, gather, tree
from drivetrove.sources import ingest

VACIO = [("VACIO", -1, True, 0)]


def disk(cat, name):
    return cat.disks.filter(F.col("name") == name).first()["id"]


def diff_of(cat, a, b, mode="fast", src_root=None, dst_root=None):
    return compare.compare(tree.rel_index(cat.entries, disk(cat, a), src_root).drop("disk_id"),
                           tree.rel_index(cat.entries, disk(cat, b), dst_root).drop("disk_id"), mode)


def test_compare_ignores_volume_names(load):
    cat = load({"SF28": SF28, "BACKUP": BACKUP})
    diff = diff_of(cat, "SF28", "BACKUP")
    assert rows(diff, "rel_path", "status") == [
        ("CLIP", "same"), ("CLIP/B-ROLL.MOV", "missing"), ("CLIP/C0001.MP4", "mismatch")]
    s = compare.compare_summary(diff).first()
    assert (s["missing_count"], s["missing_bytes"], s["mismatch_count"], s["ok_count"]) == (1, 1000000000, 1, 0)


def test_plan_covers_folders_and_empty_ones(load):
    cat = load({"SF28": SF28, "CONVACIA": [("CONVACIA", -1, True, 0), ("VACIA", 0, True, 0)], "VACIO": VACIO})
    plan = compare.in_copy_order(compare.copy_plan(diff_of(cat, "SF28", "VACIO"))).collect()
    assert [(r["rel_path"], r["size"], r["is_folder"]) for r in plan] == [
        ("CLIP", 0, True), ("CLIP/B-ROLL.MOV", 1000000000, False), ("CLIP/C0001.MP4", 4563402752, False)]
    assert rows(compare.copy_plan(diff_of(cat, "CONVACIA", "VACIO")), "rel_path", "size", "is_folder", "overwrite") == [
        ("VACIA", 0, True, False)]


def test_type_collision_is_a_conflict(load):
    cat = load({"SF28": SF28, "CLASH": [("CLASH", -1, True, 0), ("CLIP", 0, False, 42)]})
    diff = diff_of(cat, "SF28", "CLASH")
    assert compare.compare_summary(diff).first()["conflict_count"] == 1
    assert rows(compare.copy_plan(diff, include_mismatch=True), "rel_path") == [("CLIP/B-ROLL.MOV",), ("CLIP/C0001.MP4",)]


def test_scoped_comparison(load):
    cat = load({"SF28": SF28, "BACKUP": BACKUP})
    diff = diff_of(cat, "SF28", "BACKUP", src_root=entry_id(cat, "/SF28/CLIP"), dst_root=entry_id(cat, "/BACKUP/CLIP"))
    assert rows(diff, "rel_path", "status") == [("B-ROLL.MOV", "missing"), ("C0001.MP4", "mismatch")]


def test_deep_against_fast(load):
    cat = load({
        "SRC": [("SRC", -1, True, 0), ("DCIM", 0, True, 0), ("A.mov", 1, False, 100), ("B.mov", 1, False, 200), ("C.mov", 1, False, 50)],
        "DST": [("DST", -1, True, 0), ("DCIM", 0, True, 0), ("A.mov", 1, False, 100), ("C.mov", 1, False, 50)]})
    hashes = F.when(F.col("path") == "/SRC/DCIM/A.mov", "h1").when(F.col("path") == "/DST/DCIM/A.mov", "h2") \
        .when(F.col("name") == "B.mov", "h3")
    cat = cat.replacing(entries=cat.entries.withColumn("content_hash", hashes).withColumn("hash_algo", F.lit("x")))
    assert rows(diff_of(cat, "SRC", "DST"), "rel_path", "status") == [
        ("DCIM", "same"), ("DCIM/A.mov", "same"), ("DCIM/B.mov", "missing"), ("DCIM/C.mov", "same")]
    deep = diff_of(cat, "SRC", "DST", "deep")
    assert rows(deep, "rel_path", "status") == [
        ("DCIM", "same"), ("DCIM/A.mov", "mismatch"), ("DCIM/B.mov", "missing"), ("DCIM/C.mov", "unverified")]
    assert rows(compare.copy_plan(deep, include_mismatch=True), "rel_path", "overwrite") == [
        ("DCIM/A.mov", True), ("DCIM/B.mov", False)]
    unlike = cat.replacing(entries=cat.entries.withColumn("hash_algo", F.concat(F.lit("a"), "disk_id")))
    assert ("DCIM/A.mov", "unverified") in rows(diff_of(unlike, "SRC", "DST", "deep"), "rel_path", "status")


def test_missing_tree_and_prefixes(spark, load):
    cat = load({"SRC": [("SRC", -1, True, 0), ("NOA", 0, True, 0), ("CLIP", 1, True, 0), ("a.mp4", 2, False, 100),
                        ("b.mp4", 2, False, 50), ("NOA2", 0, True, 0), ("c.mp4", 5, False, 7), ("d.mp4", 0, False, 1)],
                "DST": [("DST", -1, True, 0)]})
    diff = diff_of(cat, "SRC", "DST")
    assert rows(compare.missing_tree(diff), "rel_path", "files", "bytes") == [
        ("", 4, 158), ("NOA", 2, 150), ("NOA/CLIP", 2, 150), ("NOA2", 1, 7)]
    for prefixes in (["NOA"], spark.createDataFrame([("NOA",)], "prefix string")):
        assert rows(compare.copy_plan(diff, prefixes=prefixes), "rel_path") == [
            ("NOA",), ("NOA/CLIP",), ("NOA/CLIP/a.mp4",), ("NOA/CLIP/b.mp4",)]
    assert compare.copy_plan(diff, prefixes=[""]).count() == compare.copy_plan(diff).count() == 7
    levels = rows(tree.tree_levels(compare.missing_tree(diff)), "rel_path", "parent_path", "name", "depth")
    assert levels == [("NOA", "", "NOA", 1), ("NOA/CLIP", "NOA", "CLIP", 2), ("NOA2", "", "NOA2", 1)]


def test_lists_are_sorted_then_cut(load):
    cat = load({"SF28": SF28, "VACIO": VACIO})
    cut = compare.diff_list(diff_of(cat, "SF28", "VACIO"), "missing", 2).collect()
    assert [(r["rel_path"], r["truncated"]) for r in cut] == [("CLIP", True), ("CLIP/B-ROLL.MOV", True)]


def test_register_copied_closes_the_gap(load):
    cat = load({"SRC": [("SRC", -1, True, 0), ("NOA", 0, True, 0), ("CLIP", 1, True, 0), ("a.mp4", 2, False, 100),
                        ("b.mp4", 2, False, 50)], "DST": [("DST", -1, True, 0)]})
    target = disk(cat, "DST")
    copied = compare.copy_plan(diff_of(cat, "SRC", "DST")).withColumn("disk_id", F.lit(target).cast("bigint"))
    after, inserted = ingest.register_copied(cat, copied)
    assert inserted.count() == 2
    assert compare.copy_plan(diff_of(after, "SRC", "DST")).isEmpty()
    assert rows(after.disks.filter("name = 'DST'"), "file_count", "folder_count", "total_size") == [(2, 3, 150)]
    assert rows(after.entries.filter(F.col("disk_id") == target), "path", "size_logical") == [
        ("/DST", 150), ("/DST/NOA", 150), ("/DST/NOA/CLIP", 150), ("/DST/NOA/CLIP/a.mp4", 100), ("/DST/NOA/CLIP/b.mp4", 50)]
    again, none = ingest.register_copied(after, copied.withColumn("size", F.col("size") * 2))
    assert none.isEmpty()
    assert rows(again.disks.filter("name = 'DST'"), "total_size") == [(300,)]
    assert again.name_postings.filter("token = 'a'").count() == 2


def test_gather(spark, load):
    cat = load({"SF28": SF28, "SF99": [("SF99", -1, True, 0), *SF28[1:]]})
    cat = cat.replacing(disks=cat.disks.withColumn("is_online", F.col("name") == "SF99").withColumn(
        "mount_path", F.when(F.col("name") == "SF99", "/Volumes/SF99")))
    chosen = [(entry_id(cat, p),) for p in ("/SF28/CLIP/C0001.MP4", "/SF28/CLIP", "/SF99/CLIP/C0001.MP4", "/SF99/CLIP")]
    groups, files, totals = gather.gather_plan(cat, spark.createDataFrame(chosen, "id bigint"))
    assert [(g["disk_name"], g["total"], g["total_bytes"]) for g in groups.collect()] == [
        ("SF99", 2, 5563402752), ("SF28", 2, 5563402752)]
    assert totals.first().asDict() == {"total_files": 4, "total_bytes": 11126805504, "expanded_folders": 2}
    targets = rows(gather.gather_targets(files, "/dst"), "source", "target", "error")
    assert ("/Volumes/SF99/CLIP/C0001.MP4", "/dst/SF99/CLIP/C0001.MP4", None) in targets
    assert (None, None, "disk offline: SF28") in targets
    assert not gather.gather_plan(cat, spark.createDataFrame([], "id bigint"))[2].first()["expanded_folders"]


def test_list_reads_the_comparison_once(spark):
    diff = spark.createDataFrame([(f"p{i}", "mismatch", i) for i in range(5)], "rel_path string, status string, src_entry_id bigint")
    for limit, cut in ((4, True), (5, False), (6, False)):
        page = compare.diff_list(diff, "mismatch", limit)
        assert [(r["rel_path"], r["truncated"]) for r in page.collect()] == [(f"p{i}", cut) for i in range(min(limit, 5))]
        assert page.columns == [*diff.columns, "truncated"]
        assert "subquery" not in page._jdf.queryExecution().optimizedPlan().toString()
    assert compare.diff_list(diff, "extra", 3).isEmpty()
