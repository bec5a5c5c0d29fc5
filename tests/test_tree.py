import random

from conftest import BACKUP, SF28, entry_id, rows
from pyspark.sql import functions as F

from drivetrove.operators import compare, tree
from drivetrove.session import materialize, skew_join


def test_paths_sizes_and_totals(load):
    cat = load({"SF28": SF28})
    assert rows(cat.entries, "path", "size_logical", "size_physical") == [
        ("/SF28", 5563402752, 5563407872), ("/SF28/CLIP", 5563402752, 5563407872),
        ("/SF28/CLIP/B-ROLL.MOV", 1000000000, 1000001024), ("/SF28/CLIP/C0001.MP4", 4563402752, 4563406848)]
    disk = cat.disks.first()
    assert (disk["total_size"], disk["file_count"], disk["folder_count"]) == (5563402752, 2, 2)
    assert (disk["kind"], disk["is_online"]) == ("archive", False)
    clip = cat.entries.filter("name = 'C0001.MP4'").first()
    assert (clip["ext"], clip["created_at"], clip["rel_path"], clip["depth"]) == ("mp4", 1685577600, "CLIP/C0001.MP4", 2)
    assert cat.entries.filter("is_folder AND ext IS NOT NULL").isEmpty()
    assert cat.entries.filter("created_at = 0").isEmpty()


def test_children_skip_the_volume(load):
    cat = load({"SF28": SF28})
    top = tree.list_children(cat.entries, 1).collect()
    assert [(r["name"], r["child_count"]) for r in top] == [("CLIP", 2)]
    inside = tree.list_children(cat.entries, 1, top[0]["id"]).collect()
    assert [r["name"] for r in inside] == ["B-ROLL.MOV", "C0001.MP4"]


def test_children_of_many_roots(load):
    cat = load({"X": [("a", -1, True, 0), ("B", -1, True, 0), ("c.txt", 0, False, 1)]})
    assert [r["name"] for r in tree.list_children(cat.entries, 1).collect()] == ["a", "B"]


def test_deep_random_tree_matches_walking(spark):
    rng = random.Random(7)
    parent = {0: None}
    for i in range(1, 400):
        parent[i] = i - 1 if i < 60 else rng.randrange(i)
    data = [(i, 1, p, f"n{i}", i < 300, 1) for i, p in parent.items()]
    shuffled = rng.sample(data, len(data))
    df = spark.createDataFrame(shuffled, "id bigint, disk_id bigint, parent_id bigint, name string, is_folder boolean, size_logical bigint")

    def walk(i):
        return [] if i is None else walk(parent[i]) + [i]

    got = {r["id"]: (r["path"], r["ancestor_ids"], r["depth"]) for r in tree.with_paths(df).collect()}
    for i in parent:
        chain = walk(i)
        assert got[i] == ("/" + "/".join(f"n{c}" for c in chain), chain[:-1], len(chain) - 1)


def test_cycles_are_kept_apart(spark):
    data = [(1, 1, None, "v", True), (2, 1, 3, "a", True), (3, 1, 2, "b", True), (4, 1, 3, "f", False), (5, 1, 1, "ok", False)]
    df = spark.createDataFrame(data, "id bigint, disk_id bigint, parent_id bigint, name string, is_folder boolean")
    out = tree.with_paths(df)
    assert rows(tree.cyclic(out), "id") == [(2,), (3,), (4,)]
    assert rows(out.filter("path IS NOT NULL"), "path") == [("/v",), ("/v/ok",)]


def test_noise_and_relative_index(load):
    cat = load({"SRC": [
        ("SRC", -1, True, 0), ("CLIP", 0, True, 0), ("real.mp4", 1, False, 100), (".DS_Store", 1, False, 6),
        ("._real.mp4", 1, False, 4), (".Spotlight-V100", 0, True, 0), ("indice.db", 3, False, 999)]})
    assert rows(tree.rel_index(cat.entries), "rel_path") == [("CLIP",), ("CLIP/real.mp4",)]
    clip = entry_id(cat, "/SRC/CLIP")
    assert rows(tree.rel_index(cat.entries, 1, clip), "rel_path") == [("real.mp4",)]


def test_subtree_and_expansion(spark, load):
    cat = load({"SF28": SF28, "SF99": [("SF99", -1, True, 0), *SF28[1:]]})
    ids = spark.createDataFrame([(entry_id(cat, "/SF28/CLIP"),), (entry_id(cat, "/SF28/CLIP/C0001.MP4"),), (987654,)], "id bigint")
    files, folders = tree.expand_to_files(cat.entries, ids)
    assert rows(files, "path") == [("/SF28/CLIP/B-ROLL.MOV",), ("/SF28/CLIP/C0001.MP4",)]
    assert folders.count() == 1
    assert rows(tree.subtree(cat.entries, ids), "name") == [("B-ROLL.MOV",), ("C0001.MP4",), ("CLIP",)]


def test_minimal_cover(spark):
    df = spark.createDataFrame([(p,) for p in ("NOA", "NOA/x", "NOA2", "a/b/c", "a/b", "a/b/c/d")], "path string")
    assert rows(tree.minimal_cover(df), "path") == [("NOA",), ("NOA2",), ("a/b",)]
    assert rows(tree.minimal_cover(df.union(spark.createDataFrame([("",)], "path string"))), "path") == [("",)]


def test_tree_from_paths(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("a/b/d.txt",), ("e",)], "p string")
    out = tree.tree_from_paths(df, "p")
    up = out.select(F.col("id").alias("parent_id"), F.col("path").alias("up"))
    assert rows(out.join(up, "parent_id", "left"), "path", "is_folder", "up") == [
        ("a", True, None), ("a/b", True, "a"), ("a/b/c.txt", False, "a/b"), ("a/b/d.txt", False, "a/b"), ("e", False, None)]


def test_skew_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None)
                                    .otherwise(F.col("id") % 40).alias("k"))
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = skew_join(left, right, "k", how, spread=F.col("v"), hot_rows=100)
            plain = left.join(right, "k", how)
            assert rows(got, *sorted(got.columns)) == rows(plain, *sorted(plain.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rollup_of_backup(load):
    cat = load({"SF28": SF28, "BACKUP": BACKUP})
    assert rows(cat.disks, "name", "total_size") == [("BACKUP", 1000000), ("SF28", 5563402752)]


def test_paths_and_sizes_at_once(spark):
    """Roots, deep and empty folders, a file as parent, a missing parent, a cycle and what hangs below it."""
    rows = [(1, None, "V", True, 7), (2, 1, "A", True, None), (3, 2, "B", True, 5), (4, 3, "f", False, 10), (5, 1, "g", False, 20), (6, 4, "in", False, 3),
            (7, 1, "empty", True, 9), (8, 99, "lost", True, 1), (9, 8, "h", False, 4), (10, 11, "x", True, 0), (11, 10, "y", True, 0), (12, 11, "z", False, 8)]
    nodes = spark.createDataFrame([(1, *r, r[-1]) for r in rows], "disk_id long, id long, parent_id long, name string, is_folder boolean, size_logical long, size_physical long")
    got, want = tree.with_paths_and_sizes(nodes), tree.folder_rollup(tree.with_paths(nodes))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r["id"]: r["size_logical"] for r in got.filter("is_folder").collect()} == {1: 33, 2: 13, 3: 13, 7: 0, 8: 4, 10: 0, 11: 0}


def test_unasked_columns_are_not_shuffled(spark):
    rows = [(1, 1, "A/x", "/V/A/x", False, 5, "h1", "md5"), (2, 1, "A/x", "/V/A/x", False, 6, None, None), (3, 1, "B", "/V/B", True, 0, None, None)]
    entries = spark.createDataFrame(rows, "id long, disk_id long, rel_path string, path string, is_folder boolean, size_logical long, content_hash string, hash_algo string")
    index = tree.rel_index(entries)
    assert sorted(index.collect()) == [(1, "A/x", False, 6, 2, None, None), (1, "B", True, 0, 3, None, None)]
    plan = compare.compare(index, index)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(content_hash" not in plan and "max_by(size_logical" in plan


def test_hot_keys_are_found_by_hash_first(spark):
    left = spark.range(400).select("id", (F.col("id") % 20).alias("k")).unionByName(spark.range(400, 1000).select("id", F.lit(7).cast("long").alias("k")))
    left = left.unionByName(spark.range(1000, 1100).select("id", F.lit(None).cast("long").alias("k")))
    right = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = skew_join(left, right, "k", how, spread=F.col("id"), hot_rows=50)
            assert sorted(map(repr, joined.collect())) == sorted(map(repr, left.join(right, "k", how).select(joined.columns).collect())), how
        plan = skew_join(left, right, "k", "left", spread=F.col("id"), hot_rows=50)._jdf.queryExecution().optimizedPlan().toString()
        assert "_bucket" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_leaves_and_holders_of_any_depth(spark):
    deep = [(i, i - 1 if i else None, f"f{i}", True) for i in range(12)]
    nodes = spark.createDataFrame([*deep, (50, 11, "leaf", True), (51, 50, "file", False), (60, 99, "lost", True), (61, 60, "x", False), (70, 51, "odd", False)],
                                  "id bigint, parent_id bigint, name string, is_folder boolean")
    got = {r["id"]: (r["path"], r["ancestor_ids"]) for r in tree.with_paths(nodes).collect()}
    start = "/" + "/".join(f"f{i}" for i in range(12))
    assert got[51] == (f"{start}/leaf/file", [*range(12), 50])
    assert got[70] == (f"{start}/leaf/file/odd", [*range(12), 50, 51])
    assert got[60] == ("/lost", []) and got[61] == ("/lost/x", [60])


def test_relative_index_moves_rows_before_it_counts(spark):
    rows_ = [(i, 1, f"a/{i % 3}", f"/v/a/{i % 3}", False, i, f"h{i}", "md5") for i in range(9)]
    entries = spark.createDataFrame(rows_, "id bigint, disk_id bigint, rel_path string, path string, is_folder boolean, size_logical bigint, content_hash string, hash_algo string")
    index = tree.rel_index(entries)
    assert rows(index, "rel_path", "entry_id", "size", "content_hash") == [("a/0", 6, 6, "h6"), ("a/1", 7, 7, "h7"), ("a/2", 8, 8, "h8")]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") < plan.index("Exchange")  # counted above the only shuffle
    assert plan.count("Exchange hashpartitioning") == 1


def test_disks_and_transcripts_need_no_closed_trees(spark):
    from drivetrove.plans.demo import demo_catalog, is_built
    cat = demo_catalog(spark, "/root/testdata/sf0.001/")
    assert cat.disks.count() == 25 and not cat["text_postings"].isEmpty()
    assert not any(is_built(cat, name) for name in ("entries", "planned_entries", "nodes"))


def test_rows_move_once_to_their_chains(spark):
    nodes = spark.createDataFrame([(1, None, "v", True, 0), (2, 1, "a", True, 0), (3, 2, "x", False, 5), (4, 3, "odd", False, 7)],
                                  "id bigint, parent_id bigint, name string, is_folder boolean, size_logical bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        closed = tree.with_paths_and_sizes(nodes.withColumn("size_physical", F.col("size_logical")))
        plan = closed._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "_bucket" not in plan  # parents were counted before, so no pass looks for hot ones
    assert rows(closed, "id", "path", "rel_path", "size_logical") == [
        (1, "/v", None, 12), (2, "/v/a", "a", 12), (3, "/v/a/x", "a/x", 5), (4, "/v/a/x/odd", "a/x/odd", 7)]


def test_shuffle_files_go_with_the_step(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {every.apply(i).getName() for i in range(every.size())}

    before = files()
    step = materialize(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert not [name for name in files() - before if name.startswith("shuffle_")]
    assert step.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_cover_reads_its_paths_once(spark):
    paths = spark.createDataFrame([(1, "a"), (1, "a/b"), (1, "c/d"), (2, "a/b"), (2, "a/b"), (3, ""), (3, "x")], "k int, path string")
    cover = tree.minimal_cover(paths, ("k",))
    assert rows(cover, "k", "path") == [(1, "a"), (1, "c/d"), (2, "a/b"), (3, "")]
    plan = cover._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan  # only stored steps are read


def test_subtrees_are_decided_by_ids(spark, load):
    cat = load({"SF28": SF28})
    clip, clip_id = cat.entries, entry_id(cat, "/SF28/CLIP")
    found = tree.subtree(clip, spark.createDataFrame([(clip_id,), (clip_id,)], "id bigint"))
    assert rows(found, "path") == [("/SF28/CLIP",), ("/SF28/CLIP/B-ROLL.MOV",), ("/SF28/CLIP/C0001.MP4",)]
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()  # whole rows meet the chosen ids only
