import hashlib
from datetime import UTC, datetime
import json
import os
import zipfile

import pytest
from conftest import rows, typed
from pyspark.sql import functions as F

from drivetrove import Catalog
from drivetrove.catalog import commits, last_commit
from drivetrove.functions import media, solar, text as tx, words
from drivetrove.operators import enrich, search, status
from drivetrove.sources import files, probes, sinks
from drivetrove.streaming.presence import presence_batch, presence_changes
from drivetrove.streaming.runs import Runs
from drivetrove.streaming.sinks import index_sink, online_now, online_status_sink, read_index


def values(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_text_expressions(spark):
    assert values(spark, tx.extension, ["a.MP4", "noext", "dot.", ".hidden", "a.b/c", "x." + "y" * 33, "x." + "é" * 17]) == [
        "mp4", None, None, "hidden", None, None, None]
    assert values(spark, tx.tokens, ["Canción_final-v2 ÑANDÚ", ""]) == [["cancion", "final", "v2", "nandu"], []]
    assert values(spark, tx.base_name, ["a/b/", "x", "/"]) == ["b", "x", None]


def test_media_expressions(spark):
    assert values(spark, media.frame_rate, ["30000/1001", "25/1", "25", "0/0", "x", "3/x"]) == [30000 / 1001, 25.0, 25.0, 0.0, 0.0, 0.0]
    got = values(spark, media.iso6709, ["+34.0522-118.2437/", "-24.1858-065.2995+1259.000/", "+34.05", "garbage", "+95.0+010.0/"])
    assert [None if g is None else tuple(g) for g in got] == [(34.0522, -118.2437), (-24.1858, -65.2995), None, None, None]
    assert values(spark, media.iso8601_unix, ["1970-01-01T00:00:00.000000Z", "2023-06-01T00:00:00", "2023-06-01 12:30", "nope", "2023-13-01T00:00:00"]) == [
        0, 1685577600, 1685622600, None, None]
    assert values(spark, media.hfs_to_unix, [0, 2082844800, 2082844800 + 1685577600], "bigint") == [None, None, 1685577600]
    assert values(spark, lambda c: media.strip_times(c, 3), [4000, 0], "bigint") == [[1.0, 2.0, 3.0], [0.0]]
    assert values(spark, words.size_bytes, ["1gb", "500mb", "2", "1.5gb", "1,5kb", "big", " 7 MB ", "1.", ".5gb", "1.2.3", "3xb", ""]) == [
        2**30, 500 * 2**20, 2, 3 * 2**29, 1536, None, 7 * 2**20, None, None, None, None, None]
    assert values(spark, words.day_unix, ["2023-01-01", "01/01/2023", "2023-02-30", "2023-1-1", "1969-12-31"]) == [1672531200, None, None, None, -86400]
    assert tuple(values(spark, words.year_bounds, [2023], "int")[0]) == (1672531200, 1704067199)


def test_light(spark):
    times = spark.range(0, 86400, 300).select(F.col("id").alias("t"), solar.light_phase(F.lit(0.0), F.lit(0.0), F.col("id")).alias("p"))
    phases = {r["t"]: r["p"] for r in times.collect()}
    assert phases[43200] == "day" and phases[0] == "night" and any("sunset" in p for p in phases.values())
    assert values(spark, lambda c: solar.light_phase(c, F.lit(0.0), F.lit(0)), [95.0], "double") == [None]
    # the sun is worked out once where a phase is read, and once more where phases are filtered
    plan = enrich.light_histogram(enrich.with_light(spark.range(3).selectExpr(
        "id / 2 AS gps_lat", "id / 3 AS gps_lon", "id AS captured_at", "id AS size_logical")))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.upper().count("ATAN2") <= 2


def test_probes(spark):
    good = {"format": {"duration": "4.5", "bit_rate": "120000000", "tags": {"com.apple.quicktime.make": "Sony", "creation_time": "2023-06-01T00:00:00Z"}},
            "streams": [{"codec_type": "audio", "codec_name": "aac"},
                        {"codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 2160, "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001",
                         "tags": {"location": "-24.1858-065.2995/", "model": "A7"}}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps({"streams": [{"codec_type": "audio"}]})), (3, "junk")], "entry_id bigint, json string")
    assert rows(probes.probe_video_meta(df), "entry_id", "duration_ms", "width", "height", "vcodec", "acodec", "bitrate") == [
        (1, 4500, 3840, 2160, "hevc", "aac", 120000000)]
    assert rows(probes.probe_location_meta(df).filter("entry_id = 1"), "gps_lat", "gps_lon", "camera_make", "camera_model", "captured_at") == [
        (-24.1858, -65.2995, "Sony", "A7", 1685577600)]


def test_nearest_place_across_poles_and_dateline(spark):
    import math
    import random
    rng = random.Random(2)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), f"p{i}") for i in range(40)] + [(99, 10.0, 179.9, "east"), (98, 89.9, 0.0, "pole")]
    points = [(10.0, -179.9), (89.5, 170.0), (-89.0, 5.0)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]

    def xyz(lat, lon):
        a, b = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    gaz = spark.createDataFrame(places, "place_id bigint, lat double, lon double, place string")
    df = spark.createDataFrame([*points, (91.0, 0.0)], "lat double, lon double")
    got = {(r["lat"], r["lon"]): r["place"] for r in enrich.nearest_place(df, gaz, cell=0.05).collect()}
    want = {p: min(places, key=lambda g: math.dist(xyz(*p), xyz(g[1], g[2])))[3] for p in points}
    assert got == want and got[points[0]] == "east" and got[points[1]] == "pole"


def test_inventory_hashes_and_archives(spark, tmp_path):
    root = tmp_path / "vol"
    (root / "A").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "A" / "a.txt").write_bytes(b"hello")
    (root / "A" / ".DS_Store").write_bytes(b"x")
    (root / "node_modules" / "m.js").write_bytes(b"y")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr(zipfile.ZipInfo("fotos/", (2023, 1, 1, 0, 0, 0)), "")
        z.writestr(zipfile.ZipInfo("fotos/a.jpg", (2023, 11, 14, 22, 13, 20)), b"q" * 2048)
    (root / "bad.zip").write_bytes(b"not a zip")
    tree = files.file_inventory(spark, str(root), exclude_junk=True)
    assert rows(tree, "rel_path", "is_folder", "ext") == [
        ("A", True, None), ("A/a.txt", False, "txt"), ("bad.zip", False, "zip"), ("z.zip", False, "zip")]
    assert tree.filter("rel_path = 'A/a.txt'").first()["modified_at"] == int(os.path.getmtime(root / "A" / "a.txt"))
    hashed = dict(rows(files.content_hash(spark, str(root)), "rel_path", "content_hash"))
    assert hashed == {str(f.relative_to(root)): hashlib.sha256(f.read_bytes()).hexdigest() for f in root.rglob("*") if f.is_file() and not f.name.startswith(".")}
    members = files.archive_index(spark, str(root))
    assert rows(members, "path", "name", "is_dir", "size", "modified") == [
        ("fotos", "fotos", True, 0, 1672531200), ("fotos/a.jpg", "a.jpg", False, 2048, 1700000000)]


def test_walk_sees_empty_folders_and_follows_no_links(spark, tmp_path):
    root = tmp_path / "TESTVOL"
    (root / "CLIP").mkdir(parents=True)
    (root / "CLIP" / "a.mov").write_bytes(b"\0" * 1234)
    (root / "readme.txt").write_bytes(b"hello")
    tree = files.file_inventory(spark, str(root))
    ids = {r["rel_path"]: (r["id"], r["parent_id"]) for r in tree.collect()}
    assert ids.keys() == {"CLIP", "CLIP/a.mov", "readme.txt"} and ids["CLIP/a.mov"][1] == ids["CLIP"][0] and ids["CLIP"][1] is None
    clip = tree.filter("name = 'a.mov'").first()
    assert (clip["size_logical"], clip["is_folder"]) == (1234, False) and (clip["size_physical"] >= 1234 or clip["size_physical"] == 0)

    (root / "empty" / "deep" / "deeper").mkdir(parents=True)
    (root / "up").symlink_to(root)
    (root / "gone").symlink_to(root / "nowhere")
    (root / "_kept").write_bytes(b"x")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "h.txt").write_bytes(b"x")
    seen = {r["rel_path"]: (r["is_folder"], r["size_logical"]) for r in files.file_inventory(spark, str(root)).collect()}
    assert {k: v for k, v in seen.items() if k not in ids} == {
        "empty": (True, 0), "empty/deep": (True, 0), "empty/deep/deeper": (True, 0), "up": (False, 0), "gone": (False, 0), "_kept": (False, 1),
        ".hidden": (True, 0), ".hidden/h.txt": (False, 1)}
    assert not files.file_inventory(spark, str(root), skip_hidden=True).filter("rel_path LIKE '.hidden%'").count()
    assert rows(files.walk(spark, str(root / "empty")), "rel_path") == [("deep",), ("deep/deeper",)]
    there = {r["rel_path"] for r in files.walk(spark, str(root), ["readme.txt"], skip_hidden=True).collect()}
    assert {"CLIP", "CLIP/a.mov"} <= {r["rel_path"] for r in files._stored(spark, str(root), ["readme.txt"], True).filter("NOT rel_path LIKE 'up%'").collect()} <= there  # no empty folders, links or hidden names
    assert there.isdisjoint({"readme.txt", ".hidden", ".hidden/h.txt"}) and {"CLIP", "CLIP/a.mov", "empty/deep"} <= there
    assert files.walk(spark, str(root / "absent")).isEmpty() and files.file_inventory(spark, f"file://{root}").count() == len(seen)


def test_hash_trees(spark, tmp_path):
    data = {"empty": b"", "one": b"abcd", "long": bytes(range(23)), "longer": bytes(reversed(range(37)))}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)

    def tree(content, chunk, fan):
        level = [hashlib.sha256(content[i:i + chunk]).hexdigest() for i in range(0, max(1, len(content)), chunk)]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        return level[0]

    got = {r["rel_path"]: (r["size"], r["content_hash"], r["hash_algo"]) for r in files.content_hash(spark, str(tmp_path), chunk=4, fan=3).collect()}
    assert got == {n: (len(c), tree(c, 4, 3), "sha256-tree-4-3" if len(c) > 4 else "sha256") for n, c in data.items()}
    before = {(r["rel_path"], r["chunk"]): r["digest"] for r in files.chunk_hashes(spark, str(tmp_path), 4).collect()}
    (tmp_path / "long").write_bytes(data["long"][:9] + b"!" + data["long"][10:])
    after = {(r["rel_path"], r["chunk"]): r["digest"] for r in files.chunk_hashes(spark, str(tmp_path), 4).collect()}
    assert [k for k in before if before[k] != after[k]] == [("long", 2)]


def test_export_quotes_only_where_needed(spark, tmp_path):
    df = spark.createDataFrame([("D", '/a "b", c', "n", "mp4", 1, None)], "disk string, path string, name string, type string, size bigint, modified bigint").coalesce(1)
    sinks.export_rows(df, "csv", f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["disk,path,name,type,size,modified", 'D,"/a ""b"", c",n,mp4,1,']
    sinks.export_rows(df, "json", f"{tmp_path}/json")
    assert json.loads(next((tmp_path / "json").glob("*.json")).read_text())["modified"] is None


def test_volumes_and_scopes(spark):
    disks = typed(spark, "disks", [(1, "A", "u1", 100, True, "/old"), (2, "B", None, 100, False, None), (3, "C", "u3", 0, True, "/m3")],
                  ["id", "name", "volume_uuid", "total_size", "is_online", "mount_path"])
    vols = typed(spark, "volumes", [("X", "/mx", "u1", 10**12, 10**12 - 100), ("B", "/mb", "u9", 100, 100), ("C", "/m3", None, 7, 3)],
                 ["name", "mount_path", "fingerprint", "total_space", "available_space"])
    assert rows(status.online_status(disks, vols), "name", "is_online", "mount_path") == [("A", True, "/mx"), ("B", True, "/mb"), ("C", False, None)]
    assert rows(status.live_space(disks, vols), "name", "live_free") == [("A", 10**12 - 100), ("B", None), ("C", 3)]
    assert rows(status.disk_drift(disks, vols), "name", "status") == [("A", "upToDate"), ("B", "upToDate"), ("C", "upToDate")]
    devices = typed(spark, "devices", [("a", "*", False), ("b", "1, 3,x", False), ("c", "*", True)], ["id", "scopes", "revoked"])
    seen = {d: [i for (i,) in rows(status.filter_by_scope(disks.withColumn("disk_id", F.col("id")), devices, d), "id")] for d in "abcz"}
    assert seen == {"a": [1, 2, 3], "b": [1, 3], "c": [], "z": []}


def test_presence_batch(spark):
    polls = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "b")], "poll int, mount_path string")
    assert rows(presence_batch(polls), "poll", "mount_path", "event") == [
        (1, "a", "initial"), (1, "b", "initial"), (2, "b", "removed"), (3, "b", "added")]


def test_presence_stream(spark, tmp_path):
    beats = spark.createDataFrame([("a", 0), ("b", 0), ("a", 2), ("a", 4), ("a", 60)], "mount_path string, t bigint")
    stamped = beats.select("mount_path", F.timestamp_seconds(F.col("t") + 1700000000).alias("at"))
    for n, (low, high) in enumerate([(0, 1), (2, 5), (60, 61)]):
        part = stamped.filter(F.unix_seconds("at").between(1700000000 + low, 1700000000 + high))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema("mount_path string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    begin = datetime.fromtimestamp(1700000000 - 9, UTC)
    q = presence_changes(source, timeout_ms=10_000, started=begin).writeStream.format("parquet").option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("mount_path", "event", (F.unix_seconds("at") - 1700000000).alias("s"))
    assert rows(got, "mount_path", "event", "s") == [
        ("a", "added", 60), ("a", "initial", 0), ("a", "removed", 14), ("b", "initial", 0), ("b", "removed", 10)]


def test_sinks_are_idempotent(spark, tmp_path):
    root = str(tmp_path)
    entries = typed(spark, "entries", [(1, 1, "uno dos"), (2, 2, "tres")], ["id", "disk_id", "name"])
    renamed = entries.filter("disk_id = 1").withColumn("name", F.lit("cuatro"))
    late = typed(spark, "entries", [(3, 1, "seis siete"), (4, 1, "")], ["id", "disk_id", "name"])  # one disk over three batches
    sink = index_sink(root)
    for batch_id, batch in ((0, entries), (1, renamed), (1, renamed), (2, late)):
        sink(batch, batch_id)
    postings, facts = read_index(spark, root)
    assert rows(postings, "token", "entry_id", "disk_id") == [("cuatro", 1, 1), ("seis", 3, 1), ("siete", 3, 1), ("tres", 2, 2)]
    assert rows(facts, "disk_id", "n_docs", "n_words") == [(1, 3, 3), (2, 1, 1)]

    disks = typed(spark, "disks", [(1, "A", "u1"), (2, "B", "u2"), (3, "C", "u3")], ["id", "name", "volume_uuid"])
    vols = typed(spark, "volumes", [("X", "/mx", "u1"), ("Y", "/my", "u2"), ("Z", "/mz", "u3")], ["name", "mount_path", "fingerprint"])
    at = F.timestamp_seconds("s").alias("at")
    one = spark.createDataFrame([("/mx", "initial", 1), ("/my", "initial", 1)], "mount_path string, event string, s bigint").select("mount_path", "event", at)
    two = spark.createDataFrame([("/my", "removed", 5), ("/mz", "added", 6)], "mount_path string, event string, s bigint").select("mount_path", "event", at)
    keep = online_status_sink(root)
    for batch_id, batch in ((3, one), (4, two), (4, two)):
        keep(batch, batch_id)
    assert rows(online_now(spark, root, disks, vols), "name", "is_online") == [("A", True), ("B", False), ("C", True)]
    sinks.append_audit(typed(spark, "access_log", [(86400 * 3 + 5, "d")], ["ts", "device_id"]), f"{root}/audit")
    assert str(spark.read.parquet(f"{root}/audit").first()["day"]) == "1970-01-04"


def test_catalog_defaults_to_empty_tables(spark):
    assert Catalog(spark, {}).transcripts.isEmpty()


def test_runs_stay_few_and_whole(spark, tmp_path):
    def last(tables):
        return {"t": tables["t"].groupBy("k").agg(F.max("v").alias("v"))}

    runs = Runs(str(tmp_path), {"t": "k bigint, v bigint"}, last, fan=3, keep_seconds=0)
    assert runs.read(spark)["t"].isEmpty()
    opened = []
    for batch in range(30):
        rows_ = spark.createDataFrame([(batch % 4, batch), (100 + batch, batch)], "k bigint, v bigint")
        for _ in range(2 if batch % 5 == 0 else 1):  # seen again
            runs.add(spark, batch, {"t": rows_})
        opened.append(len(last_commit(spark, str(tmp_path)).places))
    assert max(opened) <= 2 * 4 and opened[26] == 1
    assert rows(last(runs.read(spark))["t"], "k", "v") == sorted([*[(k, max(b for b in range(30) if b % 4 == k)) for k in range(4)], *[(100 + b, b) for b in range(30)]], key=str)
    assert runs.read(spark)["t"].count() < 60  # what was replaced is gone
    kept = {p for c in commits(spark, str(tmp_path))[:2] for p in c.places.values()}
    assert len(list((tmp_path / "data").iterdir())) < 30 and all((tmp_path / p).is_dir() for p in kept)


def test_a_merge_that_dies_leaves_the_batches(spark, tmp_path):
    def dies(tables):
        raise OSError("lost")

    one = spark.createDataFrame([(1,)], "k bigint")
    runs = Runs(str(tmp_path), {"t": "k bigint"}, dies, fan=2)
    runs.add(spark, 0, {"t": one})
    with pytest.raises(OSError):
        runs.add(spark, 1, {"t": one})
    runs.merge = lambda tables: tables
    runs.add(spark, 1, {"t": one})  # the query starts again with the same batch
    assert runs.read(spark)["t"].count() == 2
    runs.add(spark, 2, {"t": one})
    assert runs.read(spark)["t"].count() == 3 and len(last_commit(spark, str(tmp_path)).places) == 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_name_postings_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([(1, 1, "Élan elan b.MOV"), (2, 1, ""), (3, 2, "b b b"), (4, 2, None)], "entry_id long, disk_id long, text string")
    got, want = search.name_postings(docs), search.build_postings(docs)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() == 4
    assert "Exchange" not in _plan(got) and "Exchange" in _plan(want)


def test_postings_stay_where_they_are(spark, tmp_path, monkeypatch):
    """A merge shuffles postings only if many entries came again."""
    root, shape = str(tmp_path), "id long, disk_id long, name string"
    sink = index_sink(root)
    sink(spark.createDataFrame([(1, 1, "old name"), (2, 1, "b")], shape), 0)
    sink(spark.createDataFrame([(3, 1, "c c")], shape), 1)
    postings, _ = read_index(spark, root)
    assert "Exchange" not in _plan(postings) and postings.count() == 4
    sink(spark.createDataFrame([(1, 2, "new name")], shape), 2)
    few = read_index(spark, root)[0]
    want = {("new", 1, 2, 1), ("name", 1, 2, 1), ("b", 2, 1, 1), ("c", 3, 1, 2)}
    assert {(r["token"], r["entry_id"], r["disk_id"], r["tf"]) for r in few.collect()} == want and few.count() == 4
    monkeypatch.setattr("drivetrove.streaming.sinks.FEW_AGAIN", 0)
    assert sorted(read_index(spark, root)[0].collect()) == sorted(few.collect())


def test_places_of_many_points_are_not_broadcast(spark):
    from drivetrove.operators import enrich
    from drivetrove.session import skew_join
    left, right = spark.range(50).withColumn("k", F.col("id") % 5), spark.range(5).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        joined = skew_join(left, right, "k", "left", spread=F.col("id"), rows=10)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    points = spark.createDataFrame([(10.0, 10.0), (10.0, 10.0), (-80.0, 170.0), (95.0, 0.0)], "lat double, lon double")
    places = spark.createDataFrame([(2, 10.1, 10.0, "b"), (1, 10.1, 10.0, "a"), (3, 50.0, 0.0, "far")], "place_id long, lat double, lon double, place string")
    assert rows(enrich.nearest_place(points, places, cell=0.01), "lat", "lon", "place_id", "place") == [(-80.0, 170.0, 1, "a"), (10.0, 10.0, 1, "a")]
    assert enrich.nearest_place(points, places.limit(0)).count() == 0
