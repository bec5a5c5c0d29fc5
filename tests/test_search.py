import random
import re
import sqlite3

import pytest
from conftest import NODES, SF28, entry_id, rows, typed
from pyspark.sql import functions as F

from drivetrove import Catalog
from drivetrove.functions import text as tx
from drivetrove.operators import pending, saved_search, search, stats, tags
from drivetrove.session import materialize
from drivetrove.sources import ingest


@pytest.fixture(scope="module")
def cat(load):
    return load({"SF28": SF28, "Año Ñandú": [("Año Ñandú", -1, True, 0), ("Canción_final v2.MOV", 0, False, 5 * 2**30), ("node_modules", 0, True, 0)]})


def test_terms_require_all_and_prefix_the_last():
    assert tx.query_terms("Canción  final!") == [("cancion", False), ("final", True)]
    assert tx.query_terms(" ._- ") == []


def test_name_search(cat):
    found = search.search_names(cat, "c00").collect()
    assert [(r["name"], r["path"], r["total"], r["truncated"]) for r in found] == [
        ("C0001.MP4", "/SF28/CLIP/C0001.MP4", 1, False)]
    assert rows(search.search_names(cat, "CANCION fin"), "name") == [("Canción_final v2.MOV",)]
    assert search.search_names(cat, "!!!").isEmpty()
    page = search.search_names(cat, "c", limit=1).collect()
    assert len(page) == 1 and page[0]["total"] == 3 and page[0]["truncated"]
    assert search.search_names(cat, "c", disk_id=1).count() == 1


def test_attribute_search(cat):
    def names(**filters):
        return [r["name"] for r in search.search_advanced(cat, filters).collect()]

    assert names(kind="file", min_size=2 * 2**30) == ["Canción_final v2.MOV", "C0001.MP4"]
    assert names(exts=["MOV"], max_size=2 * 2**30) == ["B-ROLL.MOV"]
    assert names(modified_after=1685581200) == ["C0001.MP4"]
    assert names(text="clip", kind="folder") == ["CLIP"]
    assert names() == [] and names(text=" . ") == [] and names(place=" ") == []


def test_place_and_light_are_literal(cat):
    spot = F.when(F.col("name") == "C0001.MP4", "San Salvador de Jujuy, AR").when(F.col("name") == "B-ROLL.MOV", "100% Buenos_Aires")
    lit = F.when(F.col("name") == "C0001.MP4", "golden dusk sunset")
    there = cat.replacing(entries=cat.entries.withColumn("gps_place", spot).withColumn("light_phase", lit))
    assert rows(search.search_advanced(there, {"place": "jujuy"}), "name") == [("C0001.MP4",)]
    assert rows(search.search_advanced(there, {"place": "%"}), "name") == [("B-ROLL.MOV",)]
    assert rows(search.search_advanced(there, {"place": "_"}), "name") == [("B-ROLL.MOV",)]
    assert rows(search.search_advanced(there, {"light": "Sunset"}), "name") == [("C0001.MP4",)]


def test_tags(spark, cat):
    clip, roll = entry_id(cat, "/SF28/CLIP/C0001.MP4"), entry_id(cat, "/SF28/CLIP/B-ROLL.MOV")
    add = spark.createDataFrame([(clip, " Boda "), (clip, "4K"), (roll, "boda"), (clip, "boda"), (roll, "  "), (roll, "x" * 65)],
                                "entry_id bigint, tag string")
    tagged = tags.add_tags(cat, add)
    assert [tuple(r) for r in tags.list_tags(tagged).collect()] == [("boda", 2), ("4k", 1)]
    assert rows(search.search_advanced(tagged, {"tags": ["boda", "4K", "boda"]}), "name") == [("C0001.MP4",)]
    fewer = tags.remove_tags(tagged, spark.createDataFrame([(clip, "4k")], "entry_id bigint, tag string"))
    assert [tuple(r) for r in tags.list_tags(fewer).collect()] == [("boda", 2)]


WORDS = "perro perros gato éste the and árbol uno dos tres hola".split()


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    texts = []
    for i in range(60):
        n = rng.choice([1, 5, 11, 12, 13, 30, 80])
        texts.append((i, "w", "es" if i % 2 else "en", " ".join(rng.choice(WORDS) + rng.choice(["", ",", " -", "!"]) for _ in range(n))))
    cat = Catalog(spark, {"entries": typed(spark, "entries", [(i, 1) for i in range(60)], ["id", "disk_id"])})
    new = typed(spark, "transcripts", texts, ["entry_id", "model", "lang", "text"])
    done = ingest.upsert_transcripts(cat, new)
    return done.replacing(text_postings=done.text_postings, text_stats=done["text_stats"].cache()), texts


def fts(texts):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, x) for i, _, _, x in texts])
    return db


@pytest.mark.parametrize("query, match", [("perr", '"perr"*'), ("este the", '"este" "the"*'), ("arbol un", '"arbol" "un"*')])
def test_ranking_equals_full_text_engine(spoken, query, match):
    cat, texts = spoken
    ranked = search.rank_text(cat.text_postings, cat["text_stats"], tx.query_terms(query)).collect()
    expected = dict(fts(texts).execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", [match]).fetchall())
    assert {r["entry_id"]: round(r["score"], 9) for r in ranked} == {k: round(v, 9) for k, v in expected.items()}




#: A word as the index sees it: letters and digits, with the marks that folding takes off them.
_WORD = re.compile("[^\\W_](?:[^\\W_]|[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f])*")


def cut_by_hand(text, terms, size=12, left="«", right="»", gap="…"):
    """The fragment by a plain walk over all words."""
    found = list(_WORD.finditer(text))
    folded = [tx.fold_py(m.group()) for m in found]
    term_of = [next((i for i, (t, prefix) in enumerate(terms) if (w.startswith(t) if prefix else w == t)), -1)
               for w in folded]
    hits = [i for i, t in enumerate(term_of) if t >= 0]
    best, start = -1, 0
    for n, i in enumerate(hits):
        inside = [j for j in hits[n:n + size] if j < i + size]
        different = len({term_of[j] for j in inside})
        score = different * 1000 + len(inside) - different
        if score > best:
            slack = (size - (inside[-1] + 1 - i)) // 2
            best, start = score, max(0, min(i - slack, len(found) - size))
    shown = range(start, min(start + size, len(found)))
    out, at = [], found[start].start() if start else 0
    for i in shown:
        word = found[i].group()
        out += [text[at:found[i].start()], left + word + right if term_of[i] >= 0 else word]
        at = found[i].end()
    ends = start + size >= len(found)
    return (gap if start else "") + "".join(out) + (text[at:] if ends else gap)


def test_snippets(spark, spoken):
    cat, texts = spoken
    got = {r["entry_id"]: r["snippet"] for r in search.search_transcripts(cat, "perr").collect()}
    expected = dict(fts(texts).execute("SELECT rowid, snippet(t, 0, '«', '»', '…', 12) FROM t WHERE t MATCH '\"perr\"*'").fetchall())
    assert got.keys() == expected.keys()
    short = [i for i, _, _, x in texts if len(x.split()) <= 12 and i in got]
    assert short and all(got[i] == expected[i] for i in short)
    assert all("«perro" in s for s in got.values())
    assert got == {i: cut_by_hand(x, [("perr", True)]) for i, _, _, x in texts if i in got}

    def cut(data, terms, size):
        df = spark.createDataFrame(list(enumerate(data)), "id long, x string")
        return [r["snippet"] for r in tx.snippets(df, "id", "x", terms, size, "[", "]", "~").orderBy("id").collect()]

    assert cut(["a b c d e f hit g h i", "Hit, a b c!"], [("hit", True)], 3) == ["~f [hit] g~", "[Hit], a b~"]
    rng = random.Random(4)
    odd = [None, "", " ,.- ", "(no)", "caf\u0065\u0301 hit_hit", "x\n\nhit\ty\n"]
    data = odd + ["".join(rng.choice(["hit", "Hítx", "an", "ant", "b", "ç"]) + rng.choice([" ", ", ", "\n", "_", " - "]) for _ in range(rng.choice([1, 5, 40, 3000]))) for _ in range(60)]
    for terms, size in (([("hit", True)], 3), ([("an", False), ("hit", True)], 4), ([("hit", False), ("hit", True)], 12), ([("nowhere", True)], 5)):
        assert cut(data, terms, size) == [None if x is None else cut_by_hand(x, terms, size, "[", "]", "~") for x in data]
    assert search.search_transcripts(cat, "perr", lang="es").count() == sum(1 for i in got if i % 2)


def test_new_transcript_leaves_no_stale_words(spark, spoken):
    cat, _ = spoken
    new = typed(spark, "transcripts", [(1, "w", "es", "ahora habla de tortugas")], ["entry_id", "model", "lang", "text"])
    after = ingest.upsert_transcripts(cat, new)
    assert rows(search.search_transcripts(after, "tortugas"), "entry_id") == [(1,)]
    assert rows(after.text_postings.filter("entry_id = 1"), "token") == [("ahora",), ("de",), ("habla",), ("tortugas",)]
    assert after["text_stats"].first()["n_docs"] == 60


def test_pending(spark):
    files = [(1, 1, False, "jpg"), (2, 1, False, "PNG"), (3, 1, False, "mov"), (4, 1, True, None), (5, 2, False, "zip"), (6, 1, False, "mp3")]
    cat = Catalog(spark, {
        "entries": typed(spark, "entries", files, ["id", "disk_id", "is_folder", "ext"]),
        "thumbnails": typed(spark, "thumbnails", [(1,), (3,)], ["entry_id"]),
        "embeddings": typed(spark, "embeddings", [(1, "m", None), (3, "m", None)], ["entry_id", "model", "frame_ts"]),
        "video_meta": typed(spark, "video_meta", [(3, 9000)], ["entry_id", "duration_ms"])})

    def ids(kind, **kw):
        return [i for (i,) in rows(pending.pending(cat, kind, **kw), "id")]

    assert ids("thumbnails") == [2] and ids("thumbnails", disk_id=2) == []
    assert ids("video_meta") == [] and ids("archives") == [5] and ids("transcripts") == [3, 6]
    assert ids("embeddings", model="m") == [] and ids("embeddings", model="other") == [1, 3]
    assert ids("embeddings", model="m", rebuild=True) == [1, 3]
    assert ids("video_embeddings", model="m") == [3]  # a vector without frame time does not count
    assert rows(pending.frame_sampling_plan(cat, "m", 2), "id", "frame_ts") == [(3, 3.0), (3, 6.0)]


def test_duplicates_keep_exact_counts(spark):
    files = [(i, 1, "a.mov", 2**20, False, f"/{i}") for i in range(7)] + [(9, 1, "b.mov", 2**21, False, "/9"), (10, 1, "b.mov", 2**21, False, "/10"),
             (11, 1, "c.mov", 5, False, "/11"), (12, 1, "c.mov", 5, False, "/12")]
    cat = Catalog(spark, {
        "entries": typed(spark, "entries", files, ["id", "disk_id", "name", "size_logical", "is_folder", "path"]),
        "disks": typed(spark, "disks", [(1, "D")], ["id", "name"])})
    got = rows(stats.duplicate_groups(cat, items=3), "name", "count", "wasted", "item", "id")
    assert got == [("a.mov", 7, 6 * 2**20, 1, 0), ("a.mov", 7, 6 * 2**20, 2, 1), ("a.mov", 7, 6 * 2**20, 3, 2),
                   ("b.mov", 2, 2**21, 1, 9), ("b.mov", 2, 2**21, 2, 10)]
    assert stats.wasted_total(stats.duplicate_summary(cat, min_size=0)).first()[0] == 6 * 2**20 + 2**21 + 5


def test_search_strings(spark):
    boxes = ["C0001 ext:mp4 size>2gb after:2023-06-01 type:file", "tag:Boda,4K tag:boda render", "ext:.mov,mp4", "render final",
             "size<=500mb before:2023-12-31", "type:archivo", "luz:Atardecer lugar:San place:Juan cat:FOTOS", "size>big after:01/01/2023 type:what", "   "]
    df = spark.createDataFrame(list(enumerate(boxes)), "search_id bigint, box string")
    out = {r["search_id"]: r for r in saved_search.structure_search_log(df, "box").collect()}
    assert (out[0]["text"], out[0]["exts"], out[0]["min_size"], out[0]["kind"], out[0]["modified_after"]) == (
        "C0001", ["mp4"], 2 * 2**30, "file", 1685577600)
    assert (out[1]["tags"], out[1]["text"]) == (["boda", "4k"], "render")
    assert (out[2]["exts"], out[2]["text"], out[3]["text"]) == (["mov", "mp4"], "", "render final")
    assert (out[4]["max_size"], out[4]["modified_before"]) == (500 * 2**20, 1703980800 + 86399)
    assert out[5]["kind"] == "file"
    assert (out[6]["light"], out[6]["place"], out[6]["exts"][:2]) == ("sunset", "San Juan", ["jpg", "jpeg"])
    assert all(out[7][c] is None for c in ("min_size", "modified_after", "kind")) and out[7]["text"] == ""
    asked = saved_search.has_criteria(saved_search.structure_search_log(df, "box"))
    assert rows(asked, "search_id") == [(i,) for i in range(7)]


def test_natural_order_and_pages(spark):
    names = [(i, n, False) for i, n in enumerate(["clip10", "Clip2", "álbum", "clip 1", "clip002b"])]
    cat = typed(spark, "entries", names, ["id", "name", "is_folder"])
    assert [r["name"] for r in stats.browse_order(cat).collect()] == ["álbum", "clip 1", "Clip2", "clip002b", "clip10"]
    page = stats.page(cat, [F.col("id")], 2).collect()
    assert [(r["id"], r["total"], r["truncated"]) for r in page] == [(0, 5, True), (1, 5, True)]


def test_dictionary_changes_no_answer(spark, load):
    rng = random.Random(8)
    words = ["red", "rose", "rosé", "mov", "movie", "moving", "a", "ab", "abc", "w", "wood", "x1"]

    def tree(n):
        return [("D", -1, True, 0), *[(" ".join(rng.choices(words, k=rng.randint(1, 6))) + rng.choice([".mov", ".jpg", ""]), 0, False, 1) for _ in range(n)]]

    cat = load({"D1": tree(60), "D2": tree(30)})
    cat = Catalog(spark, {t: materialize(cat[t]) for t in cat})
    cat = ingest.delete_subtrees(cat, cat.entries.filter("id % 7 = 3 and not is_folder").select("id"))
    cat = ingest.bulk_ingest(cat, spark.createDataFrame([("D3", i, p, n, f, s, s, 0, 0) for i, (n, p, f, s) in enumerate(tree(25))], NODES))
    cat = Catalog(spark, {t: materialize(cat[t]) for t in cat})
    bare = Catalog(spark, {t: cat[t] for t in cat if t != "name_terms"})
    fresh = search.build_terms(search.name_documents(cat.entries))
    assert rows(cat["name_terms"], "token", "disk_id", "tf", "doc_len", "n") == rows(fresh, "token", "disk_id", "tf", "doc_len", "n")
    disk = cat.disks.filter("name = 'D2'").first()["id"]
    for query, limit, only in ((".mov", 5, None), ("x1", 4, disk), ("red w", 1000, None), ("rose movi", 6, disk), ("red nowhere", 5, None)):
        answers = [[(r["id"], round(r["score"], 9), r["total"], r["truncated"]) for r in search.search_names(c, query, limit, only).collect()] for c in (cat, bare)]
        assert answers[0] == answers[1], (query, limit, only)


def test_saved_searches_pairs_and_sums(spark, cat):
    asked = spark.createDataFrame([(1, "ext:mov size>1gb"), (2, "ext:mov size>1gb"), (3, "type:folder"), (4, "final v"), (5, "canción ext:jpg"), (6, ""), (7, "size<1kb type:file")], "search_id long, box string")
    specs = saved_search.structure_search_log(asked, "box")
    names = {r["id"]: r["name"] for r in cat.entries.collect()}
    pairs = sorted((r["search_id"], names[r["entry_id"]]) for r in saved_search.match_saved_searches(cat, specs).collect())
    folders = sorted(r["name"] for r in cat.entries.filter("is_folder").collect())
    assert pairs == [(1, "Canción_final v2.MOV"), (2, "Canción_final v2.MOV"), *[(3, f) for f in folders], (4, "Canción_final v2.MOV")]
    summed = saved_search.summarize_saved_searches(cat, specs, F.count("*").alias("n"))
    assert rows(summed, "search_id", "n") == [(1, 1), (2, 1), (3, len(folders)), (4, 1)]


def test_saved_search_totals_by_size_bounds(spark, load):
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 7, 8, 9, 1000, 1024, 10**6, 10**6 + 1, 2**33]) for _ in range(120)]
    items = [("D", -1, True, 0), *[(f"{rng.choice(['red', 'green'])} {i % 9}.{rng.choice(['mov', 'jpg'])}", 0, False, s) for i, s in enumerate(sizes)]]
    cat = load({"D": items})
    unknown = cat.entries.filter(F.col("name").startswith("red 3")).select("id").limit(2)
    entries = cat.entries.join(unknown.withColumn("_gone", F.lit(True)), "id", "left")
    cat = cat.replacing(entries=materialize(entries.withColumn("size_logical", F.when(F.col("_gone").isNull(), F.col("size_logical"))).drop("_gone")))
    texts, edges = ["red", "green 1", "ext:mov", "gr ext:jpg", "type:file", ""], [0, 1, 7, 8, 9, 999, 1000, 1024, 10**6, 2**33, 2**34]
    asked = []
    for text in texts:
        for low, high in [(None, None), *[(rng.choice([None, *edges]), rng.choice([None, *edges])) for _ in range(14)]]:
            asked.append((len(asked), " ".join([text, *([f"size>{low}b"] if low is not None else []), *([f"size<{high}b"] if high is not None else [])])))
    asked += [(len(asked), asked[1][1]), (len(asked), "nowhere size>1kb")]
    specs = materialize(saved_search.structure_search_log(spark.createDataFrame(asked, "search_id long, box string"), "box"))
    assert specs.filter("min_size > max_size").count() > 0 and specs.filter("min_size IS NULL AND max_size IS NULL").count() > 4
    pairs = saved_search.match_saved_searches(cat, specs).join(cat.entries.select(F.col("id").alias("entry_id"), "size_logical"), "entry_id")
    expected = pairs.groupBy("search_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_logical"), F.lit(0)).alias("bytes"), F.sum("entry_id").alias("ids"))
    found = saved_search.total_saved_searches(cat, specs, n=F.lit(1), bytes=F.col("size_logical"), ids=F.col("id"))
    assert rows(found, "search_id", "n", "bytes", "ids") == rows(expected, "search_id", "n", "bytes", "ids") != []
    assert found.columns == ["search_id", "n", "bytes", "ids"]
    assert saved_search.total_saved_searches(cat, specs.limit(0), n=F.lit(1)).isEmpty()


def test_texts_move_instead_of_their_words(spark):
    docs = spark.createDataFrame([(1, 1, "a b a"), (2, 1, "b"), (2, 1, "b"), (3, 2, None)], "entry_id long, disk_id long, text string")
    index = search.build_postings(docs)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, index.collect())) == [("a", 1, 1, 2, 3), ("b", 1, 1, 1, 3), ("b", 2, 1, 2, 1)]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_names_are_searched_without_storing_entries(spark):
    from drivetrove.plans.demo import demo_catalog, is_built
    from drivetrove.plans.queries import QUERIES
    sf_dir = "/root/testdata//sf0.001"
    assert QUERIES["name_search"](spark, sf_dir).count() > 0
    assert not is_built(demo_catalog(spark, sf_dir), "entries")
