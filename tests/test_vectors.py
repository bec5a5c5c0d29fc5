import numpy as np
import pytest
from conftest import rows, typed
from pyspark.sql import functions as F

from drivetrove import Catalog
from drivetrove.operators import vectors


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def crowd(spark):
    """Loose clusters, exact copies and strays."""
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(6, 8)))
    near = centres[rng.integers(0, 6, 150)] + rng.normal(scale=0.12, size=(150, 8))
    m = unit(np.vstack([near, rng.normal(size=(40, 8)), near[:20]])).astype(np.float64)
    m[190:] = m[:20]
    ids = rng.permutation(len(m)) * 3 + 1
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "entry_id bigint, vec array<double>")
    return df, dict(zip(ids.tolist(), m))


def greedy(vecs, threshold):
    leader = {}
    for i in sorted(vecs):
        first = next((j for j in sorted(vecs) if leader.get(j) == j and j < i and vecs[j] @ vecs[i] >= threshold), None)
        leader[i] = i if first is None else first
    return leader


@pytest.mark.parametrize("cell_rows, block, ballot", [(4096, 4096, 512), (20, 7, 3)])
def test_leaders_equal_the_sequential_rule(crowd, cell_rows, block, ballot):
    df, vecs = crowd
    got = {r["entry_id"]: r["leader"] for r in vectors.leader_clusters(df, 0.92, cell_rows, block, ballot).collect()}
    assert got == greedy(vecs, 0.92)


def test_pairs_are_exact_in_many_cells(crowd):
    df, vecs = crowd
    seen, reps = {}, []
    for i in sorted(vecs):
        if vecs[i].tobytes() not in seen:
            seen[vecs[i].tobytes()] = i
            reps.append(i)
    expected = sorted((a, b) for a in reps for b in reps if a < b and vecs[a] @ vecs[b] >= 0.9)
    assert rows(vectors.similarity_pairs(df, 0.9, cell_rows=25, block=10), "a", "b") == sorted(expected, key=str)


@pytest.fixture(scope="module")
def cat(spark):
    vecs = [(1, "m", None, [1.0, 0.0, 0.0]), (2, "m", 1.0, [0.0, 1.0, 0.0]), (2, "m", 2.0, [0.0, 0.0, 1.0]),
            (3, "m", 0.0, [1.0, 0.0, 0.0]), (3, "m", 1.0, [-1.0, 0.0, 0.0]), (4, "other", None, [1.0, 0.0]), (5, "m", 3.0, [0.0, 0.6, 0.8]),
            (5, "m", 1.0, [0.0, 0.6, 0.8])]
    names = [(i, 1, f"{i}.jpg", False, i * 2**20, f"/D/{i}.jpg", "jpg") for i in range(1, 6)]
    return Catalog(spark, {
        "embeddings": typed(spark, "embeddings", vecs, ["entry_id", "model", "frame_ts", "vec"]),
        "entries": typed(spark, "entries", names, ["id", "disk_id", "name", "is_folder", "size_logical", "path", "ext"]),
        "disks": typed(spark, "disks", [(1, "D")], ["id", "name"])})


def test_best_frame_and_threshold(cat):
    got = vectors.semantic_search(cat, "m", [0.0, 0.0, 1.0], threshold=0.5).collect()
    assert [(r["id"], round(r["score"], 6), r["frame_ts"]) for r in got] == [(2, 1.0, 2.0), (5, 0.8, 1.0)]
    assert rows(vectors.semantic_search(cat, "other", [1.0, 0.0, 0.0]), "id") == []


def test_signatures(cat):
    got = {r["entry_id"]: [round(x, 6) for x in r["vec"]] for r in vectors.signatures(cat, "m").collect()}
    assert got == {1: [1.0, 0.0, 0.0], 2: [0.0, round(0.5**0.5, 6), round(0.5**0.5, 6)], 5: [0.0, 0.6, 0.8]}  # 3 cancels out


def test_similar_excludes_itself(cat):
    assert [r["id"] for r in vectors.similar_to(cat, "m", 2, threshold=0.1).collect()] == [5]
    with pytest.raises(ValueError):
        vectors.similar_to(cat, "m", 3)


def test_batch_search_keeps_winners_over_batches(spark):
    rng = np.random.default_rng(1)
    m = unit(rng.normal(size=(300, 5)))
    owner = rng.integers(0, 40, 300)
    data = [(int(o), "m", float(t), [float(x) for x in v]) for t, (o, v) in enumerate(zip(owner, m))]
    cat = Catalog(spark, {"embeddings": typed(spark, "embeddings", data, ["entry_id", "model", "frame_ts", "vec"]).repartition(3)})
    asked = unit(rng.normal(size=(9, 5)))
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "query_id bigint, vec array<double>")
    m32 = m.astype(np.float32).astype(np.float64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        got = rows(vectors.batch_semantic(cat, queries, "m", k=4, block=4), "query_id", "rank", "entry_id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = []
    for i, q in enumerate(asked):
        best = {o: max(m32[owner == o] @ q) for o in set(owner.tolist())}
        expected += [(i, r + 1, o) for r, o in enumerate(sorted(best, key=lambda o: (-best[o], o))[:4])]
    assert got == sorted(expected, key=str)


def test_visual_duplicates_and_hybrid(spark, cat):
    dup = vectors.visual_duplicates(cat, "m", threshold=0.7).collect()
    assert [(r["leader"], r["name"], r["size"], r["count"], r["wasted"]) for r in dup] == [(2, "5.jpg", 5 * 2**20, 2, 2 * 2**20)]
    spoken = spark.createDataFrame([(2, 1.0, "x"), (3, 1.0, "y")], "id bigint, score double, snippet string")
    visual = vectors.semantic_search(cat, "m", [0.0, 0.0, 1.0], 0.5)
    merged = vectors.hybrid_merge(visual, spoken, 2).collect()
    assert [(r["id"], r["snippet"]) for r in merged] == [(2, None), (5, None)]
    assert [r["id"] for r in vectors.hybrid_merge(visual, spoken).collect()] == [2, 5, 3]
    only = vectors.hybrid_search(cat, {"exts": ["jpg"], "min_size": 4 * 2**20}, "m", [0.0, 0.0, 1.0], threshold=0.0)
    assert rows(only.select(F.col("id")), "id") == [(5,)]


def test_one_odd_vector_drops_no_other(spark, cat):
    odd = typed(spark, "embeddings", [(1, "m", 9.0, [5.0, 5.0]), (6, "m", None, [3.0, 4.0]), (6, "m", 1.0, [1.0, 0.0, 0.0]), (7, "m", 0.0, [])], ["entry_id", "model", "frame_ts", "vec"])
    mixed = cat.replacing(embeddings=cat.embeddings.unionByName(odd))
    got = {r["entry_id"]: [round(x, 6) for x in r["vec"]] for r in vectors.signatures(mixed, "m").collect()}
    assert got == {1: [1.0, 0.0, 0.0], 2: [0.0, round(0.5**0.5, 6), round(0.5**0.5, 6)], 5: [0.0, 0.6, 0.8], 6: [0.6, 0.8]}
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0])], "query_id bigint, vec array<double>")
    best = vectors.batch_semantic(mixed, asked, "m", k=1).collect()
    assert sorted((r["query_id"], r["entry_id"], round(r["score"], 6)) for r in best) == [(1, 1, 1.0), (2, 1, 5.0)]


def test_filters_come_before_the_cut(spark):
    n = 700
    names = [(i, 1, f"{i}.x", False, 1, f"/D/{i}", "pdf" if i > 600 else "jpg") for i in range(1, n + 1)]
    vecs = [(i, "m", None, [1.0, i / 10_000]) for i in range(1, n + 1)]  # the smaller the id, the nearer
    cat = Catalog(spark, {
        "entries": typed(spark, "entries", names, ["id", "disk_id", "name", "is_folder", "size_logical", "path", "ext"]),
        "embeddings": typed(spark, "embeddings", vecs, ["entry_id", "model", "frame_ts", "vec"]),
        "entry_tags": typed(spark, "entry_tags", [(i, "red") for i in range(650, n + 1)], ["entry_id", "tag"]),
        "disks": typed(spark, "disks", [(1, "D")], ["id", "name"])})
    found = vectors.hybrid_search(cat, {"exts": ["pdf"]}, "m", [1.0, 0.0], limit=50)
    assert found.count() == 50 and found.filter("id <= 600").isEmpty()
    assert vectors.hybrid_search(cat, {"exts": ["pdf"], "tags": ["red"]}, "m", [1.0, 0.0]).count() == 51


def test_pruning_is_measured(spark, crowd):
    df, _ = crowd
    assert 0 < vectors.routed_share(df, 0.99, cell_rows=20) < vectors.routed_share(df, 0.2, cell_rows=20) <= 1


def _greedy(ids, edges):
    """Smallest chosen neighbour of every node, itself where it is chosen."""
    below = {}
    for low, high in edges:
        below.setdefault(high, []).append(low)
    best = {}
    for i in sorted(ids):
        chosen = [x for x in below.get(i, []) if best[x] == x]
        best[i] = min(chosen) if chosen else i
    return best


def _settled(spark, ids, edges, block):
    found, rounds = vectors.settle(spark.createDataFrame([(i,) for i in ids], "entry_id bigint"), spark.createDataFrame(edges, "low bigint, high bigint"), block)
    return {r["entry_id"]: r["neighbour"] for r in found.collect()}, rounds


def test_settling_equals_the_sequential_choice(spark):
    rng = np.random.default_rng(3)
    ids = [int(x) for x in rng.permutation(900)[:400] * 7]
    pairs = {(min(a, b), max(a, b)) for a, b in rng.choice(ids, (1500, 2)).tolist() if a != b}
    pairs |= {(min(ids), x) for x in ids[:150] if x != min(ids)}  # a node that many hang on
    expected = _greedy(ids, pairs)
    for block in (16, 4096):
        got, rounds = _settled(spark, ids, sorted(pairs), block)
        assert got.keys() == expected.keys() and rounds <= 12
        chosen = {i for i, n in expected.items() if i == n}
        assert {i for i, n in got.items() if i == n} == chosen
        assert all(n in chosen and (i == n or (n, i) in pairs) for i, n in got.items())
    assert got == expected  # in one block the smallest is known at once
    assert _settled(spark, [], [], 8) == ({}, 0)


def test_rounds_follow_blocks_not_nodes(spark):
    """Each node of a run waits for the one before; as many blocks take as many rounds, however long they are."""
    taken = []
    for n, block in ((200, 50), (2000, 500)):
        edges = [(i, j) for i in range(n) for j in (i + 1, i + 2) if j < n]
        got, rounds = _settled(spark, range(n), edges, block)
        assert {i for i, b in got.items() if i == b} == set(range(0, n, 3))
        taken.append(rounds)
    assert taken[0] == taken[1] <= 5


def test_clusters_of_crowds_are_thinned_first(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = unit(rng.normal(size=(6, 6)))
    m = unit(centres[rng.integers(0, 6, 500)] + rng.normal(scale=0.05, size=(500, 6)))
    turn = np.linspace(0, 3, 200)  # a slow pan: every picture is like the next
    pan = np.zeros((200, 6))
    pan[:, 0], pan[:, 1] = np.cos(turn), np.sin(turn)
    m = np.concatenate([m, pan])
    ids = rng.permutation(len(m)) * 3
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "entry_id bigint, vec array<double>")
    order = np.argsort(ids)
    leaders, expected = [], {}
    for k in order:
        near = [j for j in leaders if m[j] @ m[k] >= 0.95]
        expected[int(ids[k])] = int(min(ids[j] for j in near)) if near else int(ids[k])
        leaders += [] if near else [k]
    thinned = []
    real = vectors._smallest_neighbour
    monkeypatch.setattr(vectors, "_smallest_neighbour", lambda *a: thinned.append(1) or real(*a))
    for degree, passes in ((1000, 1), (2, 3)):
        thinned.clear()
        got = {r["entry_id"]: r["leader"] for r in vectors.leader_clusters(df, 0.95, cell_rows=100, block=64, ballot=20, degree=degree).collect()}
        assert got == expected
        assert len(thinned) >= passes and (passes > 1 or len(thinned) == 1)
