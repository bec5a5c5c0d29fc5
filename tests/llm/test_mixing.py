import numpy as np

from drivetrove.llm.mixing import mix, sainte_lague


def brute_seats(weights, caps, seats):
    given = [0] * len(weights)
    for _ in range(seats):
        best = max((w / (2 * g + 1), -i) for i, (w, g, c) in enumerate(zip(weights, given, caps)) if g < c and w > 0)
        given[-best[1]] += 1
    return given


def test_seats_match_highest_quotients():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        weights, caps = rng.integers(0, 60, n).astype(float), rng.integers(0, 12, n)
        seats = int(rng.integers(0, caps[weights > 0].sum() + 1))
        assert sainte_lague(weights, caps, seats).tolist() == brute_seats(weights.tolist(), caps.tolist(), seats)


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if per * w[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: per * w[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, block):
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(want[s] - targets[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - targets[s]) <= 4 * block, (s, taken[s], targets[s])
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_mix(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 300)), ["a", "b", "é", "Z", None][int(rng.integers(0, 5)) if i % 3 else 0]) for i in range(400)]
    rows += [(None, None, None), (None, "x y", "b"), (7, "w w", "a"), (7, "w w", "a"), (9, "", "empty")]
    made = mix(docs(rows), block=8, shard_words=2000)
    got = made.collect()
    assert len(got) == len(rows)
    check(got, 8 * 8)
    again = mix(docs(rows[::-1]).repartition(7), block=8, shard_words=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_empty(spark, docs):
    assert mix(docs([(1, "a", "s")]).limit(0)).count() == 0
    assert [r["taken"] for r in mix(docs([(1, None, None)])).collect()] == [0]


def test_tiny_sources(spark, docs):
    rows = [(i, "w " * 1000, "big") for i in range(40)] + [(100 + i, "w " * 10, f"s{i:02}") for i in range(50)] + [(900, "one", "t")]
    made = mix(docs(rows)).collect()
    got = {}
    for r in made:
        got.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert len(got) == 52 and all(abs(t - n) <= max(1, 0.06 * t) for t, n in got.values()), got


def test_long_text(spark, docs):
    rows = [(1, "w " * 300_000, "a"), (2, "w " * 5, "a"), (3, "w " * 300, "b")]
    made = {r["doc_id"]: r for r in mix(docs(rows), shard_words=1000).collect()}
    check(list(made.values()), 64)
    assert made[1]["size"] == 300_000
