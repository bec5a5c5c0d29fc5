import random
import re

import numpy as np
import pytest

from drivetrove.llm.common import table
from drivetrove.llm.neardup import bit_limits, near_duplicates, odd_sketch, one_of_each, samples_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                up[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        name = min((x for x in groups[top(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), name, d == name))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def case(seed, copies=60):
    rng = random.Random(seed)
    text = lambda n: rng.choices([f"w{k}" for k in range(50)], k=n)
    rows, at = [], 0
    for _ in range(12):
        words = text(rng.choice([3, 5, 30, 120, 300]))
        for _ in range(rng.randint(1, 6)):
            other = [x if rng.random() > 0.02 else "new" + str(rng.random()) for x in words]
            rows.append((at, " ".join(other).title() if rng.random() < 0.3 else "\n".join(other)))
            at += 1
    words = text(200)
    for k in range(copies):  # one group whose members differ from each other by more than from the first
        other = list(words)
        for _ in range(rng.randint(0, 12)):
            other[rng.randrange(200)] = f"z{k}"
        rows.append((at + k, " ".join(other)))
    at += copies
    return rows + [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one"), (at + 4, "One"), (None, rows[0][1]), (None, "alone in the world of nulls"), (at + 9, rows[-1][1]), (at + 9, rows[-1][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, docs, seed):
    rows = case(seed)
    want = brute(rows)
    assert got(near_duplicates(docs(rows), block=2048 if seed == 1 else 7)) == want


def test_given_rows(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(near_duplicates(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_edges(spark, docs):
    assert near_duplicates(docs([(1, "a")]).limit(0)).count() == 0
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, None), (None, "x y z q"), (4, "A B C D E"), (5, "u v"), (5, "u v")]
    df = docs(rows)
    kept = one_of_each(df)
    assert kept.schema == df.schema
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a b c d e"), (3, None), (None, "x y z q"), (5, "u v")], key=str)


def test_sketch():
    rng = np.random.default_rng(1)
    for size in (8, 60, 500, 4000):
        far = 0
        for share, wanted in ((0.8, True), (0.95, True), (0.55, False)):
            for _ in range(60):
                pool = rng.integers(0, 2**64, 2 * size, np.uint64)
                both = round(share * size * 2 / (1 + share))
                a, b = np.unique(pool[:size]), np.unique(pool[size - both:2 * size - both])
                if wanted and 100 * both < 80 * (2 * size - both):
                    b = a
                x, y = samples_of(a), samples_of(b)
                differ = np.bitwise_count(np.frombuffer(odd_sketch(x), np.uint64) ^ np.frombuffer(odd_sketch(y), np.uint64)).sum()
                close = differ <= bit_limits(*(np.array([v]) for v in (len(a), len(b), len(x), len(y))), 0.8)[0]
                assert close or not wanted
                far += not close
        assert size < 500 or far > 50
