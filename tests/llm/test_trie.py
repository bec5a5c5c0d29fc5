import hashlib
import random
import zlib

import pytest

from drivetrove.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, level int, key string"


def content(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", content(role or "", text or ""), text or ""))
    convs = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        giver = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        made[c] = tuple(convs.get(giver, [])[:h] + own[h:])
    members = {}
    for c, line in made.items():
        for d in range(len(line) + 1):
            members.setdefault(line[:d], []).append(c)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in members if len(x) == len(node) + 1 and x[:-1] == node]
        leaves = sum(not any(len(y) > len(x) and y[:len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in held if made[c] == node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"width": 1, "most": 2}])
def test_trie(spark, options):
    rng = random.Random(4)
    rows = []
    for c in [*range(-7, 40), 100, 103, 2500]:
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a", "é", ""])))
    for c in range(200, 260):  # copies that share more than a block, then go on apart or end
        rows += [(c, t, "user", f"turn {t} ü") for t in range(19 + c % 3)] + [(c, 50, "bot", str(c))] * (c % 2)
    rows += [(7, None, None, "first"), (7, None, "bot", None), (8, 3, "user", "tie"), (8, 3, "user", "tie"), (None, 1, "user", "x"), (61, 0, "u", "alone")]
    rng.shuffle(rows)
    assert rows_of(spark, rows, **options) == brute(rows)


def test_long_and_empty(spark):
    rows = [(1, t, "user", "word " * 2000) for t in range(300)] + [(3, 0, "user", "x")]
    assert rows_of(spark, rows, width=2, most=4) == brute(rows)
    assert rows_of(spark, rows[:0] or [(None, 1, "a", "b")]) == []


def test_many_ends(spark):
    rows = [(5 * c, 0, "user", "same") for c in range(3000)]
    assert rows_of(spark, rows) == brute(rows)
