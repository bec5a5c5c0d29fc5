import re

import numpy as np

from drivetrove.llm.common import held_out, table
from drivetrove.llm.quality import grow, only_good, quality, statistics

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


TEXTS = [None, "", " \n\t", "a", "a b c d e a b c d e", "é ü é ü é ü é ü\n\né ü é ü é ü é ü\n", "x " * 50, "one two three four five six seven eight nine ten", "a b c a\x1cb",
         "#*$%&|<> q\nq\nq \nq", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 z"]


def test_statistics():
    rng = np.random.default_rng(2)
    more = [" ".join(rng.choice(list("abc\n"), rng.integers(0, 60))) for _ in range(60)]
    for t in TEXTS + more:
        assert statistics(t or "")[0] == brute(t), t


def test_monotone():
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.random(500)) > 0.6).astype(float)
    forest = grow(x, y, [1, 0, -1], trees=30)
    assert ((forest.score(x) > 0) == (y > 0)).mean() > 0.95
    for j, sign in ((0, 1), (2, -1)):
        lines = np.repeat(rng.random((40, 3)), 50, axis=0)
        lines[:, j] = np.tile(np.linspace(0, 1, 50), 40)
        steps = np.diff(forest.score(lines).reshape(40, 50), axis=1) * sign
        assert (steps >= -1e-12).all()


def test_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(9)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, kept int")
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (99, "big word " * 60000)]
    for given in (labels, labels.limit(0)):
        got = quality(docs(rows), given).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted(str((r["doc_id"], *[r[n] for n in names])) for r in got if r["doc_id"] != 99) == sorted(str((i, *brute(t))) for i, t in rows if i != 99)
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
        assert not any(r["kept"] and r["base_failed"] for r in got)
        kept = only_good(docs(rows), given)
        assert kept.schema == docs(rows).schema
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality(docs(rows).limit(0), labels).count() == 0


def test_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = quality(docs, labels.filter(~held_out("doc_id", 5))).join(labels.filter(held_out("doc_id", 5)), "doc_id").filter("quality is not null").toPandas()
    kept, good = got["kept"].to_numpy(), got["quality"].to_numpy() == 1
    print(len(got), (kept == good).mean(), kept[good].mean(), kept[~good].mean())
    assert kept[good].mean() > 0.97 and kept[~good].mean() < 0.1
