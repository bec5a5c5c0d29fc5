import random
import re
from collections import Counter

import pytest

from drivetrove.llm.divergence import divergence

SCHEMA = "text string, lang string, source string, term string, count int, words int"


def brute(rows, min_df, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for x, _, w in docs if x == lang for t in set(w))
        kept = [t for t in df if df[t] >= min_df]
        counts = {}
        for x, s, w in docs:
            if x == lang:
                counts.setdefault(s, Counter()).update(w)
        whole = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, divergence(df, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"most_terms": 64, "source_block": 2}])
def test_divergence(spark, options):
    rng = random.Random(2)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)] + ["É", "é", "\u00df", "X-y", "𝒳"]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "é", None, "Z"])
        rows.append((" ".join(rng.choices(words[: 20 + 5 * (ord(source[0]) % 9 if source else 3)], k=rng.randint(0, 12))), lang, source))
    rows += [(None, "en", "none"), ("1 2 3", "de", "digits"), ("rare words only", "fr", "x"), ("", "fr", "y"), ("lone", "it", "z"), ("waz " * 30000 + "wak", "en", "b"), rows[0], rows[0]]
    for min_df in (5, 1):
        assert rows_of(spark, rows, min_df=min_df, top=7, **options) == brute(rows, min_df, 7)


def test_nothing_kept(spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, None, None)]
    assert rows_of(spark, rows) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert divergence(spark.createDataFrame([("a", "b", "c", "", 1, 1)], SCHEMA).limit(0)).count() == 0
