import math
import random
import re
import zlib
from collections import Counter

import pytest

from drivetrove.llm.lm import lm_scores

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def brute(rows, order, strength=300.0):
    c = Counter()
    for i, t in rows:
        if not held(i):
            line = [None, *tokens(t), "</s>"]
            for p in range(1, len(line)):
                for k in range(1, order + 1):
                    if p - k + 1 >= 0:
                        c[tuple(line[p - k + 1:p + 1])] += 1
    train = sum(v for k, v in c.items() if len(k) == 1)
    known = sum(len(k) == 1 for k in c)
    starts = c[("</s>",)]

    def prob(h, w):
        if not h:
            return (c[(w,)] + 0.1) / (train + 0.1 * (known + 1))
        n = starts if h == (None,) else c[h]
        low = prob(h[1:], w)
        return (c[(*h, w)] + strength * low) / (n + strength) if n else low

    out = []
    for i, t in rows:
        line = [None, *tokens(t), "</s>"]
        base = sum(math.log10(prob((), w)) for w in line[1:])
        model = sum(math.log10(prob(tuple(line[max(0, p - order + 1):p]), line[p])) for p in range(1, len(line)))
        out.append((str(i), held(i), len(line) - 1, sum(c[(w,)] > 0 for w in line[1:]), train, round(base, 6), round(model, 6)))
    return sorted(out)


def rows_of(got):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect())


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, docs, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choices(["the", "The", "é", "of", "x", "y", "Zz"], k=rng.randint(0, 30)))) for i in range(120)]
    rows += [(None, "of the x"), (3, None), (4, ""), (7, rows[7][1]), (7, rows[7][1]), (500, "q " * 40000)]
    for size in (8 << 20, 900):
        assert rows_of(lm_scores(docs(rows), order=order, block_bytes=size)) == brute(rows, order)


def test_empty(spark, docs):
    assert lm_scores(docs([(1, "a")]).limit(0)).count() == 0
    only_held = next(i for i in range(100) if held(i))
    assert rows_of(lm_scores(docs([(only_held, "a b")]))) == brute([(only_held, "a b")], 3)
