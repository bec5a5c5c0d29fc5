import hashlib
import random

import numpy as np
import pytest

from drivetrove.llm.common import table
from drivetrove.llm.repeats import LoserTree, decoded, front_coded, without_repeats


def brute(rows, length=100):
    rows = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, raw in rows:
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if first[raw[s:s + length]] < (i, s):
                gone[s:s + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def case(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("ab é\n" if seed % 2 else "abcdefgh ", k=n))
    shared = [text(n) for n in (90, 99, 100, 101, 140, 260, 400)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(1, 150)))
            if rng.random() < 0.2 and parts[-1]:
                x = parts[-1]
                k = rng.randrange(len(x))
                parts[-1] = x[:k] + "#" + x[k + 1:]
        rows.append((i, "".join(parts)))
    rows += [(70, rows[5][1]), (71, rows[5][1]), (72, "xy" * 700), (73, "z" * 1500), (None, rows[9][1]), (None, shared[-1]), (80, None), (81, ""), (82, rows[3][1]), (82, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, docs, seed):
    rows = case(seed)
    for size, hot in ((8 << 20, 50_000), (3000, 50_000), (3000, 2)):
        assert got(without_repeats(docs(rows), block_bytes=size, hot=hot)) == brute(rows)


def test_given_rows(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(without_repeats(df, block_bytes=60_000)) == brute(rows)


def test_empty(spark, docs):
    assert without_repeats(docs([(1, "a")]).limit(0)).count() == 0
    assert got(without_repeats(docs([(1, None)]))) == brute([(1, None)])


def test_loser_tree():
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 20):
        runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 9))).encode() for _ in range(rng.randint(0, 12))) for _ in range(n)]
        merged = list(LoserTree([decoded(*front_coded(r)) for r in runs]))
        assert [s for _, _, s in merged] == sorted(s for r in runs for s in r)
        last = b""
        for _, share, s in merged:
            real = next((k for k, (x, y) in enumerate(zip(last, s)) if x != y), min(len(last), len(s)))
            assert share == real
            last = s
