import hashlib
import random
import re

from drivetrove.llm.contamination import contamination, without_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def norm(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items):
    spans = [m.span() for m in WORD.finditer(norm(text))]
    words = [norm(text)[a:b] for a, b in spans]
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(norm(t))
        for i in range(max(1, len(w) - 12) if w else 0):
            win = w[i:i + 13]
            for p in range(len(words) - len(win) + 1):
                if words[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {item} if item is not None else set()
    names = sorted(found)
    return (len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)), spans, hit


def case():
    rng = random.Random(3)
    vocab = ["the", "Of", "é", "x1", "ünï", "zz", "9"]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.choice([2, 5, 13, 14, 30])))) for i in range(12)] + [("n", None), ("e", "!!"), (None, "lone item zz"), ("3", "q q q"), ("3", "q q q")]
    rows = []
    for i in range(80):
        t = " ".join(rng.choices(vocab, k=rng.randint(0, 40)))
        if i % 3 == 0:
            t += ", " + rng.choice(items)[1].upper() + "." if (x := rng.choice(items))[1] is None else " -- " + x[1].upper().replace(" ", "\n") + "; tail"
        rows.append((i, t))
    return rows + [(None, "q Q q"), (5, None), (6, ""), (7, "lone item zz"), (7, "lone item zz"), (8, "word " * 30000 + "q q q")], items


def frame(spark, items):
    return spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, n_hit int")


def test_contamination(spark, docs):
    rows, items = case()
    for size in (8 << 20, 60):  # one block of items, and several
        got = contamination(docs(rows), frame(spark, items), block_bytes=size).collect()
        want = sorted(str((i, *brute(t, items)[0])) for i, t in rows)
        assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in got) == want
    known = dict(rows[:80])
    for r in got:
        if r["doc_id"] is not None and 10 <= r["doc_id"] < 80 and r["hit_spans"]:
            (_, spans, hit) = brute(known[r["doc_id"]], items)
            starts = {spans[p][0] for p in hit if p - 1 not in hit}
            assert {a for a, _ in r["hit_spans"]} == starts


def test_filter_keeps_columns(spark, docs):
    rows, items = case()
    df = docs(rows)
    kept = without_contaminated(df, frame(spark, items))
    assert kept.schema == df.schema
    want = sorted(str((i, t)) for i, t in rows if not brute(t, items)[0][4])
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == want


def test_empty(spark, docs):
    none = frame(spark, [("a", "b")]).limit(0)
    assert [r["n_hit"] for r in contamination(docs([(1, "a b")]), none).collect()] == [0]
    assert contamination(docs([(1, "a b")]).limit(0), none).count() == 0
    assert without_contaminated(docs([(1, "a b")]), none).count() == 1
