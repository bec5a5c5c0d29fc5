import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivetrove.llm.common import table
from drivetrove.llm.toxicity import SYMBOLS, letter_counts, model_of, restored_word, spaced, symbol, toxicity, viterbi

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    rows = table(spark, SF, "documents").filter("lang = 'en'").limit(1500).collect()
    return model_of(letter_counts([r["text"] for r in rows] + ["idiot stupid moron loser clown trash pathetic "] * 20).astype(float))


def test_letter_counts():
    got, want = letter_counts(["Abé,  b!", "", "a\nb"]), Counter()
    for word in ("abé", "b", "a", "b"):
        code = [0, 0, *[s for c in word for s in ([symbol(c)] if c < "\x80" else [27, 27])], 0]
        want.update(tuple(code[i:i + 3]) for i in range(1, len(code) - 2))
        want.update([(0, 0, code[2])])
    for gram, n in want.items():
        if gram[0] == gram[1] == 0:
            continue
        assert got[gram[0] * SYMBOLS**2 + gram[1] * SYMBOLS + gram[2]] >= n


@pytest.mark.parametrize("written, meant", [("1d10t", "idiot"), ("id!ot", "idiot"), ("idiiiiot", "idiot"), ("l0ser", "loser"), ("tr@sh", "trash"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"),
                                            ("p4thet1c", "pathetic"), ("cl0wn", "clown"), ("i*d*i*o*t", "idiot")])
def test_decoding(model, written, meant):
    assert meant in restored_word(written, model)
    assert viterbi(meant, model) == meant


def test_viterbi_is_best(model):
    def force(word, a=0, b=0, last=""):
        if not word:
            return model[a, b, 0]
        from drivetrove.llm.toxicity import BETWEEN, DROP_MARK, DROP_REPEAT, DROP_SIGN, LOOKS_LIKE, SWAP
        c, rest = word[0], word[1:]
        if c.isalpha():
            ways = [(c, 0.0)] + ([("", DROP_REPEAT)] if c == last else [])
        else:
            ways = [(x, SWAP) for x in LOOKS_LIKE.get(c, "")] + [("", DROP_MARK if c in BETWEEN else DROP_REPEAT if c == last else DROP_SIGN)]
        return max(cost + (model[a, b, symbol(x)] + force(rest, b, symbol(x), c) if x else force(rest, a, b, c)) for x, cost in ways)

    def value(word, read):  # best cost of one reading
        best = {(0, 0, 0): 0.0}
        from drivetrove.llm.toxicity import BETWEEN, DROP_MARK, DROP_REPEAT, DROP_SIGN, LOOKS_LIKE, SWAP
        last = ""
        for c in word:
            new = {}
            for (k, a, b), s in best.items():
                ways = ([(c, 0.0)] + ([("", DROP_REPEAT)] if c == last else [])) if c.isalpha() else [(x, SWAP) for x in LOOKS_LIKE.get(c, "")] + [("", DROP_MARK if c in BETWEEN else DROP_REPEAT if c == last else DROP_SIGN)]
                for x, cost in ways:
                    if x and (k >= len(read) or read[k] != x):
                        continue
                    key = (k + 1, b, symbol(x)) if x else (k, a, b)
                    v = s + cost + (model[a, b, symbol(x)] if x else 0)
                    new[key] = max(v, new.get(key, -np.inf))
            best, last = new, c
        return max(v + model[a, b, 0] for (k, a, b), v in best.items() if k == len(read))

    for word in ("1d10t", "aaab", "x*y", "6!1|", "ll1ll", "é0é"):
        assert abs(force(word) - value(word, viterbi(word, model))) < 1e-9


def test_spaced():
    assert spaced("you i d i o t there".split()) == ["idiot"] and spaced("a a a a a".split()) == [] and spaced("a b c".split()) == []


def test_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity(docs, labels).filter("held_out").join(labels, "doc_id").filter("toxic is not null").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    score, toxic = got.score.to_numpy(), got.toxic.to_numpy()
    rank = score.argsort().argsort()
    auc = (rank[toxic == 1].sum() - (toxic == 1).sum() * ((toxic == 1).sum() - 1) / 2) / ((toxic == 1).sum() * (toxic == 0).sum())
    told = got.predicted.to_numpy()
    print(len(got), auc, (told == toxic).mean(), told[toxic == 1].mean(), told[toxic == 0].mean())
    assert auc > 0.95 and told[toxic == 1].mean() > 0.85 and told[toxic == 0].mean() < 0.02


def test_edges(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 == 1), 9) for i in range(80)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, score int")
    rows = [(i, ("you idiot " if i % 4 == 1 else "fine text ") + chr(97 + i % 26) + chr(97 + i // 26)) for i in range(80)] + [(None, None), (200, ""), (201, "an 1d10t"), (201, "an 1d10t"), (202, "x " * 50000 + "i d i o t")]
    got = toxicity(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    assert len({r["score"] for r in got if r["doc_id"] in (None, 200)}) == 1
    assert len({r["score"] for r in toxicity(docs(rows), labels.limit(0)).collect()}) == 1
    assert toxicity(docs(rows).limit(0), labels).count() == 0


@pytest.mark.parametrize("written, meant", [("f**k", "fk"), ("stuupid", "stupid"), ("iiddiioott", "idiot"), ("i,d,i,o,t", "idiot"), ("i--d--i--o--t", "idiot"), ("i..d..i..o..t", "idiot"),
                                            ("i/d/i/o/t", "idiot"), ("i#d#i#o#t", "idiot"), ("idi" + "o" * 200 + "t", "idiot")])
def test_every_disguise_is_decoded(model, written, meant):
    assert meant in restored_word(written, model)


def test_every_sign_reaches_the_decoder(model, monkeypatch):
    seen = []
    monkeypatch.setattr("drivetrove.llm.toxicity.viterbi", lambda word, model: seen.append(word) or "read")
    written = ["f**k", "s**t", "a$$", "a55", "id10+", "stuupid", "i,d", "a" + "b" * 100]
    assert all("read" in restored_word(w, model) for w in written) and set(written) <= set(seen)
    assert restored_word("plain", model) == ("plain",) and restored_word("2026", model) == ()


def test_spelt_words_are_cut(model):
    from drivetrove.llm.toxicity import Words, cut
    known = Words(model, tuple, {"a": 90, "stupid": 9, "idiot": 9, "moron": 8, "you": 40, "i": 50, "id": 2, "pid": 2})
    assert cut("astupid", known) == ["a", "stupid"] and cut("idiotmoron", known) == ["idiot", "moron"] and cut("y0u1d10t", known) == ["you", "idiot"]
    assert cut("zqzqz", known) == ["zqzqz"] and cut("idi" + "o" * 5000 + "t", known) == ["idiot"] and cut("", known) == []
    assert cut("x" * 60000 + "idiot", known)[-1] == "idiot"


def test_spelt_words_count(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(160)], "doc_id long, toxic int")
    rows = [(i, ("see an idiot " if i % 4 == 1 else "a fine text ") + chr(97 + i % 26) + chr(97 + i // 26)) for i in range(160)]
    got = {r["doc_id"]: r["score"] for r in toxicity(docs(rows + [(300, "a i d i o t"), (301, "a f i n e"), (302, "an idi" + "o" * 80 + "t")]), labels).collect()}
    assert got[300] > got[301] and got[302] > got[301]


def test_all_labels_are_learnt_from(spark, docs, monkeypatch):
    """More labelled texts than the sample that once was drawn; only few of them show the toxic word."""
    seen = []
    monkeypatch.setattr("drivetrove.llm.toxicity.logistic", lambda rows, width, n, positive, **more: seen.append((rows.count(), n, positive)) or (np.zeros(width), 0.0))
    rows = spark.range(26_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    labels = rows.select("doc_id", (F.col("doc_id") % 4 == 1).cast("int").alias("toxic"))
    toxicity(rows, labels)
    want = [i for i in range(26_000) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [(len(want), len(want), sum(i % 4 == 1 for i in want))] and len(want) > 20_000


def test_texts_are_stored_once_without_their_features(spark, docs, monkeypatch):
    """What is stored on the way: equal labelled texts once, and of every text only the features that were chosen."""
    from drivetrove.llm import toxicity as module
    steps, store = {}, module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: steps.setdefault(name, store(df, name)))
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(160)], "doc_id long, toxic int")
    text = lambda i: ("see an idiot " if i % 4 == 1 else "a fine text ") + chr(97 + i % 80 // 26) + chr(97 + i % 80 % 26)
    rows = [(i, text(i)) for i in range(160)] + [(7, text(7)), (None, None), (400, "an idiot")]
    got = {r["doc_id"]: r["score"] for r in toxicity(docs(rows), labels).collect()}
    assert got[400] > 0.5 and all((got[i] > 0.5) == (i % 4 == 1) for i in range(160))
    learnt = [(text(i), int(i % 4 == 1)) for i in [*range(160), 7] if zlib.crc32(str(i).encode()) % 5]
    assert sorted((r["text"], r["toxic"], r["copies"]) for r in steps["labelled"].collect()) == sorted((*k, n) for k, n in Counter(learnt).items())
    stored = steps["columns"].selectExpr("max(size(columns)) AS most", "count(*) AS n").first()
    assert stored["n"] == len(rows) and stored["most"] <= 3 and "text" not in steps["columns"].columns


def test_words_are_decoded_once_a_worker(model, monkeypatch):
    from drivetrove.llm import toxicity as module
    seen, decode = [], module.restored_word
    monkeypatch.setattr(module, "_decoded", {})
    monkeypatch.setattr(module, "restored_word", lambda *given: seen.append(given[0]) or decode(*given))
    common = {"stupid": 9, "idiot": 9}
    reads = [module.Words(model, tuple, common)["1d10t"] for _ in range(3)]
    assert seen == ["1d10t"] and reads == [reads[0]] * 3 and "idiot" in reads[0]
    module.Words(model, tuple, {"idiot": 1})["1d10t"]
    module.Words(model + 1, tuple, common)["1d10t"]
    assert seen == ["1d10t"] * 3


def test_plain_words_are_not_kept_as_decoded(model, monkeypatch):
    from drivetrove.llm import toxicity as module
    monkeypatch.setattr(module, "_decoded", {})
    known = module.Words(model, tuple, {"idiot": 9})
    written = ["world,", "(world)", "12.50", "--", "world", "1d10t", "idiot!"]
    assert [known[w] for w in written] == [restored_word(w, known.model, known.common) for w in written]
    assert set(known.decoded) == {"1d10t", "idiot!"}
    # readings are looked up once for a word of a text, however often it stands there
    asked = []
    monkeypatch.setattr(module.Words, "__getitem__", lambda self, w: asked.append(w) or ("x",), raising=False)
    assert module.text_features("b a b a b", known) == {"x"} and sorted(asked) == ["a", "b"]
