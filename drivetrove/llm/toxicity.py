"""Toxicity with noisy-channel deobfuscation.

Words with a sign, a mark or a repeated letter become lattices of letters: a sign may stand for letters it looks like, a repeated letter may be one, a
mark between letters may be nothing. Viterbi decoding under a letter trigram model of the corpus picks the reading, and a
linear model over restored words and their beginnings scores the text. Words spelt with single characters are one lattice,
cut into words by the counts of whole words.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from .common import held_out, materialize, only, small_batches, texts, utf8

# What signs stand for in common disguises.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
BETWEEN = "*.-_~'`,"
SYMBOLS = 28  # 0: outside words, 1-26: letters, 27: any other letter
_CODE = bytes(27 if c >= 128 else c - 96 if 97 <= c <= 122 else 0 for c in range(256))
_ENDS = ".,;:?!\"'()[]{}<>«»&*%#|-_~`/\\"
_MARKS = "\"'()[]{}.,;:?&*%#|<>"  # of these, such as look like no letter
_TWICE = re.compile(r"(.)\1", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")
SWAP, DROP_MARK, DROP_SIGN, DROP_REPEAT = -1.5, -1.0, -6.0, -1.0
UNKNOWN, UNKNOWN_LETTER = -12.0, -3.3  # a word that no count has: once, and by letter


def letter_counts(batch: list[str]) -> np.ndarray:
    out = np.zeros(SYMBOLS**3, np.int64)
    for text in batch:
        code = np.frombuffer(b"\0\0" + utf8(text).lower().translate(_CODE) + b"\0", np.uint8)
        code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])].astype(np.int64) if len(code) else code.astype(np.int64)
        if len(code) > 2:
            out += np.bincount(code[:-2] * SYMBOLS**2 + code[1:-1] * SYMBOLS + code[2:], minlength=SYMBOLS**3)
    return out


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two before), from all texts; at most 28^3 sums reach the driver."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in small_batches(batch, "text"):
                total += letter_counts(texts(part.column("text")))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = only(docs, text="string").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(SYMBOLS**3)
    for r in rows:
        count[r["gram"]] = r["n"]
    return model_of(count)


def model_of(count: np.ndarray) -> np.ndarray:
    three = count.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 10 * p1) / (two.sum(axis=1, keepdims=True) + 10)
    return np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5))


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


@cache
def _ways(c: str, again: bool) -> tuple[tuple[str, int, float], ...]:
    """What a character may stand for, the letter's symbol and the cost; ``again``: it stands after itself."""
    if c.isalpha():
        said, drop = [(c, 0.0)], DROP_REPEAT if again else None
    else:
        said = [(x, SWAP) for x in LOOKS_LIKE.get(c, "")]
        drop = DROP_MARK if c in BETWEEN else DROP_REPEAT if again else DROP_SIGN
    return (*((x, symbol(x), cost) for x, cost in said), *([("", 0, drop)] if drop is not None else []))


def viterbi(word: str, model) -> str:
    """Most likely reading of a lower-case word: letters only."""
    # What was said is linked back, so that time and memory stay in proportion to the word's length.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = ""
    for c in word:
        options = _ways(c, c == last)
        if len(options) == 1 and options[0][0]:  # one reading: states only meet where their last letters do
            x, s, cost = options[0]
            if len(states) == 1:
                [((a, b), (score, said))] = states.items()
                states, last = {(b, s): (score + cost + model[a][b][s], (said, x))}, c
                continue
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, said) in states.items():
            row = model[a][b]
            for x, s, cost in options:
                if x:
                    key, value = (b, s), score + cost + row[s]
                else:
                    key, value = (a, b), score + cost
                best = new.get(key)
                if best is None or value > best[0]:
                    new[key] = (value, (said, x) if x else said)
        states, last = new, c
    said = max(((score + model[a][b][0], said) for (a, b), (score, said) in states.items()), key=lambda v: v[0])[1]
    out = []
    while said:
        said, x = said
        out.append(x)
    return "".join(reversed(out))


#: Readings that a worker has decoded, by model and common words, for its later tasks and passes; one model at a time.
_decoded: dict[str, dict[str, tuple[str, ...]]] = {}
DECODED_MOST, DECODED_LENGTH = 200_000, 64


def _decoded_by(model: np.ndarray, common: Mapping[str, int]) -> dict[str, tuple[str, ...]]:
    key = xxhash.xxh3_128_hexdigest(np.asarray(model, np.float64).tobytes() + repr(sorted(common.items())).encode("utf-8", "surrogatepass"))
    if key not in _decoded:
        _decoded.clear()
    return _decoded.setdefault(key, {})


class Words(dict):
    """Restored words by word as written; ``of`` turns a restored word into what is kept."""

    def __init__(self, model: np.ndarray, of, common: Mapping[str, int], most: int = 300_000):
        self.decoded = _decoded_by(model, common)
        self.model, self.of, self.most = np.asarray(model).tolist(), of, most
        whole = np.log(max(1, sum(common.values())))
        self.common = {w: float(np.log(n) - whole) for w, n in common.items()}
        self.starts = {w[:k] for w in common for k in range(1, len(w) + 1)}

    def __missing__(self, raw: str):
        if len(self) >= self.most:
            self.clear()
        self[raw] = value = self.of(self.restored(raw))
        return value

    def restored(self, raw: str) -> tuple[str, ...]:
        if (bare := raw.strip(_ENDS)).isalpha() and raw.strip(_MARKS) == bare and not _TWICE.search(bare):
            return (bare,)  # nothing to restore
        if not _LETTERS.search(bare):
            return ()
        if len(raw) > DECODED_LENGTH:
            return restored_word(raw, self.model, self.common)
        if raw not in self.decoded:
            if len(self.decoded) >= DECODED_MOST:
                self.decoded.clear()
            self.decoded[raw] = restored_word(raw, self.model, self.common)
        return self.decoded[raw]


def restored_word(raw: str, model, common: Mapping[str, float] = {}) -> tuple[str, ...]:
    """Readings of a word as written, and its runs of letters. Without signs, marks and repeats the one reading is the word; a word
    of letters only that is commoner than its reading stays as it is."""
    bare = raw.strip(_ENDS)
    plain = tuple(_LETTERS.findall(bare))
    if not plain or bare == raw and raw.isalpha() and not _TWICE.search(raw):
        return plain
    reads = []
    for written in dict.fromkeys((raw.strip(_MARKS), bare)):
        if not written.isalpha() or _TWICE.search(written):
            read = viterbi(written, model)
            if read and (read,) != plain and read not in reads and not (written in common and common[written] >= common.get(read, -np.inf)):
                reads.append(read)
    return (*reads, *plain)


def cut(run: str, known: Words) -> list[str]:
    """Words of a spelt run: the best sequence of common words, each read through the channel, and of unknown stretches."""
    run = "".join(c for c in run if c.isalpha() or c in LOOKS_LIKE)  # other marks are dropped in any reading
    run = re.sub(r"(.)\1{3,}", r"\1\1\1", run, flags=re.S)  # likewise what repeats more often than in any word
    size = len(run)
    # By position: outside words, and in an unknown stretch; each with its start and the word that ends there.
    best: list[tuple[float, int, str | None]] = [(-np.inf, 0, None)] * (size + 1)
    inside: list[tuple[float, int]] = [(-np.inf, 0)] * (size + 1)
    best[0] = (0.0, 0, None)
    for i in range(size):
        score = best[i][0]
        each = UNKNOWN_LETTER + (0.0 if run[i].isalpha() else SWAP)
        inside[i + 1] = max((score + UNKNOWN + each, i), (inside[i][0] + each, inside[i][1]))
        if inside[i + 1][0] > best[i + 1][0]:
            best[i + 1] = (inside[i + 1][0], inside[i + 1][1], None)
        said, j, last, floor = {"": 0.0}, i, "", UNKNOWN
        while said and j < size:
            c = run[j]
            options = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LOOKS_LIKE[c]]
            drop = DROP_REPEAT if c == last else -np.inf if c.isalpha() else DROP_SIGN
            floor += UNKNOWN_LETTER + SWAP
            new: dict[str, float] = {}
            for word, cost in said.items():
                for x, more in [*options, ("", drop)]:
                    # What costs more than an unknown stretch as long can't be part of the best sequence.
                    if (value := cost + more) > max(floor, new.get(word + x, -np.inf)) and (not word + x or word + x in known.starts):
                        new[word + x] = value
            said, last, j = new, c, j + 1
            for word, cost in said.items():
                if word in known.common and (value := score + cost + known.common[word]) > best[j][0]:
                    best[j] = (value, i, word)
    out, j = [], size
    while j:
        _, i, word = best[j]
        out.append(word if word is not None else viterbi(run[i:j], known.model))
        j = i
    return out[::-1]


def spaced(words: list[str]) -> list[str]:
    """Words spelt with single characters, four or more in a row, put together; a run of one and the same is no spelling."""
    short = [i for i, w in enumerate(words) if len(w) == 1]
    if len(short) < 4:
        return []
    out = []
    for _, run in groupby(enumerate(short), lambda at: at[1] - at[0]):
        own = [words[i] for _, i in run]
        if len(own) >= 4 and len(set(own)) > 2:
            out.append("".join(own))
    return out


def features(words: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(xxhash.xxh3_64_intdigest(x) - 2**63 for w in words for x in ([w, "^" + w[:5]] if len(w) > 5 else [w]))


def text_features(text: str, known: Words) -> set:
    words = text.lower().split()
    found = set().union(*filter(None, map(known.__getitem__, set(words))))
    for whole in spaced(words):
        if _LETTERS.search(whole):
            found |= set(known.of(tuple(cut(whole, known))))
    return found


def logistic(rows: DataFrame, width: int, n: int, positive: int, ridge: float = 0.5, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic model over ``rows(toxic, columns)``, the columns being those of 0/1 features that are 1. Spark sums
    the gradients over all rows; only ``width`` of them reach the driver a round."""
    share = np.clip(positive / n if n else 0.1, 1e-3, 1 - 1e-3)
    if not width or positive in (0, n):
        return np.zeros(width), float(np.log(share / (1 - share)))
    vector = F.udf(lambda at: Vectors.sparse(width, sorted(at or []), [1.0] * len(at or [])), VectorUDT())
    fitted = LogisticRegression(regParam=ridge / n, standardization=False, maxIter=rounds, labelCol="toxic").fit(
        rows.select(F.col("toxic").cast("double").alias("toxic"), vector("columns").alias("features")))
    return fitted.coefficients.toArray(), float(fitted.intercept)


def common_words(docs: DataFrame, most: int = 20_000) -> dict[str, int]:
    """The ``most`` words that most of ``docs(text, copies)`` hold, with their numbers of texts, two at least."""

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text"):
                held = [set(filter(str.isalpha, (x.strip(_ENDS) for x in set(t.lower().split())))) for t in texts(part.column("text"))]
                copies = np.repeat(np.asarray(part.column("copies")), [len(h) for h in held])
                yield pa.RecordBatch.from_arrays([pa.array([w for h in held for w in h], pa.string()), pa.array(copies, pa.int64())], ["word", "copies"])

    counted = docs.select("text", "copies").mapInArrow(run, "word string, copies long").groupBy("word").agg(F.sum("copies").alias("n")).filter("n > 1")
    return {r["word"]: r["n"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()}


def labelled_texts(docs: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """``h, doc_id, toxic, copies, text`` of the labelled texts outside the held-out fold, equal ones once: toxic if one label says so, under
    the smallest id. Only ids and hashes meet the labels, then whole texts are moved once."""
    chosen = only(labels, doc_id="long", toxic="int").dropna().filter(~held_out("doc_id", folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = hashed_texts(docs).filter(~held_out("doc_id", folds))
    each = materialize(hashed.select("doc_id", "h").join(chosen, "doc_id").groupBy("h").agg(
        F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "labels")
    # merged at every size, so that what is moved grows with the texts; a repeated row meets its text twice
    return materialize(hashed.join(each.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("h", "doc_id", "toxic", "copies", "text"), "labelled")


def hashed_texts(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="long", text="string").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))


def telling_features(labelled: DataFrame, n: int, p: int, model: np.ndarray, common: Mapping[str, int], width: int) -> dict[int, int]:
    """The ``width`` features that tell most about the labels, numbered."""

    def run(batches):
        known = Words(model, features, common)
        for batch in batches:
            for part in small_batches(batch, "text"):
                found = [text_features(t, known) for t in texts(part.column("text"))]
                toxic = np.repeat(np.asarray(part.column("toxic")), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.int64()), pa.array(toxic, pa.int32())], ["f", "toxic"])

    flat = labelled.select("text", "toxic").mapInArrow(run, "f long, toxic int")
    counted = flat.groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.sum("toxic").alias("t")).filter("c >= 3")
    z = (F.col("t") - F.col("c") * (p / max(1, n))) / F.sqrt(F.col("c") * max(p / max(1, n) * (1 - p / max(1, n)), 1e-9))
    top = counted.withColumn("z", F.abs(z)).filter("z >= 3").orderBy(F.desc("z"), "f").limit(width).select("f")
    return {r["f"]: k for k, r in enumerate(sorted(top.collect()))}


def columns_of(docs: DataFrame, number: Mapping[int, int], model: np.ndarray, common: Mapping[str, int]) -> DataFrame:
    """``docs(doc_id, text, h)`` with the numbers of the features that a text has in place of the text."""

    def run(batches):
        known = Words(model, lambda words: tuple(number[f] for f in features(words) if f in number), common)
        for batch in batches:
            for part in small_batches(batch, "text"):
                found = [sorted(text_features(t, known)) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "h", "columns"])

    return docs.mapInArrow(run, "doc_id long, h long, columns array<int>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, width: int = 4096) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Learns from all ``labels`` (doc_id, toxic 0/1) of documents outside the held-out fold, equal texts once; only the text decides a
    score. NULL and empty texts get the score of a text without any known word. Repeated rows score alike, an id labelled twice
    is toxic if one label says so, NULL ids count as the text '' for the fold. Without labels every text gets one low score.
    Empty input: no rows.
    """
    labelled, model = labelled_texts(docs, labels, folds), letter_model(docs)
    size = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    n, p = size["n"], size["p"] or 0
    common = common_words(labelled)
    number = telling_features(labelled, n, p, model, common, width)
    # every text is read for its columns once, to learn from and to score
    found = materialize(columns_of(hashed_texts(docs), number, model, common), "columns")
    learnt = labelled.select("h", "doc_id", "toxic").join(found.dropDuplicates(["doc_id", "h"]), ["doc_id", "h"])
    w, bias = logistic(learnt.select("h", "toxic", "columns"), len(number), n, p)

    def run(batches):
        for batch in batches:
            at = batch.column("columns")
            row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            sums = bias + np.bincount(row, weights=w[at.flatten().to_numpy()], minlength=len(at))
            scores = 1 / (1 + np.exp(-np.clip(sums, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])

    return found.select("doc_id", held_out("doc_id", folds).alias("held_out"), "columns").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
