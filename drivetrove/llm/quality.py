"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

Trees are grown on histograms with monotonic constraints on chosen statistics (more repetition never makes a document
better). A forest is four arrays by tree and node, so a batch of documents walks every tree level in a few numpy steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WHITE, change_rows, map_texts, only, texts, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Statistics as the trees see them, with the sign of their effect on quality (0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_char": -1, "dup_lines": -1, "repeated_words": -1, "distinct_words": 0, "words_per_line": 0,
            "top_word": -1, "digits_per_char": 0, "upper_per_char": 0, "longest_word": 0, "end_marks": 0}
BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
STATS = T.StructType([*BASE.fields, T.StructField("features", T.ArrayType(T.FloatType()))])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text. Windows are numbered exactly, by ranking pairs."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    span, rank = 1, ids.astype(np.int64)
    while span < window:  # rank of windows of `span` words -> of twice as many, or of the wanted length
        step = min(span, window - span)
        left, right = rank[:len(ids) - span - step + 1], rank[step:step + len(ids) - span - step + 1]
        wide = int(rank.max()) + 1
        rank = left * wide + right  # exact: ranks stay below the number of words
        span += step
        if span < window:
            rank = np.unique(rank, return_inverse=True)[1]
    _, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = len(text)
    word_chars = chars - (len(raw) - len(raw.translate(None, WHITE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(ids)
    share = 1 / max(1, n)
    count = np.bincount(ids) if n else np.zeros(1)
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(raw) - len(raw.translate(None, b".!?"))
    features = [log(1 + n), word_chars * share, n_symbols / max(1, chars), dup / max(1, len(lines)), repeated * share, len(number) * share,
                n / max(1, len(lines)), float(count.max()) * share, digits / max(1, chars), upper / max(1, chars),
                float(max(map(len, number), default=0)), marks * share]
    return [n, word_chars, n_symbols, dup, repeated], features


@dataclass
class Forest:
    """``feature`` (-1: leaf), ``split``, ``value`` by tree and heap-ordered node; children of i are 2i+1 and 2i+2."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for the rows of ``x``."""
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        for feature, split, value in zip(self.feature, self.split, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > split[node]))
            total += value[node]
        return total


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss. A split on a constrained statistic must order its children's values, and each
    side keeps below or above their middle, so the whole forest is monotone in it."""
    n, width = x.shape if len(x) else (0, len(signs))
    nodes = 2 ** (depth + 1) - 1
    p0 = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    forest = Forest(np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes)), log(p0 / (1 - p0)))
    if not n:
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, forest.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, low, high = np.zeros(n, np.int64), np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for i in range(nodes):
            rows = np.flatnonzero(node == i)
            if not len(rows) or (i and forest.feature[t, (i - 1) // 2] < 0):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            forest.value[t, i] = rate * np.clip(gs / (hs + ridge), low[i], high[i])
            if 2 * i + 2 >= nodes:
                continue
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                gl = np.bincount(binned[rows, j], g[rows], len(cuts[j]) + 1).cumsum()[:-1]
                hl = np.bincount(binned[rows, j], h[rows], len(cuts[j]) + 1).cumsum()[:-1]
                left, right = np.clip(gl / (hl + ridge), low[i], high[i]), np.clip((gs - gl) / (hs - hl + ridge), low[i], high[i])
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least) | (signs[j] * (right - left) < 0)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(left[k]), float(right[k]))
            if best[1] < 0:
                continue
            _, j, k, left_value, right_value = best
            forest.feature[t, i], forest.split[t, i] = j, cuts[j][k]
            for child in (2 * i + 1, 2 * i + 2):
                low[child], high[child] = low[i], high[i]
            if signs[j]:
                middle = (left_value + right_value) / 2
                below, above = (2 * i + 1, 2 * i + 2) if signs[j] > 0 else (2 * i + 2, 2 * i + 1)
                high[below], low[above] = min(high[below], middle), max(low[above], middle)
            node[rows] = 2 * i + 1 + (binned[rows, j] > k)
        margin += forest.value[t, node]
    return forest


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 5) -> Forest:
    """Fits on a bounded sample: the ``sample`` labelled ids that come first in a seeded order, one row each."""
    chosen = only(labels, doc_id="long", quality="int").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    rows = map_texts(only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id"), "text", described, STATS) \
        .groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("r")).select("r.*").collect()  # at most `sample` rows
    x = np.array([r["features"] for r in sorted(rows)], float).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([r["quality"] for r in sorted(rows)], float), list(FEATURES.values()))


def described(batch: list[str]) -> dict[str, list]:
    found = [statistics(t) for t in batch]
    return {"features": [f for _, f in found]} | {f.name: [s[k] for s, _ in found] for k, f in enumerate(BASE.fields)}


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def verdicts(found: list[tuple[list[int], list[float]]], forest: Forest, least: float) -> tuple[list[bool], np.ndarray, list[bool]]:
    failed = [base_failed(s[0], s[4]) for s, _ in found]
    x = np.array([f for _, f in found], np.float32).astype(float).reshape(len(found), len(FEATURES))
    good = 1 / (1 + np.exp(-forest.score(x)))
    return failed, good, [not f and p >= least for f, p in zip(failed, good.tolist())]


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 20_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    good (probability of good quality by the trees), kept (not base_failed and ``good >= least``).

    ``labels`` (doc_id, quality 0/1) train the trees on at most ``sample`` labelled documents. NULL or empty text: no words,
    so base_failed. Without labels the trees say 0.5 for all and nothing but base_failed rejects. Repeated rows are judged
    alike; an id labelled twice takes its lower label. Ids may be NULL; empty input: no rows.
    """
    forest = train(docs, labels, sample)

    def judge(batch: list[str]) -> dict[str, list]:
        found = [statistics(t) for t in batch]
        failed, good, kept = verdicts(found, forest, least)
        return {f.name: [s[k] for s, _ in found] for k, f in enumerate(BASE.fields)} | {"base_failed": failed, "good": good.tolist(), "kept": kept}

    schema = T.StructType([*BASE.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("good", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return map_texts(only(docs, doc_id="long", text="string"), "text", judge, schema).drop("text")


def only_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    forest = train(docs, labels, sample)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in texts(batch.column("text"))]
        return batch.filter(pa.array(verdicts(found, forest, least)[2], pa.bool_()))

    return change_rows(docs, keep)
