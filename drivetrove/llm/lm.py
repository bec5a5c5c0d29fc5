"""Language-model scoring by a weighted backoff automaton.

Histories that the training texts hold are states, each seen continuation is an arc with its log probability, and a failure arc leads
from a history to the one without its first word, at the cost of the backoff weight. A text is scored by one traversal from the start
state: a token takes the arc of the state, or failure arcs until there is one. Smoothing is interpolated, so arcs and failures
together give P(w | h) = (c(hw) + strength * P(w | shorter h)) / (c(h) + strength).

The counts of the whole corpus are never gathered: a block of documents gets the exact counts of just those n-grams that it
holds, builds the part of the automaton that its texts can reach, and steps all its texts through it together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .aligned import BLOCK_BYTES, bucket_bounds, mixed, pack, pack_sorted, unpack, unpack_sorted
from .common import held_out, materialize, only, small_batches, texts, utf8

#: Hashes of the marks before and after a text; no word hashes to them but by the chance of any two 64-bit hashes.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
BLOCKS = "block long, n_tokens long, doc_ids array<bigint>, held array<boolean>, sizes array<int>, words binary, vocabulary binary"
SENT = "bucket int, block long, length int, keys binary, counts binary"
BACK = "block long, bucket int, length int, counts binary, found long, total long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Text of one block; keys are exchanged in buckets of twice that, so that a task that builds an automaton stays small.
LM_BLOCK_BYTES = BLOCK_BYTES // 2
#: Tokens that one lane of the traversal takes; a longer text is several lanes.
LANE = 512
#: Bits of a key of several words beyond those that number the tokens.
SPARE_BITS = 20


class Places(dict):
    """Numbers of byte strings in the order of their first use."""

    def __missing__(self, key: bytes) -> int:
        self[key] = place = len(self)
        return place


def stored_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``docs`` (doc_id, text, held_out) in blocks of about ``block_bytes`` of neighbouring texts, one row each: token ids by text (the end
    counts as a token) and the sorted hashes that they number."""

    def block_of(block: int, ids: list, held: list, lines: list[np.ndarray], places: Places) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else int(END) for w in places), np.uint64, len(places))
        vocabulary, rank = np.unique(hashes, return_inverse=True)
        words = rank[np.concatenate(lines)].astype(np.uint32)
        row = (block, len(words), ids, held, [len(x) for x in lines], pack(words), pack_sorted(vocabulary))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["block", "n_tokens", "doc_ids", "held", "sizes", "words", "vocabulary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_block = TaskContext.get().partitionId() << 32
        ids, held, lines, places, size = [], [], [], Places(), 0
        for batch in batches:
            for part in small_batches(batch, "text"):
                for doc_id, out, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts(part.column("text"))):
                    words = utf8(text).lower().split()
                    words.append(b"")
                    lines.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
                    ids.append(doc_id)
                    held.append(out)
                    size += len(text) + 64
                    if size >= block_bytes:
                        yield block_of(next_block, ids, held, lines, places)
                        next_block += 1
                        ids, held, lines, places, size = [], [], [], Places(), 0
        if ids:
            yield block_of(next_block, ids, held, lines, places)

    return materialize(docs.mapInArrow(run, BLOCKS), "lm-blocks")


class Grams:
    """N-grams of a stored block: sorted keys by length, where each token's n-gram is among them, and one token that ends each."""

    def __init__(self, block: dict, order: int, shift: int):
        self.sizes = np.array(block["sizes"], np.int64)
        words, vocabulary = unpack(block["words"], np.uint32), unpack_sorted(block["vocabulary"])
        first = np.cumsum(self.sizes) - self.sizes
        self.depth = np.arange(len(words)) - np.repeat(first, self.sizes) + 1  # words since the start mark, which is 0
        self.start = first
        padded = np.concatenate([np.full(order, START), vocabulary[words]])  # what reaches beyond the start mark is never a key
        gram, here = padded[order:], np.arange(len(words)) + order
        self.keys, self.at, self.ends = [vocabulary], [words.astype(np.int64)], [np.zeros(0, np.int64)]
        for length in range(2, order + 1):
            old = padded[here - length + 1]
            gram = mixed(gram, np.where(self.depth == length - 1, START, old))
            fits = np.flatnonzero(self.depth >= length - 1)
            keys, one, place = np.unique(gram[fits] >> np.uint64(shift), return_index=True, return_inverse=True)
            at = np.full(len(words), -1, np.int64)
            at[fits] = place
            self.keys.append(keys)
            self.at.append(at)
            self.ends.append(fits[one])

    def train_counts(self, held: np.ndarray) -> list[np.ndarray]:
        used = np.repeat(~held, self.sizes)
        return [np.bincount(at[used & (at >= 0)], minlength=len(keys)).astype(np.uint32) for keys, at in zip(self.keys, self.at)]


class Automaton:
    """States, arcs and failure arcs of the histories that a block's texts can be in.

    State 0 is the empty history, 1 the start of a text, and each n-gram shorter than the order has a number after these. Arcs lie
    sorted by state and word (``arcs``), with their weight and the state they lead to; ``fail`` and ``backoff`` belong to states.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], known: int, total: int, add: float, strength: float):
        self.words, order = max(1, len(grams.keys[0])), len(counts)
        base = 2 + np.cumsum([0, *[len(k) for k in grams.keys[:order - 1]]])  # first state of each length
        space = total + add * (known + 1)
        self.unknown = np.log10(add / space)
        ended = np.searchsorted(grams.keys[0], END)
        trained = float(counts[0][ended]) if ended < len(counts[0]) else 0.0
        states = int(base[order - 1])
        self.fail, self.backoff = np.zeros(states, np.int64), np.zeros(states)
        self.start = 1 if trained and order > 1 else 0
        self.backoff[1] = np.log10(strength / (trained + strength))
        arcs, weights, leads = [], [], []
        lower = np.zeros(0)  # weights of the arcs one shorter, by n-gram
        for length in range(1, order + 1):
            n = counts[length - 1].astype(float)
            if length == 1:
                weight = np.log10((n + add) / space)
                state, word, suffix = np.zeros(len(n), np.int64), np.arange(len(n)), np.zeros(len(n), np.int64)
            else:
                end = grams.ends[length - 1]
                word, tail = grams.at[0][end], grams.at[length - 2][end]
                before = grams.at[length - 2][end - 1]
                at_start = (grams.depth[end] == 1) if length == 2 else np.zeros(len(end), bool)
                state = np.where(at_start, 1, base[length - 2] + before)
                seen = np.where(at_start, trained, counts[length - 2].astype(float)[before]) if len(end) else np.zeros(0)
                weight = np.log10((n + strength * 10.0 ** lower[tail]) / (seen + strength))
                suffix = base[length - 2] + tail
            if length < order:
                own = base[length - 1] + np.arange(len(n))
                self.fail[own], self.backoff[own] = suffix, np.log10(strength / (n + strength))
            else:
                own = suffix  # the longest history that an arc of full length leads to
            there = n > 0
            arcs.append((state * self.words + word)[there])
            weights.append(weight[there])
            leads.append(own[there])
            lower = weight
        sort = np.argsort(found := np.concatenate(arcs), kind="stable")
        self.arcs, self.weight, self.lead = found[sort], np.concatenate(weights)[sort], np.concatenate(leads)[sort]
        self.order = order

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after ``word`` and the log probabilities of all arcs on the way."""
        state, gained, after = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            wanted = state[left] * self.words + word[left]
            place = np.minimum(np.searchsorted(self.arcs, wanted), max(0, len(self.arcs) - 1))
            hit = self.arcs[place] == wanted if len(self.arcs) else np.zeros(len(left), bool)
            done = left[hit]
            gained[done] += self.weight[place[hit]]
            after[done] = self.lead[place[hit]]
            left = left[~hit]
            lost = state[left] == 0  # a word that no training text holds
            gained[left[lost]] += self.unknown
            left = left[~lost]
            gained[left] += self.backoff[state[left]]
            state[left] = self.fail[state[left]]
        return after, gained

    def scores(self, grams: Grams) -> np.ndarray:
        """Log probability of each text: all are traversed together, a token a step. A state depends on the last words alone, so
        lanes within a long text start a history earlier, from the empty one, and count from their first own token."""
        lanes = np.maximum(1, -(-grams.sizes // LANE))
        text = np.repeat(np.arange(len(grams.sizes)), lanes)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        size = np.minimum(grams.sizes[text] - begin, LANE)
        warm = np.minimum(begin, self.order - 1)
        steps = size + warm
        by_length = np.argsort(-steps, kind="stable")
        text, begin, warm, steps = text[by_length], begin[by_length], warm[by_length], steps[by_length]
        place, state, sums = grams.start[text] + begin - warm, np.where(begin == 0, self.start, 0), np.zeros(len(text))
        active = len(text)
        for t in range(int(steps[0]) if len(steps) else 0):
            while steps[active - 1] <= t:
                active -= 1
            state[:active], gained = self.step(state[:active], grams.at[0][place[:active] + t])
            sums[:active] += np.where(t >= warm[:active], gained, 0.0)
        return np.bincount(text, sums, len(grams.sizes))


def lm_scores(docs: DataFrame, order: int = 3, add: float = 0.1, strength: float = 300.0, folds: int = 10, block_bytes: int = LM_BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows that aren't held out (``crc32(doc_id as text) % folds != 0``), scored on all. Tokens are the words of
    the text, A-Z in lower case, and one end. base_score: unigrams with ``add`` added. score: the log10 probability by the automaton of
    n-grams up to ``order``; a history never seen is passed over. The default strength is about the best for held-out texts of the test
    tables. Words are told apart by 64-bit hashes; keys of longer n-grams have 20 bits more than the number of tokens takes, so one
    in a million shares its count with another.

    NULL or empty text: just the end token. NULL id: counts as the text '' for the fold. Repeated rows count as often as they
    stand there. Without training rows every count is 0. Empty input: no rows.
    """
    base = only(docs, doc_id="long", text="string").withColumn("held_out", held_out("doc_id", folds))
    blocks = stored_blocks(base, block_bytes)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    n = max(1, ceil(tokens * 3 / block_bytes))
    shift = max(0, 64 - SPARE_BITS - ceil(log2(tokens + 1)))

    def shifts(length: int) -> int:
        return shift if length > 1 else 0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                grams = Grams(block, order, shift)
                out = []
                for length, (keys, counts) in enumerate(zip(grams.keys, grams.train_counts(np.array(block["held"], bool))), 1):
                    cut = bucket_bounds(keys, n, shifts(length))
                    out += [(b, block["block"], length, pack_sorted(keys[i:j]), pack(counts[i:j])) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["bucket", "block", "length", "keys", "counts"])

    def add_up(rows: pa.Table) -> pa.Table:
        out = []
        for length in range(1, order + 1):
            part = [r for r in rows.to_pylist() if r["length"] == length]
            if not part:
                continue
            keys, counts = [unpack_sorted(r["keys"]) for r in part], [unpack(r["counts"], np.uint32) for r in part]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.uint64)
            told, at = ((int((sums > 0).sum()), int(sums.sum())) if length == 1 else (0, 0)), 0
            for r, k in zip(part, keys):
                out.append((r["block"], r["bucket"], length, pack(sums[place[at:at + len(k)]]), *told))
                told, at = (0, 0), at + len(k)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["block", "bucket", "length", "counts", "found", "total"])

    answers = materialize(blocks.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(add_up, BACK), "ngrams")
    sums = answers.agg(F.sum("found").alias("v"), F.sum("total").alias("n")).first()
    known, total = int(sums["v"] or 0), int(sums["n"] or 0)

    def score(rows: pa.Table, back: pa.Table) -> pa.Table:
        block = rows.to_pylist()[0]
        grams = Grams(block, order, shift)
        told = sorted((r["length"], r["bucket"], r["counts"]) for r in back.to_pylist())
        counts = [np.concatenate([np.zeros(0, np.uint64), *[unpack(c, np.uint64) for k, _, c in told if k == length]]) for length in range(1, order + 1)]
        single = counts[0][grams.at[0]].astype(float)
        base_score = np.add.reduceat(np.log10((single + add) / (total + add * (known + 1))), grams.start)
        n_known = np.add.reduceat((single > 0).astype(np.int64), grams.start)
        model = Automaton(grams, counts, known, total, add, strength).scores(grams)
        return pa.table([pa.array(block["doc_ids"], pa.int64()), pa.array(block["held"], pa.bool_()), pa.array(grams.sizes), pa.array(n_known),
                         pa.array(np.full(len(model), total, np.int64)), pa.array(base_score), pa.array(model)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
