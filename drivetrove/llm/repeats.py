"""Removal of repeated passages by sorting suffixes: a byte goes if a string of `length` bytes over it also starts earlier.

Only suffixes at anchors are sorted. Anchors are the minimisers of the text's k-grams, so they depend on content alone and
every string of `length` bytes holds one at the same place wherever it occurs. Three exchanges between blocks of documents
narrow the work down (see ``aligned``):

1. hashes of the anchors' k-grams tell which anchors occur elsewhere, and whether in other surroundings;
2. of those, hashes of the whole surroundings tell which occurrence comes first. All others are covered whole;
3. first occurrences whose k-gram has several surroundings go to a merge sort: each block sends sorted, front-coded runs of
   suffixes, loser trees combine them without comparing known prefixes again, and the common prefixes that they leave
   behind group the strings around each anchor.

K-grams with too many surroundings for one task skip step 3; hashes of the single strings around them join step 2 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .aligned import BLOCK_BYTES, bucket_bounds, in_blocks, pack, pack_sorted, sorted_rows, unpack, unpack_sorted
from .common import only, texts, utf8

GRAM = 32
LAST = np.int64(2**63 - 1)  # where NULL ids sort
SEEN, VARIED, HOT = 1, 2, 4
SENT = "bucket int, block int, keys binary, facts binary, extra binary"
BACK = "block int, bucket int, answers binary, kind int"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(raw: bytes) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    x = (np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    span = 1
    while span < GRAM:
        x = x[:-span] * np.uint64(0xBF58476D1CE4E5B9) + x[span:]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        span *= 2
    return x


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[:-(width - span)], values[width - span:]) if span < width else values


class Anchors:
    """Anchors of a block's documents: k-gram hash, row and place; rows in an order that every pass repeats."""

    def __init__(self, rows: pa.Table, length: int):
        self.length, self.reach = length, length - GRAM
        self.rows = sorted_rows(rows)
        self.raw = [utf8(t) for t in texts(self.rows.column("text"))]
        self.ids = np.array([LAST if i is None else i for i in self.rows.column("doc_id").to_pylist()], np.int64)
        hashes, row, place = [], [], []
        for r, raw in enumerate(self.raw):
            if len(raw) < length:
                continue
            grams = gram_hashes(raw)
            order = (grams >> np.uint64(32)).astype(np.uint32)
            least = sliding(order, self.reach + 1, np.minimum)
            pad = np.zeros(self.reach, np.uint32)
            at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), self.reach + 1, np.maximum) == order)
            hashes.append(grams[at])
            place.append(at.astype(np.int64))
            row.append(np.full(len(at), r, np.int64))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hash, self.row, self.place = join(hashes, np.uint64), join(row, np.int64), join(place, np.int64)
        self.keys, self.at = np.unique(self.hash, return_inverse=True)

    def around(self, i: int) -> tuple[bytes, bytes]:
        """Up to ``reach`` bytes before an anchor, and up to ``length`` from it on."""
        raw, p = self.raw[self.row[i]], int(self.place[i])
        return raw[max(0, p - self.reach):p], raw[p:p + self.length]

    def surroundings(self, some: np.ndarray) -> np.ndarray:
        hashed = xxhash.xxh3_64_intdigest
        raw, row, place, reach, length = self.raw, self.row, self.place, self.reach, self.length
        out = np.empty(len(some), np.uint64)
        for k, (r, p) in enumerate(zip(row[some].tolist(), place[some].tolist())):
            a = max(0, p - reach)
            out[k] = hashed(raw[r][a:p + length], p - a)
        return out

    def strings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each string of ``length`` bytes around the anchors ``some``: hash, row, start."""
        hashed, out = xxhash.xxh3_64_intdigest, []
        pairs = {(int(self.row[i]), s) for i in some for s in range(max(0, int(self.place[i]) - self.reach), min(int(self.place[i]), len(self.raw[self.row[i]]) - self.length) + 1)}
        for r, s in sorted(pairs):
            out.append((hashed(self.raw[r][s:s + self.length], 7), r, s))
        return (np.array([x[0] for x in out], np.uint64), np.array([x[1] for x in out], np.int64), np.array([x[2] for x in out], np.int64))


def framed(rows: list[tuple], names: list[str], kinds: tuple) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


SENT_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
SENT_NAMES = ["bucket", "block", "keys", "facts", "extra"]
BACK_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.int32())
BACK_NAMES = ["block", "bucket", "answers", "kind"]


def answers_of(back: pa.Table, kind: int, dtype: type) -> np.ndarray:
    found = sorted((r["bucket"], r["answers"]) for r in back.to_pylist() if r["kind"] == kind)
    return np.concatenate([np.zeros(0, dtype), *[unpack(a, dtype) for _, a in found]])


# -- step 1: which k-grams repeat ------------------------------------------------------------------------------------

def send_grams(rows: pa.Table, n: int, length: int) -> pa.Table:
    block = rows.column("block")[0].as_py()
    anchors = Anchors(rows, length)
    look = (anchors.surroundings(np.arange(len(anchors.hash))) >> np.uint64(32)).astype(np.uint32)
    count = np.bincount(anchors.at, minlength=len(anchors.keys)).astype(np.uint32)
    low, high = np.full(len(anchors.keys), 2**32 - 1, np.uint32), np.zeros(len(anchors.keys), np.uint32)
    np.minimum.at(low, anchors.at, look)
    np.maximum.at(high, anchors.at, look)
    count = np.minimum(count, 2**31 - 1) * 2 + (low != high)  # lowest bit: several surroundings within the block
    cut = bucket_bounds(anchors.keys, n)
    return framed([(b, block, pack_sorted(anchors.keys[i:j]), pack(low[i:j]), pack(count[i:j].astype(np.uint32)))
                   for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j], SENT_NAMES, SENT_KINDS)


def judge_grams(rows: pa.Table, hot: int) -> pa.Table:
    parts = rows.to_pylist()
    keys, look = [unpack_sorted(r["keys"]) for r in parts], np.concatenate([unpack(r["facts"], np.uint32) for r in parts])
    count = np.concatenate([unpack(r["extra"], np.uint32) for r in parts])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, count // 2, len(distinct))
    low, high = np.full(len(distinct), 2**32 - 1, np.uint32), np.zeros(len(distinct), np.uint32)
    np.minimum.at(low, at, look)
    np.maximum.at(high, at, look)
    varied = (low != high) | (np.bincount(at, count % 2, len(distinct)) > 0)
    told = (SEEN * (total > 1) + VARIED * varied + HOT * (varied & (total > hot))).astype(np.uint8)[at]
    out, start = [], 0
    for r, k in zip(parts, keys):
        out.append((r["block"], r["bucket"], pack(told[start:start + len(k)]), 1))
        start += len(k)
    return framed(out, BACK_NAMES, BACK_KINDS)


# -- step 2: which surroundings, or strings around hot k-grams, come first -------------------------------------------

class Claims:
    """What a block asks in step 2: hashes with the document and start of their first occurrence in the block."""

    def __init__(self, anchors: Anchors, told: np.ndarray):
        self.of_anchor = told[anchors.at] if len(anchors.at) else np.zeros(0, np.uint8)
        some = np.flatnonzero(self.of_anchor & SEEN)
        hot = some[(self.of_anchor[some] & HOT) > 0]
        look = anchors.surroundings(some)
        strings, s_row, s_start = anchors.strings(hot)
        self.some, self.n_some, self.s_row, self.s_start = some, len(some), s_row, s_start
        every = np.concatenate([look, strings])
        ids = anchors.ids[np.concatenate([anchors.row[some], s_row])]
        start = np.concatenate([anchors.place[some], s_start])
        order = np.lexsort((start, ids, every))
        self.keys, first, self.at = np.unique(every[order], return_index=True, return_inverse=True)
        self.at = self.at[np.argsort(order)]  # back to the order asked in
        self.ids, self.start = ids[order][first], start[order][first]
        self.own_first = (ids == self.ids[self.at]) & (start == self.start[self.at])


def send_claims(rows: pa.Table, back: pa.Table, n: int, length: int) -> pa.Table:
    block = rows.column("block")[0].as_py()
    told = answers_of(back, 1, np.uint8)
    claims = Claims(Anchors(rows, length), told)
    cut = bucket_bounds(claims.keys, n)
    out = [(b, block, pack_sorted(claims.keys[i:j]), pack(claims.ids[i:j]), pack(claims.start[i:j].astype(np.uint32)))
           for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]
    out += [(r["bucket"], block, None, r["answers"], None) for r in back.to_pylist()]  # step 1's answers, for step 3
    return framed(out, SENT_NAMES, SENT_KINDS)


def judge_claims(rows: pa.Table) -> pa.Table:
    every = rows.to_pylist()
    out = [(r["block"], r["bucket"], r["facts"], 1) for r in every if r["keys"] is None]
    parts = [r for r in every if r["keys"] is not None]
    if parts:
        keys = [unpack_sorted(r["keys"]) for r in parts]
        ids = np.concatenate([unpack(r["facts"], np.int64) for r in parts])
        start = np.concatenate([unpack(r["extra"], np.uint32) for r in parts])
        flat = np.concatenate(keys)
        order = np.lexsort((start, ids, flat))
        _, first, at = np.unique(flat[order], return_index=True, return_inverse=True)
        told = np.empty(len(flat), np.uint8)
        told[order] = (ids[order] == ids[order][first][at]) & (start[order] == start[order][first][at])
        begin = 0
        for r, k in zip(parts, keys):
            out.append((r["block"], r["bucket"], pack(told[begin:begin + len(k)]), 2))
            begin += len(k)
    return framed(out, BACK_NAMES, BACK_KINDS)


# -- step 3: sorted runs of suffixes and their merge -----------------------------------------------------------------

def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    most = min(len(a), len(b))
    if a[start:most] == b[start:most]:
        return most
    step = start
    while a[step:step + 16] == b[step:step + 16]:
        step += 16
    while a[step] == b[step]:
        step += 1
    return step


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Of a sorted run: prefix shared with the one before and length of the rest, by suffix; the rests."""
    sizes, rests, last = np.zeros((len(suffixes), 2), np.uint16), [], b""
    for k, s in enumerate(suffixes):
        shared = common(last, s, 0)
        sizes[k] = shared, len(s) - shared
        rests.append(s[shared:])
        last = s
    return sizes, b"".join(rests)


def decoded(sizes: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """Suffixes of a run with the prefix that each shares with the one before."""
    last, at = b"", 0
    for shared, rest in sizes.tolist():
        last = last[:shared] + rests[at:at + rest]
        at += rest
        yield shared, last


class LoserTree:
    """Merges sorted runs. A waiting suffix knows how much it shares with the winner it lost to; of two candidates that know
    it about the same winner the longer share is smaller, and only equal shares are compared, from there on."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs, self.k = runs, 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list[bytes | None] = [None] * self.k
        self.share = [0] * self.k
        self.loser = [-1] * self.k
        for i, run in enumerate(runs):
            _, self.head[i] = next(run, (0, None))
        self.winner = self._build(1) if self.k > 1 else 0

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._match(node, self._build(2 * node), self._build(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """Lets a and b meet; the loser stays in ``node`` and learns what it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None or x is None:
            win, lose = (a, b) if y is None else (b, a)
        elif self.share[a] != self.share[b]:
            win, lose = (a, b) if self.share[a] > self.share[b] else (b, a)  # the loser's share with the winner stays as it was
        else:
            shared = common(x, y, self.share[a])
            win, lose = (a, b) if (x[shared:shared + 1], a) <= (y[shared:shared + 1], b) else (b, a)
            self.share[lose] = shared
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(run, prefix shared with the suffix before, suffix) in order."""
        while self.head[self.winner] is not None:
            win = self.winner
            yield win, self.share[win], self.head[win]
            self.share[win], self.head[win] = next(self.runs[win], (0, None))
            node = (win + self.k) // 2
            while node:
                win = self._match(node, win, self.loser[node])
                node //= 2
            self.winner = win


def covered(anchors: Anchors, claims: Claims, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (row, start, end) that step 2 settles, and the anchors left for step 3."""
    is_first = claims.own_first & (first[claims.at] > 0) if len(claims.at) else np.zeros(0, bool)
    later = claims.some[~is_first[:claims.n_some]]
    row, place = anchors.row[later], anchors.place[later]
    sizes = np.array([len(x) for x in anchors.raw], np.int64)
    whole = np.column_stack([row, np.maximum(0, place - anchors.reach), np.minimum(sizes[row], place + anchors.length)])
    gone = ~is_first[claims.n_some:]
    single = np.column_stack([claims.s_row[gone], claims.s_start[gone], claims.s_start[gone] + anchors.length])
    spans = np.concatenate([whole[whole[:, 2] - whole[:, 1] >= anchors.length], single])
    left = claims.some[is_first[:claims.n_some]]
    told = claims.of_anchor[left]
    return spans, left[(told & VARIED > 0) & (told & HOT == 0)]


def send_runs(rows: pa.Table, back: pa.Table, n: int, length: int) -> pa.Table:
    block = rows.column("block")[0].as_py()
    anchors = Anchors(rows, length)
    claims = Claims(anchors, answers_of(back, 1, np.uint8))
    spans, left = covered(anchors, claims, answers_of(back, 2, np.uint8))
    out = []
    if len(spans):
        out.append((block % n, block, None, pack(np.ascontiguousarray(spans).ravel()), None))
    bucket = (anchors.hash[left] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    for b in np.unique(bucket).tolist():
        some = left[bucket == b]
        near = [anchors.around(i) for i in some.tolist()]
        order = sorted(range(len(near)), key=lambda k: near[k][1])
        sizes, rests = front_coded([near[k][1] for k in order])
        sizes = np.column_stack([sizes, np.array([len(near[k][0]) for k in order], np.uint16)])
        chosen = some[order]
        facts = np.column_stack([anchors.ids[anchors.row[chosen]], anchors.place[chosen], chosen])
        out.append((b, block, pack(np.ascontiguousarray(sizes).ravel()), pack(facts.ravel()),
                    pack(np.frombuffer(rests + b"".join(near[k][0] for k in order), np.uint8))))
    return framed(out, SENT_NAMES, SENT_KINDS)


def merge_runs(rows: pa.Table, length: int) -> pa.Table:
    """Strings around the anchors of a bucket that start earlier elsewhere: per block (anchor, first offset, last offset)."""
    every = rows.to_pylist()
    out = [(r["block"], r["bucket"], r["facts"], 3) for r in every if r["keys"] is None]
    parts = sorted((r for r in every if r["keys"] is not None), key=lambda r: r["block"])
    if not parts:
        return framed(out, BACK_NAMES, BACK_KINDS)
    reach, runs, facts, befores = length - GRAM, [], [], []
    for r in parts:
        sizes = unpack(r["keys"], np.uint16).reshape(-1, 3)
        blob = unpack(r["extra"], np.uint8).tobytes()
        split = int(sizes[:, 1].sum())
        runs.append(decoded(sizes[:, :2], blob[:split]))
        facts.append(unpack(r["facts"], np.int64).reshape(-1, 3))
        ends = split + np.cumsum(sizes[:, 2], dtype=np.int64)
        befores.append([blob[e - s:e] for e, s in zip(ends.tolist(), sizes[:, 2].tolist())])
    taken, run, shares, size, before, index = [0] * len(runs), [], [], [], [], []
    for which, share, suffix in LoserTree(runs):
        run.append(which)
        index.append(taken[which])
        shares.append(share)
        size.append(len(suffix))
        before.append(befores[which][taken[which]])
        taken[which] += 1
    run_, index_ = np.array(run), np.array(index)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in facts])[:-1]])
    fact = np.concatenate(facts)[offsets[run_] + index_]
    share, size_ = np.array(shares), np.array(size)
    left_size = np.array([len(b) for b in before])
    left = np.frombuffer(b"".join(b[::-1].ljust(reach, b"\0") for b in before), np.uint8).reshape(-1, reach).astype(np.uint64)
    rank = np.empty(len(fact), np.int64)
    order = np.lexsort((fact[:, 1], fact[:, 0]))
    moved = np.concatenate([[0], np.cumsum((np.diff(fact[order, 0]) != 0) | (np.diff(fact[order, 1]) != 0))])
    rank[order] = moved  # by document and place; equal pairs alike
    # only suffixes whose k-gram another one shares can repeat
    group = np.cumsum(share < GRAM)
    busy = np.bincount(group)[group] > 1
    low, high = np.full(len(fact), reach + 1), np.full(len(fact), -1)
    hashed, some = np.zeros(len(fact), np.uint64), np.flatnonzero(busy)
    for offset in range(reach + 1):  # strings that start `offset` bytes before the anchor
        if offset:
            hashed = (hashed ^ (left[:, offset - 1] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(31)
        need = length - offset
        right = np.cumsum(share < need)
        rows_ = some[(left_size[some] >= offset) & (size_[some] >= need)]
        if not len(rows_):
            continue
        key = np.lexsort((rank[rows_], hashed[rows_], right[rows_]))
        rows_ = rows_[key]
        new = np.concatenate([[True], (np.diff(right[rows_]) != 0) | (hashed[rows_][1:] != hashed[rows_][:-1])])
        first = rank[rows_][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = rows_[rank[rows_] > first]
        low[later] = np.minimum(low[later], offset)
        high[later] = offset
    hit = np.flatnonzero(high >= 0)
    for which, r in enumerate(parts):
        own = hit[run_[hit] == which]
        if len(own):
            out.append((r["block"], r["bucket"], pack(np.column_stack([fact[own, 2], low[own], high[own]]).astype(np.int64).ravel()), 4))
    return framed(out, BACK_NAMES, BACK_KINDS)


# -- the result ------------------------------------------------------------------------------------------------------

def merged_spans(spans: np.ndarray, sizes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Maximal runs by row; ``spans`` has row, start, end."""
    base = np.concatenate([[0], np.cumsum(sizes + 1)])  # one line for all rows, with a gap between them
    start, end = base[spans[:, 0]] + spans[:, 1], base[spans[:, 0]] + spans[:, 2]
    order = np.argsort(start, kind="stable")
    start, end, row = start[order], np.maximum.accumulate(end[order]) if len(end) else end, spans[order, 0]
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
    last = np.append(new[1:] - 1, len(start) - 1) if len(new) else new
    out: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(row[new].tolist(), start[new].tolist(), end[last].tolist()):
        out.setdefault(r, []).append((a - int(base[r]), b - int(base[r])))
    return out


def finish(rows: pa.Table, back: pa.Table, length: int, with_text: bool) -> pa.Table:
    found = back.to_pylist()
    spans = [unpack(r["answers"], np.int64).reshape(-1, 3) for r in found if r["kind"] == 3]
    hits = [unpack(r["answers"], np.int64).reshape(-1, 3) for r in found if r["kind"] == 4]
    if hits:
        anchors, hit = Anchors(rows, length), np.concatenate(hits)
        place = anchors.place[hit[:, 0]]
        spans.append(np.column_stack([anchors.row[hit[:, 0]], place - hit[:, 2], place - hit[:, 1] + length]))
    rows = sorted_rows(rows)
    raws = [utf8(t) for t in texts(rows.column("text"))]
    runs_of = merged_spans(np.concatenate([np.zeros((0, 3), np.int64), *spans]), np.array([len(x) for x in raws], np.int64))
    n_bytes, removed, n_spans, digests, kept_texts = [], [], [], [], []
    for r, raw in enumerate(raws):
        kept, at, gone, runs = [], 0, 0, 0
        for a, b in runs_of.get(r, ()):
            runs += 1
            kept.append(raw[at:a])
            gone += b - a
            at = b
        kept.append(raw[at:])
        whole = b"".join(kept)
        n_bytes.append(len(raw))
        removed.append(gone)
        n_spans.append(runs)
        digests.append(hashlib.sha256(whole).hexdigest())
        kept_texts.append(whole)
    made = [rows.column("doc_id").combine_chunks(), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return pa.table([*made, pa.array(kept_texts, pa.binary())], [*names, "kept"]) if with_text else pa.table(made, names)


def without_repeats(docs: DataFrame, length: int = 100, block_bytes: int = BLOCK_BYTES, hot: int = 50_000, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and
    ``kept`` (the remaining bytes) if ``with_text``.

    Texts count as UTF-8 bytes and matches never cross documents. A byte goes if it is in a string of ``length`` bytes that
    also starts earlier, in a document with a smaller id or earlier in the same; strings are judged on the input. Strings of
    equal 64-bit hash count as equal. K-grams with over ``hot`` anchors in several surroundings are settled by hashes.

    NULL or empty text: nothing. NULL ids come after all others and count as one id. Rows with the same id count as one
    document: of two equal strings in them the earlier start stays, equal starts both stay. Empty input: no rows.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    blocks, n = in_blocks(only(docs, doc_id="long", text="string"), block_bytes)
    by_block = blocks.groupBy("block")
    one = by_block.applyInArrow(lambda t: send_grams(t, n, length), SENT).groupBy("bucket").applyInArrow(lambda t: judge_grams(t, hot), BACK)
    two = by_block.cogroup(one.groupBy("block")).applyInArrow(lambda t, b: send_claims(t, b, n, length), SENT) \
        .groupBy("bucket").applyInArrow(judge_claims, BACK)
    three = by_block.cogroup(two.groupBy("block")).applyInArrow(lambda t, b: send_runs(t, b, n, length), SENT) \
        .groupBy("bucket").applyInArrow(lambda t: merge_runs(t, length), BACK)
    return by_block.cogroup(three.groupBy("block")).applyInArrow(lambda t, b: finish(t, b, length, with_text), OUT + (", kept binary" if with_text else ""))
