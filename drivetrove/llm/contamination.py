"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

The automaton reads word numbers instead of characters: a text is normalised and split in one pass over its bytes,
words unknown to the benchmark become one number that no pattern holds, and the automaton meets each word once. Offsets
of the hit words in the original text are worked out only for texts with a hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import only, small_batches, texts, utf8

WINDOW = 13
#: Normalisation on UTF-8 bytes: A-Z become a-z, all that ends a word becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORDS = re.compile(rb"[^ ]+")

RANGES = T.ArrayType(T.ArrayType(T.IntegerType()))
SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()),
    T.StructField("hit_spans", RANGES), T.StructField("contaminated", T.BooleanType()),
])


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


def windows(found: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(found[i:i + size]) for i in range(max(1, len(found) - size + 1))] if found else []


class Automaton:
    """Windows of the items as patterns over word numbers; built once per Python worker from the items' texts."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.number: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            for window in windows(words(text), size):
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                patterns.setdefault(key, set()).add(item)
        self.find = None
        if patterns:
            self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, owners in patterns.items():
                self.find.add_word(key, (len(key), owners))
            self.find.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges that are hit, and the items behind them."""
        if self.find is None or not found:
            return [], set()
        ranges: list[list[int]] = []
        items: set[str] = set()
        for end, (length, owners) in self.find.iter(tuple(map(self.number.get, found, repeat(0)))):
            start = end - length + 1
            while ranges and start <= ranges[-1][1]:
                start = min(start, ranges.pop()[0])
            ranges.append([start, end + 1])
            items |= owners
        return [(a, b) for a, b in ranges], {x for x in items if x is not None}


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Code point offsets in the original text of ranges of words."""
    raw = utf8(text)
    places = [m.span() for m in _WORDS.finditer(raw.translate(FOLD))]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [[int(before[places[a][0]]), int(before[places[b - 1][1]])] for a, b in ranges]


def blocks_of(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The test items in blocks of at most ``limit`` bytes of text (one item at least), streamed through the driver; at least
    one block, which may be empty."""
    block: list[tuple[str | None, str | None]] = []
    held = 0
    for row in only(benchmark, item_id="string", text="string").toLocalIterator():
        size = len(utf8(row["text"]))
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += size
    yield block


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode("utf-8", "surrogatepass")).hexdigest()


Found = tuple[int, list[tuple[int, int]], list[str]]


def scanned(docs: DataFrame, benchmark: DataFrame, text: str, window: int, block_bytes: int, finish: Callable[[pa.RecordBatch, list[Found]], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``finish`` of each batch of ``docs`` and, for each text, its number of words, the word ranges hit and the items. Texts go to Python
    once and are split once; only a benchmark of several blocks takes a pass more for each block but the last."""
    spark, blocks = docs.sparkSession, blocks_of(benchmark, block_bytes)
    last = next(blocks)
    added = [T.StructField("_ranges", RANGES), T.StructField("_items", T.ArrayType(T.StringType()))]
    kinds = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]

    def scan(block, last_one: bool):
        built: list[Automaton] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not built:
                built.append(Automaton(block.value, window))
            for batch in batches:
                for part in small_batches(batch, text):
                    before = zip(part.column("_ranges").to_pylist(), part.column("_items").to_pylist()) if "_ranges" in part.schema.names else repeat(([], []))
                    found: list[Found] = []
                    for t, (ranges, owners) in zip(part.column(text).to_pylist(), before):
                        split = words(t)
                        hit, items = built[0].scan(split)
                        found.append((len(split), merged(hit + [tuple(r) for r in ranges]) if ranges else hit, sorted(items.union(owners))))
                    part = part.select([n for n in part.schema.names if n not in ("_ranges", "_items")])
                    if last_one:
                        yield finish(part, found)
                    else:
                        yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([f[k] for f in found], kind) for k, kind in zip((1, 2), kinds)]], [*part.schema.names, "_ranges", "_items"])

        return run

    whole = T.StructType([*docs.schema.fields, *added])
    for block in blocks:
        docs = docs.mapInArrow(scan(spark.sparkContext.broadcast(last), False), whole)
        last = block
    return docs.mapInArrow(scan(spark.sparkContext.broadcast(last), True), schema)


def contaminated(n_words: int, n_hit: int, share: int = 20) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): how much of its text the benchmark (item_id, text) holds.

    Columns: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items (ids, sorted as text),
    items_sha256, hit_spans (merged hits in the original text: code points, end exclusive), contaminated
    (``share * n_hit >= n_words`` with a hit). A window is ``window`` consecutive item words; an item of fewer words, but not
    none, is one window.

    Items go to the workers in blocks of at most ``block_bytes`` of text; a larger benchmark takes more passes, each with one
    block. NULL text has no words. An item without id hits words, but is not listed. Repeated items count once; repeated
    documents are judged alike. Empty benchmark: nothing is hit.
    """

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.list_(pa.int32())), pa.bool_()]

    def judge(part: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        hits = [sum(b - a for a, b in ranges) for _, ranges, _ in found]
        made = [[n for n, _, _ in found], hits, [len(items) for *_, items in found], [items for *_, items in found], [digest(items) for *_, items in found],
                [offsets(t, ranges) if ranges else [] for t, (_, ranges, _) in zip(texts(part.column("text")), found)], [contaminated(f[0], h, share) for f, h in zip(found, hits)]]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, made, kinds)], ["doc_id", *SCHEMA.names])

    return scanned(only(docs, doc_id="long", text="string"), benchmark, "text", window, block_bytes, judge, T.StructType([T.StructField("doc_id", T.LongType()), *SCHEMA.fields]))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay as they are, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index("text")
    renamed = docs.toDF(*names)

    def keep(part: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        return part.filter(pa.array([not contaminated(n, sum(b - a for a, b in ranges), share) for n, ranges, _ in found], pa.bool_()))

    return scanned(renamed, benchmark, names[at], window, block_bytes, keep, renamed.schema).toDF(*docs.columns)
