"""Near-duplicates by MinHash bands, verified first by odd sketches and then on full shingle sets.

Equal sets collapse into one class before anything else. Inside a band bucket members are compared with one hub, the member
that meets most others over all its buckets, never all with all. Only where that leaves a bucket in several components, the
members outside the largest one are held against the others, in pairs of bounded blocks; a block tells one link between a
member and each other component at most, as more would join nothing. Odd sketches drop pairs that are below the threshold
beyond sampling error; the rest is confirmed on the sets themselves, so no link is wrong.
Missed links: two sets at the threshold share no band with probability (1 - 0.8^rows)^bands, 3e-5 for 20 bands of 4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .aligned import Hashes, mixed
from .common import materialize, only, small_batches, texts, utf8

SHINGLE, BANDS, ROWS = 4, 20, 4
K = BANDS * ROWS
#: Samples and bits of the odd sketches.
BINS, BITS = 2048, 4096
SIGMAS = 5
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 2**32, K, np.uint32) | np.uint32(1))
_B = _RNG.integers(0, 2**32, K, np.uint32)

FACTS = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("samples", T.IntegerType()),
])


def shingles(text: str, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, without words none."""
    words = utf8(text).lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    x = h[:len(h) - size + 1]
    for k in range(1, size):
        x = mixed(x, h[k:len(h) - size + 1 + k])
    return np.unique(x)


def minhashes(found: np.ndarray) -> np.ndarray:
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    return np.min([(x[i:i + 2048, None] * _A + _B).min(axis=0) for i in range(0, len(x), 2048)], axis=0)


def samples_of(found: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted hashes: the smallest of each bin, where the top bits are the bin."""
    bins = found >> np.uint64(64 - BINS.bit_length() + 1)
    return found[np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))]


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity bitmap: each sample flips one bit."""
    x = (samples ^ (samples >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.packbits((np.bincount((x >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def bit_limits(n1: np.ndarray, n2: np.ndarray, m1: np.ndarray, m2: np.ndarray, least: float) -> np.ndarray:
    """Most differing bits of sketches of sets with n elements and m samples whose similarity may be ``least``.

    At that similarity the union has (n1 + n2) / (1 + least) elements in u bins, and least * u samples agree, give or take
    SIGMAS deviations; the others flip bits, some of them twice.
    """
    union = (n1 + n2) / (1 + least)
    filled = BINS * (1 - np.exp(-union / BINS))
    spread = least * (1 - least) * filled * np.maximum(1 - filled / np.maximum(union, filled), 0.25) + 1  # drawn without replacement, but some hide others
    agree = least * filled - SIGMAS * np.sqrt(spread)
    load = np.maximum(m1 + m2 - 2 * np.maximum(agree, 0), 0) / BITS
    chance = 1 - np.exp(-2 * load)
    parity = BITS * np.maximum((1 - np.exp(-4 * load)) / 4 - load * np.exp(-4 * load), 0) + 1
    return BITS / 2 * chance + SIGMAS * np.sqrt(parity)


def facts(batch: list[str], hashes: Hashes) -> list[tuple]:
    out = []
    for text in batch:
        found = shingles(text, hashes)
        if not len(found):
            out.append((0, None, None, None, None))
            continue
        lowest, samples = minhashes(found), samples_of(found)
        bands = [xxhash.xxh3_64_intdigest(lowest[i * ROWS:(i + 1) * ROWS].tobytes(), i) - 2**63 for i in range(BANDS)]
        out.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), bands, odd_sketch(samples), len(samples)))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes of ``edges`` (a, b). Alternates large and small stars;
    each round is two sums by node and joins whose hot nodes Spark can split."""
    stars = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = materialize(small.filter("a != b").distinct(), "stars")
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))


def similar_sets(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= least * (len(x) + len(y) - shared)


class Verifier:
    """Keeps what is needed to confirm pairs of classes: their sketches, sizes and one document each."""

    def __init__(self, docs: DataFrame, classes: DataFrame, least: int, small_ids: int):
        self.docs, self.classes, self.least, self.small_ids = docs, classes, least, small_ids

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (hub, node) whose sizes and odd sketches allow the similarity."""
        sides = [self.classes.select(F.col("set_key").alias(key), F.col("n_shingles").alias(f"n{i}"), F.col("samples").alias(f"m{i}"), F.col("sketch").alias(f"s{i}"))
                 for i, key in ((1, "hub"), (2, "node"))]
        least = self.least

        def close(batches):
            for batch in batches:
                n1, n2, m1, m2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n1", "n2", "m1", "m2"))
                differ = np.bitwise_count(bitmaps(batch.column("s1")) ^ bitmaps(batch.column("s2"))).sum(axis=1, dtype=np.int64)
                keep = (differ <= bit_limits(n1, n2, m1, m2, least / 100)) & (100 * np.minimum(n1, n2) >= least * np.maximum(n1, n2))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["hub", "node"])

        return pairs.join(sides[0], "hub").join(sides[1], "node").mapInArrow(close, "hub binary, node binary")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """Full shingle sets (set_key, members) of classes, from the text of one document each."""
        wanted = materialize(nodes.join(self.classes.select("set_key", "rep"), "set_key"), "wanted")
        ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
        if wanted.count() <= self.small_ids:
            ids = F.broadcast(ids)
        chosen = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

        def to_sets(batches):
            hashes = Hashes()
            for batch in batches:
                for part in small_batches(batch, "text"):
                    found = [shingles(t, hashes) for t in texts(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                                                      pa.array([x.tobytes() for x in found], pa.binary())], ["set_key", "members"])

        sets = chosen.mapInArrow(to_sets, "set_key binary, members binary").join(wanted.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])
        return materialize(sets, "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of stored pairs (hub, node) whose full shingle sets are similar enough, as edges (a, b)."""
        sets = self.sets_of(pairs.select(F.col("hub").alias("set_key")).union(pairs.select(F.col("node").alias("set_key"))).distinct())
        both = pairs.join(sets.select(F.col("set_key").alias("node"), F.col("members").alias("y")), "node") \
                    .join(sets.select(F.col("set_key").alias("hub"), F.col("members").alias("x")), "hub")
        least = self.least

        def similar(batches):
            for batch in batches:
                for part in small_batches(batch, "y"):
                    keep = [similar_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least)
                            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
                    part = part.filter(pa.array(keep, pa.bool_()))
                    yield pa.RecordBatch.from_arrays([part.column("hub"), part.column("node")], ["a", "b"])

        return materialize(both.mapInArrow(similar, "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, least: int = 80, block: int = 2048, small_ids: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are split on white space, A-Z in lower case; a document's set holds its distinct 4-word shingles (64-bit hashes).
    Documents are linked where ``100 * intersection >= least * union``; component_id is the smallest doc_id reachable, kept says
    that it is the own one. ``block``: members of a bucket that one task holds at once where a hub leaves the bucket in several
    components. ``small_ids``: ids that may be broadcast to fetch the texts to confirm; more are joined by shuffling.

    NULL or empty text: no shingles, linked with nothing. NULL ids: linked like others, but never name a component; where no id
    is known component_id is NULL and kept true. Rows with equal ids are documents of their own that share the id. Empty
    input: no rows.
    """
    base = only(docs, doc_id="long", text="string")

    def describe(batches):
        hashes = Hashes()
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32())
        for batch in batches:
            for part in small_batches(batch, "text"):
                made = facts(texts(part.column("text")), hashes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)]], ["doc_id", *FACTS.names])

    described = materialize(base.mapInArrow(describe, T.StructType([T.StructField("doc_id", T.LongType()), *FACTS.fields])), "minhash")
    classes = materialize(described.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("samples").alias("samples")), "classes")
    labels = linked(base, classes, least, block, small_ids)
    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left") \
                   .withColumn("label", F.coalesce("label", "set_key"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    answer = materialize(named.join(smallest, "label").select("set_key", "component_id"), "components")
    some = described.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(answer, "set_key", "left")
    none = described.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def linked(docs: DataFrame, classes: DataFrame, least: int, block: int, small_ids: int) -> DataFrame:
    """(node, label) of all classes that have a link."""
    verifier = Verifier(docs, classes, least, small_ids)
    banded = classes.select(F.explode("bands").alias("key"), F.col("set_key").alias("node"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = materialize(banded.join(sizes, "key"), "buckets")
    met = rows.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = materialize(rows.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("h")).select("key", F.col("h.node").alias("hub")), "hubs")
    pairs = rows.join(hubs, "key").filter("node != hub").select("hub", "node").distinct()
    edges = verifier.confirmed(materialize(verifier.plausible(pairs), "pairs"))
    labels = components(edges)

    known = rows.filter("size > 2").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = materialize(known, "labelled")
    shares = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    opened = shares.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most")) \
                   .filter("size > most").select("key", "main")
    # open buckets with the same largest component are looked at together, each member once
    met = materialize(known.join(opened, "key").select("main", "node", "label").distinct(), "open")
    if met.isEmpty():
        return labels
    sizes = met.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m_blocks"),
                                    F.ceil(F.count_if(F.col("label") != F.col("main")) / block).cast("int").alias("s_blocks"))
    facts_of = classes.select(F.col("set_key").alias("node"), "n_shingles", "samples", "sketch", "bands")
    sets = verifier.sets_of(met.select(F.col("node").alias("set_key")).distinct()).withColumnRenamed("set_key", "node")
    members = met.join(sizes, "main").join(facts_of, "node").join(sets, "node")
    columns = ["main", "s_block", "m_block", "node", "label", "n_shingles", "samples", "sketch", "bands", "members"]
    place = F.xxhash64("node")
    left = members.filter("label != main").withColumns({
        "s_block": F.pmod(place, "s_blocks").cast("int"), "m_block": F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1))}).select(columns)
    right = members.withColumns({
        "m_block": F.pmod(place, "m_blocks").cast("int"), "s_block": F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1))}).select(columns)
    right = right.toDF(*[f"r_{c}" for c in columns])  # new names: both sides stem from the same table

    def held_against(some: pa.Table, others: pa.Table) -> pa.Table:
        """One link between each member outside the largest component and each other component that it meets, if there is any."""
        a, b = [], []
        if some.num_rows and others.num_rows:
            x, y = Side(some), Side(others.rename_columns(columns))
            for i in range(some.num_rows):
                near = (y.bands == x.bands[i]).any(axis=1) & (y.label != x.label[i])
                near &= np.bitwise_count(y.maps ^ x.maps[i]).sum(axis=1, dtype=np.int64) <= bit_limits(x.n[i], y.n, x.m[i], y.m, least / 100)
                linked_to = set()
                for j in np.flatnonzero(near).tolist():
                    if y.label[j] not in linked_to and similar_sets(x.sets[i], y.sets[j], least):
                        linked_to.add(y.label[j])
                        a.append(x.node[i])
                        b.append(y.node[j])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    more = left.groupBy("main", "s_block", "m_block").cogroup(right.groupBy("r_main", "r_s_block", "r_m_block")).applyInArrow(held_against, "a binary, b binary")
    more = materialize(more, "links")
    if more.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))


class Side:
    """Columns of one side of a block, as arrays."""

    def __init__(self, rows: pa.Table):
        self.node, self.label = rows.column("node").to_pylist(), np.array(rows.column("label").to_pylist(), object)
        self.n, self.m = rows.column("n_shingles").to_numpy(), rows.column("samples").to_numpy()
        self.maps = bitmaps(rows.column("sketch").combine_chunks())
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]


def one_of_each(docs: DataFrame, least: int = 80, small_ids: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near-duplicates does, with all their columns. A row that
    stands there more than once, alike in all columns, stays once. Rows without id can't be told apart by it, so they stay
    together if one of them does."""
    judged = materialize(near_duplicates(docs, least, small_ids=small_ids), "judged")
    known = judged.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = names[[c.lower() for c in docs.columns].index("doc_id")]
    plain = docs.toDF(*names)
    single, several = known.filter("n = 1").select(F.col("doc_id").alias(key)), known.filter("n > 1").select(F.col("doc_id").alias(key))
    if judged.filter("kept").count() <= small_ids:  # beyond that both sides are shuffled
        single = F.broadcast(single)
    kept = plain.join(single, key, "left_semi")
    if not several.isEmpty():
        kept = kept.unionByName(plain.join(several, key, "left_semi").dropDuplicates())
    nameless = judged.filter("doc_id is null").groupBy("kept").count().collect()  # two rows at most
    if any(r["kept"] for r in nameless):
        kept = kept.unionByName(plain.filter(F.col(key).isNull()).dropDuplicates())
    return kept.toDF(*docs.columns)
