"""How far the sources of a language differ in their words: exact sparse document vectors, group sums, sparse pairs.

Terms carry their language, so one CountVectorizer with ``minDF`` and no limit on the vocabulary counts each language by itself. Its
document vectors are written as indices and counts and summed by group. Two groups are compared on the terms that they hold:
what a group lacks has one and the same share, which is worked in from counts of equal shares and the size of the vocabulary.
All shares and sums are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from drivetrove.session import scratch_path

from .common import materialize, only, small_batches, utf8

#: Terms are runs of ASCII letters and of all beyond ASCII, so bytes decide; A-Z become a-z, all else becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Between language and term; no term holds it.
MARK = b"\x00"
UNIT, ADDED = 1_000_000_000, 5
#: One of so many slices of all terms is counted to see how large the vocabulary will be.
SLICES = 64
VECTOR = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def tokens(docs: DataFrame) -> DataFrame:
    """lang, source and words of each document; a word is its language and the term. ``slice`` has the distinct words of one slice of all
    terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "text"):
                sizes, starts, data, sliced = [np.zeros(1, np.int64)], [0], [], []
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    words, prefix = utf8(text).translate(FOLD).split(), utf8(lang) + MARK
                    data.append(prefix.join([b"", *words]))
                    sizes.append(np.fromiter(map(len, words), np.int64, len(words)) + len(prefix))
                    starts.append(starts[-1] + len(words))
                    sliced.append([prefix + w for w in set(words) if crc32(w) % SLICES == 0])
                ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
                found = pa.StringArray.from_buffers(starts[-1], pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(data)))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), found),
                                                  pa.array(sliced, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["lang", "source", "words", "slice"])

    base = only(docs, text="string", lang="string", source="string").fillna("")
    return base.mapInArrow(run, "lang string, source string, words array<string>, slice array<string>")


def vocabulary_size(found: DataFrame, min_df: int) -> int:
    """About how many terms stand in ``min_df`` documents of their language."""
    kept = found.select(F.explode("slice").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    return SLICES * kept.count()


def group_counts(found: DataFrame, min_df: int, most_terms: int) -> DataFrame:
    """lang, source, term and count (over 0) of the terms kept. A vocabulary of about more than ``most_terms`` is fitted in so many
    parts, by hash of the term, that none is larger: the driver and a task hold one part at a time."""
    parts = max(1, -(-vocabulary_size(found, min_df) // most_terms))
    out = found.select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("count")).limit(0)
    for part in range(parts):
        own = found if parts == 1 else found.withColumn("words", F.filter("words", lambda w: F.pmod(F.xxhash64(w), F.lit(parts)) == part))
        try:
            model = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(min_df), vocabSize=2**31 - 1).fit(own.select(F.array_distinct("words").alias("words")))  # documents count, not uses
        except IllegalArgumentException as error:
            if "vocabulary size should be > 0" not in str(error):
                raise
            continue  # no term of this part is in enough documents
        path = scratch_path(found.sparkSession, "term-vectors")
        model.transform(own).select("lang", "source", "vector").write.parquet(path)
        # the stored form of a vector: its indices and counts side by side
        flat = found.sparkSession.read.schema(f"lang string, source string, vector {VECTOR}").parquet(path)
        sums = flat.select("lang", "source", F.inline(F.arrays_zip("vector.indices", "vector.values"))).toDF("lang", "source", "at", "n") \
            .groupBy("lang", "source", "at").agg(F.sum(F.col("n").cast("long")).alias("count"))
        names = [w.rsplit(MARK.decode(), 1)[1] for w in model.vocabulary]
        known = found.sparkSession.createDataFrame(pa.table({"at": pa.array(range(len(names)), pa.int32()), "term": pa.array(names, pa.string())}))
        out = out.unionByName(sums.join(known, "at").select("lang", "source", "term", "count"))
    return out


def share(count: Column, total: Column, size: Column) -> Column:
    """p = 1 + floor(UNIT * (count + ADDED) / (total + ADDED * size)), in whole numbers of up to 38 digits; NULL where nothing is kept."""
    exact = lambda x: x.cast("decimal(20,0)")
    top, bottom = exact(F.lit(UNIT)) * exact(count + ADDED), exact(total + ADDED * size)
    return F.call_function("div", top, F.nullif(bottom, F.lit(0))) + 1


def both_hold(cells: DataFrame, cells_each: int = 200_000, dense: int = 2_000_000) -> DataFrame:
    """lang, source_a, source_b, value: over the terms that both groups hold, the difference of their shares less what ``one`` of
    ``divergence`` counts for them. Terms are dealt into parts, sources of a language into ``block``s, and each pair of blocks of a part
    is one group of rows; a task makes a dense table of at most ``dense`` shares of it at a time."""
    parts = max(1, -(-cells.count() // cells_each))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cells.withColumn("other", other).select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                                                    "source", "block", "term", "p", "p0")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("term")
        names, source = np.unique(rows.column("source").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        p, p0, block = rows.column("p").to_numpy(), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        p0[source], block[source] = rows.column("p0").to_numpy(), rows.column("block").to_numpy()
        term = rows.column("term").to_numpy(zero_copy_only=False).astype(object)
        number = np.cumsum(np.concatenate([[0], term[1:] != term[:-1]])).astype(np.int64)
        sums = np.zeros((len(names), len(names)), np.int64)
        step = max(1, dense // len(names))
        for low in range(0, int(number[-1]) + 1, step):
            own = slice(*np.searchsorted(number, [low, low + step]))
            width = int(number[own][-1]) - low + 1
            share_, held = np.zeros((len(names), width), np.int64), np.zeros((len(names), width), bool)
            share_[source[own], number[own] - low], held[source[own], number[own] - low] = p[own], True
            for i in range(len(names) - 1):
                at = np.flatnonzero(held[i])  # the first group's terms are enough
                a, b, a0, b0 = share_[i, at], share_[i + 1:, at], p0[i], p0[i + 1:, None]
                sums[i, i + 1:] += ((np.abs(a - b) - np.abs(a - b0) - np.abs(a0 - b) + np.abs(a0 - b0)) * held[i + 1:, at]).sum(axis=1)
        lang, x, y = (rows.column(c)[0].as_py() for c in ("lang", "x", "y"))
        a, b = np.nonzero(np.triu(sums != 0, 1) & ((x == y) | (block[:, None] != block)))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source_a": pa.array(names[a], pa.string()), "source_b": pa.array(names[b], pa.string()), "value": pa.array(sums[a, b], pa.int64())})

    return dealt.groupBy("lang", "part", "x", "y").applyInArrow(compare, "lang string, source_a string, source_b string, value long")


def divergence(docs: DataFrame, min_df: int = 30, top: int = 50, most_terms: int = 1_000_000, source_block: int = 256) -> DataFrame:
    """How the sources of each language of ``docs`` (text, lang, source) differ: lang, source, part, item, value, rank.

    A language keeps the terms that at least ``min_df`` of its documents hold. A group (lang, source), or a language, gives each
    kept term the share ``p`` of ``share``. Part ``pair``: each other source of the language, value the sum of the differences of
    shares over all kept terms, ranked by it. Part ``term``: the ``top`` terms of the group whose share is above the language's, value
    the difference. Ranks go by value, descending, then item.

    NULL text, lang or source is ''. Repeated rows are documents of their own. A language without kept terms has pairs of value 0 and
    no terms; a language with one source has no pairs; a group without terms is compared like any other. Empty table: no rows.
    """
    found = materialize(tokens(docs), "terms")
    cells = materialize(group_counts(found, min_df, most_terms), "term-counts")
    by_lang = cells.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"))
    sizes = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_count").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = found.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size", "lang_total"])
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / source_block).cast("int").alias("blocks"))
    groups = groups.join(per_lang, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    groups = materialize(groups.withColumn("p0", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("size")), F.lit(0).cast("long"))), "term-groups")
    cells = materialize(cells.join(groups, ["lang", "source"]).select("lang", "source", "term", "count", "block", "blocks", "p0", share(F.col("count"), F.col("total"), F.col("size")).alias("p")), "term-shares")

    def side(df: DataFrame, letter: str, *shared: str) -> DataFrame:
        return df.select(*shared, *[F.col(c).alias(f"{c}_{letter}") for c in df.columns if c not in shared])

    def far(x: str, y: str) -> Column:
        return F.abs(F.col(x) - F.col(y))

    facts = groups.select("lang", "source", "size", "p0")
    pairs = side(facts, "a", "lang", "size").join(side(facts.drop("size"), "b", "lang"), "lang").filter("source_a < source_b") \
        .select("lang", "source_a", "source_b", (F.col("size") * far("p0_a", "p0_b")).alias("value"))
    # what one group holds against what the other lacks: equal shares count together
    equal = cells.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    one = side(equal, "a", "lang").join(side(facts.drop("size"), "b", "lang"), "lang").filter("source_a <> source_b") \
        .select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), (F.col("n_a") * (far("p_a", "p0_b") - far("p0_a", "p0_b"))).alias("value"))
    both = both_hold(cells)
    sums = None
    for part in (pairs, one, both):
        part = part.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    compared = sums.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value").withColumn("rank", F.row_number().over(order))

    q = by_lang.join(sizes, "lang").select("lang", "term", share(F.col("lang_count"), F.col("lang_total"), F.col("size")).alias("q"))
    above = cells.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return compared.withColumn("part", F.lit("pair")).unionByName(ranked.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
