"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get integer numbers of blocks by highest quotients, and pass them on to their shards in the same way; a
seeded permutation then picks blocks inside each shard. The apportionment walks down a tree of bounded fan-out
(groups of sources, source, groups of shards, shard), so no task ever holds an unbounded group, however large a
source is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, materialize, only

FAN_OUT = 1024
#: Multiplier of the block permutation; prime and above any number of blocks in a shard, so it never shares a factor.
STEP = 2_147_483_647


def sainte_lague(weights: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients weight / (2k + 1), none above its cap; ties go to the earlier place."""
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    given = np.zeros(len(weights), np.int64)
    seats = int(min(seats, caps[weights > 0].sum()))
    if seats <= 0:
        return given

    def at(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.minimum(np.floor(weights / divisor + 0.5), 2.0**62).astype(np.int64))

    low, high = 0.0, 2 * float(weights.max()) + 1.0  # seats(low) > seats >= seats(high)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if at(middle).sum() <= seats else (middle, high)
    given = at(high)
    while (left := seats - int(given.sum())) > 0:  # quotients that tie at the threshold
        quotient = np.where(given < caps, weights / (2 * given + 1), -1.0)
        given[np.argsort(-quotient, kind="stable")[:min(left, int((quotient == quotient.max()).sum()))]] += 1
    return given


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point, NULL last. Ranges are sorted apart and offset, so no task sorts them all."""
    spread = sources.withColumn("last", F.col("source").isNull()).repartitionByRange(F.col("last"), F.col("source"))
    parts = materialize(spread.withColumn("part", F.spark_partition_id()), "sources")
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(sizes):  # at most as many as there are shuffle partitions
        before[part] = at
        at += sizes[part]
    offset = F.coalesce(*[F.when(F.col("part") == p, F.lit(n).cast("long")) for p, n in before.items()], F.lit(0).cast("long"))
    order = Window.partitionBy("part").orderBy("last", "source")
    return parts.select("source", "source_size", (F.row_number().over(order) - 1 + offset).alias("rank"))


def targets(sources: DataFrame, weights: list[float], budget: float, most: float) -> DataFrame:
    """``target`` of each source: shares of ``budget`` times all sizes by weight, the excess over ``most`` times the own
    size reshared by weight until none is above. Each round is one sum over the sources."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = sources.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))) \
                   .withColumn("ceiling", F.col("source_size") * float(most))
    whole = float(table.agg(F.sum("source_size")).first()[0] or 0) * budget
    per_weight = 0.0
    while True:  # only grows; ends when no further source reaches its ceiling
        free = F.col("ceiling") > F.col("weight") * per_weight
        row = table.agg(F.sum(F.when(~free, F.col("ceiling"))).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("open")).first()
        level = (whole - (row["full"] or 0.0)) / row["open"] if row["open"] else per_weight
        if level <= per_weight:
            break
        per_weight = level
    return table.withColumn("target", F.least("ceiling", F.col("weight") * per_weight)).drop("weight", "ceiling")


def apportion(nodes: DataFrame, up: list[str]) -> DataFrame:
    """Seats of the nodes (group columns ``up``, ``name``, ``weight``, ``cap``) from their parents' ``seats``."""

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name", kind="stable").reset_index(drop=True)
        pdf["seats"] = sainte_lague(pdf["weight"].to_numpy(), pdf["cap"].to_numpy(), int(pdf["given"].iloc[0]))
        return pdf.drop(columns="given")

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in nodes.columns if c != "given") + ", seats long"
    return nodes.groupBy(*up).applyInPandas(share, schema)


def quotas(cells: DataFrame, block: int) -> DataFrame:
    """Blocks for each (rank, shard). ``cells``: rank, shard, weight (its part of the target), cap."""
    top = cells.agg(F.max("rank").alias("r"), F.max("shard").alias("s"), F.sum("weight").alias("w")).first()
    if top["r"] is None:
        return cells.select("rank", "shard").withColumn("seats", F.lit(0).cast("long"))
    levels: list[tuple[int, int | None]] = []  # (divisor of the rank, divisor of the shard or None for whole sources)
    size = 1
    while size <= top["s"]:
        levels.append((1, size))
        size *= FAN_OUT
    size = 1
    while True:
        levels.append((size, None))
        if size > top["r"]:
            break
        size *= FAN_OUT
    if not levels or levels[0][1] is None:
        levels.insert(0, (1, 1))

    def named(df: DataFrame, level: tuple[int, int | None]) -> DataFrame:
        by, part = level
        return df.withColumn("a", F.floor(F.col("rank") / by).cast("long")) \
                 .withColumn("b", F.lit(0).cast("long") if part is None else F.floor(F.col("shard") / part).cast("long"))

    given = None
    for level, above in zip(reversed(levels), [None, *reversed(levels[1:])], strict=False):
        nodes = named(cells, level).groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.sum("cap").alias("cap"), F.min("rank").alias("rank"), F.min("shard").alias("shard"))
        if above is None:
            given = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.least(F.lit(round((top["w"] or 0) / block)), F.col("cap")).cast("long").alias("given"))
            continue
        own = nodes.select(F.col("a").alias("x"), F.col("b").alias("y"), "rank", "shard", "weight", "cap")
        joined = named(own, above).withColumnsRenamed({"a": "pa", "b": "pb"}).join(given, ["pa", "pb"])
        seats = apportion(joined.select("pa", "pb", "x", "y", (F.col("x") if level[1] is None else F.col("y")).alias("name"), "weight", "cap", "given"), ["pa", "pb"])
        given = materialize(seats.select(F.col("x").alias("pa"), F.col("y").alias("pb"), F.col("seats").alias("given")), "quotas")
    return given.select(F.col("pa").alias("rank"), F.col("pb").alias("shard"), F.col("given").alias("seats"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shard_words: int = 1 << 18,
    seed: int = 17,
) -> DataFrame:
    """How many words of each document a mix takes.

    ``docs`` needs doc_id, text and source. Returns one row per row of ``docs``: doc_id, source, size (words), source_size,
    target (of its source), taken (words, repeats counted), block_words. ``weights`` repeat over the sources in code point
    order, NULL last. Words of a source are laid out in shards of about ``shard_words``, in an order fixed by ``seed``, and
    cut into blocks of ``block``, or fewer words for all where that is over 1/16 of the smallest target, down to one; a shard with quota q of m blocks takes each q div m times and q mod m of them once more,
    so no document exceeds ceil(most) times its size and a source misses its target by less than a block per shard.

    NULL or empty text: size 0, taken 0. NULL source: a source of its own. NULL id: placed by its text. Repeated rows are
    separate documents, and as they are alike it doesn't matter which comes first. Empty input: no rows. A source without words
    has target 0.
    """
    whole = int(-(-most // 1))
    base = only(docs, doc_id="long", text="string", source="string")
    sized = base.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).alias("place"))
    sized = materialize(sized, "sizes")
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = materialize(targets(sources, list(weights), budget, most), "targets")
    smallest = sources.filter("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(block, int((smallest or 0) // 16)))  # a block must not be more than a small source gets
    known = sources.select(F.col("source").alias("s"), "source_size", "rank", "target",
                           F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("shards"))
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s") \
                  .withColumn("shard", F.pmod("place", "shards")).drop("shards")
    order = Window.partitionBy("rank", "shard").orderBy("place", "doc_id", "size")
    placed = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = F.ceil(F.col("words") / block)
    cells = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).groupBy("rank", F.pmod("place", "shards").alias("shard")) \
                 .agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = materialize(cells.filter("words > 0").select("rank", "shard", "words", (F.col("target") * F.col("words") / F.col("source_size")).alias("weight"),
                                                         (blocks * whole).cast("long").alias("cap")), "cells")
    dealt = quotas(cells, block).join(cells.select("rank", "shard", "words"), ["rank", "shard"]) \
        .select("rank", "shard", "words", "seats", blocks.cast("long").alias("m"),
                F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), blocks.cast("long")).alias("shift"))
    out = placed.join(dealt, ["rank", "shard"], "left")
    start, end = F.col("end") - F.col("size"), F.col("end")

    def copies(j):
        return F.expr("seats div m") + F.when((j * F.lit(STEP) + F.col("shift")) % F.col("m") < F.col("seats") % F.col("m"), 1).otherwise(0)

    span = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    taken = F.aggregate(span, F.lit(0).cast("long"), lambda total, j: total + copies(j) * (F.least(end, (j + 1) * block) - F.greatest(start, j * block)))
    return out.select("doc_id", "source", "size", "source_size", "target",
                      F.when((F.col("size") > 0) & F.col("seats").isNotNull(), taken).otherwise(F.lit(0)).cast("long").alias("taken"),
                      F.lit(block).alias("block_words"))
