"""Prefix tries of conversations by ROLLUP over positional columns.

A conversation is a row of turn ids by position, and one ``GROUP BY node, ROLLUP (t1 .. tn)`` aggregates all its prefixes at once,
where ``grouping_id`` tells how deep a group lies. Columns come in blocks: what several conversations share beyond one block goes on
in the next, wider one, keyed by the node where the block before ended. A second ROLLUP, over the nodes and from the last block to
the first, sums subtrees. A conversation that no other shares a node with any more is a plain path and needs no further block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, only

ROOT = "root"
#: A turn id is an MD5 in hex and then the bytes of the text.
DIGEST = 32


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn_id) with their place ``pos`` from 1, by turn (NULL first), role and turn id. Ranges of rows are numbered apart,
    so that a conversation of any length is spread over tasks."""
    ranges = turns.repartitionByRange("conv_id", "turn", "role", "turn_id").withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "trie-turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(earlier)).filter("before > 0").drop("n")
    order = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "turn_id")
    # only a conversation that goes on from the range before has a row in `before`: one for each range at most
    return ranges.withColumn("pos", F.row_number().over(order).cast("long")).join(F.broadcast(before), ["conv_id", "part"], "left") \
        .select("conv_id", "turn_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"))


def rebuilt(conversations: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, pos, turn_id), where c begins with the first ``crc32(c) % spread`` turns of
    c - c % group instead of its own."""
    base = only(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = base.select("conv_id", "turn", role.alias("role"), F.concat(F.md5(content), F.octet_length(text).cast("string")).alias("turn_id"))
    own = materialize(numbered(turns), "trie-positions")
    heads = own.filter((F.col("pos") < spread) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("giver")) \
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "turn_id"))), lambda x: x["turn_id"]).alias("head"))  # fewer than `spread`
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    plan = own.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"h": h, "giver": F.col("conv_id") - F.col("conv_id") % group}).join(heads, "giver", "left")
    taken = F.when(F.col("head").isNull() | (F.col("h") == 0), F.expr("cast(array() as array<string>)")).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1))))
    plan = plan.withColumn("taken", taken).withColumn("k", F.size("taken").cast("long"))
    plan = materialize(plan.select("conv_id", "h", "k", "taken", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    borrowed = plan.select("conv_id", F.posexplode("taken").alias("pos", "turn_id")).select("conv_id", (F.col("pos") + 1).cast("long").alias("pos"), "turn_id")
    rest = own.filter(F.col("pos") > h).join(plan.select("conv_id", "h", "k"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_id")
    return plan.select("conv_id", "length"), materialize(borrowed.unionByName(rest), "trie-rebuilt")


def path_key(columns: list[str]) -> Column:
    """Key of the node that a row's turn columns lead to; columns that are NULL don't count."""
    return F.when(F.col(columns[0]).isNull(), F.col("node")).otherwise(F.md5(F.concat_ws("|", "node", *columns)))


def in_columns(active: DataFrame, turns: DataFrame, start: int, names: list[str]) -> DataFrame:
    """``active`` (node, conv_id, length) with the turn ids of the positions after ``start``, NULL beyond a conversation's end."""
    part = turns.filter((F.col("pos") > start) & (F.col("pos") <= start + len(names)))
    wide = part.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") - start).alias("at"), "turn_id"))).alias("m"))  # a block at most
    return active.join(wide, "conv_id", "left").select("node", "conv_id", "length", *[F.try_element_at("m", F.lit(i).cast("long")).alias(t) for i, t in enumerate(names, 1)])


def prefixes(rows: DataFrame, start: int, names: list[str]) -> DataFrame:
    """One row for each node that a block's rows pass, with its members' count, least id and greatest length."""
    listed, width = ", ".join(names), len(names)
    found = rows.sparkSession.sql(f"""
        SELECT node, {listed}, {width} - bit_count(grouping_id()) AS level, count(*) AS n_convs, min(conv_id) AS conv_id, max(length) AS longest
        FROM {{rows}} GROUP BY node, ROLLUP ({listed})""", rows=rows)
    path = F.array(*names)
    own = F.when(F.col("level") > 0, F.try_element_at(path, F.col("level")))
    found = found.filter(own.isNotNull() | ((F.col("level") == 0) & (F.lit(start) == 0)))
    parent = F.when(F.col("level") > 1, F.md5(F.concat_ws("|", "node", F.slice(path, 1, F.greatest(F.col("level") - 1, F.lit(1)))))).when(F.col("level") == 1, F.col("node"))
    return found.withColumns({"key": path_key(names), "parent": parent, "depth": F.col("level") + F.lit(start).cast("long"),
                              "saved": F.coalesce((F.col("n_convs") - 1) * F.substring(own, DIGEST + 1, 20).cast("long"), F.lit(0)).cast("long")})


def subtrees(nodes: DataFrame, below: DataFrame | None, start: int, names: list[str]) -> DataFrame:
    """Sums over the subtrees of a block's nodes; ``below`` (node, children, leaves, saved) has what lies under the last level."""
    width, listed = len(names), ", ".join(names)
    if below is None:
        nodes = nodes.withColumns({c: F.lit(0).cast("long") for c in ("children_below", "leaves_below", "saved_below")})
    else:
        under = below.select(F.col("node").alias("key"), *[F.col(c).alias(f"{c}_below") for c in ("children", "leaves", "saved")])
        nodes = nodes.join(under, "key", "left").fillna(0, ["children_below", "leaves_below", "saved_below"])
    children = ", ".join([*[f"count_if(level = {i})" for i in range(1, width + 1)], "sum(children_below)"])
    sums = nodes.sparkSession.sql(f"""
        SELECT node, {listed}, {width} - bit_count(grouping_id()) AS at, array({children}) AS by_level, sum(saved + saved_below) AS saved_tokens,
               sum(CAST(longest = depth AS BIGINT) + leaves_below) AS n_leaves, min(struct(level, key, parent, conv_id, depth, n_convs)) AS top
        FROM {{nodes}} GROUP BY node, ROLLUP ({listed})""", nodes=nodes)
    own = F.when(F.col("at") > 0, F.try_element_at(F.array(*names), F.col("at")))
    return sums.filter(own.isNotNull() | (F.col("at") == 0)).select("node", "at", "top.*", F.element_at("by_level", F.col("at") + 1).alias("n_children"), "n_leaves", "saved_tokens")


def id_digests(ended: DataFrame, chunk: int = 1000) -> DataFrame:
    """``ends_sha256`` for each key of ``ended`` (key, conv_id): SHA-256 of its ids, ascending, comma-joined. Sorted ranges write runs of at most
    ``chunk`` ids; a hash then takes up the runs of a key one after the other, so no list of ids is ever whole."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [0]
            for i in range(1, len(keys)):
                if keys[i] != keys[i - 1] or i - cuts[-1] >= chunk:
                    cuts.append(i)
            spans = list(zip(cuts, [*cuts[1:], len(keys)])) if keys else []
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in spans], pa.string()), pa.array([ids[i] for i, _ in spans], pa.int64()),
                                              pa.array([",".join(map(str, ids[i:j])) for i, j in spans], pa.string())], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key != open_:
                    if open_ is not None:
                        done.append((open_, state.hexdigest()))
                    open_, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["key", "ends_sha256"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    listed = ended.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(runs, "key string, first long, ids string")
    return listed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 5, spread: int = 9, width: int = 8, most: int = 32) -> DataFrame:
    """The prefix trie of rebuilt ``conversations`` (conv_id, turn, role, text); one row per node, the root (depth 0) included.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id), n_convs (members), n_children, n_leaves (childless
    nodes in its subtree), saved_tokens (over its subtree, each node's members but one times the UTF-8 bytes of its last text) and
    ends_sha256 (of the ids of members that end there, ascending, comma-joined). A conversation begins with the first
    ``crc32(conv_id) % spread`` turns of conversation ``conv_id - conv_id % group`` in place of as many own ones.

    Blocks are ``width`` columns, then twice as many each time up to ``most``; the number of blocks follows the longest prefix that
    two conversations share. Turns are ordered by turn (NULL first); equal turns by role, then by the digest of the content. NULL role
    or text is empty. Rows without conv_id belong to no conversation and are left out. A repeated row is a turn of its own.
    An empty table has no trie, so no rows.
    """
    convs, turns = rebuilt(conversations, group, spread)
    active, start = convs.select(F.lit(ROOT).alias("node"), "conv_id", "length"), 0
    blocks, ended, tails = [], [], []
    while True:
        names = [f"t{i}" for i in range(1, width + 1)]
        rows = materialize(in_columns(active, turns, start, names).withColumn("key", path_key(names)), "trie-block")
        nodes = materialize(prefixes(rows, start, names), "trie-nodes")
        blocks.append((nodes, start, names))
        ended.append(rows.filter(F.col("length") <= start + width).select("key", "conv_id"))
        on = nodes.filter((F.col("level") == width) & (F.col("longest") > F.col("depth")))
        tails.append(on.filter("n_convs = 1").select("conv_id", "key", "depth", "longest"))
        shared = on.filter("n_convs > 1").select("key")
        start, width = start + width, min(2 * width, most)
        if not shared.limit(1).count():
            break
        active = rows.filter(F.col("length") > start).select("key", "conv_id", "length").join(shared, "key").withColumnRenamed("key", "node")
    below, whole = None, []
    for (nodes, begin, names), alone in zip(reversed(blocks), reversed(tails)):
        paths = alone.select(F.col("key").alias("node"), *[F.lit(n).cast("long").alias(c) for c, n in (("children", 1), ("leaves", 1), ("saved", 0))])
        sums = materialize(subtrees(nodes, paths if below is None else paths.unionByName(below), begin, names), "trie-sums")
        below = sums.filter("at = 0").select("node", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        whole.append(sums if begin == 0 else sums.filter("at > 0"))
    table = whole[0]
    for part in whole[1:]:
        table = table.unionByName(part)
    digests = ended[0]
    for part in ended[1:]:
        digests = digests.unionByName(part)
    alone = tails[0]
    for part in tails[1:]:
        alone = alone.unionByName(part)
    nothing = hashlib.sha256(b"").hexdigest()
    parents = table.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = table.join(parents, "parent", "left").join(id_digests(digests), "key", "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    out = out.select(*[F.col(c).cast("long").alias(c) for c in columns], F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    end = F.col("pos") == F.col("longest")
    path = turns.join(alone.drop("key"), "conv_id").filter(F.col("pos") > F.col("depth")).select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(nothing)).alias("ends_sha256"))
    return out.unionByName(path)
