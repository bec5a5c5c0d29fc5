"""Vector ranking, signatures and visual duplicates.

Vectors are unit length, so cosine is a dot product. Products run on Arrow batches with numpy; Spark
partitions, shuffles and aggregates everything around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from drivetrove.catalog import Catalog
from drivetrove.operators.search import filtered_ids, search_advanced, search_transcripts, to_items
from drivetrove.operators.stats import DUPLICATE_GROUPS, MIN_DUPLICATE, with_disk_name
from drivetrove.session import materialize, number_rows, release, skew_join

SEMANTIC_LIMIT = 200
HYBRID_LIMIT = 300
VISUAL_THRESHOLD = 0.92

#: Rows of one side of a block product.
BLOCK = 4096
#: Upper bound of pivots held by the driver and by each task.
MAX_PIVOTS = 4096
#: Candidates that each cell puts forward per election round.
BALLOT = 512
#: Similar pairs a vector beyond which a task writes none and crowds are thinned first.
DEGREE = 32
#: Nodes of consecutive ids that one task walks in order.
SETTLED = 4096


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, dim))
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim).astype(np.float64)


def dot(column: Column | str, query: list[float]) -> Column:
    """Dot product with one constant vector; NULL for vectors of another length."""
    constant = np.asarray(query, dtype=np.float64)
    dim = len(constant)

    @F.arrow_udf("double")
    def product(vectors: pa.Array) -> pa.Array:
        usable = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
        scores = np.full(len(vectors), np.nan)
        mask = usable.to_numpy(zero_copy_only=False)
        scores[mask] = _matrix(vectors.filter(usable), dim) @ constant
        return pa.array(scores, mask=~mask)

    return product(F.col(column) if isinstance(column, str) else column)


def semantic_scores(cat: Catalog, model: str, query: list[float], threshold: float = 0.0,
                    exclude: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """Best frame of every entry against the query: ``entry_id, score, frame_ts``; ties take the earliest.

    ``within(entry_id)`` restricts the entries before anything is ranked.
    """
    rows = cat.embeddings.filter((F.col("model") == model) & (F.size("vec") == len(query)))
    if exclude is not None:
        rows = rows.filter(F.col("entry_id") != exclude)
    if within is not None:
        rows = rows.join(within, "entry_id", "left_semi")
    scored = rows.select("entry_id", "frame_ts", dot("vec", query).alias("score"))
    best = scored.groupBy("entry_id").agg(F.max(F.struct("score", (-F.col("frame_ts")).alias("ts"))).alias("b"))
    return best.select("entry_id", F.col("b.score").alias("score"), (-F.col("b.ts")).alias("frame_ts")).filter(
        F.col("score") >= threshold)


def _top_items(cat: Catalog, scored: DataFrame, limit: int) -> DataFrame:
    top = scored.orderBy(F.col("score").desc(), "entry_id").limit(limit).withColumnRenamed("entry_id", "id")
    return to_items(cat, top).orderBy(F.col("score").desc(), "id")


def semantic_search(cat: Catalog, model: str, query: list[float], threshold: float = 0.0,
                    limit: int = SEMANTIC_LIMIT, exclude: int | None = None,
                    within: DataFrame | None = None) -> DataFrame:
    return _top_items(cat, semantic_scores(cat, model, query, threshold, exclude, within), limit)


def signatures(cat: Catalog, model: str) -> DataFrame:
    """Unit-length mean vector of every entry; entries whose vectors cancel out are dropped.

    The earliest non-empty vector of an entry sets its length, its vectors of another length are left out. Sums are
    taken per Arrow batch first, so an entry with very many frames meets as a few partial sums. Twelve digits are
    kept: equal frames then give equal signatures whatever the order of summation.
    """
    rows = cat.embeddings.filter((F.col("model") == model) & (F.size("vec") > 0)).select(
        "entry_id", "frame_ts", "vec", F.size("vec").alias("dim"))
    lengths = rows.groupBy("entry_id").agg(F.min(F.struct("frame_ts", "dim")).alias("f")).select("entry_id", F.col("f.dim").alias("dim"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, entries = b.column("dim").to_numpy(), b.column("entry_id").to_numpy()
            for dim in np.unique(dims):
                mine = b.filter(pa.array(dims == dim))
                own = entries[dims == dim]
                order = np.argsort(own, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
                sums = np.add.reduceat(_matrix(mine.column("vec"), int(dim))[order], starts, axis=0)
                yield pa.record_batch({"entry_id": own[order][starts], "dim": np.full(len(starts), dim, np.int32),
                                       "part": pa.array(list(sums), pa.list_(pa.float64()))})

    parts = rows.select("entry_id", "vec", "dim").mapInArrow(partial, "entry_id bigint, dim int, part array<double>")
    sums = parts.join(lengths, ["entry_id", "dim"], "left_semi").groupBy("entry_id").agg(F.collect_list("part").alias("parts"))
    total = F.reduce(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)),
                     lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    norm = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda acc, x: acc + x * x))
    return sums.select("entry_id", total.alias("sum")).withColumn("norm", norm).filter("norm > 0").select(
        "entry_id", F.transform("sum", lambda x: F.round(x / F.col("norm"), 12)).alias("vec"))


def similar_to(cat: Catalog, model: str, entry_id: int, threshold: float = 0.0,
               limit: int = SEMANTIC_LIMIT) -> DataFrame:
    """Entries like one entry, itself excluded."""
    own = cat.replacing(embeddings=cat.embeddings.filter(F.col("entry_id") == entry_id))
    rows = signatures(own, model).collect()  # at most the one signature asked for
    if not rows:
        raise ValueError(f"entry {entry_id} has no usable vector of {model}")
    return semantic_search(cat, model, list(rows[0]["vec"]), threshold, limit, exclude=entry_id)


def batch_semantic(cat: Catalog, queries: DataFrame, model: str, k: int = 8, block: int = BLOCK) -> DataFrame:
    """Top ``k`` entries of every row of ``queries(query_id, vec)``; a query meets the vectors of its own length.

    Both sides are cut into blocks, and each pair of blocks is one task. It keeps its ``k`` best entries per query,
    which cannot lose a global winner, so the shuffle behind it carries few rows. An entry's vectors share a block.
    """
    vectors = cat.embeddings.filter((F.col("model") == model) & (F.size("vec") > 0)).select(
        "entry_id", "vec", F.size("vec").alias("dim"))
    asked = queries.filter(F.size("vec") > 0).select(
        "query_id", F.col("vec").cast("array<double>").alias("q_vec"), F.size("vec").alias("q_dim"))
    counts = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("v_blocks")).join(
        asked.groupBy(F.col("q_dim").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q_blocks")), "dim")
    counts = materialize(counts, "blocks")  # one row per vector length
    left = vectors.join(counts, "dim").select(
        "dim", "entry_id", "vec", F.pmod(F.xxhash64("entry_id"), "v_blocks").cast("int").alias("v_block"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"))
    right = asked.join(counts.withColumnRenamed("dim", "q_dim"), "q_dim").select(
        "q_dim", "query_id", "q_vec", F.pmod(F.xxhash64("query_id"), "q_blocks").cast("int").alias("r_q_block"),
        F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("r_v_block"))

    def best_of(entries: pa.Table, wanted: pa.Table) -> pa.Table:
        if not entries.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "entry_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim = entries.column("dim")[0].as_py()
        own, ids = entries.column("entry_id").to_numpy(), wanted.column("query_id").to_numpy()
        products = _matrix(entries.column("vec").combine_chunks(), dim) @ _matrix(wanted.column("q_vec").combine_chunks(), dim).T
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
        best, names = np.maximum.reduceat(products[order], starts, axis=0), own[order][starts]
        top = np.argsort(-best, axis=0, kind="stable")[:k]  # ties at the cut go to smaller ids, and names are ascending
        cols = np.broadcast_to(np.arange(len(ids)), top.shape)
        return pa.table({"query_id": ids[cols.ravel()], "entry_id": names[top.ravel()], "score": best[top.ravel(), cols.ravel()]})

    found = left.groupBy("dim", "v_block", "q_block").cogroup(right.groupBy("q_dim", "r_v_block", "r_q_block")).applyInArrow(
        best_of, "query_id bigint, entry_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entry_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


# --- all pairs above a threshold -------------------------------------------------------------------


def _reach(threshold: float) -> float:
    """Distance between unit vectors whose cosine is the threshold, plus room for rounding."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6


def _cells(sigs: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """Give every vector its home cell (nearest pivot) and the cells it may have neighbours in.

    A neighbour u of v with home p is at least as near to p as to v's own pivot h, so v is within the reach of the
    half space on p's side: ``(|v-p|^2 - |v-h|^2) / (2 |p-h|) <= reach``. It also is no farther from p than the reach
    and the radius of p's cell. Listing the pivots that pass both as ``cells`` loses no pair; :func:`routed_share`
    tells how much that leaves.
    """
    total = sigs.count()
    pivots = min(MAX_PIVOTS, max(1, total // cell_rows))
    if total == 0 or pivots == 1:
        return sigs.withColumn("home", F.lit(0)).withColumn("cells", F.array(F.lit(0)))
    sample = sigs.orderBy(F.xxhash64("entry_id")).limit(pivots).collect()  # at most MAX_PIVOTS vectors
    centres = np.array([r["vec"] for r in sample], dtype=np.float64)
    reach = _reach(threshold)
    gaps = np.sqrt(np.maximum(_squares(centres, centres), 1e-18))
    columns = sigs.columns

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            square = _squares(_matrix(b.column("vec"), centres.shape[1]), centres)
            home = square.argmin(axis=1) if len(square) else np.zeros(0, int)
            yield pa.record_batch({"home": home.astype(np.int32), "far": np.sqrt(square.min(axis=1, initial=np.inf))})

    radii = sigs.select("vec").mapInArrow(nearest, "home int, far double").groupBy("home").agg(F.max("far").alias("far")).collect()
    radius = np.full(pivots, -np.inf)  # of cells, at most MAX_PIVOTS
    for r in radii:
        radius[r["home"]] = r["far"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            square = _squares(_matrix(b.column("vec"), centres.shape[1]), centres)
            home = square.argmin(axis=1) if len(square) else np.zeros(0, int)
            own = square[np.arange(len(home)), home]
            beyond = (square - own[:, None]) / (2 * gaps[home])
            within = (beyond <= reach) & (np.sqrt(square) <= radius[None, :] + reach)
            lists = pa.array([np.flatnonzero(row).astype(np.int32) for row in within], pa.list_(pa.int32()))
            yield pa.record_batch([*[b.column(c) for c in columns], pa.array(home.astype(np.int32)), lists],
                                  names=[*columns, "home", "cells"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sigs.schema)
    return sigs.mapInArrow(assign, f"{ddl}, home int, cells array<int>")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def routed_share(sigs: DataFrame, threshold: float, cell_rows: int = BLOCK) -> float:
    """Part of all cells that a vector is sent to on average: 1.0 means that geometry prunes nothing."""
    row = _cells(sigs, threshold, cell_rows).agg(F.avg(F.size("cells")).alias("sent"), (F.max("home") + 1).alias("cells")).first()
    return float(row["sent"] / row["cells"]) if row["cells"] else 0.0


def _meet(anchored: DataFrame, routed: DataFrame, sizes: DataFrame, work, schema: str) -> DataFrame:
    """Bring anchored vectors (at home) and routed vectors (in all their cells) together in bounded tasks.

    Crowded cells are cut into blocks on both sides, and each pair of blocks is one task.
    """
    a_blocks, r_blocks = F.col("a_blocks"), F.col("r_blocks")
    left = anchored.withColumn("cell", F.col("home")).join(sizes, "cell").select(
        "cell", "entry_id", "vec",
        F.pmod(F.xxhash64("entry_id"), a_blocks).cast("int").alias("ablock"),
        F.explode(F.sequence(F.lit(0), r_blocks - 1)).alias("rblock"))
    # new names: both sides may stem from the same table
    right = routed.select("entry_id", "vec", F.explode("cells").alias("cell")).join(sizes, "cell").select(
        F.col("cell").alias("r_cell"), F.col("entry_id").alias("r_id"), F.col("vec").alias("r_vec"),
        F.explode(F.sequence(F.lit(0), a_blocks - 1)).alias("r_ablock"),
        F.pmod(F.xxhash64("entry_id"), r_blocks).cast("int").alias("r_rblock"))
    return left.groupBy("cell", "ablock", "rblock").cogroup(
        right.groupBy("r_cell", "r_ablock", "r_rblock")).applyInArrow(work, schema)


def _block_counts(anchored: DataFrame, routed: DataFrame, rows: int) -> DataFrame:
    """Number of blocks per cell and side."""
    a = anchored.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("a"))
    r = routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("r"))
    return a.join(r, "cell").select("cell", F.ceil(F.col("a") / rows).cast("int").alias("a_blocks"),
                                    F.ceil(F.col("r") / rows).cast("int").alias("r_blocks"))


def _sides(left: pa.Table, right: pa.Table):
    def side(t: pa.Table, ids: str, vec: str):
        vectors = t.column(vec).combine_chunks()
        return t.column(ids).to_numpy(), _matrix(vectors, len(vectors[0]) if len(vectors) else 0)

    return *side(left, "entry_id", "vec"), *side(right, "r_id", "r_vec")


def _smallest_neighbour(anchored: DataFrame, routed: DataFrame, threshold: float, rows: int,
                        answer: str) -> DataFrame:
    """For vectors of the ``answer`` side: the smallest id below their own on the other side that is similar.

    Each task returns one row per vector at most, so the output stays linear even where everything is
    alike.
    """
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, a, r_ids, r = _sides(left, right)
        ids, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a_ids) and len(r_ids):
            close = (a @ r.T) >= threshold
            own, other = (a_ids, r_ids) if answer == "anchored" else (r_ids, a_ids)
            close = close if answer == "anchored" else close.T
            close &= other[None, :] < own[:, None]
            lowest = np.where(close, other[None, :], np.iinfo(np.int64).max).min(axis=1)
            found = close.any(axis=1)
            ids, hits = own[found], lowest[found]
        return pa.table({"entry_id": pa.array(ids, pa.int64()), "neighbour": pa.array(hits, pa.int64())})

    met = _meet(anchored, routed, _block_counts(anchored, routed, rows), work, "entry_id bigint, neighbour bigint")
    return met.groupBy("entry_id").agg(F.min("neighbour").alias("neighbour"))


def collapse_copies(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors become one representative (smallest id), and a table ``entry_id -> representative``."""
    reps = sigs.groupBy("vec").agg(F.min("entry_id").alias("representative"))
    copies = skew_join(sigs, reps, "vec", "inner", spread=F.col("entry_id")).select("entry_id", "representative")
    return reps.select(F.col("representative").alias("entry_id"), "vec"), copies


def similarity_pairs(sigs: DataFrame, threshold: float, cell_rows: int = BLOCK, block: int = BLOCK) -> DataFrame:
    """Pairs ``a < b`` of different vectors with cosine at or above the threshold, exact.

    Identical vectors stand together behind their smallest id (:func:`collapse_copies`), so a crowd of
    copies yields no pairs among itself.
    """
    # stored first: float sums may differ in the last bit if computed twice
    reps, _ = collapse_copies(materialize(sigs, "signatures"))
    cells = materialize(_cells(reps, threshold, cell_rows), "cells")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, a, r_ids, r = _sides(left, right)
        if not len(a_ids) or not len(r_ids):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        product = a @ r.T
        i, j = np.nonzero((product >= threshold) & (a_ids[:, None] < r_ids[None, :]))
        return pa.table({"a": a_ids[i], "b": r_ids[j], "score": product[i, j]})

    sizes = _block_counts(cells, cells, block)
    return _meet(cells, cells, sizes, work, "a bigint, b bigint, score double")


def _edges(undecided: DataFrame, threshold: float, rows: int, degree: int) -> DataFrame | None:
    """Similar pairs ``low < high`` of the undecided, or None where somewhere more than ``degree`` a vector would come."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, a, r_ids, r = _sides(left, right)
        high, low = np.zeros(0, int), np.zeros(0, int)
        if len(a_ids) and len(r_ids):
            close = ((a @ r.T) >= threshold) & (r_ids[None, :] < a_ids[:, None])
            if np.count_nonzero(close) > degree * (len(a_ids) + len(r_ids)):
                return pa.table({"low": pa.array([None], pa.int64()), "high": pa.array([None], pa.int64())})  # a crowd: no pairs of it are written
            high, low = np.nonzero(close)
        return pa.table({"low": pa.array(r_ids[low], pa.int64()), "high": pa.array(a_ids[high], pa.int64())})

    found = materialize(_meet(undecided, undecided, _block_counts(undecided, undecided, rows), work, "low bigint, high bigint"), "edges")
    if found.filter("low IS NULL").isEmpty():
        return found
    release(found)
    return None


def settle(ids: DataFrame, edges: DataFrame, block: int = SETTLED) -> tuple[DataFrame, int]:
    """Greedy choice by ascending id on a graph: ``entry_id, neighbour``, and the rounds it took.

    A node is chosen (its own ``neighbour``) iff no smaller neighbour is; else ``neighbour`` is a chosen one. Nodes stand in blocks of
    consecutive ids. A round walks every block in order as far as nodes outside it are not needed, then passes on what was decided. So a
    run of nodes that wait for each other takes a round for each block it enters, not for each node. A task holds the nodes of one block and
    the edges inside; edges between blocks only say who waits.
    """
    placed = number_rows(ids.select("entry_id"), "entry_id", name="_n")
    nodes = materialize(placed.select("entry_id", F.floor((F.col("_n") - 1) / block).cast("bigint").alias("block")), "nodes")

    def at(end: str) -> DataFrame:
        return nodes.select(F.col("entry_id").alias(end), F.col("block").alias(f"{end}_block"))

    ends = skew_join(edges.select("low", "high"), at("low"), "low", spread=F.col("high"))
    links = materialize(skew_join(ends, at("high"), "high", spread=F.col("low")), "links")
    answers, rounds = None, 0

    def walk(own: pa.Table, inside: pa.Table) -> pa.Table:
        own = own.sort_by("entry_id")
        names, waits = own.column("entry_id").to_numpy(), own.column("waits").to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(names, inside.column(c).to_numpy()) for c in ("low", "high"))
        low = low[np.argsort(high, kind="stable")]
        ends = np.cumsum(np.bincount(high, minlength=len(names)))
        chosen = np.full(len(names), -1)  # the smallest chosen neighbour, itself, or -1: open
        for i, (start, end) in enumerate(zip(np.r_[0, ends], ends)):
            below = low[start:end]
            taken = below[chosen[below] == below]
            if len(taken):
                chosen[i] = taken.min()
            elif not waits[i] and (chosen[below] >= 0).all():
                chosen[i] = i
        known = chosen >= 0
        return pa.table({"entry_id": pa.array(names[known], pa.int64()), "neighbour": pa.array(names[chosen[known]], pa.int64())})

    while not nodes.isEmpty():
        rounds += 1
        between = links.filter("low_block <> high_block")
        waiting = between.select(F.col("high").alias("entry_id"), F.lit(True).alias("waits")).distinct()
        own = nodes.join(waiting, "entry_id", "left").fillna(False, ["waits"])
        inside = links.filter("low_block = high_block").select(F.col("high_block").alias("_block"), "low", "high")
        walked = materialize(own.groupBy("block").cogroup(inside.groupBy("_block")).applyInArrow(walk, "entry_id bigint, neighbour bigint"), "walked")
        chosen = walked.filter("entry_id = neighbour").select(F.col("entry_id").alias("low"))
        reached = skew_join(between, chosen, "low", "left_semi", spread=F.col("high")).select(F.col("high").alias("entry_id"), F.col("low").alias("neighbour"))
        decided = materialize(walked.unionByName(reached).groupBy("entry_id").agg(F.min("neighbour").alias("neighbour")), "decided")
        answers = decided if answers is None else answers.unionByName(decided)
        left = materialize(nodes.join(decided, "entry_id", "left_anti"), "nodes")
        rest = skew_join(links, decided.select(F.col("entry_id").alias("low")), "low", "left_anti", spread=F.col("high"))
        rest = materialize(skew_join(rest, decided.select(F.col("entry_id").alias("high")), "high", "left_anti", spread=F.col("low")), "links")
        release(nodes, links, walked)
        nodes, links = left, rest
    return (ids.select("entry_id", F.col("entry_id").alias("neighbour")) if answers is None else answers), rounds


def leader_clusters(sigs: DataFrame, threshold: float = VISUAL_THRESHOLD, cell_rows: int = BLOCK,
                    block: int = BLOCK, ballot: int = BALLOT, degree: int = DEGREE) -> DataFrame:
    """Greedy leader clustering by ascending id: ``entry_id, leader``.

    A vector leads iff no leader with a smaller id is similar to it. Similar pairs are found once and the leaders then chosen on the
    pairs alone (:func:`settle`). Where crowds of look-alikes would give more than ``degree`` pairs a vector, they are thinned first: every
    cell puts forward its ``ballot`` smallest undecided ids, those without a smaller undecided neighbour lead, and whatever is similar to a
    leader is out. At the end each member joins its smallest similar leader, which is what the sequential loop does.
    """
    reps, copies = collapse_copies(materialize(sigs, "signatures"))
    cells = materialize(_cells(reps, threshold, cell_rows), "cells")
    open_ids, decided = cells, []
    while (edges := _edges(open_ids, threshold, block, degree)) is None:
        turn = F.row_number().over(Window.partitionBy("home").orderBy("entry_id"))
        standing = open_ids.withColumn("_turn", turn).filter(F.col("_turn") <= ballot).drop("_turn")
        blocked = _smallest_neighbour(open_ids, standing, threshold, block, "routed")
        elected = materialize(standing.join(blocked, "entry_id", "left_anti"), "leaders")
        out = materialize(_smallest_neighbour(open_ids, elected, threshold, block, "anchored"), "members")
        left = materialize(open_ids.join(elected, "entry_id", "left_anti").join(out, "entry_id", "left_anti"), "undecided")
        if open_ids is not cells:
            release(open_ids)
        open_ids = left
        decided += [elected.select("entry_id", F.col("entry_id").alias("neighbour")), out]
    answers, _ = settle(open_ids, edges)
    for part in decided:
        answers = answers.unionByName(part)
    answers = materialize(answers, "answers")
    own = answers.filter("entry_id = neighbour").select("entry_id", F.col("entry_id").alias("leader"))
    leaders = cells.join(own.select("entry_id"), "entry_id", "left_semi")
    # a leader chosen late may be smaller than the one that took a member out
    joined = _smallest_neighbour(cells, leaders, threshold, block, "anchored").join(own, "entry_id", "left_anti")
    members = joined.unionByName(answers.filter("entry_id <> neighbour")).groupBy("entry_id").agg(F.min("neighbour").alias("leader"))
    leader_of = own.unionByName(members).withColumnRenamed("entry_id", "representative")
    return skew_join(copies, leader_of, "representative", spread=F.col("entry_id")).select("entry_id", "leader")


def visual_duplicates(cat: Catalog, model: str, threshold: float = VISUAL_THRESHOLD,
                      min_size: int = MIN_DUPLICATE, limit: int = DUPLICATE_GROUPS) -> DataFrame:
    """Clusters of look-alikes with count, largest size and recoverable bytes, most wasteful first."""
    clusters = leader_clusters(signatures(cat, model), threshold)
    items = clusters.join(cat.entries.select(F.col("id").alias("entry_id"), "disk_id", "name", "size_logical"),
                          "entry_id")
    known = with_disk_name(items, cat)
    largest = F.max(F.struct("size_logical", (-F.col("entry_id")).alias("_id"), "name")).alias("top")
    groups = known.groupBy("leader").agg(
        F.count(F.lit(1)).alias("count"), F.sum("size_logical").alias("total"), largest)
    return groups.filter((F.col("count") >= 2) & (F.col("top.size_logical") >= min_size)).select(
        "leader", F.col("top.name").alias("name"), F.col("top.size_logical").alias("size"), "count",
        (F.col("total") - F.col("top.size_logical")).alias("wasted"),
    ).orderBy(F.col("wasted").desc(), "leader").limit(limit)


# --- visual and spoken together --------------------------------------------------------------------


def hybrid_merge(visual: DataFrame, spoken: DataFrame, limit: int = HYBRID_LIMIT) -> DataFrame:
    """Visual hits by score, then spoken hits that were not among them."""
    columns = ["id", "score", "frame_ts", "snippet", "origin"]
    seen = visual.select("id", "score", "frame_ts", F.lit(None).cast("string").alias("snippet"),
                         F.lit(0).alias("origin"))
    heard = spoken.join(visual, "id", "left_anti").select(
        "id", "score", F.lit(None).cast("double").alias("frame_ts"), "snippet", F.lit(1).alias("origin"))
    order = [F.col("origin"), F.col("score").desc(), F.col("id")]
    return seen.select(columns).unionByName(heard.select(columns)).orderBy(*order).limit(limit)


def hybrid_search(cat: Catalog, filters: dict, model: str | None = None, query: list[float] | None = None,
                  text: str | None = None, lang: str | None = None, threshold: float = 0.05,
                  limit: int = HYBRID_LIMIT) -> DataFrame:
    """Look for a concept by vector and by words spoken, under attribute filters.

    Filters come before the ranking on both sides, so however few entries pass them, the page fills. Without a
    concept this is the attribute search, text included. Spoken hits have no graded score; they keep their relevance
    order behind the visual ones.
    """
    if query is None and not text:
        return search_advanced(cat, filters)
    attributes = {k: v for k, v in filters.items() if k != "text"}
    within = filtered_ids(cat, attributes)
    visual = spoken = None
    if query is not None:
        visual = semantic_search(cat, model, query, threshold, limit, within=within)
    if text:
        heard = search_transcripts(cat, text, limit, lang, within).withColumnRenamed("entry_id", "id")
        spoken = to_items(cat, heard.withColumn("score", -F.col("score")))
    if visual is None:
        visual = spoken.filter(F.lit(False)).withColumn("frame_ts", F.lit(None).cast("double"))
    if spoken is None:
        spoken = visual.filter(F.lit(False)).withColumn("snippet", F.lit(None).cast("string"))
    return hybrid_merge(visual, spoken, limit)
