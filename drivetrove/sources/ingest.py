"""Importing, rescanning and editing catalogues. Every function returns a new :class:`Catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from drivetrove.catalog import Catalog, disk_counts
from drivetrove.functions import paths, text as tx
from drivetrove.operators import search, tree
from drivetrove.schema import DERIVED, ENRICHMENT, TABLES, conform
from drivetrove.session import materialize, skew_join

# Input trees: nodes(disk_name, local_idx, parent_idx, name, is_folder, size_logical, size_physical,
# created, modified [, enrichment columns]); parent_idx -1 marks the root and 0 an unknown time.


def _unknown_if_zero(column: str):
    return F.when(F.col(column) != 0, F.col(column))


def number_trees(nodes: DataFrame, disks: DataFrame, next_disk: int, next_entry: int) -> tuple[DataFrame, DataFrame]:
    """Global ids for many trees at once: ``id = base + local_idx``.

    The base is a running sum over one row per disk; entries themselves are never sorted or numbered.
    """
    sizes = nodes.groupBy("disk_name").agg((F.max("local_idx") + 1).alias("_n"))
    order = Window.orderBy("disk_name")
    before = Window.orderBy("disk_name").rowsBetween(Window.unboundedPreceding, -1)
    # stored, so its size is known and rows need no shuffle to meet it
    numbered = materialize(disks.join(sizes, disks["name"] == sizes["disk_name"]).withColumns({
        "disk_id": F.row_number().over(order).cast("bigint") + (next_disk - 1),
        "base": F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.lit(next_entry),
    }).drop("_n"), "numbered")
    return numbered, nodes.join(numbered.select("disk_name", "disk_id", "base"), "disk_name")


def entries_of(nodes: DataFrame) -> DataFrame:
    """Numbered nodes as catalogue entries with paths and recursive folder sizes."""
    have = set(nodes.columns)
    flat = nodes.select(
        (F.col("base") + F.col("local_idx")).alias("id"), "disk_id",
        F.when(F.col("parent_idx") >= 0, F.col("base") + F.col("parent_idx")).alias("parent_id"),
        "name", "is_folder", "size_logical", "size_physical",
        _unknown_if_zero("created").alias("created_at"), _unknown_if_zero("modified").alias("modified_at"),
        F.when(~F.col("is_folder"), tx.extension(F.col("name"))).alias("ext"),
        *[c for c in ENRICHMENT if c in have])
    return conform(tree.with_paths_and_sizes(flat), "entries")


def _top_ids(cat: Catalog) -> tuple[int, int]:
    disks = cat.disks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    entries = cat.entries.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return disks + 1, entries + 1


def _with_index(cat: Catalog, entries: DataFrame) -> Catalog:
    """Add new entries together with their name postings and index facts."""
    docs = search.name_documents(entries)
    stats, terms, known = search.index_stats(docs), {}, "name_stats" in cat
    if "name_terms" in cat or "name_postings" not in cat:  # an index without a dictionary goes on without one
        terms["name_terms"] = lambda: conform(search.merge_terms(cat["name_terms"], search.build_terms(docs)), "name_terms")
    return cat.replacing(
        entries=cat.entries.unionByName(entries),
        name_postings=lambda: cat["name_postings"].unionByName(conform(search.name_postings(docs), "name_postings")),
        name_stats=(lambda: cat["name_stats"].unionByName(stats)) if known else stats, **terms)


def _add_disks(cat: Catalog, numbered: DataFrame, entries: DataFrame) -> Catalog:
    counted = numbered.drop("id", "total_size", "file_count", "folder_count").join(disk_counts(entries), "disk_id")
    rows = conform(counted.withColumnRenamed("disk_id", "id"), "disks")
    return _with_index(cat.replacing(disks=cat.disks.unionByName(rows)), entries)


def bulk_ingest(cat: Catalog, nodes: DataFrame) -> Catalog:
    """Import trees as offline archive disks."""
    disks = nodes.select(F.col("disk_name").alias("name"), F.lit("archive").alias("kind"),
                         F.lit(False).alias("is_online")).distinct()
    numbered, placed = number_trees(nodes, disks, *_top_ids(cat))
    return _add_disks(cat, numbered, materialize(entries_of(placed), "entries"))


def drop_disks(cat: Catalog, ids: DataFrame) -> Catalog:
    """Remove whole disks ``ids(id)`` with every derived row and posting; tables that nobody asks for are not built for it."""
    gone = ids.select(F.col("id").alias("disk_id")).distinct()
    leaving = cat.entries.join(gone, "disk_id", "left_semi").select(F.col("id").alias("entry_id"))
    changed = {"disks": cat.disks.join(gone.select(F.col("disk_id").alias("id")), "id", "left_anti"),
               "entries": cat.entries.join(gone, "disk_id", "left_anti")}
    # like the tables of any catalogue, built when they are first asked for
    for table in DERIVED:
        if table in cat:
            by_disk = "disk_id" in TABLES[table].names
            changed[table] = lambda table=table, by_disk=by_disk: cat[table].join(
                gone if by_disk else leaving, "disk_id" if by_disk else "entry_id", "left_anti")
    for facts in ("name_stats", "text_stats", "name_terms"):
        if facts in cat:
            changed[facts] = lambda facts=facts: cat[facts].join(gone, "disk_id", "left_anti")
    return cat.replacing(**changed)


def delete_disk(cat: Catalog, disk_id: int) -> Catalog:
    return drop_disks(cat, cat.disks.filter(F.col("id") == disk_id).select("id"))


def delete_subtrees(cat: Catalog, ids: DataFrame) -> Catalog:
    """Remove entries ``ids(id)`` with everything below them and all derived rows.

    Folders above lose what leaves, as do the counts of disks and the facts of both indexes; nothing else is worked out anew.
    """
    leaving = materialize(tree.subtree(cat.entries, ids).select(
        "id", "disk_id", "parent_id", "name", "is_folder", "size_logical", "size_physical", "ancestor_ids"), "leaving")
    lost = leaving.select("id", "parent_id", "is_folder", "ancestor_ids", (-F.coalesce("size_logical", F.lit(0))).alias("l"), (-F.coalesce("size_physical", F.lit(0))).alias("p"))
    left = _grown(cat.entries.join(leaving.select("id"), "id", "left_anti"), _above(lost))
    changed = {"entries": left}
    by_entry = leaving.select(F.col("id").alias("entry_id"))
    for table in DERIVED:
        if table in cat:
            changed[table] = lambda table=table: cat[table].join(by_entry, "entry_id", "left_anti")
    names = search.name_documents(leaving)

    def fewer_docs(stats: str, docs: DataFrame) -> DataFrame:
        fewer = search.index_stats(docs).select("disk_id", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_words")).alias("n_words"))
        return cat[stats].unionByName(fewer).groupBy("disk_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))

    if "name_stats" in cat:
        changed["name_stats"] = lambda: fewer_docs("name_stats", names)
    if "text_stats" in cat and "transcripts" in cat:
        changed["text_stats"] = lambda: fewer_docs("text_stats", cat.transcripts.join(
            leaving.select(F.col("id").alias("entry_id"), "disk_id"), "entry_id"))
    if "name_terms" in cat:
        changed["name_terms"] = lambda: search.merge_terms(cat["name_terms"], search.build_terms(names).withColumn("n", -F.col("n")))
    fewer = disk_counts(leaving).select(F.col("disk_id").alias("id"), *[(-F.col(c)).alias(c) for c in COUNTS])
    changed["disks"] = _counted(cat.disks, fewer)
    return cat.replacing(**changed)


COUNTS = ("file_count", "folder_count", "total_size")


def _above(files: DataFrame) -> DataFrame:
    """What changed sizes (``parent_id, is_folder, ancestor_ids, l, p``) add to the folders above the files: ``id, l, p``. Files of one
    folder are summed before its ancestors are listed."""
    direct = files.filter("NOT is_folder AND parent_id IS NOT NULL").groupBy("parent_id").agg(
        F.sum("l").alias("l"), F.sum("p").alias("p"), F.any_value("ancestor_ids").alias("ancestor_ids"))
    return direct.select(F.explode("ancestor_ids").alias("id"), "l", "p").groupBy("id").agg(F.sum("l").alias("l"), F.sum("p").alias("p"))


def _grown(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """``entries`` with the changes ``(id, l, p)`` added to their sizes."""
    joined = entries.join(changes.select("id", F.col("l").alias("_l"), F.col("p").alias("_p")), "id", "left")
    added = {"size_logical": "_l", "size_physical": "_p"}
    return joined.select(*[F.when(F.col(added[c]).isNull(), F.col(c)).otherwise(F.coalesce(c, F.lit(0)) + F.col(added[c])).alias(c) if c in added else F.col(c) for c in entries.columns])


def _counted(disks: DataFrame, changes: DataFrame) -> DataFrame:
    """``disks`` with changes ``(id, file_count, folder_count, total_size)`` added."""
    summed = changes.groupBy("id").agg(*[F.sum(c).alias(f"_{c}") for c in COUNTS])
    joined = disks.join(summed, "id", "left")
    return joined.select(*[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in COUNTS else F.col(c) for c in disks.columns])


def same_disk(disks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Catalogued disks that are the scanned ``volumes(volume_uuid, name)``: ``id, volume_name``.

    A disk is the same by uuid; a disk without uuid is the same by name. Two known uuids never mix.
    """
    by_uuid = disks.filter("volume_uuid IS NOT NULL").join(
        volumes.filter("volume_uuid IS NOT NULL").select("volume_uuid", F.col("name").alias("volume_name")), "volume_uuid")
    by_name = disks.filter("volume_uuid IS NULL").join(
        volumes.select(F.col("name").alias("volume_name")).distinct(), disks["name"] == F.col("volume_name"))
    return by_uuid.select("id", "volume_name").unionByName(by_name.select("id", "volume_name")).distinct()


def preserve_enrichment(fresh: DataFrame, old: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fill enrichment columns of ``fresh`` files from ``old`` ones that did not change.

    Unchanged means same relative path, same size and same known modification time. Fresh values win
    column by column, except that hash, algorithm and hashing time always come from one side.
    """
    on = [*keys, "rel_path"]
    any_known = F.lit(False)
    for c in ENRICHMENT:
        any_known = any_known | F.col(c).isNotNull()
    # several old nodes on one path: the newest one counts
    kept = old.filter((~F.col("is_folder")) & any_known & F.col("rel_path").isNotNull()).groupBy(*on).agg(
        F.max(F.struct("id", "size_logical", "modified_at", *ENRICHMENT)).alias("_o"))
    joined = skew_join(fresh, kept, on, "left", spread=F.col("id"))
    unchanged = ((~F.col("is_folder")) & F.col("modified_at").isNotNull()
                 & (F.col("_o.modified_at") == F.col("modified_at"))
                 & (F.col("_o.size_logical") == F.col("size_logical")))
    hashed = F.col("content_hash").isNotNull()

    def filled(c: str):
        before = F.when(unchanged, F.col(f"_o.{c}"))
        if c in ("content_hash", "hash_algo", "hashed_at"):
            return F.when(hashed, F.col(c)).otherwise(before)
        return F.coalesce(F.col(c), before)

    return joined.select(*[filled(c).alias(c) if c in ENRICHMENT else F.col(c) for c in fresh.columns])


def rescan_replace(cat: Catalog, nodes: DataFrame, volumes: DataFrame) -> tuple[Catalog, DataFrame]:
    """Replace every scanned volume by its fresh tree and keep the enrichment of unchanged files.

    ``volumes(name, volume_uuid, kind, capacity, mount_path, scanned_at)`` describes the scanned volumes,
    ``nodes`` holds their trees under ``disk_name = name``. Also returns one report row per volume.
    """
    old = materialize(same_disk(cat.disks, volumes), "replaced")
    numbered, placed = number_trees(nodes, volumes.withColumn("is_online", F.lit(True)), *_top_ids(cat))
    fresh = materialize(entries_of(placed), "fresh")
    names = numbered.select(F.col("disk_id"), F.col("disk_name").alias("volume_name"))
    before = cat.entries.join(old.withColumnRenamed("id", "disk_id"), "disk_id")
    kept = preserve_enrichment(fresh.join(names, "disk_id"), before, ("volume_name",))
    rows = materialize(conform(kept, "entries"), "entries")
    after = _add_disks(drop_disks(cat, old.select("id")), numbered, rows)
    replaced = old.groupBy("volume_name").agg(F.count(F.lit(1)).alias("_n"))
    report = numbered.select("disk_id", F.col("disk_name").alias("volume_name")).join(
        disk_counts(rows), "disk_id").join(replaced, "volume_name", "left").select(
        "volume_name", "disk_id", (F.col("file_count") + F.col("folder_count")).alias("entries"),
        F.col("file_count").alias("files"), F.col("folder_count").alias("folders"),
        F.col("_n").isNotNull().alias("replaced"))
    return after, report


def merge_import(cat: Catalog, nodes: DataFrame, replace: bool = False) -> Catalog:
    """Add trees by disk name; known names are replaced or kept as they are."""
    incoming = nodes.select(F.col("disk_name").alias("name")).distinct()
    if replace:
        known = cat.disks.join(incoming, "name", "left_semi").select("id")
        return bulk_ingest(drop_disks(cat, known), nodes)
    new = nodes.join(cat.disks.select(F.col("name").alias("disk_name")), "disk_name", "left_anti")
    return bulk_ingest(cat, new)


def latest_disk(cat: Catalog, volume_uuid: str | None = None, name: str | None = None) -> DataFrame:
    """Entries of the newest disk by uuid, or by name among the disks without uuid."""
    if volume_uuid is not None:
        mine = cat.disks.filter(F.col("volume_uuid") == volume_uuid)
    else:
        mine = cat.disks.filter(F.col("volume_uuid").isNull() & (F.col("name") == name))
    newest = mine.agg(F.max("id")).scalar()
    return cat.entries.filter(F.col("disk_id") == newest)


def incremental_splice(old: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = (),
                       force_full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Combine a catalogued tree with a fresh listing, both by ``rel_path``.

    Below every topmost folder whose modification time did not change (and is known) the old rows are
    reused; everything else comes from the listing. Returns the rows and the reused folders.
    """
    on = [*keys, "rel_path"]
    columns = [*on, "name", "is_folder", "size_logical", "size_physical", "created_at", "modified_at"]
    # both are read several times: stored are only the columns that count, with the folder that a row lies in
    old, fresh = (materialize(rows.select(*columns, paths.parent(F.col("rel_path")).alias("_up")), name) for rows, name in ((old, "old"), (fresh, "listed")))
    known = old.filter("is_folder AND modified_at <> 0 AND rel_path IS NOT NULL AND rel_path <> ''").select(
        *on, F.col("modified_at").alias("_was"))
    steady = fresh.filter("is_folder AND modified_at <> 0").join(known, on).filter("modified_at = _was").select(*on)
    if force_full:
        steady = steady.filter(F.lit(False))
    top = materialize(
        tree.minimal_cover(steady.withColumnRenamed("rel_path", "path"), keys).withColumnRenamed("path", "rel_path"),
        "reused")

    # Whether a row lies below a reused folder depends on its parent only: folders are expanded, not rows.
    def below(rows: DataFrame, how: str) -> DataFrame:
        parents = rows.select(*keys, "_up").distinct().withColumn(
            "rel_path", F.explode(paths.prefixes(F.col("_up"), include_self=True)))
        covered = skew_join(parents, top, on, "left_semi", spread=F.col("_up")).select(*keys, "_up").distinct()
        return skew_join(rows, covered, [*keys, "_up"], how, spread=F.col("rel_path")).select(*columns)

    named = F.col("rel_path").isNotNull()
    # roots have no relative path and always come from the listing
    kept = below(fresh.filter(named), "left_anti").unionByName(fresh.filter(~named).select(columns))
    return kept.unionByName(below(old.filter(named), "left_semi")), top


def register_copied(cat: Catalog, copied: DataFrame) -> tuple[Catalog, DataFrame]:
    """Enter copied items ``(disk_id, rel_path, size, is_folder)`` into the destination catalogues.

    Missing ancestor folders are created, existing files get the new size, new files are added and
    indexed. Idempotent; also returns the inserted files. Only new nodes get chains, from the nearest folder that exists; folders
    above take the changes of size that reach them through stored ancestors, and disks those of their counts.
    """
    copied = materialize(copied.select("disk_id", "rel_path", "size", "is_folder"), "asked")  # a comparison as a rule, read three times
    folders = copied.select("disk_id", F.explode(paths.prefixes(F.col("rel_path"))).alias("rel_path")).unionByName(
        copied.filter("is_folder").select("disk_id", "rel_path")).filter("rel_path <> ''").distinct()
    wanted = materialize(
        folders.withColumn("is_folder", F.lit(True)).withColumn("size", F.lit(0).cast("bigint")).unionByName(
            copied.filter("NOT is_folder").groupBy("disk_id", "rel_path").agg(F.max("size").alias("size"))
            .withColumn("is_folder", F.lit(False)).select("disk_id", "rel_path", "is_folder", "size")), "copied")
    on = ["disk_id", "rel_path", "is_folder"]
    roots = cat.entries.filter("parent_id IS NULL").select("disk_id", F.col("id").alias("_root"), F.col("path").alias("_base"))
    known = cat.entries.filter("rel_path IS NOT NULL")
    new = wanted.join(known.select(*on), on, "left_anti").join(roots, "disk_id")
    # dense new ids: one offset per partition, rows stay where they are
    placed = materialize(new.withColumn("_part", F.spark_partition_id()).withColumn(
        "_seq", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33)), "new")
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_off", F.coalesce(F.sum("_n").over(first), F.lit(0))).select("_part", "_off")
    top = _top_ids(cat)[1]
    fresh = placed.join(F.broadcast(offsets), "_part").withColumn("id", F.col("_off") + F.col("_seq") + F.lit(top))
    up = paths.parent(F.col("rel_path"))
    parents = known.filter("is_folder").select("disk_id", F.col("rel_path").alias("_up"), F.col("id").alias("_pid")) \
        .unionByName(fresh.filter("is_folder").select("disk_id", F.col("rel_path").alias("_up"), F.col("id").alias("_pid"))) \
        .groupBy("disk_id", "_up").agg(F.max("_pid").alias("_pid"))
    linked = skew_join(fresh.withColumn("_up", up), parents, ["disk_id", "_up"], "left", spread=F.col("id"))
    # the folders on the way to a new node: those that exist end in one whose ancestors are stored, the others are new
    way = fresh.select("id", "disk_id", F.explode(paths.prefixes(F.col("rel_path"))).alias("_up")).filter("_up <> ''")
    stored = known.filter("is_folder").groupBy("disk_id", F.col("rel_path").alias("_up")).agg(F.max(F.struct("id", "ancestor_ids")).alias("_at"))
    made = fresh.filter("is_folder").select("disk_id", F.col("rel_path").alias("_up"), F.col("id").alias("_made"))
    deep = F.size(F.split("_up", "/"))
    met = way.join(stored, ["disk_id", "_up"], "left").join(made, ["disk_id", "_up"], "left")
    chains = met.groupBy("id").agg(
        F.max_by(F.concat("_at.ancestor_ids", F.array("_at.id")), F.when(F.col("_at").isNotNull(), deep)).alias("_known"),
        F.sort_array(F.collect_list(F.when(F.col("_made").isNotNull(), F.struct(deep.alias("d"), "_made")))).alias("_new"))  # a path's folders
    name = F.element_at(F.split("rel_path", "/"), -1)
    ancestors = F.concat(F.coalesce("_known", F.array("_root")), F.coalesce(F.transform("_new", lambda x: x["_made"]), F.array().cast("array<bigint>")))
    added = materialize(conform(linked.join(chains, "id", "left").select(
        "id", "disk_id", F.coalesce("_pid", "_root").alias("parent_id"), name.alias("name"), "is_folder",
        F.when(F.col("is_folder"), F.lit(0)).otherwise(F.col("size")).cast("bigint").alias("size_logical"),
        F.when(F.col("is_folder"), F.lit(0)).otherwise(F.col("size")).cast("bigint").alias("size_physical"),
        F.when(~F.col("is_folder"), tx.extension(name)).alias("ext"), F.concat("_base", F.lit("/"), "rel_path").alias("path"), "rel_path",
        F.size(ancestors).alias("depth"), ancestors.alias("ancestor_ids")), "entries"), "added")
    sizes = wanted.filter("NOT is_folder").select(*on, "size")
    resized = materialize(known.filter("NOT is_folder").join(sizes, on).select(
        "id", "disk_id", "parent_id", "is_folder", "ancestor_ids", (F.col("size") - F.coalesce("size_logical", F.lit(0))).alias("l"),
        (F.col("size") - F.coalesce("size_physical", F.lit(0))).alias("p")), "resized")
    moved = resized.drop("id").unionByName(added.select("disk_id", "parent_id", "is_folder", "ancestor_ids", F.col("size_logical").alias("l"), F.col("size_physical").alias("p")))
    changes = materialize(_above(moved).unionByName(resized.select("id", "l", "p")), "changes")
    after = _grown(cat.entries.unionByName(added), changes)
    new_rows = _grown(added, changes)
    inserted = new_rows.filter("NOT is_folder")
    indexed = _with_index(cat, new_rows)
    grown = resized.groupBy(F.col("disk_id").alias("id")).agg(F.sum("l").alias("total_size")).select("id", F.lit(0).alias("file_count"), F.lit(0).alias("folder_count"), "total_size")
    more = disk_counts(added).withColumnRenamed("disk_id", "id").select("id", *COUNTS).unionByName(grown.select("id", *COUNTS))
    return indexed.replacing(entries=conform(after, "entries"), disks=conform(_counted(cat.disks, more), "disks")), inserted


def apply_annotations(df: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Set ``columns`` of the rows named by ``updates(id, ...)``; NULL is a legal new value."""
    new = updates.select("id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(new, "id", "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns
                           else F.col(c) for c in df.columns])


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of old rows with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def clear_embeddings(cat: Catalog, model: str, ids: DataFrame | None = None) -> Catalog:
    """Forget the vectors of one model, for all entries or for ``ids(entry_id)``."""
    mine = F.col("model") == model
    if ids is None:
        return cat.replacing(embeddings=cat.embeddings.filter(~mine))
    gone = cat.embeddings.filter(mine).join(ids.select("entry_id").distinct(), "entry_id", "left_anti")
    return cat.replacing(embeddings=cat.embeddings.filter(~mine).unionByName(gone))


def upsert_transcripts(cat: Catalog, new: DataFrame) -> Catalog:
    """Store transcripts by entry and replace their index rows, so no stale word remains."""
    old = cat.transcripts.join(new.select("entry_id"), "entry_id", "left_semi")
    disk_of = cat.entries.select(F.col("id").alias("entry_id"), "disk_id")
    docs = new.join(disk_of, "entry_id").select("entry_id", "disk_id", "text")
    postings = conform(search.build_postings(docs), "text_postings")
    away = search.index_stats(old.join(disk_of, "entry_id").select("entry_id", "disk_id", "text")).select(
        "disk_id", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_words")).alias("n_words"))
    stats = search.index_stats(docs).unionByName(away)
    if "text_stats" in cat:
        stats = cat["text_stats"].unionByName(stats)
    return cat.replacing(
        transcripts=replace_by_key(cat.transcripts, conform(new, "transcripts"), ["entry_id"]),
        text_postings=replace_by_key(cat.text_postings, postings, ["entry_id"])
        if "text_postings" in cat else postings,
        text_stats=stats.groupBy("disk_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words")))
