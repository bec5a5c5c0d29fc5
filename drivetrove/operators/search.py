"""Name search, transcript search and attribute search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from drivetrove.catalog import Catalog
from drivetrove.functions import text as tx, words
from drivetrove.operators.stats import with_disk_name

NAME_LIMIT = 1000
ADVANCED_LIMIT = 2000
SCOPED_LIMIT = 500
TRANSCRIPT_LIMIT = 200
SNIPPET_WORDS = 12

#: Prefixes of so many letters have their entries counted in the dictionary.
PREFIX = 3

# BM25 parameters of the usual full-text default ranking.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6


def build_postings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Inverted index of ``docs(entry_id, disk_id, text)``: one row per word and entry.

    Texts move to their entry, so words are counted where they are read; they would be several times the text.
    """
    split = docs.select("entry_id", "disk_id", text_col).repartition("entry_id").select("entry_id", "disk_id", tx.tokens(F.col(text_col)).alias("w"))
    return (
        split.select("entry_id", "disk_id", F.size("w").alias("doc_len"), F.explode("w").alias("token"))
        .groupBy("token", "entry_id", "disk_id", "doc_len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        .select("token", "entry_id", "disk_id", "tf", "doc_len")
    )


def name_postings(docs: DataFrame) -> DataFrame:
    """:func:`build_postings` for names, one row of ``docs(entry_id, disk_id, text)`` per entry: words are counted inside their row, so
    nothing is shuffled."""
    split = docs.select("entry_id", "disk_id", tx.tokens(F.col("text")).alias("w"))
    spread = split.select("entry_id", "disk_id", F.size("w").alias("doc_len"), "w", F.explode(F.array_distinct("w")).alias("token"))
    return spread.select("token", "entry_id", "disk_id", F.size(F.filter("w", lambda x: x == F.col("token"))).alias("tf"), "doc_len")


def name_documents(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("id").alias("entry_id"), "disk_id", F.col("name").alias("text"))


def index_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus facts of BM25: number of documents and words, per disk so that they can be maintained."""
    return docs.groupBy("disk_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(F.size(tx.tokens(F.col(text_col)))), F.lit(0)).alias("n_words"))


def build_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Dictionary of ``docs(disk_id, text)``: how many of a disk's entries hold a word with each frequency and length (its impact
    classes), and, under the prefix and ``*``, how many hold a word that begins with its first letters."""
    split = docs.select("disk_id", tx.tokens(F.col(text_col)).alias("w"))
    count = F.count(F.lit(1)).alias("n")
    spread = split.select("disk_id", F.size("w").alias("doc_len"), "w", F.explode(F.array_distinct("w")).alias("token"))
    classes = spread.withColumn("tf", F.size(F.filter("w", lambda x: x == F.col("token")))).groupBy("token", "disk_id", "tf", "doc_len").agg(count)
    starts = F.array_distinct(F.concat(*map(_starts, range(1, PREFIX + 1))))
    begun = split.select("disk_id", F.explode(starts).alias("token")).groupBy("token", "disk_id").agg(count)
    return classes.select("token", "disk_id", "tf", "doc_len", "n").unionByName(
        begun.select("token", "disk_id", F.lit(0).alias("tf"), F.lit(0).alias("doc_len"), "n"))


def _starts(size: int) -> Column:
    """The first ``size`` letters of the words that have as many, marked."""
    return F.transform(F.filter("w", lambda x: F.length(x) >= size), lambda x: F.concat(F.substring(x, 1, size), F.lit("*")))


def merge_terms(*parts: DataFrame) -> DataFrame:
    """Dictionaries added up; a part may take away with negative counts."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("token", "disk_id", "tf", "doc_len").agg(F.sum("n").alias("n")).filter("n > 0")


def update_postings(index: DataFrame, replaced: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop the postings of ``replaced(disk_id)`` and add those of ``fresh`` documents."""
    return index.join(replaced.select("disk_id").distinct(), "disk_id", "left_anti").unionByName(fresh)


def _matches(token: Column, term: tuple[str, bool]) -> Column:
    word, prefix = term
    return F.startswith(token, F.lit(word)) if prefix else token == F.lit(word)


def rank_text(postings: DataFrame, stats: DataFrame, terms: list[tuple[str, bool]],
              disk_id: int | None = None) -> DataFrame:
    """Entries holding every term: BM25 score (lower is better) and their ``total`` on each row.

    All terms are counted in one aggregation keyed by entry. A prefix counts as one term: its frequency
    is the sum over all words it matches. Corpus facts stay global when the answer is cut to one disk.
    """
    if not terms:
        return postings.filter(F.lit(False)).select("entry_id", "disk_id", F.lit(0.0).alias("score"),
                                                    F.lit(0).cast("bigint").alias("total"))
    any_term = F.lit(False)
    for term in terms:
        any_term = any_term | _matches(F.col("token"), term)
    hits = postings.filter(any_term).groupBy("entry_id").agg(
        F.max("disk_id").alias("disk_id"), F.max("doc_len").alias("doc_len"),
        *[F.coalesce(F.sum(F.when(_matches(F.col("token"), t), F.col("tf"))), F.lit(0)).alias(f"tf{i}")
          for i, t in enumerate(terms)])
    wanted = F.lit(True) if disk_id is None else F.col("disk_id") == disk_id
    for i in range(len(terms)):
        wanted = wanted & (F.col(f"tf{i}") > 0)
    # one row: how many entries hold each term, and how many are wanted
    df = hits.agg(F.struct(F.count_if(wanted).alias("total"), *[
        F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])).scalar()
    corpus = stats.agg(F.struct(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words"))).scalar()
    scored = hits.filter(wanted).withColumn("_df", df).withColumn("_c", corpus)
    n = F.col("_c.n")
    length = F.lit(1 - B) + F.lit(B) * F.col("doc_len") * n / F.col("_c.words")
    score = F.lit(0.0)
    for i in range(len(terms)):
        seen = F.col(f"_df.df{i}")
        idf = F.greatest(F.log((n - seen + 0.5) / (seen + 0.5)), F.lit(MIN_IDF))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + F.lit(K1) * length)
    return scored.select("entry_id", "disk_id", (-score).alias("score"), F.col("_df.total").alias("total"))


def to_items(cat: Catalog, hits: DataFrame) -> DataFrame:
    """Hits ``(id, ...)`` as items with disk name and path; unknown ids disappear."""
    items = cat.entries.select("id", "disk_id", "name", "is_folder", "size_logical", "modified_at", "ext", "path",
                               "gps_place", "light_phase")
    # with the disk at hand only its part of the table is read
    return with_disk_name(hits.join(items, ["disk_id", "id"] if "disk_id" in hits.columns else "id"), cat)


def search_items(cat: Catalog, hits: DataFrame) -> DataFrame:
    """Items for ``hits(id, rank)`` in the order of ``rank``."""
    return to_items(cat, hits.select("id", "rank")).orderBy("rank", "id")


def _score(tf: Column, doc_len: Column, n: float, words: float, seen: float) -> Column:
    """BM25 part of one term (higher is better) by known corpus facts."""
    idf = max(math.log((n - seen + 0.5) / (seen + 0.5)), MIN_IDF)
    length = F.lit(1 - B) + F.lit(B) * doc_len * n / F.lit(words)
    return F.lit(idf) * tf * (K1 + 1) / (tf + F.lit(K1) * length)


def rank_names(cat: Catalog, terms: list[tuple[str, bool]], limit: int, disk_id: int | None = None) -> DataFrame:
    """What ``rank_text`` gives for names, the best ``limit`` of it at least, by way of the dictionary.

    The dictionary tells how many entries hold each term before any posting is read. A single word stops early: only postings
    of the impact classes that reach the page are read. Several terms start from the rarest word, and the others' postings
    count only where it occurs. Postings of other disks than ``disk_id`` are not read.
    """
    ids = cat.disks.agg(F.collect_set("id")).scalar()  # disks are few
    corpus = cat["name_stats"].agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).withColumn("disks", ids).first()
    present = F.col("disk_id").isin(corpus["disks"])  # a hit counts only with its disk, so the total agrees with the items
    postings = cat.name_postings.filter(present if disk_id is None else present & (F.col("disk_id") == disk_id))
    known = cat["name_terms"].filter(present)
    starts = [F.lit(f"{word}*") for word, prefix in terms if prefix and len(word) <= PREFIX]
    wanted = F.col("token").isin(*starts) if starts else F.lit(False)
    for term in terms:
        wanted = wanted | (_matches(F.col("token"), term) & (F.col("tf") > 0))
    facts = known.filter(wanted)
    per_term = [x for i, (word, prefix) in enumerate(terms) for x in (
        F.sum(F.when(_matches(F.col("token"), (word, prefix)) & (F.col("tf") > 0), F.col("n"))).alias(f"sum{i}"), F.max(F.when(_matches(F.col("token"), (word, prefix)) & (F.col("tf") > 0), F.col("token"))).alias(f"max{i}"),
        F.min(F.when(_matches(F.col("token"), (word, prefix)) & (F.col("tf") > 0), F.col("token"))).alias(f"min{i}"), F.sum(F.when(F.col("token") == F.lit(f"{word}*"), F.col("n"))).alias(f"begun{i}"))]
    told = facts.agg(*per_term).first()
    if any(told[f"sum{i}"] is None for i in range(len(terms))) or not corpus["docs"]:
        return rank_text(postings.filter(F.lit(False)), cat["name_stats"], terms)  # some term is nowhere
    single = [told[f"min{i}"] == told[f"max{i}"] for i in range(len(terms))]  # the term is one word
    n, words_ = float(corpus["docs"]), float(corpus["words"])
    if len(terms) == 1 and single[0]:
        seen = float(told["sum0"])
        here = facts.filter("tf > 0") if disk_id is None else facts.filter("tf > 0").filter(F.col("disk_id") == disk_id)
        score = -_score(F.col("tf"), F.col("doc_len"), n, words_, seen)
        classes = here.groupBy("tf", "doc_len").agg(F.sum("n").alias("n")).withColumn("score", score).orderBy("score").collect()  # as many as names have shapes
        total, reached, cut = sum(r["n"] for r in classes), 0, 0.0
        for r in classes:
            reached, cut = reached + r["n"], r["score"]
            if reached >= limit:
                break
        page = postings.filter(F.col("token") == F.lit(told["min0"])).withColumn("score", score).filter(F.col("score") <= cut + 1e-9)
        return page.select("entry_id", "disk_id", "score", F.lit(total).cast("bigint").alias("total"))
    exact = [i for i in range(len(terms)) if single[i]]
    rarest = min(exact, key=lambda i: told[f"sum{i}"]) if exact else None
    seen = []
    for i, (word, prefix) in enumerate(terms):
        if single[i]:
            seen.append(F.lit(float(told[f"sum{i}"])))
        elif told[f"begun{i}"] is not None:
            seen.append(F.lit(float(told[f"begun{i}"])))
        else:  # a long prefix of several words: its entries are counted
            every = cat.name_postings.filter(present & _matches(F.col("token"), (word, prefix)))
            seen.append(every.agg(F.count_distinct("entry_id").cast("double")).scalar())
    any_term = F.lit(False)
    for term in terms:
        any_term = any_term | _matches(F.col("token"), term)
    hits = postings.filter(any_term)
    if rarest is not None:
        first = postings.filter(F.col("token") == F.lit(told[f"min{rarest}"])).select("entry_id")
        hits = hits.join(first, "entry_id", "left_semi")
    hits = hits.groupBy("entry_id").agg(F.max("disk_id").alias("disk_id"), F.max("doc_len").alias("doc_len"), *[
        F.coalesce(F.sum(F.when(_matches(F.col("token"), t), F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
    for i in range(len(terms)):
        hits = hits.filter(F.col(f"tf{i}") > 0)
    length = F.lit(1 - B) + F.lit(B) * F.col("doc_len") * F.lit(n) / F.lit(words_)
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.lit(n) - seen[i] + 0.5) / (seen[i] + 0.5)), F.lit(MIN_IDF))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + F.lit(K1) * length)
    total = hits.agg(F.count(F.lit(1))).scalar()
    return hits.select("entry_id", "disk_id", (-score).alias("score"), total.alias("total"))


def search_names(cat: Catalog, query: str, limit: int = NAME_LIMIT, disk_id: int | None = None) -> DataFrame:
    """Best names first; every row carries the exact total and whether the page was cut."""
    terms = tx.query_terms(query)
    if "name_terms" in cat and terms:
        ranked = rank_names(cat, terms, limit, disk_id)
    else:
        # a hit counts only with its disk, so the total agrees with the items
        present = cat.name_postings.join(cat.disks.select(F.col("id").alias("disk_id")), "disk_id", "left_semi")
        ranked = rank_text(present, cat["name_stats"], terms, disk_id)
    best = ranked.orderBy("score", "entry_id").limit(limit).select(
        F.col("entry_id").alias("id"), "disk_id", "score", "total")
    return to_items(cat, best).withColumn("truncated", F.col("total") > limit).orderBy("score", "id")


def search_transcripts(cat: Catalog, query: str, limit: int = TRANSCRIPT_LIMIT, lang: str | None = None,
                       within: DataFrame | None = None) -> DataFrame:
    """Transcripts holding every word, best first, with a marked fragment; ``within(entry_id)`` may restrict them."""
    terms = tx.query_terms(query)
    ranked = rank_text(cat.text_postings, cat["text_stats"], terms)
    if lang is not None:
        spoken = cat.transcripts.filter(F.col("lang") == lang).select("entry_id")
        ranked = ranked.join(spoken, "entry_id", "left_semi")
    if within is not None:
        ranked = ranked.join(within, "entry_id", "left_semi")
    best = ranked.orderBy("score", "entry_id").limit(limit)
    if not terms:
        return best.select("entry_id", "score", F.lit(None).cast("string").alias("snippet"))
    # fragments are cut only for the rows on the page
    texts = cat.transcripts.select("entry_id", "text").join(best, "entry_id", "left_semi")
    cut = tx.snippets(texts, "entry_id", "text", terms, SNIPPET_WORDS)
    return best.select("entry_id", "score").join(cut, "entry_id").orderBy("score", "entry_id")


def having_all_tags(cat: Catalog, tags: list[str]) -> DataFrame:
    """Entries carrying every requested tag (repeated requests count once)."""
    wanted = sorted({t.strip().lower() for t in tags})
    return (
        cat.entry_tags.filter(F.col("tag").isin(wanted)).groupBy("entry_id")
        .agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(wanted)).select("entry_id")
    )


_FIELDS = ("exts", "tags", "min_size", "max_size", "modified_after", "modified_before", "kind", "disk_id")


def has_criteria(filters: dict) -> bool:
    """True when at least one filter is set; blank text, place and light do not count."""
    if any((filters.get(k) or "").strip() for k in ("text", "place", "light")):
        return True
    return any(filters.get(k) not in (None, [], ()) for k in _FIELDS)


def _contains(column: str, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.strip().lower()))


def build_predicate(filters: dict) -> Column:
    """Conjunction of the attribute filters. Wildcards in place and light are taken literally."""
    col = F.col
    parts: list[Column] = []
    if filters.get("kind"):
        parts.append(col("is_folder") == F.lit(filters["kind"] == "folder"))
    if filters.get("exts"):
        parts.append(col("ext").isin([e.lower() for e in filters["exts"]]))
    category = words.canonical_category(filters.get("category"))
    if category:
        parts.append(col("ext").isin(words.CATEGORIES[category]))
    for key, column, lower in (("min_size", "size_logical", True), ("max_size", "size_logical", False),
                               ("modified_after", "modified_at", True), ("modified_before", "modified_at", False)):
        if filters.get(key) is not None:
            parts.append(col(column) >= filters[key] if lower else col(column) <= filters[key])
    if filters.get("disk_id") is not None:
        parts.append(col("disk_id") == filters["disk_id"])
    if (filters.get("place") or "").strip():
        parts.append(_contains("gps_place", filters["place"]))
    if (filters.get("light") or "").strip():
        parts.append(_contains("light_phase", filters["light"]))
    predicate = F.lit(True)
    for part in parts:
        predicate = predicate & part
    return predicate


def match_attributes(cat: Catalog, filters: dict) -> DataFrame:
    """All entries meeting the filters, with a relevance ``score`` (0 without text)."""
    rows = cat.entries.filter(build_predicate(filters))
    words_asked = (filters.get("text") or "").strip()
    terms = tx.query_terms(words_asked)
    attributes_only = {k: v for k, v in filters.items() if k != "text"}
    if (words_asked and not terms and not has_criteria(attributes_only)) or not (
            has_criteria(filters) or words.canonical_category(filters.get("category"))):
        rows = rows.filter(F.lit(False))  # nothing asked never means everything
    if filters.get("tags"):
        rows = rows.join(having_all_tags(cat, filters["tags"]), rows["id"] == F.col("entry_id"), "left_semi")
    if not terms:
        return rows.withColumn("score", F.lit(0.0))
    ranked = rank_text(cat.name_postings, cat["name_stats"], terms)
    return rows.join(ranked.select(F.col("entry_id").alias("id"), "score"), "id")


def search_advanced(cat: Catalog, filters: dict, limit: int = ADVANCED_LIMIT) -> DataFrame:
    """Attribute search: by relevance when there is text, otherwise largest first."""
    matched = match_attributes(cat, filters).select("id", "disk_id", "name", "is_folder", "size_logical",
                                                    "modified_at", "ext", "path", "score")
    matched = matched.join(cat.disks.select(F.col("id").alias("disk_id")), "disk_id", "left_semi")
    total = matched.agg(F.count(F.lit(1))).scalar()
    ordering = [F.col("score"), F.col("id")] if tx.query_terms(filters.get("text") or "") \
        else [F.col("size_logical").desc(), F.col("id")]
    best = matched.orderBy(*ordering).limit(limit)
    return with_disk_name(best, cat).withColumn("total", total).withColumn(
        "truncated", F.col("total") > limit).orderBy(*ordering)


def filtered_ids(cat: Catalog, filters: dict) -> DataFrame | None:
    """Entries ``(entry_id)`` that may be ranked under attribute filters, None when nothing is asked.

    Folders never pass an extension filter.
    """
    if not has_criteria(filters) and not words.canonical_category(filters.get("category")):
        return None
    kept = cat.entries.filter(build_predicate(filters))
    kept = kept.filter("NOT is_folder") if filters.get("exts") else kept
    ids = kept.select(F.col("id").alias("entry_id"))
    return ids.join(having_all_tags(cat, filters["tags"]), "entry_id", "left_semi") if filters.get("tags") else ids


def get_entries(cat: Catalog, ids: list[int]) -> DataFrame:
    return cat.entries.filter(F.col("id").isin(ids))


META = ("id", "content_hash", "gps_lat", "gps_lon", "gps_place", "captured_at", "camera_make", "camera_model",
        "light_phase")


def entry_meta(cat: Catalog, ids: list[int] | None = None) -> DataFrame:
    """Enrichment columns and whether any of them is known."""
    rows = cat.entries if ids is None else get_entries(cat, ids)
    known = F.lit(False)
    for column in META[1:]:
        known = known | F.col(column).isNotNull()
    return rows.select(*META, known.alias("enriched"))
