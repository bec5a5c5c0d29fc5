"""WARC archives: written record by record, read back by verifying the chain of record boundaries.

Archives are plain text sinks and sources to Spark, so they lie in any store that Spark reaches and large files are read by byte
ranges. A range is cut at every ``WARC/1.`` that begins a line, whether a record starts there or a payload holds the same bytes.
What reads as a record header becomes a candidate with its own offset and that of its successor, as its length says.
Candidates that follow each other without a gap are one run; pointer jumping over the runs, from the start of each file, leaves
just those that a reader of the whole file would meet. Everything else belongs to the payload of the record before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from drivetrove.session import scratch_path

from .common import materialize, only

#: No end of this is also its start, so its occurrences never overlap and any reader cuts at the same places.
BREAK = "\nWARC/1."
CRLF, GAP = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexed: Column) -> Column:
    """Base32 of a digest given in hex, a multiple of 5 bytes long: each 5 hex digits are 4 letters."""
    digits = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*parts: Column) -> Column:
    """A urn:uuid that the parts decide; NULL parts are told from empty ones."""
    x = F.md5(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(x, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def one_line(text: Column) -> Column:
    """White space percent-encoded, as a header has no room for it."""
    for plain, coded in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one WARC/1.1 record for each row of ``pages`` (page_id, url, html) below ``path``, a new folder.

    Of the rows with equal html of ``least`` bytes or more, that with the largest page_id (then url) is a response, the others are
    revisits without payload that refer to it; shorter ones are all responses. Payloads that occur once are written where they are
    read, as long as the table of the others is small enough to send to all tasks; of each of the others only one copy is moved.
    Payloads are the html in UTF-8 below an HTTP head. NULL html is empty, a NULL url or page_id leaves its header out, rows that
    are wholly alike are a response and revisits of it (below ``least`` bytes, responses with the same record id). ``date`` is the
    date of all records, so that reruns write the same. An empty table writes no record. One archive comes from each task.
    """
    base = only(pages, page_id="long", url="string", html="string").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumns({"same": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})
    shared = base.filter(F.col("size") >= least).groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("page_id", "url")).alias("top"))
    shared = materialize(shared.filter("rows > 1").drop("rows"), "warc-shared")  # its size is known then, and decides how it is joined
    digest = base32(F.sha1(F.col("payload").cast("binary")))
    facts = ("page_id", "url", "same", "size", "digest")
    single = base.join(shared, "same", "left_anti").withColumn("digest", digest).select(*facts, "payload", F.lit(1).alias("copy"), F.lit(None).cast("string").alias("refers_to"))
    copies = base.join(shared, "same").withColumn("digest", digest).groupBy(*facts, "top").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    is_top = F.struct("page_id", "url").eqNullSafe(F.col("top")) & (F.col("copy") == 1)
    bodies = base.join(shared, "same", "left_semi").select("same", "payload").dropDuplicates(["same"])
    first = copies.filter(is_top).join(bodies, "same").withColumn("refers_to", F.lit(None).cast("string"))
    again = copies.filter(~is_top).withColumn("payload", F.lit("")).withColumn("refers_to", record_id(F.col("top.page_id"), F.col("top.url"), F.col("same"), F.lit(1)))
    rows = single
    for part in (first, again):
        rows = rows.unionByName(part.select(*facts, "payload", F.col("copy").cast("int").alias("copy"), "refers_to"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(GAP))
    revisit = F.col("refers_to").isNotNull()

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), field("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("same"), F.col("copy"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", one_line(F.col("url"))), field("Page-ID", F.col("page_id")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", F.col("refers_to")), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(http) + F.octet_length("payload")))
    rows.select(F.concat(head, F.lit(GAP), http, "payload").alias("value")).write.option("lineSep", GAP).option("compression", "none").text(path)


def pieces(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """What lies between two cuts: file, block (where its byte range begins), n (bytes up to the next cut), at (bytes before it of
    pieces that begin in the same range) and ``columns`` over ``value``, the text after the cut."""
    lines = spark.read.option("lineSep", BREAK).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("block"),
                         F.octet_length("value").cast("long").alias("n"), *columns)
    schema = T.StructType([*lines.schema.fields, T.StructField("at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, reached = None, 0  # rows of a range come one after the other, in the order of the file
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            sizes = batch.column("n").to_numpy() + len(BREAK)
            at = np.zeros(len(sizes), np.int64)
            starts = [i for i in range(len(files)) if i == 0 or (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])]
            for i, j in zip(starts, [*starts[1:], len(files)]):
                reached = reached if (files[i], blocks[i]) == here else 0
                here = (files[i], blocks[i])
                at[i:j] = reached + np.concatenate([[0], np.cumsum(sizes[i:j - 1])])
                reached = int(at[j - 1] + sizes[j - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], schema=pa.schema([*batch.schema, pa.field("at", pa.int64())]))

    return lines.mapInArrow(run, schema)


def header_of(value: Column) -> tuple[Column, Column]:
    """Header of a piece, without the bytes that the cut took, and the length of the block after it; both NULL where none is."""
    whole = F.concat(value, F.lit("\n"))  # the cut after a header may have taken its last byte
    header = F.when(F.instr(whole, GAP) > 0, F.substring_index(whole, GAP, 1))
    digits = F.regexp_extract(header, r"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|\z)", 1)
    return header, F.when(header.rlike(r"\A(?:WARC/1\.)?[01]\r\n"), digits).try_cast("long")


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All pieces with their offset in the file (``start``); those that read as a record header have ``head`` (its bytes), ``length``
    (of the block that follows) and ``next`` (where the next record must start). Also the offset (``base``) of each byte range."""
    header, length = header_of(F.col("value"))
    found = materialize(pieces(spark, path, F.octet_length(header).cast("long").alias("header"), length.alias("length"), F.col("_metadata.file_size").alias("size")), "warc-pieces")
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("n") + len(BREAK)).alias("bytes"), F.max("size").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(blocks.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "warc-ranges")
    odd = bases.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size")) \
        .filter(~(F.col("bytes") - F.col("size")).isin(0, len(BREAK)) & ~F.col("file").rlike(r"\.(?:gz|bz2|zst|lz4|snappy|deflate)$"))
    if broken := odd.first():
        raise ValueError(f"pieces of {broken['file']} add up to {broken['bytes']} bytes, its size is {broken['size']}")
    place = F.col("base") + F.col("at")
    magic = F.when(place == 0, 0).otherwise(len(BREAK) - 1)  # the cut takes these bytes of a header; nothing stands before a file's first
    found = found.join(bases.select("file", "block", "base"), ["file", "block"]) \
        .select("file", "block", "at", "size", (place - magic).alias("start"), F.when(F.col("length").isNotNull(), F.col("header") + len(GAP) + magic).alias("head"), "length")
    return found.withColumn("next", F.col("start") + F.col("head") + F.col("length") + len(GAP)), bases.select("file", "block", "base")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from the start of their file meets."""
    valid = found.filter("next is not null")
    order = Window.partitionBy("file", "block").orderBy("start")
    begins = ~F.lag("next").over(order).eqNullSafe(F.col("start"))
    runs = materialize(valid.withColumn("begins", begins).withColumn("last", ~F.lead("start").over(order).eqNullSafe(F.col("next")))
                       .withColumn("run", F.last(F.when(F.col("begins"), F.col("start")), ignorenulls=True).over(order)), "warc-runs")
    exits = runs.filter("last").select("file", "run", F.col("next").alias("to_start"))
    landing = runs.select("file", F.col("run").alias("to_run"), F.col("start").alias("to_start"))
    state = exits.join(landing, ["file", "to_start"], "left") \
        .select("file", "run", "to_run", F.when(F.col("to_run").isNotNull(), F.col("to_start")).alias("to_start"), F.when(F.col("run") == 0, F.lit(0).cast("long")).alias("entered"))
    state = materialize(state, "warc-jumps")
    while state.filter("entered is not null and to_run is not null").limit(1).count():  # twice as many runs of a chain each time
        told = state.filter("entered is not null and to_run is not null").select("file", F.col("to_run").alias("run"), F.col("to_start").alias("told"))
        beyond = state.select("file", F.col("run").alias("to_run"), F.col("to_run").alias("run_2"), F.col("to_start").alias("start_2"))
        state = materialize(state.join(beyond, ["file", "to_run"], "left").join(told, ["file", "run"], "left")
                            .select("file", "run", F.col("run_2").alias("to_run"), F.col("start_2").alias("to_start"), F.coalesce("entered", "told").alias("entered")), "warc-jumps")
    met = state.filter("entered is not null").select("file", "run", "entered")
    return runs.join(met, ["file", "run"]).filter("start >= entered").select("file", "block", "at", "start", "head", "length", "next", "size")


def odd_pieces(found: DataFrame, real: DataFrame) -> DataFrame:
    """The pieces that are no complete record by themselves, with the record they belong to (``owner``), if any, and for its first piece
    head, length and whether the record is ``complete``."""
    nexts = real.select("file", F.col("start").alias("next"), F.lit(True).alias("followed"))
    known = real.select("file", "start", "head", "length", "next", "size").join(nexts, ["file", "next"], "left") \
        .select("file", "start", F.col("start").alias("own"), "head", "length", (F.coalesce("followed", F.lit(False)) | (F.col("next") == F.col("size"))).alias("complete"))
    known = materialize(found.select("file", "block", "at", "start").join(known, ["file", "start"], "left"), "warc-known")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.groupBy("file", "block").agg(F.max("own").alias("own")).select("file", "block", F.last("own", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("file", "block").orderBy("start")
    owned = known.withColumn("owner", F.last("own", ignorenulls=True).over(order)).join(carried, ["file", "block"]).withColumn("owner", F.coalesce("owner", "carried"))
    parts = owned.filter("own is null and owner is not null").select("file", "owner").distinct().withColumn("parted", F.lit(True))
    owned = owned.join(parts, ["file", "owner"], "left").filter("own is null or parted or not complete")
    return materialize(owned.select("file", "block", "at", "owner", "head", "length", "complete"), "warc-odd")


RECORD_FIELDS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "page_id": "Page-ID",
                 "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the uncompressed WARC files at ``path``: file, start, the header fields of ``RECORD_FIELDS`` (NULL where missing),
    header, content (the block), payload (the block, without an HTTP head where the content type says so) and complete.

    Only records that the chain of lengths from the start of a file meets are returned, in whole, across byte ranges too; whatever
    a payload holds can't add one. A chain ends at the file's end or where no record starts, as after a wrong length; the record
    before that has ``complete`` false unless it ends the file, and a block cut off is returned as far as it goes. A file that
    doesn't begin with a record has none, and an empty folder gives no rows.
    """
    found, bases = candidates(spark, path)
    odd = odd_pieces(found, reachable(found))  # mostly few, as payloads seldom hold a record's first bytes: then no text is moved
    first = (F.col("block") == 0) & (F.col("at") == 0)
    text = pieces(spark, path, F.col("value").cast("binary").alias("value")).withColumn("start", F.col("at") - F.when(first, 0).otherwise(len(BREAK) - 1)) \
        .withColumn("value", F.when(first, F.col("value")).otherwise(F.concat(F.lit(BREAK[1:].encode()), F.col("value"))))
    text = text.join(bases, ["file", "block"]).withColumn("start", F.col("start") + F.col("base"))
    header, length = header_of(F.col("value").cast("string"))
    plain = text.join(odd, ["file", "block", "at"], "left_anti").select("file", "start", (F.octet_length(header) + len(GAP)).cast("long").alias("head"), length.alias("length"), F.lit(True).alias("complete"), "value")
    split = text.join(odd.filter("owner is not null"), ["file", "block", "at"]).groupBy("file", F.col("owner").alias("start")).agg(
        F.max("head").alias("head"), F.max("length").alias("length"), F.max("complete").alias("complete"),
        F.sort_array(F.collect_list(F.struct(F.col("start").alias("s"), F.col("value").alias("v")))).alias("parts"))  # the pieces of one record
    joined = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.element_at("parts", 1)["v"], lambda all_, p: F.concat(all_, F.lit(b"\n"), p["v"]))
    rows = plain.unionByName(split.withColumn("value", joined).drop("parts")).withColumns({
        "header": F.substring(F.col("value"), F.lit(1), F.col("head").cast("int")).cast("string"),
        "content": F.substring(F.col("value"), (F.col("head") + 1).cast("int"), F.col("length").cast("int"))})

    def field(name: str) -> Column:
        line = rf"(?i)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*\r\n"
        return F.when(F.col("header").rlike(line), F.regexp_extract("header", line, 1))

    http_head = F.octet_length(F.substring_index(F.col("content").cast("string"), GAP, 1))
    is_http = F.coalesce(F.col("content_type").rlike("(?i)^application/http"), F.lit(False)) & (F.instr(F.col("content").cast("string"), GAP) > 0)
    return rows.withColumns({name: field(f) for name, f in RECORD_FIELDS.items()}) \
        .withColumn("payload", F.when(is_http, F.substring(F.col("content"), http_head + len(GAP) + 1, F.lit(2**31 - 1))).otherwise(F.col("content"))) \
        .select("file", "start", *RECORD_FIELDS, "header", "content", "payload", "complete")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in the shared folder, reads them back and returns one row per record:
    page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to (page_id of the response, for revisits).

    Bytes and digest are those of the payload that was read, for revisits of the response they refer to. See ``write_warc`` for
    NULLs, repeated rows and empty tables.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, least)
    read = read_warc(spark, path).select(F.col("page_id").try_cast("long").alias("page_id"), "type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                         base32(F.sha1("payload")).alias("payload_digest"))
    read = materialize(read, "warc-records")
    facts = ("page_id", "payload_bytes", "payload_digest")
    whole = read.filter("type = 'response'")
    first = whole.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"), "payload_bytes", "payload_digest")
    again = read.filter("type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, "refers_to")
    return whole.select(*facts, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")) \
        .unionByName(again.select(*facts, F.lit("revisit").alias("record_type"), F.col("first_page").alias("refers_to")))
