"""Web archives: writing WARC records and reading them back by a verified chain.

Writing.  One record per page, payload the page in UTF-8.  Of the records with
equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is
a response; the others are revisit records that refer to it.  Equality goes by
SHA-256, pre-aggregated, so a group of copies is one row before it meets the
pages.  Files are written by Spark's own committer to any file system.

Reading.  Files are read in splits, cut at every occurrence of the version line.
Each cut is a candidate record: the task parses the header and emits the offset
and the offset of the record that must follow it.  The line may also occur
inside a payload, so candidates are only believed if the chain from the start of
the file reaches them.  Chains are first followed inside segments of a file,
then pointers over whole segments are doubled (pointer jumping) until the file's
last segment is reached, and candidates beside the chain are rejected.  A
record that holds false candidates is put together from its parts.

Cases: a null page is an empty payload, a null url is written as the record's
own name, line breaks in a url are percent-encoded; empty payloads and payloads
below the limit are always responses; rows that repeat an id are written each,
and all rows with the smallest id are responses; a record cut off at the end of
a file is left out; an empty table gives no record; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise

VERSION = "WARC/1.1\r\n"
MIN_REVISIT = 100
SEGMENT_BYTES = 1 << 26
NAME = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_revisit: int = MIN_REVISIT, date: str = _DATE) -> DataFrame:
    """(record): each page as a WARC record without its last line break."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    copies = (rows.where(F.octet_length("body") >= min_revisit).groupBy("digest")
              .agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head"))
    rows = rows.join(copies, "digest", "left")
    revisit = F.coalesce(F.col("id") != F.col("head"), F.lit(False))
    size = F.octet_length("body")
    name = F.concat(F.lit(NAME), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    url = F.replace(F.replace(F.coalesce("url", name), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(VERSION), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), name, F.lit(">"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{NAME}"), F.col("head").cast("string"), F.lit(">"))),
                                 line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, block, F.lit("\r\n")).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   compression: str = "gzip", **options) -> None:
    """Write a folder of archive files."""
    (records(pages, id_col, url_col, html_col, **options).write.option("lineSep", "\r\n")
     .option("compression", compression).text(path))


def _parsed(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, where the block begins, its length) of a record's text after
    the version line; None if it isn't a record."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for text in data[:end].decode("utf-8", "replace").split("\r\n"):
        key, colon, value = text.partition(":")
        if not colon:
            return None
        fields[key.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not (length.isascii() and length.isdigit()):
        return None
    return fields, end + 4, int(length)


def payload(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    return block.partition(b"\r\n\r\n")[2]


_FIELDS = ("file string, block long, at long, size long, following long, whole boolean, type string, name string, "
           "refers string, digest string, payload_bytes long, payload_digest string")


def _split_rows(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", VERSION).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("value")))


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, place in the split, text) of every cut."""
    seen, at = None, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0), batch.column(1), batch.column(2)):
            file, block, value = file.as_py(), block.as_py(), value.as_py() or b""
            if (file, block) != seen:
                seen, at = (file, block), 0
            yield file, block, at, value
            at += len(value) + len(VERSION)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per cut: its place, and if it reads like a record, what it says
    and the offset that must follow (both relative to the split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in _FIELDS.split(",")]
        kinds = (pa.string(), *[pa.int64()] * 4, pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.string())
        out: list[tuple] = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return made

        for file, block, at, value in _with_places(batches):
            found = _parsed(value)
            if found is None:
                out.append((file, block, at, len(value), None, False, *[None] * 6))
            else:
                fields, begin, length = found
                body = value[begin:begin + length]
                whole = len(body) == length
                main = payload(body) if whole else b""
                # a cut stands after the version line that the one before it ends with
                out.append((file, block, at, len(value), at + len(VERSION) + begin + length + 4, whole,
                            fields["warc-type"].lower(), fields.get("warc-record-id"), fields.get("warc-refers-to"),
                            fields.get("warc-payload-digest"), len(main) if whole else None,
                            hashlib.sha256(main).hexdigest() if whole else None))
            if len(out) >= 10_000:
                yield batch()
        if out:
            yield batch()

    return _split_rows(spark, path).mapInArrow(run, _FIELDS)


def _on_segments(at: DataFrame) -> DataFrame:
    """Exit of every candidate: the first offset of its chain outside its segment."""

    def run(table: pa.Table) -> pa.Table:
        offsets, nexts = table["offset"].to_numpy(), table["following"].to_numpy()
        order = np.argsort(offsets)
        leaves: dict[int, int] = {}
        for o, f in zip(offsets[order][::-1].tolist(), nexts[order][::-1].tolist()):
            leaves[o] = leaves.get(f, f)  # a follower in this segment is known already, its chain goes on up
        return pa.table({"file": table["file"], "offset": offsets,
                         "leaves": np.fromiter(map(leaves.__getitem__, offsets.tolist()), np.int64, len(offsets))})

    return at.groupBy("file", "segment").applyInArrow(run, "file string, offset long, leaves long")


def reachable(at: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0; ``at`` has
    file, offset and following."""
    at = at.select("file", "offset", "following", F.floor(F.col("offset") / SEGMENT_BYTES).alias("segment"))
    most = (at.agg(F.max("segment").alias("s")).first()["s"] or 0) + 1
    entries = at.where("offset = 0").select("file", "offset")
    if most > 1:
        jump = materialise(_on_segments(at), "warc-jumps")
        hops = 1
        while True:
            step = entries.join(jump, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
            entries = materialise(entries.union(step.join(at.select("file", "offset"), ["file", "offset"], "left_semi"))
                                  .distinct(), "warc-entries")
            hops *= 2
            if hops > most:
                break
            then = jump.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("further"))
            jump = materialise(jump.join(then, ["file", "leaves"], "left").select(
                "file", "offset", F.coalesce("further", "leaves").alias("leaves")), "warc-jumps")
    entries = materialise(entries, "warc-entries").select(
        F.col("file").alias("in_file"), F.col("offset").alias("entry"),
        F.floor(F.col("offset") / SEGMENT_BYTES).alias("in_segment"))

    def walk(table: pa.Table, starts: pa.Table) -> pa.Table:
        follow = dict(zip(table["offset"].to_pylist(), table["following"].to_pylist()))
        on = []
        for o in starts["entry"].to_pylist():
            while o in follow:
                on.append(o)
                o = follow.pop(o)
        file = table["file"][0].as_py() if len(table) else None
        return pa.table({"file": pa.array([file] * len(on), pa.string()), "offset": pa.array(on, pa.int64())})

    return (at.groupBy("file", "segment").cogroup(entries.groupBy("in_file", "in_segment"))
            .applyInArrow(walk, "file string, offset long"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, type, name, refers, digest, payload_bytes, payload_digest)
    of every record in a folder of archives."""
    cuts = materialise(candidates(spark, path), "warc-cuts")
    splits = cuts.groupBy("file", "block").agg(F.sum(F.col("size") + len(VERSION)).alias("n"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    # the text of a cut stands after a version line, which is where its record begins
    placed = cuts.join(splits, ["file", "block"]).withColumns({
        "offset": F.col("base") + F.col("at") - len(VERSION),
        "following": F.col("base") + F.col("following") - len(VERSION)})
    # a cut at the very start of a file is what stands before the first version line
    placed = placed.where("offset >= 0")
    good = reachable(placed.where("following is not null").select("file", "offset", "following"))
    kept = placed.join(good, ["file", "offset"])
    out = ["file", "offset", "type", "name", "refers", "digest", "payload_bytes", "payload_digest"]
    whole = kept.where("whole").select(*out)
    broken = materialise(kept.where(~F.col("whole")).select(
        "file", "offset", F.col("following").alias("until"), "type", "name", "refers", "digest"), "warc-broken")
    if broken.isEmpty():
        return whole
    return whole.unionByName(_joined(spark, path, placed, broken).select(*out))


def _joined(spark: SparkSession, path: str, placed: DataFrame, broken: DataFrame) -> DataFrame:
    """Records that hold the version line in their payload, from all their cuts."""
    # the cuts between a record's start and its follower, found from the record's side segment by segment
    spans = broken.select("file", F.col("offset").alias("start"), "until", F.explode(F.sequence(
        F.floor(F.col("offset") / SEGMENT_BYTES), F.floor(F.col("until") / SEGMENT_BYTES))).alias("segment"))
    cuts = placed.select("file", "block", "at", "offset", F.floor(F.col("offset") / SEGMENT_BYTES).alias("segment"))
    mine = materialise(cuts.join(spans, ["file", "segment"]).where("offset >= start and offset < until")
                       .select("file", "block", "at", "offset", "start").distinct(), "warc-parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, at, value in _with_places(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([at]), pa.array([value], pa.binary())],
                                             ["file", "block", "at", "value"])

    texts = _split_rows(spark, path).join(mine.select("file").distinct(), "file", "left_semi")
    texts = texts.mapInArrow(run, "file string, block long, at long, value binary")
    parts = texts.join(mine, ["file", "block", "at"]).groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, starts, sizes, digests = [], [], [], []
            for file, start, parts_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = VERSION.encode().join(p["value"] for p in parts_)
                _, begin, length = _parsed(data)
                block = data[begin:begin + length]
                if len(block) == length:
                    main = payload(block)
                    files.append(file), starts.append(start)
                    sizes.append(len(main)), digests.append(hashlib.sha256(main).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(
                sizes, pa.int64()), pa.array(digests, pa.string())], ["file", "offset", "payload_bytes", "payload_digest"])

    made = parts.mapInArrow(whole, "file string, offset long, payload_bytes long, payload_digest string")
    return broken.join(made, ["file", "offset"])


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the
    records of ``write_archives`` as pages; a revisit has the size of the
    response that it refers to."""
    number = lambda c: F.regexp_extract(c, NAME + r"(-?\d+)>", 1)
    rows = found.select(
        F.nullif(number("name"), F.lit("")).cast("long").alias("page_id"),
        F.col("type").alias("record_type"), F.nullif(number("refers"), F.lit("")).cast("long").alias("refers_to"),
        "payload_bytes", F.when(F.col("type") == "revisit", F.regexp_replace("digest", "^sha256:", ""))
        .otherwise(F.col("payload_digest")).alias("payload_digest"))
    # one page id may stand for several texts: the digest tells which one is meant
    sizes = (rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
             .agg(F.max("payload_bytes").alias("size")))
    first = rows.where("record_type = 'response'").withColumn("size", F.col("payload_bytes"))
    again = rows.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    return first.unionByName(again).select(
        "page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
