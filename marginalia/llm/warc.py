"""WARC archives: written with revisit records for repeated payloads, and read by boundary chains.

A reader can't trust the record magic: a payload may hold it. So every place where a record could
start gives a candidate: its offset, and from its Content-Length the offset of its successor.
Pointer jumping from the file's start then keeps the candidates that the chain reaches, in
logarithmically many steps; the others are payload.

read() takes an archive as a task's unit, so the writer bounds archives by bytes, but for records that are
larger on their own. read_split() reads plain archives of any size in splits: tasks emit the candidates of
their splits, pointer jumping goes over a table of all of them, and records are put together from the
pieces that lie in the splits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.runtime import new_folder

from .common import NO_ID, SLICE_BYTES, join_hot, map_arrow, materialize

#: Ends a record.
END = "\r\n\r\n"
#: Largest payloads, in bytes, and how many of them at most an archive holds: 64 MB in all, or a single larger one.
CLASSES = ((16 << 10, 4096), (256 << 10, 256), (4 << 20, 16), (1 << 62, 1))
#: What stands before a payload in a response's block.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.IGNORECASE)
#: The digits of conv() to base 32, and those of RFC 4648.
CONV, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(column: str) -> F.Column:
    """SHA-1 in hex as base 32: 40 bits are ten hex digits and eight of base 32."""
    parts = [F.lpad(F.conv(F.substring(column, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV, BASE32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column, record: the WARC record of each row of pages (page_id, url, html), without its end.

    Of payloads with equal SHA-1 and at least min_bytes bytes, those of the least page_id are
    responses, the others revisit it; a null page_id sorts last.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
    )
    first = materialize(page.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "first")
    named = lambda c: F.concat(F.lit("<urn:page:"), F.when(F.col(c) == NO_ID, "null").otherwise(F.col(c).cast("string")), F.lit(">"))
    size = F.octet_length("html")
    response = (F.col("id") == F.col("first")) | (size < min_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", named("id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32("digest"))),
        line("X-Payload-Length", size.cast("string")),
    )
    whole = F.concat(head, line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (size + len(HTTP)).cast("string")), F.lit("\r\n" + HTTP), F.col("html"))
    short = F.concat(head, line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", named("first")), F.lit("Content-Length: 0\r\n\r\n"))
    return join_hot(page, first, "digest", "n").select(F.when(response, whole).otherwise(short).alias("record"))


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Write archives of pages, gzipped, into a new folder, and return its path.

    Spark's committer writes them, so a task that is lost and run again leaves no second copy.
    """
    path = path or new_folder(pages.sparkSession, "warc")
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    largest = pages.agg(F.max(size)).first()[0] or 0
    least = -1
    for most, count in CLASSES:
        if least < largest:  # equal payloads are of one size, so a class is complete in itself
            part = pages if least < 0 and largest <= most else pages.where((size > least) & (size <= most))
            records(part, min_bytes).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", count).text(path)
        least = most
    return path


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, offset of the block, offset of the successor) of each place where a record could start."""
    found = []
    for start in MAGIC.finditer(data):
        body = data.find(b"\r\n\r\n", start.end() - 2)
        length = LENGTH.search(data, start.end() - 2, body + 2) if body >= 0 else None
        if length:
            found.append((start.start(), body + 4, body + 8 + int(length[1])))
    table = np.array(found, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def chain(offset: np.ndarray, successor: np.ndarray, end: int) -> np.ndarray:
    """Which candidates pointer jumping from offset 0 reaches; raises ValueError if the chain doesn't reach the end."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    jump = np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n) if n else at
    jump = np.r_[jump, n]
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = n > 0 and offset[0] == 0
    while True:
        before = reached.sum()
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        if reached.sum() == before and (jump == jump[jump]).all():
            break
    kept = reached[:n]
    if end and (not kept.any() or successor[kept].max() != end):
        raise ValueError("the chain of records breaks off before the archive's end")
    return kept


def fields_of(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of a record without its end."""
    head, _, block = record.partition(END.encode())
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive."""
    offset, _, successor = candidates(data)
    for i in np.flatnonzero(chain(offset, successor, len(data))):
        yield fields_of(data[offset[i] : successor[i] - len(END)])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives, plain or gzipped: kind, id, url, refers_to, digest, payload_bytes, payload.

    An archive is read as a whole by one task; write() bounds them. payload is the body of a
    response, whose digest and length are computed from it again; a revisit has none, and digest and
    length from its header. Without payloads the column is null.
    """
    names = ["kind", "id", "url", "refers_to", "digest", "payload_bytes", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = [], 0
                for field, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    payload = block.partition(b"\r\n\r\n")[2] if field.get("warc-type") == "response" else None
                    digest = field.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = int(field.get("x-payload-length", 0))
                    if payload is not None:
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    rows.append((field.get("warc-type"), field.get("warc-record-id"), field.get("warc-target-uri"), field.get("warc-refers-to"), digest, size, payload if payloads else None))
                    held += len(block) if payloads else 0
                    if len(rows) == 256 or held > SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, run, "kind string, id string, url string, refers_to string, digest string, payload_bytes long, payload binary", 1)


def units(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, block, at, unit) of plain archives: what stands between two ends of records, and where in its split.

    Spark's text reader deals a file to splits at these ends. size is the file's, block is where a split
    begins; at counts from the split's first unit.
    """

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            places = []
            for file, block, unit in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if (file, block) != current:
                    current, at = (file, block), 0
                places.append(at)
                at += len(unit) + len(END)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.int64()), batch.column(3)], ["file", "size", "block", "at", "unit"])

    lines = spark.read.option("lineSep", END).text(path)
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("unit"))
    return map_arrow(named, place, "file string, size long, block long, at long, unit binary")


def split_candidates(found: DataFrame) -> DataFrame:
    """(file, offset, successor, block, at) of each place where a record could begin, with offsets in the file.

    A payload that ends with a line break leaves one before the next record, as the reader takes the first end there is.
    """
    text = F.col("unit").cast("string")
    length = F.regexp_extract(F.concat(text, F.lit("\r\n")), r"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", 1)
    lead = F.when(F.startswith(text, F.lit("\r\n")), 2).otherwise(0)
    size = F.octet_length("unit") + len(END)
    blocks = found.groupBy("file", "block").agg(F.max(F.col("at") + size).alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = materialize(blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("base")), "blocks")
    heads = found.where(text.rlike(r"\A(?:\r\n)?WARC/1\.[01]\r\n") & (length != ""))
    heads = heads.select("file", "block", (F.col("at") + lead).alias("at"), (F.col("at") + size + length.cast("long") + len(END)).alias("next"))
    return heads.join(blocks, ["file", "block"]).select("file", (F.col("base") + F.col("at")).alias("offset"), (F.col("base") + F.col("next")).alias("successor"), "block", "at")


def jump(candidates: DataFrame) -> DataFrame:
    """The candidates (file, offset, successor, and others) that the chains from the files' starts reach.

    Each round doubles the reach: what is reached marks what its jumps lead to, and jumps are joined to jumps.
    """
    keep = [c for c in candidates.columns if c not in ("file", "offset")]
    nodes = materialize(candidates.select("*", F.col("successor").alias("to"), (F.col("offset") == 0).alias("reached")), "jumps")
    count = None
    while True:
        marks = nodes.where("reached").select("file", F.col("to").alias("offset")).distinct().withColumn("mark", F.lit(True))
        far = nodes.select("file", F.col("offset").alias("to"), F.col("to").alias("far"))
        longer = nodes.join(far, ["file", "to"], "left").join(marks, ["file", "offset"], "left")
        nodes = materialize(longer.select("file", "offset", *keep, F.coalesce("far", "to").alias("to"), (F.col("reached") | F.coalesce("mark", F.lit(False))).alias("reached"), F.col("far").isNotNull().alias("moved")), "jumps")
        now = tuple(nodes.agg(F.count_if("reached"), F.count_if("moved")).first())
        if now == count or not now[1]:
            break
        count = now
    marks = nodes.where("reached").select("file", F.col("to").alias("offset")).distinct()
    last = nodes.join(marks, ["file", "offset"], "left_semi").select("file", "offset", *keep)
    return nodes.where("reached").select("file", "offset", *keep).union(last).distinct()


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, bytes) of the records of plain archives, which may be large; fields_of() takes bytes apart.

    Raises an error where a file's chain doesn't reach its end. Payloads that hold record heads are no records.
    A record lies in one row; nothing else is held as a whole.
    """
    found = materialize(units(spark, path), "units")
    kept = materialize(jump(split_candidates(found)), "chain")
    ends = found.groupBy("file").agg(F.max("size").alias("end")).join(kept.groupBy("file").agg(F.max("successor").alias("successor")), "file", "left")
    broken = ends.where("successor is null or end != successor").select("file").first()
    if broken:
        raise ValueError(f"the chain of records breaks off before the end of {broken.file}")
    # what goes on from an earlier split belongs to the last record that begins before this one
    record, none = F.struct("offset", "successor"), F.lit(None).cast("struct<offset:long,successor:long>")
    blocks = found.select("file", "block").distinct().join(kept.groupBy("file", "block").agg(F.max(record).alias("last")), ["file", "block"], "left")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    opening = blocks.select("file", "block", F.lit(-1).cast("long").alias("at"), before.alias("record"), F.lit(None).cast("binary").alias("unit"))
    starting = kept.select("file", "block", "at", record.alias("record"), F.lit(None).cast("binary").alias("unit"))
    rows = opening.union(starting).union(found.select("file", "block", "at", none.alias("record"), "unit"))
    rows = rows.select("file", "block", "at", F.col("record.offset").alias("offset"), F.col("record.successor").alias("successor"), "unit")

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["file", "offset", "successor", "block", "at", "piece"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        current: tuple = ()
        begun = end = 0
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            file, block, *record = current
            values = (file, *record, block, begun, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for file, block, at, offset, successor, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit is not None:
                    if not held:
                        begun = at
                    held += unit, END.encode()
                    end = at + len(unit) + len(END)
                    continue
                # a record begins, or a split with what belongs to an earlier one
                rest = b""
                if held and 0 <= at < end and current[:2] == (file, block):
                    whole = b"".join(held)
                    held, rest = [whole[: at - end]], whole[at - end :]
                if any(held):
                    yield out()
                current, held, begun = (file, block, offset, successor), [rest] if rest else [], at
        if any(held):
            yield out()

    dealt = rows.repartition("file", "block").sortWithinPartitions("file", "block", "at", F.col("unit").isNotNull())
    pieces = map_arrow(dealt, gather, "file string, offset long, successor long, block long, at long, piece binary")
    whole = pieces.groupBy("file", "offset", "successor").agg(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))).alias("pieces"))
    joined = F.aggregate(F.slice("pieces", F.lit(2), F.size("pieces")), F.col("pieces")[0]["piece"], lambda have, p: F.concat(have, p["piece"]))
    size = (F.col("successor") - F.col("offset") - len(END)).cast("int")
    return whole.select("file", "offset", F.substring(joined, F.lit(1), size).alias("bytes"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of pages and read them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Rows that repeat the least page_id of a payload are all
    responses. A null page_id stays null and is only a response where no other page has the payload.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    back = read(pages.sparkSession, write(pages, None, min_bytes), payloads=False)
    return back.select(page("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))
