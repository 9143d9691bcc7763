"""WARC: archives of pages, their normal form with one gzip member per record, and an index (operator 1)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh_path, saved, table, tune

#: Records per archive; archives stay far below the 1 GB that is usual for WARC files.
RECORDS = 8000
CHUNK = 1 << 20
LEVEL = 6
INDEX = "path string, offset long, length long, type string, record_id string, target string, digest string, refers_to string, payload_bytes long, payload_digest string"


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, sha1, record_type and refers_to.

    Of records with equal payloads of at least `least` bytes, that with the smallest page_id is the
    response and the others revisit it. Equal payloads are found by SHA-1 and length: counts and
    smallest ids are pre-aggregated, and only digests that occur twice are joined back.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    twice = p.where(F.col("bytes") >= least).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(checked_broadcast(saved(twice, "warc-twice")), "sha1", "left")
    again = F.col("first_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    return p.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id")))


def record() -> Column:
    """A WARC record as bytes: header lines, an empty line, the block. A revisit has no block."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    flat = lambda c: F.regexp_replace(c, "[\r\n]", "%0A")  # noqa: E731  no value breaks a header line
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", flat(F.col("url"))),
        line("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1-hex:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("bytes")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.length(block)),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block)


def write_archives(pages: DataFrame, path: str, least: int = 0, records: int = RECORDS) -> None:
    """Archives under path: each one gzip stream over all its records (monolithic), by Spark's text
    writer, which writes the bytes it is given and ends each record with two line breaks."""
    rows = with_revisits(pages, least).select(record().cast("string").alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)


class _Inflated:
    """Reads a gzip file of any number of members from bytes, a chunk at a time."""

    def __init__(self, data: bytes):
        self.stream = gzip.GzipFile(fileobj=io.BytesIO(data))
        self.buffer = b""

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with the mark; all that is left if there is none."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not (more := self.stream.read(CHUNK)):
                out, self.buffer = self.buffer, b""
                return out
            self.buffer += more
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n and (more := self.stream.read(max(CHUNK, n - have))):
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        out, self.buffer = whole[:n], whole[n:]
        return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers by lower-case name, header bytes, block) of each record."""
    source = _Inflated(data)
    while True:
        head = source.until(b"\r\n\r\n")
        if not head.strip():
            if not head:
                return
            continue
        head = head.lstrip(b"\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        n = int(headers.get("content-length", 0))
        block = source.take(n)
        if len(block) != n:
            raise ValueError("the archive ends within a record")
        source.take(4)
        yield headers, head, block


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """One gzip member with fixed header fields: equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites archives with one member per record; returns the index, one row per record.

    Each archive under source is inflated once, as a stream, by one task. It gives an archive of the
    same name under target and, beside it, a sidecar .idx of lines (offset, length, type, record).
    Files get their final name when they are whole, so a task that runs again, on another executor,
    replaces a file by equal bytes. Records whose header names a digest are checked against it.
    """
    tune(spark, 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # A target without a scheme is in the store that the sources came from.
                near = target if ":" in target.split("/")[0] else path[: path.index(":") + 1] + "//" * ("://" in path) + target
                store, root = _open(near)
                store.create_dir(root, recursive=True)
                name = f"{root}/{os.path.basename(path).removesuffix('.gz').removesuffix('.txt')}.warc.gz"
                draft, rows, offset = f"{name}.{os.getpid()}-{os.urandom(4).hex()}", [], 0
                with store.open_output_stream(draft, compression=None) as out:
                    for h, head, block in parse_records(data.as_buffer().to_pybytes()):
                        packed = member(head + block + b"\r\n\r\n")
                        out.write(packed)
                        digest = hashlib.sha1(block).digest()
                        stated = h.get("warc-payload-digest", "")
                        if h.get("warc-type") == "response" and stated.startswith("sha1-hex:") and stated[9:] != digest.hex():
                            raise ValueError(f"{h.get('warc-record-id')}: the payload doesn't have its digest")
                        if h.get("warc-type") == "revisit":  # digest and length of what it stands for
                            digest, n = bytes.fromhex(stated.removeprefix("sha1-hex:")), int(h.get("x-payload-length", 0))
                        else:
                            n = len(block)
                        rows.append((name, offset, len(packed), h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), stated, h.get("warc-refers-to"), n, base64.b32encode(digest).decode().rstrip("=")))
                        offset += len(packed)
                store.move(draft, name)
                with store.open_output_stream(draft, compression=None) as out:
                    out.write("".join(f"{r[1]}\t{r[2]}\t{r[3]}\t{r[4]}\n" for r in rows).encode())
                store.move(draft, name.removesuffix(".warc.gz") + ".idx")
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
                    names = [x.split()[0] for x in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return saved(files.mapInArrow(rewrite, INDEX), "warc-index")


def read_member(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at an offset of a normalised archive, and nothing else read."""
    store, name = _open(path)
    with store.open_input_file(name) as f:
        f.seek(offset)
        h, _, block = next(parse_records(f.read(length)))
    return h, block


def archive_pages(pages: DataFrame, least: int = 0, records: int = RECORDS) -> DataFrame:
    """Writes pages as archives, normalises them, and returns a row per page from what was read back:
    page_id, payload_bytes, payload_digest, record_type, refers_to, path, offset, length.

    Null html is an empty payload; null urls have no target line; a null page_id stays null and is
    never a response that others revisit unless all equal ones are null; repeated page_ids are all
    written, and of equal payloads with the same smallest page_id all are responses. An empty table
    gives no archive and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    raw, normal = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    write_archives(pages, raw, least, records)
    index = normalise(spark, raw, normal)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'page:(-?[0-9]+)', 1) AS bigint)")
    return index.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "path", "offset", "length")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))
