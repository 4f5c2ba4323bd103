"""WARC archives with a Zstandard dictionary of their own records.

Every archive is one ``.warc.zst`` style file: a skippable frame that holds a
dictionary trained on the archive's records, then one compressed frame a record.
Spark's text writer stores the frames, so any file system that Spark can write
will do; its line separator is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import deque
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: Skippable frame that carries a dictionary (WARC Zstandard convention).
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame (0x184D2A50, length 0), all ASCII: the line separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Rows of the text writer in one archive; the writer begins a file after as many.
ARCHIVE_ROWS = 32
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def _record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}:{digest}')}>"


def _clean(value: str) -> str:
    """A header value on one line: white space and controls percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record(page: str | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    page = "" if page is None else page
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frames(batches, dictionary_bytes: int, train_bytes: int, level: int, archive_bytes: int):
    """Rows of the text writer, ``ARCHIVE_ROWS`` an archive: the dictionary's frame, then the records' frames, in order.

    A row holds the frames of 1/``ARCHIVE_ROWS`` of an archive or more; a full archive with
    fewer rows is filled up with empty ones, of which only the separators are written.
    """
    import zstandard

    def start(held):
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, list(held), k=1024, d=8, f=18, accel=4)
        except zstandard.ZstdError:  # too few records to train on: no dictionary, as the convention allows
            return zstandard.ZstdCompressor(level=level, write_content_size=True), []
        raw = trained.as_bytes()
        return zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True), [DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw]

    def records():
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few rows at once as Python objects
                for page, url, html, size, digest, refers_to in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns]):
                    yield _record(page, url, html or b"", size, digest, refers_to)

    def taken(held):
        while held:
            yield held.popleft()

    def row(parts):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["frame"])

    stream = records()
    while True:
        held, size = deque(), 0
        while size < train_bytes and (record := next(stream, None)) is not None:
            held.append(record)
            size += len(record)
        if not held:
            return
        compressor, head = start(held)
        parts, size, written, left = head, 0, 0, ARCHIVE_ROWS
        for frame in map(compressor.compress, chain(taken(held), stream)):
            parts.append(frame)
            size += len(frame)
            if size * ARCHIVE_ROWS >= archive_bytes:
                yield row(parts)
                parts, size, written, left = [], 0, written + size, left - 1
                if written >= archive_bytes:
                    break
        else:
            if parts:
                yield row(parts)
            return
        for _ in range(left):
            yield row([])
        stream = chain(held, stream)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, dictionary_bytes: int = 65536, train_bytes: int = 64 << 20, level: int = 3, archive_bytes: int = 128 << 20) -> None:
    """Write one record a row below ``path``, one or more archives a partition.

    An archive ends with the record that fills ``archive_bytes`` (compressed); the next
    one has a dictionary of its own.  So a reader's task never holds more than that and
    one record, however large a partition is.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes the one with the
    largest id becomes a response and the others revisits of it; smaller payloads are
    all responses.  A null html is an empty payload; a null url leaves its field out.
    A null id is below every other; where all equal payloads have null ids, each is a
    response.  Rows repeated in full with the largest id are each a response.  The
    first ``train_bytes`` of an archive, normally all of it, train its dictionary,
    which affects sizes alone.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("string").cast("binary").alias("html"))
    base = base.withColumn("same", F.sha2("html", 256))
    equal = base.filter(F.octet_length("html") >= revisit_bytes).groupBy("same").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keeper IS NOT NULL").drop("n")
    marked = base.join(equal, "same", "left")
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    body = F.when(~other, F.col("html"))  # a revisit has no payload, only its size and digest
    rows = marked.select(F.col("page_id").cast("string"), "url", body.alias("html"), F.octet_length("html").alias("size"), F.sha1("html").alias("digest"), F.when(other, F.col("keeper").cast("string")).alias("refers_to"))
    frames = rows.mapInArrow(lambda it: _frames(it, dictionary_bytes, train_bytes, level, archive_bytes), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


def _split(content: bytes):
    """The records of one archive, frame by frame."""
    import zstandard

    view, at, end = memoryview(content), 0, len(content)
    reader = zstandard.ZstdDecompressor()
    while at < end:
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(view[8 : 8 + size])
                if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= end:
                raise ValueError("archive ends inside a frame")
            step = view[at : at + 65536]
            out.append(frame.decompress(step))
            at += len(step) - len(frame.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    """Header fields by lower-case name, under "" the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields | {"": rest[: int(fields["content-length"])]}


_READ = "warc_type string, record_id string, target_uri string, page_id string, refers_to string, refers_to_page string, digest string, payload_bytes long, payload binary"


def _read_batches(batches):
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for contents in batches:
        for content in contents.column(0):
            rows, size = [], 0
            for raw in _split(content.as_buffer()):
                x = parse_record(raw)
                http, _, body = x[""].partition(b"\r\n\r\n")
                revisit = x["warc-type"] == "revisit"
                told = int(next(v for k, _, v in (y.partition(b":") for y in http.split(b"\r\n")) if k.lower() == b"content-length"))
                digest = x["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and (len(body) != told or hashlib.sha1(body).hexdigest() != digest):
                    raise ValueError(f"payload of {x['warc-record-id']} does not match its digest")
                rows.append((x["warc-type"], x["warc-record-id"], x.get("warc-target-uri"), x["x-page-id"] or None, x.get("warc-refers-to"), x.get("x-refers-to-page-id"), digest, told, None if revisit else body))
                size += len(body)
                if size > 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below ``path``; a revisit's payload is null.

    Digests of payloads are verified while reading; a mismatch or a torn frame is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read_batches, _READ)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = Workspace(spark, "warc").path("archives")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(F.col("page_id").cast(kind), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("refers_to_page").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest,
             max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM q
"""
