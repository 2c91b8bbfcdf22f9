"""WARC records in seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames. Each frame holds whole records up to a byte bound; the last
frame is skippable and holds the seek table (compressed and plain size of every frame). An index table maps each record
to its bundle, frame and offset inside the plain frame, so that one record costs one tail read and one frame.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslane.llm.common import arrow_rows, fresh_path, open_folder, scratch, small_batches, table, text_bytes

# Numbers of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
REVISIT_BYTES = 100
WARC_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: (compressed, plain) sizes of its frames."""
    entries = b"".join(struct.pack("<II", *pair) for pair in sizes)
    body = entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame, out of the last bytes of a bundle."""
    source.seek(size - FOOTER_BYTES)
    frames, descriptor, magic = struct.unpack("<IBI", source.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if descriptor & 0x80 else 8
    source.seek(size - FOOTER_BYTES - frames * width)
    raw = source.read(frames * width)
    out, start = [], 0
    for k in range(frames):
        packed, plain = struct.unpack_from("<II", raw, k * width)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(source, frames: list[tuple[int, int, int]], number: int) -> bytes:
    start, packed, plain = frames[number]
    source.seek(start)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)


def header_value(value: str | None) -> str:
    """A value that cannot end its header line early: controls and % are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c == "%" or ord(c) == 127 else c for c in value or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the HTTP head and the digest, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(plain: bytes, offset: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, HTTP block and the place after the record that starts at ``offset``."""
    end = plain.index(b"\r\n\r\n", offset)
    first, *rest = plain[offset:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at offset {offset}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in rest)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if plain[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, plain[start:stop], stop + 4


def record_facts(plain: bytes, offset: int) -> tuple[int | None, int, str, str, int | None]:
    """(page id, payload bytes, payload digest, type, id it refers to); a stored payload is hashed anew."""
    headers, block, _ = parse_record(plain, offset)
    head, payload = block.split(b"\r\n\r\n", 1)
    stated = int(head.rsplit(b"Content-Length: ", 1)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (stated != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    page = headers.get("X-Page-Id")
    refers = headers.get("X-Refers-To-Page-Id")
    return None if page is None else int(page), stated, digest, headers["WARC-Type"], None if refers is None else int(refers)


def mark_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response).

    Only digests that occur more than once leave the aggregation, which sums up copies before the shuffle; pages
    join them in salted pieces, so a payload that a third of all pages share is not one task's work. Rows that
    repeat the smallest page_id are responses too. Null ids never count as smallest while others exist.
    """
    salts = 16
    payload = text_bytes("html")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = (
        rows.where(F.length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    return salted.join(copies, ["digest", "salt"], "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )


INDEX = pa.schema(
    [("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
)


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write each page as a record and return the index rows (page_id, bundle, frame, offset, length), lazily.

    Payloads are shuffled once: bundles follow the partitions in which copies were found. Rows are sorted inside each
    partition, so a retried task writes the same bundle under the same name. A task holds one frame at a time. A null
    html is an empty payload; a null id is written without an id header; repeated rows are records of their own.
    """
    small_batches(pages.sparkSession)
    records = mark_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    records = records.sortWithinPartitions("page_id", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        yield from arrow_rows(_bundles(batches, files, root, folder, frame_bytes, bundle_bytes), INDEX)

    return records.mapInArrow(write, "page_id long, bundle string, frame int, offset long, length long")


def _bundles(batches, files, root: str, folder: str, frame_bytes: int, bundle_bytes: int) -> Iterator[tuple]:
    """Write bundles as rows arrive; index rows follow once their bundle is in place."""
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
    part, number = TaskContext.get().partitionId(), 0
    frame, held, sizes, index, done = io.BytesIO(), 0, [], [], 0
    out = attempt = None

    def end_frame():
        nonlocal frame, held, done
        if held:
            packed = pack.compress(frame.getvalue())
            out.write(packed)
            sizes.append((len(packed), held))
            done += len(packed)
            frame, held = io.BytesIO(), 0

    def end_bundle():
        nonlocal out, sizes, index, done, number
        end_frame()
        out.write(seek_table(sizes))
        out.close()
        files.move(attempt, f"{root}/{name}")
        rows, out, sizes, index, done = index, None, [], [], 0
        number += 1
        return rows

    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if out is not None and done >= bundle_bytes:
                yield from end_bundle()
            if out is None:
                name = f"pages-{part:06d}-{number:05d}.warc.zst"
                attempt = f"{root}/{name}.{uuid.uuid4().hex}"
                out = files.open_output_stream(attempt)
            raw = record_bytes(page_id, url, payload, digest, refers_to, refers_to is not None)
            index.append((page_id, f"{folder}/{name}", len(sizes), held, len(raw)))
            frame.write(raw)
            held += len(raw)
            if held >= frame_bytes:
                end_frame()
    if out is not None:
        yield from end_bundle()


FACTS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def read_bundles(index: DataFrame) -> DataFrame:
    """Read every indexed record back: one row of facts per record, each payload checked against its digest.

    Frames are the unit of work: a task opens a bundle at its footer, seeks to the frame and steps through the offsets.
    """
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from arrow_rows(facts(batches), FACTS)

    def facts(batches):
        opened, source, places = None, None, None
        for batch in batches:
            for bundle, frame, offsets in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bundle != opened:
                    if source is not None:
                        source.close()
                    files, path = open_folder(bundle)
                    source = files.open_input_file(path)
                    opened, places = bundle, read_seek_table(source, source.size())
                plain = read_frame(source, places, frame)
                for offset in offsets:
                    yield record_facts(plain, offset)
        if source is not None:
            source.close()

    return frames.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_record(index: DataFrame, page_id: int) -> bytes | None:
    """The stored bytes of one record, by its id: one index lookup, one tail read, one frame."""
    row = index.where(F.col("page_id") == page_id).select("bundle", "frame", "offset", "length").first()
    if row is None:
        return None
    files, path = open_folder(row.bundle)
    with files.open_input_file(path) as source:
        plain = read_frame(source, read_seek_table(source, source.size()), row.frame)
    return plain[row.offset : row.offset + row.length]


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written into bundles and read back from them."""
    folder = fresh_path(spark, "warc")
    index, _ = scratch(write_bundles(table(spark, sf_dir, "pages"), folder), "warc-index")
    return read_bundles(index)


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
