"""Web archives with one Zstandard dictionary per file.

Layout of an archive (``.warc.zst``): a skippable frame that holds the dictionary, then one Zstandard frame per WARC
record. Any record can be read alone, given the dictionary and its offset.

* A task that writes gathers records up to ``archive_bytes`` of payload, builds a dictionary from records spread evenly
  over that archive (up to ``training_bytes`` of them), and writes the archive. Memory is bounded by the two parameters.
* Of records with equal payloads of at least ``min_bytes`` the one with the smallest id is the response; the others are
  revisits that name it and carry no payload. Payloads are compared by SHA-1 and length, as archives do.
* Archive names are new for every attempt of a task, and the written manifest lists those of the attempts that counted:
  a lost executor leaves an unlisted file, never a doubled record.

Defined cases: a null payload is an empty one; a null id counts as larger than every other; of rows with the same
payload and the same smallest id one is the response and the rest are revisits that refer to that same id; a null url
is written as ``urn:x-none``; an empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import columns, shared_dir

#: Magic number of the skippable frame that holds a dictionary (fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D
#: Alphabet of base 32 (fixed value of RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RESPONSE, REVISIT = "response", "revisit"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long, dictionary_bytes long"
RECORDS = (
    "archive string, offset long, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, verified boolean"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, made inside the JVM: five bytes are eight digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan_records(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Each page with its digest, its record type and, for revisits, the id of the response.

    Only payloads that occur twice meet the pages again, on the digest; a digest that many pages share is a skewed key
    of a plain equi-join, which adaptive execution splits.
    """
    pages = columns(pages, page_id="long", url="string", html="string").withColumn(
        "payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")
    )
    pages = pages.select(
        "page_id",
        "url",
        "payload",
        base32_sha1(F.col("payload")).alias("digest"),
        F.length("payload").cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = (
        pages.where(F.col("size") >= min_bytes)
        .groupBy("digest", "size", "page_id")
        .agg(F.count(F.lit(1)).alias("same"), F.min("row").alias("row"))
        .groupBy(F.col("digest").alias("d"), F.col("size").alias("s"))
        .agg(
            F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "same", "row")).alias("first"),
            F.sum("same").alias("n"),
        )
        .where("n > 1")
    )
    joined = pages.join(first, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    other = ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    again = (F.col("first.same") > 1) & (F.col("first.row") != F.col("row"))  # the same page given more than once
    revisit = F.col("first").isNotNull() & (other | again)
    return joined.select(
        "page_id",
        "url",
        "digest",
        "size",
        F.when(revisit, REVISIT).otherwise(RESPONSE).alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _record(page_id, url, digest, size, kind, refers_to, payload) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    uri = (url or "urn:x-none").replace("\r", "%0D").replace("\n", "%0A")
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>\r\n"
        f"WARC-Target-URI: {uri}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n"
    )
    if kind == REVISIT:
        head += f"WARC-Profile: {IDENTICAL}\r\nWARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>\r\n"
    else:
        block += payload
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], dictionary_bytes: int, training_bytes: int) -> bytes:
    """A dictionary from records spread evenly over the archive, or none if they are too few to learn from."""
    total = sum(map(len, records))
    step = max(1, -(-total // training_bytes))
    samples = [r for r in records[::step] if len(r) >= 8]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    wanted = min(dictionary_bytes, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(wanted, samples, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # all samples alike: nothing to learn
        return b""


def _save(folder: str, records: list[bytes], level: int, dictionary_bytes: int, training_bytes: int) -> tuple:
    fs, root = pafs.FileSystem.from_uri(folder)
    trained = build_dictionary(records, dictionary_bytes, training_bytes)
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    press = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
    name = f"{uuid.uuid4().hex}.warc.zst"
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        packed = zstandard.ZstdCompressor(level=19).compress(trained)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        size = 8 + len(packed)
        for record in records:
            frame = press.compress(record)
            out.write(frame)
            size += len(frame)
    return f"{folder}/{name}", len(records), size, len(trained)


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    min_bytes: int = 0,
    archive_bytes: int = 16 << 20,
    dictionary_bytes: int = 64 << 10,
    training_bytes: int = 4 << 20,
    level: int = 3,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder`` (a URI); return the written manifest."""
    spark = pages.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held: list[bytes] = []
        size, made = 0, []
        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "record_type", "refers_to", "payload")]
            for row in zip(*fields, strict=True):
                held.append(_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    made.append(_save(folder, held, level, dictionary_bytes, training_bytes))
                    held, size = [], 0
        if held:
            made.append(_save(folder, held, level, dictionary_bytes, training_bytes))
        if made:
            names = ("archive", "records", "bytes", "dictionary_bytes")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=list(names))

    made = plan_records(pages, min_bytes=min_bytes).mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def load_dictionary(source) -> tuple[bytes, int]:
    """The dictionary of an open archive and the offset of its first record."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    return zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=1 << 30), 8 + size


def read_record(path: str, offset: int) -> bytes:
    """One record by its offset: only the dictionary and that record's frame are read."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as source:
        trained, _ = load_dictionary(source)
        source.seek(offset)
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        out = []
        while not one.eof:
            out.append(one.decompress(source.read(1 << 14)))
        return b"".join(out)


def _frames(path: str) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every record; reads the archive in pieces."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as source:
        trained, at = load_dictionary(source)
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        press, rest = zstandard.ZstdDecompressor(dict_data=known), b""
        while rest := rest or source.read(1 << 16):
            one, out, began = press.decompressobj(), [], at
            while True:
                piece, rest = rest[: 1 << 13], rest[1 << 13 :]
                out.append(one.decompress(piece))
                at += len(piece)
                if one.eof:
                    rest, at = one.unused_data + rest, at - len(one.unused_data)
                    break
                rest = rest or source.read(1 << 16)
                if not rest:
                    raise ValueError(f"{path} ends within a record")
            yield began, b"".join(out)


def _parse(raw: bytes) -> tuple:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length")).split(b": ")[1])
    page, to = fields["WARC-Record-ID"][12:-1], fields.get("WARC-Refers-To", "<urn:x-page:>")[12:-1]
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    good = len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    url = fields["WARC-Target-URI"]
    return (
        int(page) if page else None,
        None if url == "urn:x-none" else url,
        kind,
        size,
        digest,
        int(to) if to else None,
        good if kind == RESPONSE else None,
    )


def read_archives(manifest: DataFrame, *, readers: int | None = None) -> DataFrame:
    """Every record of the listed archives; ``verified`` says whether a response's payload has its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("archive", pa.string()),
                ("offset", pa.int64()),
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("refers_to", pa.int64()),
                ("verified", pa.bool_()),
            ]
        )
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                for offset, raw in _frames(path):
                    rows.append((path, offset, *_parse(raw)))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    paths = manifest.select("archive")
    return (paths.repartition(readers) if readers else paths).mapInArrow(read, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back and return what they hold."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, shared_dir(spark, "warc"))
    found = read_archives(manifest, readers=4 * spark.sparkContext.defaultParallelism)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + CAST(
      (CAST(concat('0x', substr(hexed, CAST(1 + 10 * (i // 8) AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '')
      AS payload_digest
  FROM p
), f AS (
  SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS head
  FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN head END AS refers_to
FROM f
"""
