"""WARC archives compressed record by record with a Zstandard dictionary made from the archive's own records.

Each file starts with a skippable frame that holds the dictionary; every record is a frame of its own. Of records with
equal payloads of at least ``REVISIT_BYTES``, the one with the smallest id is a response, the others are revisits that
refer to it and carry no payload.

Cases: a null payload is empty; shorter payloads are always responses; a null id counts as larger than any other, and
rows that tie on the smallest id of their payload are each written as responses; a null url has no target line; line
breaks in urls are escaped; repeated rows keep their records; an empty table makes no file; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import new_folder, opened, publish, staged

REVISIT_BYTES = 100
#: A dictionary frame's mark, as the .warc.zst convention fixes it.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds: payload bytes of one file, bytes that its dictionary is trained on (the same share of each record), dictionary bytes.
FILE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 64 << 10
#: Bytes of one piece of a record to train on.
PIECE_BYTES = 1 << 10


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= REVISIT_BYTES
    firsts = x.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return x.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def training_pieces(records: list[bytes]) -> list[bytes]:
    """All of ``records`` if they have TRAIN_BYTES at most; else the same share of each one, headers and payload alike: pieces
    of PIECE_BYTES at most, each at a hash-chosen offset in its own part of the record."""
    total = sum(map(len, records))
    if total <= TRAIN_BYTES:
        return records
    pieces = []
    for record in records:
        share = max(1, len(record) * TRAIN_BYTES // total)
        parts = -(-share // PIECE_BYTES)
        chosen, size = zlib.crc32(record), share // parts
        for k in range(parts):
            start, end = len(record) * k // parts, len(record) * (k + 1) // parts
            chosen = zlib.crc32(k.to_bytes(4, "little"), chosen)
            at = start + chosen % (end - start - size + 1)
            pieces.append(record[at : at + size])
    return pieces


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from pieces of all ``records``, TRAIN_BYTES in all; raw content where there are too few to train on."""
    samples = training_pieces(records)
    if len(samples) >= 16 and sum(map(len, samples)) >= 20 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8)
        except zstandard.ZstdError:
            pass  # samples too alike to train on
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _write_file(out, records: list[bytes], level: int) -> int:
    words = dictionary(records)
    raw = words.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True, write_content_size=True)
    for record in records:
        out.write(squeeze.compress(record))
    return len(records)


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write the rows of :func:`with_revisits` as .warc.zst files; returns (uri, n_records), staged."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/pages-{part:06d}-{number:04d}.warc.zst"
            n = publish(uri, lambda out: _write_file(out, held, level))
            return pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [n]})

        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(5)]
                record = _record(*row, date)
                held.append(record)
                size += len(record)
                if size >= FILE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    # sorted, so that a repeated task writes the same files
    return staged(pages.sortWithinPartitions("page_id", "digest", "url").mapInArrow(write, "uri string, n_records long"), "archives")


def records_of(file) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record of a .warc.zst file."""
    mark, size = struct.unpack("<II", file.read(8))
    if mark != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    words = zstandard.ZstdCompressionDict(file.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(file, read_across_frames=True), 1 << 16)

    def headers(source) -> dict[str, str]:
        found = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            found[name.lower()] = value
        return found

    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("no record starts here")
        own = headers(plain)
        block = io.BytesIO(plain.read(int(own["content-length"])))
        block.readline()
        http = headers(block)
        yield own, http, block.read()
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end")


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each archived record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def number(text: str | None) -> int | None:
        return int(text[len("<urn:page:") : -1]) if text and text != "<urn:page:null>" else None

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                with opened(uri) as file:
                    for own, http, payload in records_of(file):
                        digest = own["warc-payload-digest"].removeprefix("sha256:")
                        revisit = own["warc-type"] == "revisit"
                        if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                            raise ValueError("a payload differs from its digest or length")
                        rows.append((number(own["warc-record-id"]), own.get("warc-target-uri"), int(http["content-length"]), digest, own["warc-type"], number(own.get("warc-refers-to")), None if revisit else payload))
                        held += len(payload)
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    parts = max(1, files.count())
    return files.select("uri").repartition(parts).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write all pages and read the archives back."""
    return read_archives(write_archives(with_revisits(pages, **columns), folder or new_folder(pages.sparkSession, "warc")))
