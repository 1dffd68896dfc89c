"""WARC archives compressed record by record with a Zstandard dictionary.

An archive is the bytes of a ``.warc.zst`` file: a skippable frame (magic
``184D2A5D``) that holds the dictionary, then one Zstandard frame for each
record.  The dictionary is trained on the archive's own records, on an even share of
each of them that comes to some ``SAMPLE`` bytes (training needs no more); archives
too small to train on take the raw bytes of their records.  Tasks write archives of at most
``ARCHIVE`` bytes of payload into a table in the shared folder, one archive per
row, so no executor depends on another one's disk; a lost task writes its own
part again.

Of records with equal payloads (of at least ``min_bytes``) the one with the
largest page id is the response; the others are revisits that refer to it and
hold no payload.  The groups are found by aggregation on the payload's SHA-1
and length, which combines on the map side; only those of several records go on.
While they are few they are broadcast, so no page is shuffled; beyond that pages
meet them in a join that adaptive execution can split.

Definitions: null html is an empty payload; null URLs are empty target URIs;
a null page id is never the largest unless all are null, and then each such
record is a response.  Equal page ids with equal payloads are all responses.  An
empty table gives no archive.  Whole pages are stored, of any length: a page is one
value, and an archive holds at least one.  Only the named columns are read; others
may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.scratch import Scratch, broadcast_if_small
from lexaria.llm.words import bound_batches

SKIPPABLE = 0x184D2A5D
ARCHIVE = 8 << 20
SAMPLE = 1 << 20
DICTIONARY = 32 << 10
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record_id(page_id: int | None, url: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}').urn}>"


def write_record(page_id: int | None, url: str, payload: bytes, response: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with the payload in an HTTP response, or a revisit without it."""
    uri, sum_ = _uri(url), digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, url)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sum_}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[int | None, int, str, str, int | None, str, bytes]:
    """(page id, payload bytes, digest, type, refers to, target URI, payload stored); digests are verified."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise WarcError("no WARC record")
    fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise WarcError("the block is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
    kind, sum_ = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != sum_):
        raise WarcError("the payload is damaged")
    page = fields["X-Page-Id"]
    refers = fields.get("X-Refers-To-Page-Id")
    return int(page) if page else None, size, sum_, kind, int(refers) if refers else None, fields["WARC-Target-URI"], payload


def write_archive(records: list[bytes]) -> bytes:
    """Dictionary in a leading skippable frame, then a frame for each record."""
    share = min(1.0, SAMPLE / max(1, sum(map(len, records))))
    sample = [r[: max(1, int(len(r) * share))] if share < 0.25 and len(r) > 4096 else r for r in records]
    every = max(1, sum(map(len, sample)) // SAMPLE)  # records of some length give a part, short ones every so often
    sample = sample[::every]
    held = sum(map(len, sample))
    data = b"".join(sample)[:DICTIONARY]
    kind = zstandard.DICT_TYPE_RAWCONTENT
    if len(sample) >= 16 and held >= 8 * 4096:
        try:
            data = zstandard.train_dictionary(min(DICTIONARY, held // 8), sample, level=LEVEL).as_bytes()
            kind = zstandard.DICT_TYPE_FULLDICT
        except zstandard.ZstdError:  # samples too alike to train on: their bytes serve as they are
            pass
    compressor = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind), write_checksum=True, write_content_size=True
    )
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *map(compressor.compress, records)])


def read_archive(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    magic, n = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise WarcError("no dictionary frame")
    data = archive[8 : 8 + n]
    full = data[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(archive)[8 + n :]
    while len(rest):
        one = decompressor.decompressobj()
        out = one.decompress(rest)
        if not one.eof:
            raise WarcError("the last frame is cut")
        used = len(rest) - len(one.unused_data)
        rest = rest[used:]
        yield out


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    held = 0

    def sent():
        return pa.record_batch([pa.array([len(records)], pa.int64()), pa.array([write_archive(records)], pa.binary())], ["records", "warc"])

    for batch in batches:
        ids, urls, pages, response, refers = batch.columns
        for i in range(batch.num_rows):
            payload = (pages[i].as_py() or "").encode()
            records.append(write_record(ids[i].as_py(), urls[i].as_py() or "", payload, response[i].as_py(), refers[i].as_py()))
            held += len(records[-1])
            if held >= ARCHIVE:
                yield sent()
                records.clear()
                held = 0
    if records:
        yield sent()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = [read_record(r)[:5] for r in read_archive(batch.column(1)[i].as_py())]
            if len(rows) != batch.column(0)[i].as_py():
                raise WarcError("records are missing")
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """records, warc: the archives of all pages, a table in the shared folder."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = rows.withColumn("sum", F.sha1(payload.cast("binary"))).withColumn("size", F.octet_length(payload))
    scratch = Scratch(pages.sparkSession, "warc")
    last = rows.groupBy("sum", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("pages"))
    last = scratch.table(last.filter(f"pages > 1 AND last IS NOT NULL AND size >= {int(min_bytes)}").drop("pages"))
    marked = rows.join(broadcast_if_small(last, last.count(), 128), ["sum", "size"], "left").withColumn(
        "response", F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    )
    marked = marked.select("page_id", "url", "html", "response", F.when(~F.col("response"), F.col("last")).alias("refers_to"))
    bound_batches(pages.sparkSession)
    return scratch.table(marked.mapInArrow(_write, "records long, warc binary"), "none")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    return archives.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
