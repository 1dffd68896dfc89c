"""Media columns in Ogg: 8-bit samples in two multiplexed logical streams.

A payload is cut into blocks of ``BLOCK`` samples; block ``j`` is packet
``j // 2`` of stream ``j % 2``.  Each stream starts with a page that holds its
header packet and ends with a page that has the end-of-stream flag; pages take
up to 255 lacing values, packets run on over pages, and a page's granule
position counts the samples of the packets that end on it.

The reader checks every page's checksum and sequence number, reassembles
packets from lacing values, sorts them by serial number, derives each packet's
first sample from the granule positions, and interleaves the streams again.

Definitions: null text is empty; an empty payload is padded to one unit; an empty
table gives an empty result.  Equal payloads give equal bytes (serial numbers are
fixed), so ties and repeated rows come out alike.  A damaged file raises
``OggError``.  Whole texts are stored, of any length: a text is one value and takes a
few times its bytes while it is written or read.  Only the id and the text column are
read; others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.words import bound_batches, give_back

UNIT, BLOCK, STREAMS, RATE = 192, 3072, 2, 8000
#: Bytes of files in one batch of rows, or one file.
HELD = 4 << 20
MAGIC = b"OggS"
HEADER = b"LXPCM8\0\1"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def ogg_crc(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, no reflection, zero at start and end: zlib's on mirrored bits."""
    x = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream_pages(serial: int, packets: list[bytes], header: bytes) -> Iterator[bytes]:
    yield _page(2, 0, serial, 0, bytes([len(header)]), header)
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body = b"".join(packets)
    done = samples = at = 0
    number, open_ = 1, 0  # open_: samples of a packet begun on an earlier page
    while True:
        part = lacing[at : at + 255]
        at += len(part)
        values = np.frombuffer(part, dtype=np.uint8)
        ends = np.flatnonzero(values < 255)
        size = int(values.sum())
        last = at >= len(lacing)
        if len(ends):
            samples += open_ + int(values[: ends[-1] + 1].sum())
            granule = samples
            new_open = int(values[ends[-1] + 1 :].sum())
        else:
            granule = -1 if len(part) else samples  # no packet ends here
            new_open = open_ + size
        yield _page((1 if open_ else 0) | (4 if last else 0), granule, serial, number, part, body[done : done + size])
        done, open_, number = done + size, new_open, number + 1
        if last:
            return


def write_ogg(payload: bytes) -> bytes:
    """The payload as an Ogg file."""
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    streams = [_stream_pages(s + 1, blocks[s::STREAMS], HEADER + struct.pack("<BBIQ", s, STREAMS, RATE, len(payload))) for s in range(STREAMS)]
    out = [next(s) for s in streams]  # all first pages come before any other page
    while streams:
        for s in list(streams):
            page = next(s, None)
            if page is None:
                streams.remove(s)
            else:
                out.append(page)
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, number, lacing, body) of each page, checksum verified."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 4] != MAGIC or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if version or end > len(data):
            raise OggError(f"page at byte {at} is cut or of another version")
        if ogg_crc(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        yield flags, granule, serial, number, lacing, view[start:end]
        at = end


def read_ogg(data: bytes) -> tuple[bytes, dict]:
    """The payload, and what was found: pages, packets, streams, and the last packet's first sample in each stream."""
    held: dict[int, list] = {}
    pages = 0
    for flags, granule, serial, number, lacing, body in read_pages(data):
        pages += 1
        if flags & 2:
            if serial in held:
                raise OggError(f"stream {serial} starts twice")
            held[serial] = [0, b"", [], [], False]  # next page, open packet, packets, their first samples, ended
        if serial not in held:
            raise OggError(f"stream {serial} has no first page")
        state = held[serial]
        if number != state[0] or state[4]:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & 1) != bool(state[1]):
            raise OggError(f"page {number} of stream {serial} doesn't go on where the last ended")
        state[0], state[4] = number + 1, bool(flags & 4)
        values = np.frombuffer(lacing, dtype=np.uint8).astype(np.int64)
        ends = np.flatnonzero(values < 255)
        edges = np.cumsum(values)[ends].tolist()
        at, new = 0, []
        for e in edges:
            new.append(state[1] + bytes(body[at:e]))
            state[1], at = b"", e
        state[1] += bytes(body[at:])
        if not flags & 2:
            first = granule - sum(map(len, new))
            for p in new:
                state[3].append(first)
                first += len(p)
        state[2] += new
    parts: dict[tuple[int, int], bytes] = {}
    size = streams = 0
    last = []
    for serial, (_, open_, packets, starts, ended) in sorted(held.items()):
        if open_ or not ended:
            raise OggError(f"stream {serial} doesn't end")
        if not packets or packets[0][: len(HEADER)] != HEADER:
            raise OggError(f"stream {serial} has no header")
        s, streams, _, size = struct.unpack_from("<BBIQ", packets[0], len(HEADER))
        for p, start in zip(packets[1:], starts, strict=True):
            if start % BLOCK or (start // BLOCK, s) in parts:
                raise OggError(f"granule positions of stream {serial}")
            parts[start // BLOCK, s] = p
        last.append(starts[-1] if starts else -1)
    payload = b"".join(parts[k] for k in sorted(parts))
    if len(payload) != size or len(held) != streams:
        raise OggError("streams or samples are missing")
    return payload, {"pages": pages, "packets": len(parts), "streams": len(held), "starts_ms": [s * 1000 // RATE for s in last], "ms": size * 1000 // RATE}


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    return text + b" " * (-len(text) % unit if text else unit)


def features(payload: bytes, found: dict) -> str:
    """Container facts and signal statistics of the samples that were read, as JSON; integers only."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    energy = x * x
    high = np.signbit(x)
    return json.dumps(
        found | {"sum": int(x.sum()), "energy": int(energy.sum()), "peak": int(np.abs(x).max()), "crossings": int((high[1:] != high[:-1]).sum())},
        separators=(",", ":")
    )


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        texts = batch.column(1)
        at = 0
        while at < len(texts):  # bounded output batches
            ids, sizes, media, held = [], [], [], 0
            while at < len(texts) and held < HELD:
                text = (texts[at].as_py() or "").encode()
                media.append(write_ogg(payload_of(text)))
                sizes.append(len(text))
                ids.append(batch.column(0)[at].as_py())
                held += len(media[-1])
                at += 1
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)
        give_back()


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an Ogg file in a binary column."""
    bound_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            media = batch.column(2)[i].as_py()
            payload, found = read_ogg(media)
            rows.append(
                (
                    batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, found)
                )
            )
        names = [c.split()[0] for c in _OUT.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in _OUT.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of media_column's rows, from the stored bytes."""
    return media.mapInArrow(_decode, _OUT)
