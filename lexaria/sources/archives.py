"""Members of zip archives as rows.

Archives are read as binary files, those within a size cap only (others are listed with
an error and never loaded).  A first pass cuts an archive at its members' offsets, without
inflating anything; the members are then dealt to all tasks, which inflate and check
them, so one archive keeps several tasks busy.  What is damaged is a row with an error, not a failure.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an archive and of an inflated member up to which they are read.
MOST_ARCHIVE, MOST_MEMBER = 256 << 20, 64 << 20
_CUT = "archive string, sha256 string, member string, method int, crc long, size long, packed binary, error string"
_MEMBER = "archive string, sha256 string, member string, size long, content binary, error string"
STORED, DEFLATED = 0, 8


def cut_members(data: bytes) -> list[tuple]:
    """(name, method, checksum, size, packed bytes, error) of the members in the order of the directory; one row with an error where there is no directory."""
    try:
        listed = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
        return [(None, None, None, None, None, f"no archive: {e}")]
    out = []
    for m in listed:
        if m.is_dir():
            continue
        head = data[m.header_offset : m.header_offset + 30]
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            out.append((m.filename, None, None, m.file_size, None, "no member at its offset"))
            continue
        name, extra = struct.unpack("<HH", head[26:30])
        start = m.header_offset + 30 + name + extra
        packed = data[start : start + m.compress_size]
        error = "encrypted" if m.flag_bits & 1 else "cut off" if len(packed) < m.compress_size else None
        out.append((m.filename, m.compress_type, m.CRC, m.file_size, None if error else packed, error))
    return out


def inflate(packed: bytes, method: int, crc: int, size: int, most: int) -> tuple[bytes | None, str | None]:
    """A member's bytes, or why there are none; never more than the cap is inflated."""
    if size > most:
        return None, "too large"
    if method not in (STORED, DEFLATED):
        return None, f"method {method}"
    try:
        data = packed if method == STORED else zlib.decompressobj(-15).decompress(packed, most + 1)
    except zlib.error as e:
        return None, f"damaged: {e}"
    if len(data) > most:
        return None, "too large"
    return (data, None) if len(data) == size and zlib.crc32(data) == crc else (None, "damaged: another checksum or size")


def _cut(archives: DataFrame) -> DataFrame:
    """The members of rows (archive, content), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["archive"].to_pylist(), batch["content"], strict=True):
                data = data.as_py()
                digest = hashlib.sha256(data).hexdigest()
                for row in cut_members(data):  # one member a batch: a batch is no larger than what it holds
                    values = [path, digest, *row]
                    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _CUT.split(", ")])

    return archives.mapInArrow(run, _CUT)


def _inflated(members: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, errors = [], []
            for packed, method, crc, size, error in zip(*(batch[c].to_pylist() for c in ("packed", "method", "crc", "size", "error")), strict=True):
                data, why = (None, error) if packed is None else inflate(packed, method, crc, size, most)
                content.append(data)
                errors.append(why)
            yield pa.RecordBatch.from_arrays(
                [batch["archive"], batch["sha256"], batch["member"], batch["size"], pa.array(content, pa.binary()), pa.array(errors, pa.string())],
                [c.split()[0] for c in _MEMBER.split(", ")]
            )

    return members.mapInArrow(run, _MEMBER)


def read_members(
    spark: SparkSession, path: str, most_archive: int = MOST_ARCHIVE, most_member: int = MOST_MEMBER, depth: int = 1, tasks: int | None = None
) -> DataFrame:
    """archive, sha256 (of the archive), member, size, content, error: all members of the zip files of a path.

    With a depth above 1, members that are zip files themselves are opened too; theirs are rows of 'archive!member'.
    Spark lists no empty files, so they have no row.
    """
    files = spark.read.format("binaryFile").load(path)
    null = lambda kind: F.lit(None).cast(kind)
    large = files.filter(F.col("length") > most_archive).select(
        F.col("path").alias("archive"), null("string").alias("sha256"), null("string").alias("member"), F.col("length").alias("size"), null("binary").alias("content"), F.lit("too large").alias("error")
    )
    level = files.filter(F.col("length") <= most_archive).select(F.col("path").alias("archive"), "content")
    out = large
    for k in range(depth):
        members = _inflated(_cut(level).repartition(tasks or spark.sparkContext.defaultParallelism), most_member)
        nested = F.coalesce(F.lower("member").endswith(".zip") & F.col("content").isNotNull(), F.lit(False))
        last = k == depth - 1
        out = out.unionByName(members if last else members.filter(~nested))
        level = members.filter(nested).select(F.concat_ws("!", "archive", "member").alias("archive"), "content")
    return out


def member_lines(members: DataFrame) -> DataFrame:
    """archive, member, line (from 0), value: the lines of text members, as reading the files would give them; members with an error have none."""
    text = F.decode("content", "UTF-8")
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    whole = members.filter("error is null and length(content) > 0")
    return whole.select("archive", "member", F.posexplode(lines).alias("line", "value"))
