"""Vectorised word hashing on raw UTF-8 buffers.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; ``A-Z``
are lower-cased first.  Everything works on numpy views of Arrow buffers, in
segments that end at white space, so memory is bounded by the segment and not
by the text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SEGMENT = 1 << 18
BATCH = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_MASK = (1 << 64) - 1
#: Bytes of a word up to which it is hashed eight bytes at a time; longer words go through BLAKE2b.
LONG_WORD = 2048
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; what lies past the end is zero."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def window_hashes(eight: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The span hashes of windows of one size (up to LONG_WORD) that start at these places, given eight_bytes."""
    out = mix(np.full(1, size, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    for k in range(0, size, 8):
        out = mix(out ^ (eight[at + k if k else at] & _KEEP[min(size - k, 8)]))
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end].

    Spans are taken eight bytes at a time, each step a bijective mix of what came
    before and the next eight bytes, so spans of one length of up to eight bytes
    never collide and longer ones do so by chance only (a polynomial modulo a
    power of two would collide on regular words).  Very long spans are hashed one by one.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    if not len(size):
        return out
    words = eight_bytes(data)
    open_ = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = starts[open_].astype(np.int64), size[open_]
    while len(open_):
        out[open_] = mix(out[open_] ^ (words[at] & _KEEP[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def hash_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the lower-cased words of one byte array."""
    n = len(data)
    if n <= SEGMENT:
        low = _LOWER[data]
        s, e = word_spans(low)
        return s, e, span_hashes(low, s, e)
    parts = []
    at = 0
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            gap = np.flatnonzero(_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # one word longer than a segment: take it whole
                rest = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else n
        low = _LOWER[data[at:end]]
        s, e = word_spans(low)
        parts.append((s + at, e + at, span_hashes(low, s, e)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers stay alive after a task and count against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_freed() -> None:
    """Freed arrays of up to 32 MB stay with this worker until give_back: where each step takes and frees some MB, fresh pages took a fifth to a half of its time in runs outside Spark.

    Does nothing where the C library can't.
    """
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(-3, 1 << 25)  # M_MMAP_THRESHOLD
        option(-1, 1 << 28)  # M_TRIM_THRESHOLD


def one_thread() -> None:
    """Matrix products of this worker on one thread: a task has one core, and further threads only wait for each other on products this small.

    Does nothing where numpy's library is another than OpenBLAS.
    """
    try:
        with open("/proc/self/maps") as f:
            libraries = {line.split()[-1] for line in f if "openblas" in line and line.rstrip().endswith(".so")}
    except OSError:
        return
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH bytes (or one row) in this session, unless its settings name a size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most SEGMENT bytes (or one row): first, last, bytes, offsets from 0."""
    raw, offsets = text_buffer(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    give_back()


def chunk_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows of a chunk: starts, ends, hashes, and bounds of each row's words.

    A word never runs over a row's end.
    """
    if len(offsets) == 2:
        s, e, h = hash_text(data)
        return s, e, h, np.array([0, len(h)])
    low = _LOWER[data]
    inside = ~_SPACE[low]
    before = np.zeros(len(low), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = inside[1:]
    inner = offsets[1:-1]
    inner = inner[inner < len(low)]
    before[inner] = False
    tail = inner[inner > 0] - 1
    after[tail] = False
    s = np.flatnonzero(inside & ~before)
    e = np.flatnonzero(inside & ~after) + 1
    return s, e, span_hashes(low, s, e), np.searchsorted(s, offsets)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; empty if there are fewer."""
    m = len(h) - k + 1
    if m <= 0:
        return h[:0]
    out = h[:m].copy()
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + m]
    return mix(out)


def short_hash(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle."""
    x = np.uint64((0xA0761D6478BD642F * (len(h) + 1)) & _MASK)
    out = np.array([x], dtype=np.uint64)
    for v in h:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v
    return mix(out)


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions first[i] .. first[i] + count[i] - 1, and i for each."""
    of = np.repeat(np.arange(len(first)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of], of


class HashIndex:
    """Position of 64-bit keys in an array of distinct keys, by open addressing on numpy arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length() if len(keys) else 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        self.probes = 0
        wait = np.arange(len(keys))
        while len(wait):
            slot = ((keys[wait] >> self.shift).astype(np.int64) + self.probes) & self.mask
            free = self.values[slot] < 0
            first = np.zeros(len(wait), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]] = keys[wait[put]]
            self.values[slot[put]] = wait[put]
            wait = wait[~put]
            self.probes += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that are not there."""
        slot = (keys >> self.shift).astype(np.int64)
        out = self.values[slot]
        open_ = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        out[self.keys[slot] != keys] = -1
        for r in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + r) & self.mask
            value = self.values[at]
            same = (self.keys[at] == keys[open_]) & (value >= 0)
            out[open_[same]] = value[same]
            open_ = open_[~same & (value >= 0)]
        return out
