"""SentencePiece encoding, N-best segmentation and decoding over the piece lattice.

The pieces of a SentencePiece model file are edges between byte positions of a
text (with a space in front, spaces standing for the model's U+2581).  A
character without a piece of its own is spelled in byte pieces.  The model file
holds merge ranks and no probabilities, so a piece's log probability is that of
Zipf's law over its rank; byte pieces lie ``BYTE_PENALTY`` nats below the last.
Scores are whole micronats, so sums are exact and ties are ties.

No piece has a space after another character, and none has a line break; at
those places the lattice has one node that every path meets, so it is worked
out unit by unit, once for each different unit of a batch:

* forward Viterbi scores of every node, for all units at a time;
* backward scores, which give each unit's gap to its second-best path;
* N-best: a search from the end of the unit, A-star with the forward scores
  as exact heuristics, pops the paths in order of score.  Of a whole text's
  units only the ``n - 1`` with the smallest gaps can differ from their best
  path in its ``n`` best segmentations; their lists are merged by a heap.

A search entry stands for all paths that end in its suffix, none of which another
entry has, and its key is the score of the best of them; so only the ``n`` best
entries are ever held.  A unit of more than ``LONG`` bytes is solved window by
window of its positions: it takes some 30 bytes of memory for each of its own.

Among equal scores of a unit the path whose search reaches further back first
comes first, then the one found first; among equal segmentations
of a text, those that change an earlier unit come first.  Equal units are told
by their bytes.  Decoding joins the pieces' bytes and drops the space in front:
every text is restored exactly.

Definitions: a null text has null ids; an empty text has no pieces; an empty
table gives an empty result.  Whole texts are encoded, of any length and with or
without spaces.  Repeated rows are encoded alike.  Other columns are not read and
may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from array import array
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.words import HashIndex, bound_batches, chunks, eight_bytes, expand, span_hashes, window_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PENALTY = 10.0
N_BEST = 4
SPACE = "▁"
_NONE = np.int64(-(1 << 60))
#: Gap of a unit that has one path only.
FAR_GAP = np.int64(1 << 60)
#: Units, and bytes of them, that a worker remembers before it starts anew.
REMEMBER, REMEMBER_BYTES = 150_000, 16 << 20
#: Bytes of a unit up to which it is solved together with others; positions of a window of a longer one; windows held.
LONG, WINDOW, WINDOWS = 2048, 1 << 14, 6
_LIVE: dict[str, object] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            raise ValueError("no SentencePiece model")
        yield tag >> 3, value


class Pieces:
    """Pieces of a model file as bytes, with ids and scores in micronats."""

    # Piece types of the model file.
    NORMAL, USER, BYTE = 1, 4, 6

    def __init__(self, model: bytes):
        self.bytes: list[bytes] = []
        normal, self.byte_id = [], np.full(256, -1, dtype=np.int64)
        for number, value in _fields(model):
            if number != 1:
                continue
            own = dict(_fields(value))
            text, kind, i = own[1].decode(), own.get(3, self.NORMAL), len(self.bytes)
            if kind == self.BYTE:
                self.byte_id[int(text[3:5], 16)] = i
                self.bytes.append(bytes([int(text[3:5], 16)]))
            elif kind in (self.NORMAL, self.USER):
                normal.append(i)
                self.bytes.append(text.replace(SPACE, " ").encode())
            else:
                self.bytes.append(b"")
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        inner = [p for i in normal if b" " in (p := self.bytes[i]).lstrip(b" ") or b"\n" in p]
        if inner:
            raise ValueError(f"pieces go on over a space or a line break: {inner[:3]}")
        self.score = np.zeros(len(self.bytes), dtype=np.int64)
        rank = np.arange(2, len(normal) + 2)
        log = -np.log(rank) - np.log((1 / rank).sum())
        self.score[normal] = np.round(log * 1e6)
        self.score[self.byte_id] = round((log[-1] - BYTE_PENALTY) * 1e6)
        lengths = np.array([len(self.bytes[i]) for i in normal])
        flat = np.frombuffer(b"".join(self.bytes[i] for i in normal), dtype=np.uint8)
        ends = np.cumsum(lengths)
        self.by_length = {}
        hashes = span_hashes(flat, ends - lengths, ends)
        ids = np.array(normal, dtype=np.int64)
        for n in np.unique(lengths).tolist():
            some = lengths == n
            self.by_length[n] = (HashIndex(hashes[some]), ids[some])
        self.single = {self.bytes[i] for i in normal if len(self.bytes[i].decode()) == 1}
        self.pool = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        # characters with a piece of their own, by code point
        points = np.array(sorted(ord(" ") if c == b" " else ord(c.decode()) for c in self.single))
        self.points = points

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of these ids, without the space in front."""
        at, _ = expand(self.first[ids], self.length[ids])
        return self.pool[at].tobytes()[1:]


def _covered(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each byte, whether its character has a piece of its own."""
    ascii_ = np.zeros(256, dtype=bool)
    ascii_[points[points < 128]] = True
    out = ascii_[data]
    wide = np.flatnonzero(data >= 128)
    if len(wide):
        out[wide] = _wide_covered(data[wide], points)
    return out


def _wide_covered(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The same for the bytes of characters beyond ASCII, one after the other."""
    head = (data & 0xC0) != 0x80
    which = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    b0 = data[starts].astype(np.int64)
    size = np.diff(np.append(starts, len(data)))
    at = [data[np.minimum(starts + i, len(data) - 1)].astype(np.int64) & 63 for i in (1, 2, 3)]
    point = np.where(
        b0 < 128, b0,
        np.where(
            size == 2, (b0 & 31) << 6 | at[0],
            np.where(size == 3, (b0 & 15) << 12 | at[0] << 6 | at[1], (b0 & 7) << 18 | at[0] << 12 | at[1] << 6 | at[2])
        )
    )
    k = np.minimum(np.searchsorted(points, point), len(points) - 1)
    return (points[k] == point)[which]


def _edges(pieces: Pieces, data: np.ndarray, end: np.ndarray, covered: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, piece) of all edges that start at these positions; end: where the unit of each byte ends. Shortest first."""
    bare, eight = at[~covered[at]], eight_bytes(data)
    starts, sizes, ids = [bare], [np.ones(len(bare), dtype=np.int64)], [pieces.byte_id[data[bare]]]
    for length, (index, own) in pieces.by_length.items():
        at = at[at + length <= end[at]]
        if not len(at):
            break
        found = index.find(window_hashes(eight, at, length))
        hit = np.flatnonzero(found >= 0)
        starts.append(at[hit])
        sizes.append(np.full(len(hit), length))
        ids.append(own[found[hit]])
    return tuple(np.concatenate(x) for x in (starts, sizes, ids))  # type: ignore[return-value]


def _search(first: int, last: int, forward: np.ndarray | list[int], into: Callable[[int], list[tuple[int, int, int]]], n: int) -> list[tuple[int, list[int]]]:
    """(score, ids) of the n best paths from first to last: A-star from the end, forward scores as heuristics.

    into: the edges into a node, as (where it starts, score, piece). An entry is
    (minus its key, node, when it was made, score of the suffix, its step); of
    each step only its piece and the step after it are kept.
    """
    held = [(-int(forward[last]), last, 0, 0, -1)]
    piece, after, made = array("i"), array("q"), 0
    out: list[tuple[int, list[int]]] = []
    while held and len(out) < n:
        f, node, _, done, step = held.pop(0)
        if node == first:
            ids = []
            while step >= 0:
                ids.append(piece[step])
                step = after[step]
            out.append((-f, ids))
            continue
        most = n - len(out)
        for before, score, p in into(node):
            ahead = int(forward[before])
            if ahead > _NONE // 2:
                key = -(done + score + ahead)
                if len(held) < most or key <= held[-1][0]:
                    piece.append(p)
                    after.append(step)
                    made += 1
                    insort(held, (key, before, made, done + score, len(piece) - 1))
                    del held[most:]
    return out


class LongUnit:
    """One long unit, solved in windows of its positions."""

    def __init__(self, pieces: Pieces, data: np.ndarray):
        self.pieces, self.data = pieces, data
        self.size, self.reach = len(data), max(pieces.by_length)
        self.covered = _covered(data, pieces.points)
        self.end = np.full(len(data), len(data))
        self.forward = np.full(len(data) + 1, _NONE, dtype=np.int64)
        self.forward[0] = 0
        self.windows: dict[int, tuple] = {}
        for low in range(0, self.size, WINDOW):
            high = min(self.size, low + WINDOW)
            start, size, piece = _edges(pieces, data, self.end, self.covered, np.arange(low, high))
            order = np.argsort(start, kind="stable")
            values = self.forward[low : high + self.reach].tolist()
            for i, n, s in zip((start[order] - low).tolist(), size[order].tolist(), pieces.score[piece[order]].tolist(), strict=True):
                v = values[i] + s
                if v > values[i + n]:
                    values[i + n] = v
            self.forward[low : high + self.reach] = values[: len(self.forward) - low]

    def _into(self, node: int) -> list[tuple[int, int, int]]:
        """Edges into a node; those of the windows used last are held."""
        w = (node - 1) // WINDOW
        held = self.windows.pop(w, None)
        if held is None:
            low, high = w * WINDOW, min(self.size, (w + 1) * WINDOW)
            start, size, piece = _edges(self.pieces, self.data, self.end, self.covered, np.arange(max(0, low - self.reach), high))
            target = start + size
            some = np.flatnonzero((target > low) & (target <= high))
            some = some[np.argsort(target[some], kind="stable")]
            edge = np.searchsorted(target[some], np.arange(low + 1, high + 2)).tolist()
            held = edge, start[some].tolist(), self.pieces.score[piece[some]].tolist(), piece[some].tolist()
        while len(self.windows) >= WINDOWS:
            del self.windows[next(iter(self.windows))]
        self.windows[w] = held
        edge, start, score, piece = held
        k = node - 1 - w * WINDOW
        a, b = edge[k], edge[k + 1]
        return list(zip(start[a:b], score[a:b], piece[a:b], strict=True))

    def n_best(self, n: int) -> list[tuple[int, list[int]]]:
        return _search(0, self.size, self.forward, self._into, n)


class Lattice:
    """The lattices of many units (bounds into one byte buffer), solved together."""

    def __init__(self, pieces: Pieces, data: np.ndarray, bounds: np.ndarray):
        self.pieces, self.bounds, self._plain = pieces, bounds, None
        n, units = len(data), np.arange(len(bounds) - 1)
        unit = np.repeat(units, np.diff(bounds))
        start, size, piece = _edges(pieces, data, bounds[1:][unit], _covered(data, pieces.points), np.arange(n))
        # nodes: one more than bytes for each unit
        self.first, self.last = bounds[:-1] + units, bounds[1:] + units
        self.unit = np.repeat(units, np.diff(bounds) + 1)
        nodes = n + len(units)
        source = start + unit[start]
        depth = np.arange(nodes) - self.first[self.unit]
        deepest = int(depth.max(initial=0))
        self.small = np.uint16 if deepest < 1 << 16 else np.int64  # numpy sorts short integers by radix
        order = np.argsort(depth[source + size].astype(self.small), kind="stable")
        self.source, self.piece = source[order], piece[order]
        self.target, self.score = self.source + size[order], pieces.score[self.piece]
        self.forward = np.full(nodes, _NONE, dtype=np.int64)
        self.forward[self.first] = 0
        self.back = np.full(nodes, -1, dtype=np.int64)
        levels = np.searchsorted(depth[self.target], np.arange(1, deepest + 2)).tolist()
        for a, b in zip(levels, levels[1:]):
            if a < b:
                target = self.target[a:b]
                value = self.forward[self.source[a:b]] + self.score[a:b]
                np.maximum.at(self.forward, target, value)
                best = np.flatnonzero(value == self.forward[target])
                self.back[target[best]] = a + best  # of equal edges the last, which is the longest, stays

    def best_paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the best path of every unit, in order, and the bounds of each unit's."""
        now = self.last.copy()
        units = np.flatnonzero(now > self.first)
        owners, edges = [], []
        while len(units):
            e = self.back[now[units]]
            owners.append(units)
            edges.append(e)
            now[units] = self.source[e]
            units = units[now[units] > self.first[units]]
        owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        edge = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        step = np.repeat(np.arange(len(owners)), [len(o) for o in owners])
        order = np.lexsort((-step, owner))
        return edge[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self.first)))])

    def gaps(self, best: np.ndarray) -> np.ndarray:
        """What each unit's second-best path loses; very large if there is none."""
        nodes = len(self.forward)
        backward = np.full(nodes, _NONE, dtype=np.int64)
        backward[self.last] = 0
        height = self.last[self.unit] - np.arange(nodes)
        order = np.argsort(height[self.source].astype(self.small), kind="stable")
        source, target, score = self.source[order], self.target[order], self.score[order]
        levels = np.searchsorted(height[source], np.arange(1, int(height.max(initial=0)) + 2)).tolist()
        for a, b in zip(levels, levels[1:]):
            if a < b:
                np.maximum.at(backward, source[a:b], np.maximum(backward[target[a:b]] + score[a:b], _NONE))
        through = np.maximum(self.forward[self.source] + self.score + backward[self.target], _NONE)
        through[best] = _NONE
        second = np.full(len(self.first), _NONE, dtype=np.int64)
        np.maximum.at(second, self.unit[self.target], through)
        return np.where(second > _NONE // 2, self.forward[self.last] - second, FAR_GAP)

    def n_best(self, unit: int, n: int) -> list[tuple[int, list[int]]]:
        """(score, ids) of the n best paths of a unit: A-star from its end, forward scores as heuristics."""
        first, last = int(self.first[unit]), int(self.last[unit])
        if first == last:
            return [(0, [])]
        if self._plain is None:  # numbers as they are are quicker one by one
            order = np.argsort(self.target, kind="stable")
            edge = np.searchsorted(self.target[order], np.arange(len(self.forward) + 1))
            self._plain = tuple(x.tolist() for x in (edge, self.source[order], self.score[order], self.piece[order], self.forward))
        edge, source, score, piece, forward = self._plain

        def into(node: int) -> list[tuple[int, int, int]]:
            a, b = edge[node], edge[node + 1]
            return list(zip(source[a:b], score[a:b], piece[a:b], strict=True))

        return _search(first, last, forward, into, n)


def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether spans of one buffer hold the same bytes as spans of another."""
    out = a_size == b_size
    if len(a) and len(b):
        at, of = expand(a_at, a_size)
        other = expand(b_at, a_size)[0]
        out[of[a[at] != b[np.minimum(other, len(b) - 1)]]] = False
    return out


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of the units of all rows of a buffer."""
    space, line = data == 32, data == 10
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    cut[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return np.flatnonzero(cut)


def _merge(best: int, options: list[list[tuple[int, list[int]]]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(score, choice by option list) of the n best combinations."""
    heap = [(0, (0,) * len(options))]
    seen = {heap[0][1]}
    out = []
    while heap and len(out) < n:
        loss, choice = heapq.heappop(heap)
        out.append((best - loss, choice))
        for i in range(len(options) - 1, -1, -1):
            if choice[i] + 1 < len(options[i]):
                new = (*choice[:i], choice[i] + 1, *choice[i + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (loss + options[i][choice[i]][0] - options[i][new[i]][0], new))
    return out


class Encoder:
    """Encodes rows of a buffer; remembers the units it has met."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}  # by hash
        self.other: dict[bytes, int] = {}  # of units whose hash another unit has
        self.pool, self.unit_at, self.unit_size = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.first = self.size = self.total = self.gap = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)
        self.lists: dict[int, list[tuple[int, list[int]]]] = {}

    def _lattice(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lattice:
        at, _ = expand(starts, ends - starts)
        return Lattice(self.pieces, data[at], np.concatenate([[0], np.cumsum(ends - starts)]))

    def _take(self, ids: np.ndarray, sizes: np.ndarray, total: np.ndarray, gap: np.ndarray) -> None:
        """Adds units: their best ids one after the other, how many each has, scores and gaps."""
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.total = np.concatenate([self.total, total])
        self.gap = np.concatenate([self.gap, gap])

    def _slots(self, data: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
        """Slot of each unit; new units are solved and get one."""
        if len(self.first) > REMEMBER or len(self.pool) > REMEMBER_BYTES:
            self._forget()
        starts, sizes = bounds[:-1], np.diff(bounds)
        keys, pick, same = np.unique(span_hashes(data, starts, bounds[1:]), return_index=True, return_inverse=True)
        # units of one hash and other bytes, should there be any, go by their bytes
        odd = np.flatnonzero(~_equal(data, starts, sizes, data, starts[pick][same], sizes[pick][same]))
        pick, same[odd] = np.concatenate([pick, odd]), len(pick) + np.arange(len(odd))
        own, size = starts[pick], sizes[pick]
        get = self.slot.get
        slots = np.full(len(pick), -1, dtype=np.int64)
        slots[: len(keys)] = [get(k, -1) for k in keys.tolist()]
        known = np.flatnonzero(slots >= 0)
        held = slots[known]
        wrong = known[~_equal(data, own[known], size[known], self.pool, self.unit_at[held], self.unit_size[held])]
        strange = {j: data[own[j] : own[j] + size[j]].tobytes() for j in [*wrong.tolist(), *range(len(keys), len(pick))]}
        for j, unit in strange.items():
            slots[j] = self.other.get(unit, -1)
        new = np.flatnonzero(slots < 0)
        if len(new):
            new = new[np.argsort(size[new] > LONG, kind="stable")]
            slots[new] = len(self.first) + np.arange(len(new))
            usual = new[[j not in strange for j in new.tolist()]] if strange else new
            self.slot.update(zip(keys[usual].tolist(), slots[usual].tolist(), strict=True))
            self.other.update((unit, int(slots[j])) for j, unit in strange.items())
            at, _ = expand(own[new], size[new])
            self.unit_at = np.concatenate([self.unit_at, len(self.pool) + np.cumsum(size[new]) - size[new]])
            self.unit_size = np.concatenate([self.unit_size, size[new]])
            self.pool = np.concatenate([self.pool, data[at]])
        short = new[size[new] <= LONG]
        if len(short):
            lattice = self._lattice(data, own[short], own[short] + size[short])
            best, edges = lattice.best_paths()
            self._take(lattice.piece[best], np.diff(edges), lattice.forward[lattice.last], lattice.gaps(best))
        for j in new[len(short) :].tolist():
            unit = LongUnit(self.pieces, data[own[j] : own[j] + size[j]])
            paths = unit.n_best(max(2, n))
            gap = paths[0][0] - paths[1][0] if len(paths) > 1 else FAR_GAP
            self.lists[len(self.first)] = paths[:n]
            self._take(np.array(paths[0][1], dtype=np.int64), np.array([len(paths[0][1])]), np.array([paths[0][0]]), np.array([gap]))
        return slots[same]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, list[tuple[int, list[tuple[int, list[int]]]]]]]:
        """For each row: ids, score, and the n best as (score, [(unit, its ids), ...] where it differs from the best)."""
        sizes = np.diff(offsets)
        full = sizes > 0
        grown = np.concatenate([[0], np.cumsum(sizes + full)])
        spaced = np.full(int(grown[-1]), 32, dtype=np.uint8)
        row = np.repeat(np.arange(len(sizes)), sizes)
        spaced[np.arange(len(data)) + np.cumsum(full)[row]] = data
        if not len(spaced):
            yield from ((self.ids[:0], 0, [(0, [])]) for _ in sizes)
            return
        bounds = _units(spaced, grown)
        slots = self._slots(spaced, bounds, n)
        units = np.searchsorted(bounds, grown)
        where, _ = expand(self.first[slots], self.size[slots])
        ids = self.ids[where]
        ends = np.concatenate([[0], np.cumsum(self.size[slots])])[units].tolist()
        scores = np.diff(np.concatenate([[0], np.cumsum(self.total[slots])])[units]).tolist()
        open_: list[np.ndarray] = []
        for r in range(len(sizes)) if n > 1 else ():
            g = self.gap[slots[units[r] : units[r + 1]]]
            if len(g) > n - 1:
                limit = np.partition(g, n - 2)[n - 2]
                low = np.flatnonzero(g < limit)
                low = np.sort(np.concatenate([low, np.flatnonzero(g == limit)[: n - 1 - len(low)]]))
            else:
                low = np.arange(len(g))
            open_.append(low[g[low] < FAR_GAP])
        if n > 1:
            some = np.concatenate([units[r] + x for r, x in enumerate(open_)]).astype(np.int64)
            need = {s: u for s, u in zip(slots[some].tolist(), some.tolist(), strict=True) if s not in self.lists}
            if need:
                at = np.array(list(need.values()))
                lattice = self._lattice(spaced, bounds[at], bounds[at + 1])
                for k, s in enumerate(need):
                    self.lists[s] = lattice.n_best(k, n)
        for r, score in enumerate(scores):
            variants = [(score, [])]
            if n > 1 and len(open_[r]):
                options = [self.lists[s] for s in slots[units[r] + open_[r]].tolist()]
                variants = [(v, [(int(open_[r][i]), options[i][c][1]) for i, c in enumerate(choice) if c]) for v, choice in _merge(score, options, n)]
            yield ids[ends[r] : ends[r + 1]], score, variants


def _live(key: str, make):
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = make()
    return _LIVE[key]


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, binary), score, and the n best as n_best: array of (score, changes: array of (unit, ids)).

    Scores are micronats. Changes name the units where a segmentation differs from the best.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(model, "rb") as f:  # on the driver; executors get the bytes
        held, run = spark.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    best = pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(pa.struct([("unit", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _live(run, lambda: Encoder(held.value))
        for batch in batches:
            null = batch.column(1).is_null().to_pylist()
            for first, last, data, offsets in chunks(batch.column(1)):
                ids, scores, lists = [], [], []
                for i, (x, s, v) in enumerate(encoder(data, offsets, n)):
                    none = null[first + i]
                    ids.append(None if none else x.astype("<i4").tobytes())
                    scores.append(None if none else s)
                    lists.append(None if none else [{"score": a, "changes": [{"unit": u, "ids": p} for u, p in c]} for a, c in v])
                yield pa.record_batch(
                    [batch.column(0)[first:last], pa.array(ids, pa.binary()), pa.array(scores, pa.int64()), pa.array(lists, best)],
                    ["doc_id", "ids", "score", "n_best"]
                )

    return rows.mapInArrow(encode, f"doc_id {kind}, ids binary, score long, n_best array<struct<score:long,changes:array<struct<unit:int,ids:array<int>>>>>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """Encodes each whole text, decodes its ids again, and keeps counts and digests only, in one pass.

    doc_id, n_pieces, pieces_sha256 (of the ids as encode_column packs them),
    best_score, n_best_scores (joined by commas) and decoded_sha256.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(model, "rb") as f:
        held, run = spark.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_pieces", "pieces_sha256", "best_score", "n_best_scores", "decoded_sha256"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _live(run, lambda: Encoder(held.value))
        for batch in batches:
            null = batch.column(1).is_null().to_pylist()
            for first, last, data, offsets in chunks(batch.column(1)):
                out = []
                for i, (x, s, v) in enumerate(encoder(data, offsets, n)):
                    if null[first + i]:
                        out.append((None, None, None, "", None))
                        continue
                    back = encoder.pieces.decode(x)
                    out.append(
                        (len(x), hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), s, ",".join(str(a) for a, _ in v), hashlib.sha256(back).hexdigest())
                    )
                yield pa.record_batch([batch.column(0)[first:last], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    return rows.mapInArrow(check, f"doc_id {kind}, n_pieces long, pieces_sha256 string, best_score long, n_best_scores string, decoded_sha256 string")


def decode_column(model: str, spark) -> object:
    """A column function from ids (as encode_column packs them) to text."""
    with open(model, "rb") as f:
        held, run = spark.sparkContext.broadcast(f.read()), uuid.uuid4().hex

    def decode(ids: pa.Array) -> pa.Array:
        pieces = _live(run, lambda: Pieces(held.value))
        out = []
        for x in ids:
            raw = x.as_py()
            out.append(None if raw is None else pieces.decode(np.frombuffer(raw, dtype="<i4").astype(np.int64)).decode())
        return pa.array(out, pa.string())

    return F.arrow_udf(decode, "string")
