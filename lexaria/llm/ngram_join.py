"""Exact Jaccard self-join of word-shingle sets, size-aware (heavy-light).

Two texts link when ``100 * |A & B| >= 80 * |A | B|`` for their sets of distinct
5-word shingles.  A shingle is its 64-bit hash, and equality of sets that of a
128-bit digest: results are exact for sets of hashes, and words aren't compared.
Every step below is a necessary condition, so no link is lost; the last step counts
the intersection exactly.

1. *Sets.*  One pass over the texts makes each set, its 128-bit digest and its
   extended prefix: the ``n - ceil(0.8 n) + l`` smallest hashes, ``l = n // 20``.
   Linked sets share ``l`` or more hashes of these prefixes.  Equal sets count
   once from here on, under the smallest doc_id that has them.
2. *Candidates.*  A set stays if ``l`` of its prefix hashes occur in another
   set's prefix, and then if ``0.8 n`` of all its hashes occur in another
   candidate.  Each map task combines what it has of a hash before the shuffle,
   so a hash that a third of all texts hold arrives once per task.
3. *Heavy-light keys.*  The hashes that a set shares with no other candidate
   come first in the global order, the most frequent ones last.  Small sets
   (light) enumerate all 2-subsets of their extended prefix: linked light sets
   have one in common.  Large sets (heavy) put their prefix hashes in inverted
   lists, which heavy sets and the light sets large enough to link with them
   scan.  The boundary is the size at which enumerating subsets would cost more
   rows than scanning lists, from the histogram of sizes and of unshared hashes.
4. *Verification in two rounds.*  First each list's members against its most
   central member; exact links join components.  Then, inside each list, only
   pairs that still lie in different components and that the size and position
   bounds allow.  A group of copies so costs its size and not its square.
5. *Counting links* (``jaccard_links`` only).  Linked sets share a component and
   differ in size by a quarter at most.  So each component's sets go to blocks
   by classes of size, large classes to several; two blocks of one or of
   neighbouring classes meet in one group, which counts the intersections of all
   their pairs exactly by matrix products.  No pair is ever a row.

Definitions.  Null or empty texts and texts without words have an empty set and
link with nothing.  Rows with a null id get their set size, take no part in
links and have a null component.  Repeated rows count as equal texts.  Rows with
equal ids and different texts are one node: the id links with all that either text
links with.  Ties do not occur: the component's id is the smallest doc_id that links
reach.  Whole texts of any length are read; an empty table gives an empty result.
Only the id and the text column are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaria.llm.scratch import Scratch, broadcast_if_small, least_count
from lexaria.llm.words import chunk_words, chunks, mix, one_thread, shingle_hashes, short_hash

WORDS = 5
#: Hashes gathered in a map task before they are combined and sent on.
FLUSH = 1 << 21
#: Entries of the table of the most frequent hashes. It only orders hashes: any order gives the same links.
FREQUENT = 1 << 16
#: Sets, at most, whose texts are many enough to be dealt without a shuffle.
HOT = 1000
#: Rows that a posting of an inverted list costs: its own, and one against the list's lead. A subset costs its own row.
SCANS = 2
#: Sets and hashes of a block whose links are counted, and columns of a matrix product.
BLOCK_SETS, BLOCK_HASHES, COLUMNS = 512, 1 << 18, 4096


def least_overlap(n: np.ndarray | int):
    """ceil(0.8 n): fewest hashes that a set of n shares with any set it links with."""
    return (4 * n + 4) // 5


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text."""
    for first, last, data, offsets in chunks(column):
        _, _, h, bounds = chunk_words(data, offsets)
        all_of = shingle_hashes(h, WORDS)
        for i in range(last - first):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= WORDS:
                x = np.sort(all_of[lo : hi - WORDS + 1])
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            elif hi > lo:
                x = short_hash(h[lo:hi])
            else:
                x = h[:0]
            yield first + i, x


def _digest(x: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(d[0]), int(d[1])


class _Combiner:
    """Hashes with the set that holds them; one row for each hash, more only for those it shows to be shared."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.owners: list[int] = []
        self.sizes: list[int] = []
        self.held = 0

    def add(self, hashes: np.ndarray, owner: int) -> None:
        self.hashes.append(hashes)
        self.owners.append(owner)
        self.sizes.append(len(hashes))
        self.held += len(hashes)

    def flush(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hash, owner, shared: a row with shared=False for each hash; with True for each owner of a hash that several here hold."""
        h = np.concatenate(self.hashes) if self.hashes else np.zeros(0, dtype=np.uint64)
        o = np.repeat(np.array(self.owners, dtype=np.int64), self.sizes)
        self.__init__()
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        head = np.ones(len(h), dtype=bool)
        head[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(head)
        if len(h):
            several = np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)
            in_several = np.repeat(several, np.diff(np.append(starts, len(h))))
        else:
            in_several = head
        return (
            np.concatenate([h[head], h[in_several]]).view(np.int64),
            np.concatenate([o[head], o[in_several]]),
            np.concatenate([np.zeros(len(starts), dtype=bool), np.ones(int(in_several.sum()), dtype=bool)]),
        )


_FIRST = "kind byte, id long, n long, hi long, lo long"


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a text's id, set size and digest. kinds 1, 2: a prefix hash (id) and its set (lo); 2 if several sets of the task hold it."""
    keys, seen = _Combiner(), set()

    def sent():
        h, o, several = keys.flush()
        seen.clear()
        none = pa.nulls(len(h), pa.int64())
        return pa.record_batch([pa.array(several.astype(np.int8) + np.int8(1)), pa.array(h), none, none, pa.array(o)], ["kind", "id", "n", "hi", "lo"])

    for batch in batches:
        n, hi, lo = [], [], []
        for _, x in _sets(batch.column(1)):
            d = _digest(x) if len(x) else (0, 0)
            n.append(len(x))
            hi.append(d[0])
            lo.append(d[1])
            if len(x) and d not in seen:
                seen.add(d)
                need = least_overlap(len(x))
                keys.add(x[: len(x) - need + max(1, len(x) // 20)], d[1])
                if keys.held >= FLUSH:
                    yield sent()
        yield pa.record_batch(
            [pa.array(np.zeros(len(n), dtype=np.int8)), batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())],
            ["kind", "id", "n", "hi", "lo"]
        )
    yield sent()


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All hashes of the candidates: h, sid, and whether other sets of the task hold h."""
    keys = _Combiner()

    def sent():
        h, o, several = keys.flush()
        return pa.record_batch([pa.array(h), pa.array(o), pa.array(several)], ["h", "sid", "several"])

    for batch in batches:
        ids, his, los = (batch.column(i).to_pylist() for i in (0, 2, 3))
        for i, x in _sets(batch.column(1)):
            if len(x) and _digest(x) == (his[i], los[i]):
                keys.add(x, ids[i])
                if keys.held >= FLUSH:
                    yield sent()
    yield sent()


def _shared(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows whose key another owner holds as well. Rows marked several are known to be; they don't meet in one task."""
    place = F.when(F.col("several"), F.xxhash64(key, owner)).otherwise(F.col(key))
    w = Window.partitionBy("place").orderBy(owner)
    rows = rows.withColumn("place", place).withColumn("back", F.lag(owner).over(w)).withColumn("on", F.lead(owner).over(w))
    return rows.filter(F.col("several") | (F.col("back") != F.col(owner)) | (F.col("on") != F.col(owner))).select(key, owner)


def _keys(boundary: int, frequent: dict[str, np.ndarray]):
    """Keys of each set: 2-subsets of the prefix if light, prefix hashes if heavy or if a heavy set may link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent["h"], frequent["c"]
        for batch in batches:
            out = []
            sids, sizes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            for i, (sid, n) in enumerate(zip(sids, sizes, strict=True)):
                h = flat[bounds[i] : bounds[i + 1]]
                rank = np.zeros(len(h), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, counts[at], 0)
                alone = int(n) - len(h)
                h = h[np.lexsort((h, rank))]
                place = alone + np.arange(len(h))
                spare = int(n) - int(least_overlap(int(n)))
                if n <= boundary:
                    m = int((place < spare + 2).sum())
                    a, b = np.triu_indices(m, 1)
                    two = mix(h[a].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(h[b].view(np.uint64))).view(np.int64)
                    out.append((two, np.full(len(two), sid), np.full(len(two), n), int(n) - place[b] + 1, np.full(len(two), alone)))
                if 5 * n > 4 * boundary:
                    m = int((place < spare + 1).sum())
                    out.append((h[:m], np.full(m, sid), np.full(m, n), int(n) - place[:m], np.full(m, alone)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["key", "sid", "n", "rest", "alone"])

    return run


def _boundary(sets: DataFrame) -> int:
    """Largest size, by classes of the histogram, at which enumerating 2-subsets costs no more rows than scanning lists."""
    best = 0
    classes = sets.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 4).alias("c")).agg(
        F.max("n").alias("n"), F.avg(F.col("n") - F.size("hs")).alias("alone")
    ).orderBy("c").collect()
    for row in classes:  # four classes for each doubling of the size
        spare = row.n - least_overlap(row.n)
        light, heavy = max(0.0, spare + 2 - row.alone), max(0.0, spare + 1 - row.alone)
        if light * (light - 1) / 2 > max(1.0, heavy * SCANS):
            break
        best = row.n
    return best


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, with the exact size of the intersection."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    return both.filter(F.col("common") * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b", "common", "na", "nb")


def _possible(x: str, y: str):
    """Size and position bounds of two rows of one list."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (F.least(f"{x}.rest", f"{y}.rest") * 9 >= n * 4) & (F.least(f"{x}.n", f"{y}.n") * 5 >= F.greatest(f"{x}.n", f"{y}.n") * 4)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach, for each node that has an edge.

    Alternates large-star and small-star steps until nothing changes; no node's
    neighbours are ever gathered in one row, and each step is written to the
    shared folder, which cuts the lineage.
    """

    def mark(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    e = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, scratch.table(small)
        scratch.drop(old)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class JaccardJoin:
    """The join's tables: sets (sid, n, hs), keys (key, sid, n, rest, alone) and members (doc_id, n, hi, lo)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "ngram_join")
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        first = self.scratch.table(texts.mapInArrow(_first_pass, _FIRST), "none")
        self.members = first.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "hi", "lo")
        prefix = first.filter("kind > 0").select(F.col("id").alias("h"), F.col("lo").alias("sid"), (F.col("kind") == 2).alias("several"))
        hits = _shared(prefix, "h", "sid").distinct().groupBy("sid").agg(F.count("*").alias("hits"))
        whole = self.members.filter("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
        enough = F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n") / 20))
        reps = self.scratch.table(whole.join(hits, whole["lo"] == hits["sid"]).filter(enough).select("rep", "n", "hi", "lo"))
        some = broadcast_if_small(reps.select(F.col("rep").alias("doc_id"), "hi", "lo"), reps.count())
        hashes = texts.join(some, "doc_id").select("doc_id", "text", "hi", "lo").mapInArrow(_second_pass, "h long, sid long, several boolean")
        own = _shared(hashes, "h", "sid").groupBy("sid").agg(F.sort_array(F.collect_set("h")).alias("hs"))
        sets = own.join(reps.select(F.col("rep").alias("sid"), "n"), "sid").filter(F.size("hs") * 5 >= F.col("n") * 4)
        self.sets = self.scratch.table(sets.select("sid", "n", "hs"), "none")

        counts = self.sets.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
        counts = self.scratch.table(counts.filter("c > 1"), "none")
        top = counts.filter(F.col("c") >= least_count(counts, "c", FREQUENT, 5)).toPandas().sort_values("h")
        self.scratch.drop(counts)
        frequent = {"h": top["h"].to_numpy(np.int64), "c": top["c"].to_numpy(np.int64)}
        self.boundary = _boundary(self.sets)
        keys = self.sets.repartition(self._spread(), "sid").mapInArrow(_keys(self.boundary, frequent), "key long, sid long, n long, rest long, alone long")
        keys = self.scratch.table(keys, "none")
        full = keys.groupBy("key").agg(
            F.count("*").alias("size"), F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "sid", "n", "rest")).alias("lead")
        ).filter("size > 1")
        self.keys = self.scratch.table(keys.join(full, "key"), "none")
        self.scratch.drop(keys)

    def _spread(self) -> int:
        return int(self.members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _links(self, rows: DataFrame) -> DataFrame:
        """Exact links of the pairs within lists whose components differ."""
        x, y = rows.alias("x"), rows.alias("y")
        on = (F.col("x.key") == F.col("y.key")) & _possible("x", "y") & (F.col("x.root") != F.col("y.root")) & (F.col("x.sid") < F.col("y.sid"))
        pairs = x.join(y, on).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
        return _verified(pairs, self.sets)

    def classes(self) -> DataFrame:
        """(sid, root) of every set that links with another."""
        x = self.keys.select("key", "sid", "n", "rest", "lead").alias("x")
        star = x.filter(F.col("x.sid") != F.col("lead.sid")).select(
            F.col("lead.sid").alias("a"), F.col("sid").alias("b"), (
                F.least("rest", "lead.rest") * 9 >= (F.col("n") + F.col("lead.n")) * 4
            ).alias("near"), (F.least("n", "lead.n") * 5 >= F.greatest("n", "lead.n") * 4).alias("alike")
        )
        star = star.filter("near and alike").select("a", "b").distinct()
        first = self.scratch.table(components(_verified(star, self.sets), self.scratch))
        rows = self.keys.join(first.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        open_ = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        rows = self.scratch.table(rows.join(open_, "key").select("key", "sid", "n", "rest", "root"), "none")
        more = self._links(rows)
        root = rows.select("sid", "root").distinct()
        more = more.join(
            root.select(F.col("sid").alias("a"), F.col("root").alias("ra")), "a"
        ).join(root.select(F.col("sid").alias("b"), F.col("root").alias("rb")), "b")
        second = components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.scratch)
        second = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
        alone = second.join(first.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("sid"), F.col("top").alias("root"))
        return first.join(second, "root", "left").select(F.col("node").alias("sid"), F.coalesce("top", "root").alias("root")).unionByName(alone)


def _dealt(members: DataFrame, classes: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """members with the columns of their set's class (hi, lo, texts and these names).

    Of N members at most ``HOT`` sets have more than ``N / HOT``: those are broadcast,
    so that a set that a third of all texts have isn't gathered in one task.
    """
    least = max(1000, members.count() // HOT)
    hot = scratch.table(classes.filter(F.col("texts") > least).select("hi", "lo", *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__hot")))
    rows = members.join(F.broadcast(hot), ["hi", "lo"], "left")
    ready = rows.filter("__hot").select("doc_id", "n", *(F.col(f"__{c}").alias(c) for c in names))
    others = rows.filter("__hot is null").select("doc_id", "n", "hi", "lo")
    return ready.unionByName(others.join(classes, ["hi", "lo"]).select("doc_id", "n", *names))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    join = JaccardJoin(docs, id_col, text_col)
    classes = join.scratch.table(join.classes())
    members = join.members
    whole = members.filter("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("texts"))
    whole = join.scratch.table(
        whole.join(classes.withColumnRenamed("sid", "rep"), "rep", "left").select("hi", "lo", "texts", F.coalesce("root", "rep").alias("component_id"))
    )
    full = _dealt(
        members.filter("n > 0 and doc_id is not null"), whole, ["component_id"], join.scratch
    ).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = members.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(rest)


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of distinct hashes."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    i, j = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    for first in range(0, len(both), COLUMNS):
        some = both[first : first + COLUMNS]
        tables = []
        for h, row, n in ((a, i, len(left)), (b, j, len(right))):
            at = np.minimum(np.searchsorted(some, h), len(some) - 1)
            hit = some[at] == h
            table = np.zeros((n, len(some)), dtype=np.float32)
            table[row[hit], at[hit]] = 1
            tables.append(table)
        out += np.rint(tables[0] @ tables[1].T).astype(np.int64)
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, links) from rows sorted by group (root, c, p, d, q): a set's links into the other side's block, by numbers of texts."""
    one_thread()
    group, held = None, []

    def counted() -> list[tuple[np.ndarray, np.ndarray]]:
        sides = [[r for r in held if r[0] == side] for side in (0, 1)]
        same = group[1:3] == group[3:5]
        left, right = sides[0], sides[0] if same else sides[1]
        if not left or not right or (same and len(left) < 2):
            return []
        common = _shared_counts([r[4] for r in left], [r[4] for r in right])
        n, m = np.array([r[2] for r in left]), np.array([r[2] for r in right])
        link = common * 9 >= (n[:, None] + m[None, :]) * 4
        if same:
            np.fill_diagonal(link, False)
        out = [(np.array([r[1] for r in left]), link @ np.array([r[3] for r in right]))]
        if not same:
            out.append((np.array([r[1] for r in right]), np.array([r[3] for r in left]) @ link))
        return out

    def sent(parts: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in (0, 1)], ["sid", "links"])

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        side, sid, n, texts = (batch.column(k).to_pylist() for k in range(5, 9))
        flat, bounds = batch.column(9).values.to_numpy(zero_copy_only=False), batch.column(9).offsets.to_numpy()
        parts = []
        for k, key in enumerate(keys):
            if key != group:
                if held:
                    parts += counted()
                group, held = key, []
            held.append((side[k], sid[k], n[k], texts[k], flat[bounds[k] : bounds[k + 1]].copy()))
        if parts:
            yield sent(parts)
    if held and (parts := counted()):
        yield sent(parts)


def _link_counts(sets: DataFrame) -> DataFrame:
    """(sid, links) of sets (root, sid, n, texts, hs): the texts of all other sets of the component that a set links with."""
    spread = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.25)))).cast("long"))
    # hashes and sets of a block are bounded; a quarter in size is one class, and one more for rounding
    size = sets.groupBy("root", "c").agg(F.sum("n").alias("hashes"), F.count("*").alias("k"))
    size = size.select("root", "c", F.greatest(F.ceil(F.col("hashes") / BLOCK_HASHES), F.ceil(F.col("k") / BLOCK_SETS)).cast("long").alias("parts"))
    near = size.select("root", "c", F.explode(F.sequence(F.col("c") - 2, F.col("c") + 2)).alias("d")).join(
        size.select("root", F.col("c").alias("d"), F.col("parts").alias("others")), ["root", "d"]
    )
    near = near.join(size, ["root", "c"])
    rows = sets.join(near, ["root", "c"]).withColumn("p", F.pmod(F.xxhash64("sid"), F.col("parts")))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    first = (F.col("c") < F.col("d")) | ((F.col("c") == F.col("d")) & (F.col("p") <= F.col("q")))
    low, high = F.struct("c", "p"), F.struct(F.col("d").alias("c"), F.col("q").alias("p"))
    rows = rows.select(
        "root", F.when(first, low).otherwise(high).alias("a"), F.when(first, high).otherwise(low).alias("b"),
        F.when(first, 0).otherwise(1).cast("long").alias("side"), "sid", "n", "texts", "hs"
    )
    rows = rows.select(
        "root", F.col("a.c").alias("c"), F.col("a.p").alias("p"), F.col("b.c").alias("d"), F.col("b.p").alias("q"), "side", "sid", "n", "texts", "hs"
    )
    group = ["root", "c", "p", "d", "q"]
    return rows.repartition(spread, *group).sortWithinPartitions(*group).mapInArrow(_block_links, "sid long, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row; n_links counts the other rows that the row's text links with, those of equal sets too.

    Rows with a null id have no links and are nobody's.
    """
    join = JaccardJoin(docs, id_col, text_col)
    classes = join.scratch.table(join.classes())
    members = join.members
    whole = join.scratch.table(
        members.filter("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("texts"))
    )
    sets = join.sets.join(classes, "sid").join(whole.select(F.col("rep").alias("sid"), "texts"), "sid")
    links = join.scratch.table(_link_counts(join.scratch.table(sets, "none")))
    whole = whole.join(classes.withColumnRenamed("sid", "rep"), "rep", "left").join(links.withColumnRenamed("sid", "rep"), "rep", "left")
    whole = join.scratch.table(
        whole.select(
            "hi", "lo", "texts", F.coalesce("root", "rep").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).cast("long").alias("n_links")
        )
    )
    full = _dealt(
        members.filter("n > 0 and doc_id is not null"), whole, ["component_id", "n_links"], join.scratch
    ).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    rest = members.filter("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    return full.unionByName(rest)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group of near copies: the one with the smallest id. Rows with equal ids go together; null ids stay."""
    found = jaccard_components(docs, id_col, text_col)
    gone = found.filter("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(docs.sparkSession, "near_copies").table(gone)
    return docs.join(broadcast_if_small(gone, gone.count()), docs[id_col].cast("long") == gone["__gone"], "left_anti")
