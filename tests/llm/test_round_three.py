"""Divergence rules, delta Lloyd and spelling variants against plain Python, and on the inputs that break things."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexaria.llm import delta_lloyd, divergence_rules, spelling_variants
from tests.llm.test_edge_cases import LONG, TEXTS, docs, none, rows  # noqa: F401

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, distance string, v string, id string, h int, before int"


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, "c", "d", "v", "i", 3, 4) for i, v in data], VECTORS)


def lloyd(data, k, rounds, size, scale):
    """Plain Lloyd on lists of whole numbers."""
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in data
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) * scale < 1 << 27 for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y)**2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        owners = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, o) in zip(kept, owners, strict=True) if o == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i if i is not None else -1, o, d) for (i, _), (d, o) in zip(kept, assign(), strict=True)), centroids


@pytest.mark.parametrize("spread,scale", [(1, 4), (1000, 256), (60_000, 1024)])
def test_delta_lloyd_equals_lloyd(spark, spread, scale):
    """Coarse vectors have ties and repeats; wide ones leave the doubles' exact range."""
    rng = random.Random(spread)
    data = [(i // 2, [round(rng.uniform(-spread, spread), 1) for _ in range(3)]) for i in range(300)]
    data += [(None, [0.0, 0.0, 0.0]), (7, [0.0, 0.0]), (8, None), (9, [1.0, None, 2.0]), (10, [1.0, math.nan, 2.0]), (11, [math.inf, 0.0, 0.0]), (12, [1e30, 0.0, 0.0]), (13, [])]
    want, centroids = lloyd(data, 7, 4, 3, scale)
    state, got = delta_lloyd.cluster(vectors(spark, data), 7, 4, size=3, scale=scale)
    assert got.tolist() == centroids
    assert sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in state.collect()) == want
    report = delta_lloyd.cluster_report(vectors(spark, data), 7, 4, size=3, scale=scale).collect()
    assert {r.inertia for r in report} == {sum(d for _, _, d in want)} and len(report) == len(want)
    by = Counter()
    for _, o, d in want:
        by[o] += d
    assert all(r.cluster_inertia == by[r.cluster] for r in report)


def test_delta_lloyd_of_few_or_no_vectors(spark):
    got = delta_lloyd.cluster_report(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])]), 5, 3, size=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in got] == [(1, 0, 0, 0)] * 2  # the centroids are equal, the first has both
    assert delta_lloyd.cluster_report(vectors(spark, []), 5, 3, size=2).collect() == []
    assert delta_lloyd.cluster_report(vectors(spark, [(1, [1.0])]), 5, 3, size=2).collect() == []


def test_reassign_compares_what_changed():
    """Stored distances stand for unchanged owners: the work on them is against changed centroids only, and the owners are those of all."""
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (400, 2))
    old = rng.integers(-9, 9, (6, 2))
    owner, distance = delta_lloyd.reassign(x, np.full(400, -1), np.full(400, -1), old, np.ones(6, dtype=bool))
    new = old.copy()
    new[[1, 4]] += 3
    changed = (new != old).any(1)
    got = delta_lloyd.reassign(x, owner, distance, new, changed)
    d = delta_lloyd.squared_distances(x, new)
    assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all()


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("most", [0, 3, 4096])
def test_near_pairs(spark, most):
    """With few pairs a key, all keys are cut down to the last code point; no pair is lost or made twice."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"ab" * 4000, "ab" * 3999 + "a", "ab" * 1999 + "x" + "ab" * 2000}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(sorted((r.a, r.b))) for r in spelling_variants.near_pairs(df, most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}


def test_hot_segments_are_cut_finer(spark):
    """20,000 words with one head: no key's entries times probes exceed the bound, so the verified candidates stay few."""
    rng = random.Random(1)
    words = {"interna" + "".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20_000)}
    words |= {w[:9] + "q" + w[10:] for w in sorted(words)[:50]}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    cuts = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1 :]].add(w)
    want = {tuple(sorted(p)) for c in cuts.values() for p in itertools.combinations(c, 2)}
    assert {tuple(sorted((r.a, r.b))) for r in spelling_variants.near_pairs(df).collect()} == want


def test_spelling_forms(spark):
    texts = ["colour " * 60 + "Color " * 11, "COLOR colors colors colors colors colors color", None, "", "12 34 . ;", "straße " * 5, "x" * 50_000]
    df = spark.createDataFrame([(None if i == 5 else i, t, 1, "w", "r") for i, t in enumerate(texts)], "doc_id long, text string, n long, word string, root string")
    got = {r.word: r for r in spelling_variants.spelling_forms(df, least_chars=5, slip=1 << 40).collect()}
    assert set(got) == {"colour", "color", "colors", "straße"}
    assert (got["color"].n, got["color"].n_near, got["color"].form, got["color"].form_n, got["color"].root) == (13, 2, None, None, "color")
    assert (got["colors"].n_near, got["colors"].form, got["colour"].n_near) == (1, None, 1)
    chain = " ".join(["aaaaaa"] * 2 + ["aaaaab"] * 10 + ["aaaabb"] * 50 + ["aaabbb"] * 250)
    got = {r.word: r for r in spelling_variants.spelling_forms(spark.createDataFrame([(1, chain)], "doc_id long, text string"), least_n=1, slip=1 << 40).collect()}
    assert {w: (r.form, r.root) for w, r in got.items()} == {"aaaaaa": ("aaaaab", "aaabbb"), "aaaaab": ("aaaabb", "aaabbb"), "aaaabb": ("aaabbb", "aaabbb"), "aaabbb": (None, "aaabbb")}
    ties = " ".join(["planed"] * 2 + ["planet"] * 10 + ["planer"] * 10)
    got = {r.word: r for r in spelling_variants.spelling_forms(spark.createDataFrame([(1, ties)], "doc_id long, text string"), least_n=1, slip=1 << 40).collect()}
    assert got["planed"].form == "planer"


def test_words_lose_a_code_point(spark):
    text = "Überraschung geschehen"
    got = {r.word: r.n for r in spelling_variants.count_words(spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string"), least_n=1, slip=3).collect()}
    want = Counter()
    for i in range(40):
        for run in ("Überraschung", "geschehen"):
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    assert got == want


def test_spelling_of_documents(docs, none):  # noqa: F811
    got = {r.word: r.n for r in spelling_variants.spelling_forms(docs, least_n=1, slip=1 << 40).collect()}
    assert got["before"] == 3 and got["x" * 100_000] == 1
    assert spelling_variants.spelling_forms(none).count() == 0


def divergence(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(max(0, sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q, strict=True)) / 2))


def test_jensen_shannon(spark):
    from pyspark.sql import functions as F

    data = [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 7]), ([5, 5], [5, 5]), ([1, 0, 0, 9], [4, 4, 4, 4])]
    df = spark.createDataFrame(data, "p array<long>, q array<long>")
    for r in df.select("*", divergence_rules.jensen_shannon(F.col("p"), F.col("q")).alias("d")).collect():
        assert r.d == pytest.approx(divergence(r.p, r.q), abs=1e-9)


def test_quality_of_documents(spark, docs, none):  # noqa: F811
    got = {r.doc_id: r for r in divergence_rules.judge_quality(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    assert [(got[i].n_words, got[i].word_chars, got[i].base_failed, got[i].kept) for i in (1, 2, 3, 4)] == [(0, 0, True, False)] * 3 + [(1, 3, True, False)]
    words = LONG.split()
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert (got[10].n_words, got[10].n_repeat_words) == (len(words), len(covered))
    assert got[13].word_chars == 100_000 and got[13].js_words is None
    assert divergence_rules.judge_quality(none).count() == 0


def test_repeats_and_lines(spark):
    texts = ["a b c a b c", "a b a b a", "a b c d\na b c d\n\n\n a b c d\n|#|", "x y z x y z x y z", "\n\n", "q q q q"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.n_dup_lines, r.n_symbols) for r in divergence_rules.judge_quality(df).collect()}
    assert got == {0: (6, 6, 0, 0), 1: (5, 5, 0, 0), 2: (13, 12, 1, 3), 3: (9, 9, 0, 0), 4: (0, 0, 0, 0), 5: (4, 4, 0, 0)}


def test_odd_histograms_go(spark):
    """Texts of the language stay, whatever their length; shouted ones and lists without common words go; without a reference nothing is judged."""
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "to", "in", "is"], ["".join(rng.choice("abdefgilmnoprstu") for _ in range(7)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.45 else rng.choice(rare) for _ in range(n)).capitalize() + "."
    texts = [(prose(rng.randint(60, 600)), "en") for _ in range(60)]
    odd = [(prose(300).upper().replace(" ", "!! "), "en"), (" ".join(rng.sample(rare, 400)), "en"), (prose(300).upper().replace(" ", "!! "), "xx"), (prose(300).upper(), None)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts + odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence_rules.judge_quality(df).collect()}
    assert all(got[i].kept for i in range(60))
    assert [got[60 + i].kept for i in range(4)] == [False, False, True, True] and got[62].js_chars is None is got[63].js_words
