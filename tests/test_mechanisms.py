"""Greedy samples, fits on a simplex and the tagger against enumeration and plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaria.operators import fitting, selection, tagger


@pytest.mark.parametrize("seed,keys", [(1, 5), (2, 60), (3, 400)])
def test_greedy_sample_equals_a_loop(spark, seed, keys):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([None, f"k{rng.randrange(keys)}"]) for _ in range(rng.randint(0, 3))], rng.randrange(50)) for i in range(400)] + [(400, None, 3)]
    df = spark.createDataFrame(rows, "id long, keys array<string>, h int").withColumn("place", F.lit(1)).withColumn("key", F.lit("z"))
    got = selection.greedy_sample(df, "id", F.col("keys"), F.col("h")).collect()
    seen, want = set(), set()
    for i, ks, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        own = {k for k in ks or [] if k is not None}
        if not own & seen:
            want.add(i)
            seen |= own
    assert {r.id for r in got} == want and len(got) == len(want)
    assert max(r.round for r in got) <= 12 and {r.id for r in got if r.round == 0} == {i for i, ks, _ in rows if not any(ks or [])}


def test_greedy_sample_of_a_hot_key_and_of_nothing(spark):
    df = spark.range(2000).select("id", F.array(F.lit("one"), F.col("id").cast("string")).alias("keys"))
    assert [r.id for r in selection.greedy_sample(df, "id", F.col("keys"), F.col("id") * -1).collect()] == [1999]
    assert selection.greedy_sample(df.limit(0), "id", F.col("keys"), F.col("id")).collect() == []


def test_projection():
    rng = np.random.default_rng(1)
    for _ in range(200):
        v = rng.normal(size=4) * 3
        p = fitting.onto_simplex(v)
        assert p.min() >= 0 and abs(p.sum() - 1) < 1e-12
        for q in rng.dirichlet(np.ones(4), 30):
            assert ((v - p) ** 2).sum() <= ((v - q) ** 2).sum() + 1e-12


@pytest.mark.parametrize("objective", ["corr", "mse"])
def test_simplex_fit_beats_the_grid(spark, objective):
    rng = np.random.default_rng(7)
    data = []
    for g in range(8):
        x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
        y = x @ rng.normal(size=3) * (-1 if g == 7 else 1) + rng.normal(size=60) * 0.5
        data += [(g, *map(float, a), float(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*data, (0, None, 1.0, 1.0, 5.0)], "g int, a double, b double, c double, y double")
    fitted = {r.g: r for r in fitting.simplex_fit(df, ["a", "b", "c"], "y", ["g"], objective).collect()}
    grid = [np.array([i, j, 50 - i - j]) / 50 for i in range(51) for j in range(51 - i)]
    for g in range(8):
        x = np.array([r[1:4] for r in data if r[0] == g])
        y = np.array([r[4] for r in data if r[0] == g])
        w = np.array(fitted[g].weights)
        assert fitted[g].n == 60 and w.min() >= 0 and abs(w.sum() - 1) < 1e-9
        if objective == "corr":
            r = lambda v: np.corrcoef(x @ v, y)[0, 1]  # noqa: E731, B023
            assert fitted[g].r == pytest.approx(r(w), abs=1e-9) and fitted[g].r >= max(map(r, grid)) - 1e-9
        else:
            e = lambda v: ((x @ v - y) ** 2).mean()  # noqa: E731, B023
            assert e(w) <= min(map(e, grid)) + 1e-9


def test_simplex_fit_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)] * 4, "a double, b double, y double")
    row = fitting.simplex_fit(df, ["a", "b"], "y", []).first()
    assert row.r == 0 and row.weights == [0.5, 0.5]
    with pytest.raises(ValueError):
        fitting.Moments(np.zeros(1), np.zeros((1, 1)), np.zeros(1), 0.0, 1.0, "none such")


def field(rng, bins, k):
    return tagger.Weights.of(rng.normal(size=(bins + k + 2) * k), bins, k)


def batch(rng, bins, k, lengths):
    places = rng.integers(0, 4, sum(lengths))
    return rng.integers(0, bins, places.sum()), places, np.array(lengths), rng.integers(0, k, sum(lengths))


def scores(w, features, labels):
    """The score of one sequence with its labels."""
    s = w.first[labels[0]] + w.last[labels[-1]] + sum(w.follow[a, b] for a, b in zip(labels, labels[1:], strict=False))
    return s + sum(w.features[f, y] for fs, y in zip(features, labels, strict=True) for f in fs)


def test_marginals_equal_enumeration():
    rng, bins, k, lengths = np.random.default_rng(2), 7, 3, [1, 6, 3, 5, 2, 4]
    w = field(rng, bins, k)
    flat, places, n, _ = batch(rng, bins, k, lengths)
    lattice = tagger.Lattice(w, flat, places, n)
    cuts = np.split(flat, np.cumsum(places)[:-1])
    got, at, pairs = lattice.marginals(), 0, np.zeros((k, k))
    for length in lengths:
        features = cuts[at : at + length]
        paths = list(itertools.product(range(k), repeat=length))
        weight = np.exp([scores(w, features, p) for p in paths])
        for t in range(length):
            for y in range(k):
                assert got[at + t, y] == pytest.approx(sum(x for x, p in zip(weight, paths, strict=True) if p[t] == y) / weight.sum(), abs=1e-9)
        for x, p in zip(weight / weight.sum(), paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += x
        assert lattice.total[lengths.index(length)] == pytest.approx(math.log(weight.sum()), abs=1e-9)
        at += length
    assert np.allclose(lattice.pairs(), pairs)


def test_gradient_of_the_field():
    rng, bins, k = np.random.default_rng(3), 6, 3
    flat, places, n, labels = batch(rng, bins, k, [3, 1, 4])
    x = rng.normal(size=(bins + k + 2) * k)
    g = np.zeros_like(x)
    value = tagger.Lattice(tagger.Weights.of(x, bins, k), flat, places, n).gradient(labels, tagger.Weights.of(g, bins, k))
    assert value > 0
    for i in range(len(x)):
        d = np.zeros_like(x)
        d[i] = 1e-6
        up, down = (tagger.Lattice(tagger.Weights.of(x + s * d, bins, k), flat, places, n).gradient(labels, tagger.Weights.of(np.zeros_like(x), bins, k)) for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_minimise():
    a = np.diag([1.0, 10.0, 100.0])
    x, values = tagger.minimise(lambda v: (float(v @ a @ v) / 2 - v.sum(), a @ v - 1), np.zeros(3), 60, enough=1e-14)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4) and values == sorted(values, reverse=True)


def test_marked_spans():
    assert tagger.marked_spans([0.9, 0.1, 0.0, 0.6, 0.0], [0.0, 0.8, 0.1, 0.1, 0.9], 0.5) == [(0, 2), (3, 5)]
    assert tagger.marked_spans([0.9, 0.9, 0.1], [0.0, 0.0, 0.8], 0.5) == [(1, 3)] and tagger.marked_spans([], [], 0.5) == []
    assert tagger.marked_spans([0.0, 0.0], [0.9, 0.9], 0.5, least=1) == [(0, 2)]


def test_tagger_finds_held_out_phrases(spark):
    """Words of a phrase are ordinary words elsewhere: only their order tells them, so the field needs neighbours and transitions."""
    rng, bins = random.Random(5), 1 << 12
    phrases, words = [["in", "order", "to"], ["a", "number", "of"], ["prior", "to"]], "in order to a number of prior we they see go house tree on and".split()
    rows = []
    for i in range(260):
        tokens, tags = [], []
        for _ in range(rng.randint(0, 9)):
            if rng.random() < 0.3:
                p = rng.choice(phrases)
                tokens += p
                tags += [0] + [1] * (len(p) - 1)
            else:
                tokens.append(rng.choice(words[7:]) if rng.random() < 0.6 else rng.choice(["to", "of", "a"]))
                tags.append(2)
        rows.append((i, tagger.word_features(tokens, bins), tags))
    df = spark.createDataFrame(rows, "id long, features array<array<int>>, labels array<int>").repartition(4)
    model = tagger.train(df.filter("id < 200"), ["B", "I", "O"], bins, penalty=0.1, steps=25)
    assert model.losses == sorted(model.losses, reverse=True) and model.losses[-1] < 0.2 * model.losses[0]
    good = found = real = 0
    for r in model.marginals(df.filter("id >= 200"), ["id"]).collect():
        m = r.marginals
        assert all(abs(sum(p) - 1) < 1e-9 for p in m) and len(m) == len(rows[r.id][2])
        got = set(tagger.marked_spans([p[0] for p in m], [p[1] for p in m], 0.5))
        tags = rows[r.id][2]
        want = set(tagger.marked_spans([float(t == 0) for t in tags], [float(t == 1) for t in tags], 0.5))
        good, found, real = good + len(got & want), found + len(got), real + len(want)
    assert 2 * good / (found + real) > 0.9
    assert tagger.train(df.limit(0), ["B", "I"], 16).flat.any() == False  # noqa: E712


def test_terms_both_ways(spark):
    from lexaria.operators import terms

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "c-d", "E,", "f"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "a b"] + ["b c d"] * 20
    known = list({" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(60)}) + ["A  b", "a b", None, " - ", "e,"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("term", F.lit("z")).withColumn("word", F.lit("y"))
    listed = spark.createDataFrame([(t,) for t in known], "term string")
    got = [sorted(map(tuple, terms.find_terms(df, listed, ["id"], most_bytes=most).collect())) for most in (1 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) > 100
    import re

    want = []
    for i, text in enumerate(texts):
        for term in {t for t in known if t and re.search(r"[^\s-]", t)}:
            pattern = r"[\s-]+".join(map(re.escape, re.split(r"[\s-]+", term)))
            want += [(i, m.start(), m.start() + len(m[1]), term) for m in re.finditer(rf"(?<!\w)(?=({pattern})(?!\w))", text or "", re.IGNORECASE)]
    assert got[0] == sorted(want)
    assert terms.find_terms(df, listed.limit(0), ["id"]).count() == 0


XML = """<?xml version="1.0" encoding="UTF-8"?>
<pdf2xml producer="x">
<page number="1" position="absolute" top="0" left="0" height="1188" width="918">
<fontspec id="0" size="24" family="ABC+Nimbus-Medi" color="#000000"/><fontspec id="1" size="16" family="ABC+Nimbus-Regu" color="#000000"/>
<fontspec id="2" size="18" family="ABC+Nimbus-Bold" color="#000000"/><fontspec id="3" size="9" family="X+CMMI10" color="#000000"/>
<text top="100" left="200" width="300" height="20" font="0"><b>A Title</b></text>
<text top="120" left="100" width="90" height="16" font="2"><b>1 Introduction</b></text>
<text top="142" left="195" width="40" height="16" font="1">then <b>more &amp; more</b> end</text>
<text top="140" left="100" width="90" height="16" font="1">plain <i>and</i></text>
<text top="150" left="100" width="90" height="16" font="1"> </text>
<text top="160" left="100" width="20" height="9" font="3">x=y</text>
<text top="180" left="500" width="90" height="16" font="1">caf´e</text>
</page>
<page number="2" width="918"><text top="9" left="100" width="20" height="16" font="1">of the first page</text><text top="30" left="100" width="20" height="16" font="9">no font</text></page>
</pdf2xml>
"""


def test_pdf_xml(spark, tmp_path):
    from lexaria.sources import layout, pdf_xml

    for name in "ab":
        (tmp_path / f"{name}.xml").write_text(XML)
    (tmp_path / "c.xml").write_text("<pdf2xml></pdf2xml>")
    elements = pdf_xml.read_elements(spark, str(tmp_path))
    got = [(r.page, r.col, r.top, r.left, r.right, r["size"], r.kind, r.text) for r in elements.filter(F.col("doc").endswith("a.xml")).orderBy("page", "col", "top", "left").collect()]
    assert got == [
        (1, 0, 100.0, 200.0, 500.0, 24.0, "bold", "A Title"), (1, 0, 120.0, 100.0, 190.0, 18.0, "bold", "1 Introduction"), (1, 0, 140.0, 100.0, 190.0, 16.0, "plain", "plain and"),
        (1, 0, 142.0, 195.0, 235.0, 16.0, "plain", "then more & more end"), (1, 0, 160.0, 100.0, 120.0, 9.0, "math", "x=y"), (1, 1, 180.0, 500.0, 590.0, 16.0, "plain", "caf´e"),
        (2, 0, 9.0, 100.0, 120.0, 16.0, "plain", "of the first page"), (2, 0, 30.0, 100.0, 120.0, None, "plain", "no font")
    ]
    lines = layout.page_lines(elements)
    assert "applyInPandas" not in lines._jdf.queryExecution().toString() and "FlatMapGroups" not in lines._jdf.queryExecution().toString()
    found = layout.line_kinds(lines, 16.0, 20.0).filter(F.col("doc").endswith("b.xml")).orderBy("page", "col", "top").collect()
    assert [(r.text, r.kind) for r in found] == [
        ("A Title", "title"), ("1 Introduction", "heading"), ("plain and then more & more end", "body"), ("x=y", "drop"), ("café", "body"), ("of the first page", "body"), ("no font", "drop")
    ]
    assert [r.text for r in layout.paragraphs(layout.line_kinds(lines, 16.0, 20.0)).filter(F.col("doc").endswith("b.xml")).orderBy("place").collect()]


def test_lines_are_anchored_at_their_first_top(spark):
    from lexaria.sources import layout

    rows = [("d", 1, 0, float(t), float(x), x + 10.0, 10.0 + (x == 0), "plain", f"t{t}") for t, x in [(0, 0), (3, 20), (6, 40), (8, 60), (13, 80), (14, 0)]]
    got = layout.page_lines(spark.createDataFrame(rows, "doc string, page long, col long, top double, left double, right double, size double, kind string, text string"))
    assert [(r.top, r.text, r["size"]) for r in got.orderBy("top").collect()] == [(0.0, "t0 t3", 11.0), (6.0, "t6 t8", 10.0), (13.0, "t14 t13", 11.0)]


def test_roles_of_held_out_conversations(spark):
    from lexaria.plans import mechanism_queries
    from tests.oracle import SMALL

    rows = mechanism_queries.role_tagger(spark, SMALL).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == spark.read.parquet(f"{SMALL}/conversations.parquet").filter("role is not null").count()
    common = max(sum(r.role == x for r in held) for x in {r.role for r in held})
    assert sum(r.role == r.role_pred for r in held) > 1.2 * common


def test_dictionaries(spark, tmp_path):
    from lexaria.operators import dictionaries as d

    (tmp_path / "cmu.txt").write_text(";;; a comment\nREAD  R EH1 D\nREAD(2)  R IY1 D ER0\nFIRE  F AY1 ER0\nFIRE(2)  F AY1 R\nbroken\n")
    spoken = d.read_pronunciations(spark, str(tmp_path / "cmu.txt"))
    assert sorted(map(tuple, spoken.collect()))[0] == ("fire", "F AY1 ER0") and spoken.count() == 4
    own = d.override_union([spark.createDataFrame([("fire", "F AY1 AH0 ER0")], "word string, sounds string"), spoken], "word")
    words = spark.createDataFrame([("fire", 3), ("read", 1), ("table", 2), (None, 1)], "word string, n int")
    assert {r.word: (r.n, r.syllables, r.known) for r in d.dictionary_syllables(words, own).collect()} == {
        "fire": (3, 3, True), "read": (1, 1, True), "table": (2, 1, False), None: (1, None, False)
    }
    words = spark.createDataFrame([(w,) for w in ("went", "cities", "making", "ran", "boxes", "zzzed", "go")], "word string")
    forms = spark.createDataFrame([("went", "go"), ("went", "wend")], "form string, lemma string")
    lexicon = spark.createDataFrame([(w,) for w in ("go", "city", "make", "mak", "box", "boxe")], "word string")
    assert {r.word: (r.lemma, r.how) for r in d.lemmas(words, forms, lexicon).collect()} == {
        "went": ("go", "listed"), "cities": ("city", "ending"), "making": ("mak", "ending"), "ran": (None, None), "boxes": ("box", "ending"), "zzzed": (None, None), "go": ("go", "whole")
    }
    assert d.override_union([own, own], "word").count() == own.count() and d.dictionary_syllables(words.limit(0), spoken).count() == 0


def test_partial_aggregates(spark):
    """A hot group in many tasks, groups without values, and a table function's best candidates."""
    from lexaria.functions import partial

    moments = partial.Partial(lambda v: np.array([len(v), v.sum(), (v * v).sum()]), lambda s: s.sum(0), lambda s: s[2] / s[0] - (s[1] / s[0]) ** 2)
    rows = spark.range(0, 50_000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(-1)).alias("g"), (F.col("id") % 97).cast("double").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(999, None), (None, 4.0)], "g long, v double"))
    got = {r.g: r.value for r in partial.partial_aggregate(rows, ["g"], "v", moments).collect()}
    want = {r.g: r.v for r in rows.groupBy("g").agg(F.var_pop("v").alias("v")).collect()}
    assert got.keys() == want.keys() and got[999] is None and all(got[k] == pytest.approx(want[k]) for k in want if want[k] is not None)
    assert partial.partial_aggregate(rows.limit(0), ["g"], "v", moments).count() == 0
    words = spark.createDataFrame([("x", w) for w in ["abcd", "abce", None] * 500] + [("y", "zz"), ("z", None)], "g string, w string")
    best = partial.best_candidates(words, "w", "g", lambda w: [(w[:k], float(k)) for k in range(1, len(w) + 1)], 3)
    assert sorted(map(tuple, best.collect())) == [("x", "abc", 3.0), ("x", "abcd", 4.0), ("x", "abce", 4.0), ("y", "z", 1.0), ("y", "zz", 2.0)]
