"""Operators see all of their input: each of these failed while a part of it was left out."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexaria.llm import language_id, lm_scoring, ngram_join
from tests.llm.test_brute_force import _near_copies


def test_lm_learns_from_every_block(spark):
    """A long text whose order shows in every second run of 256 words only."""
    r = random.Random(3)
    names = ["the", "and", "for", "with", "that", "this", "from", "have", "not", "are"]
    lines = [w for k in range(31) for w in ([names[i % 10] for i in range(256)] if k % 2 else [r.choice(names) for _ in range(256)])]
    docs = spark.createDataFrame([(0, " ".join(lines)), (1, " ".join(names * 30))], "doc_id long, text string")
    by = {row.doc_id: row for row in lm_scoring.score_texts(docs, F.col("doc_id") == 1, steps=300).collect()}
    assert by[0].n_tokens == len(lines) + 1
    assert by[1].score / by[1].n_tokens > by[1].base_score / by[1].n_tokens + 0.4


def test_join_counts_every_link(spark, monkeypatch):
    """Near copies and equal texts against brute force, with blocks so small that components take several."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    texts = _near_copies(1) + _near_copies(1)[:20] + [""]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in map(str.split, texts)]
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_join.jaccard_links(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in rows} == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert {r.doc_id: r.component_id for r in rows} == {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}


def test_language_id_keeps_all_contexts_of_many_languages():
    r = np.random.default_rng(5)
    window = r.integers(1, 256, (4000, 4))
    grams = window @ (256 ** np.arange(3, -1, -1))
    model = language_id.PpmModel([str(i) for i in range(12)], np.arange(4000) % 12, grams, np.ones(4000))
    assert [len(level.node.values[level.node.values >= 0]) for level in model.levels] == [len(np.unique(grams >> 8 & (1 << 8 * k) - 1)) for k in range(4)]
    assert len(model.cost) == len(np.unique(grams))
