"""Worked examples with known values."""

import pytest
from pyspark.sql import functions as F

from lexaria.functions import measures, text
from lexaria.operators import corpus, evaluation, rewrite
from lexaria.sources import loaders


def one(spark, column, **values):
    row = [tuple(values.values())] or [(1,)]
    return spark.createDataFrame(row, list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("word,f,r", [("the", 1, 1), ("table", 1, 1), ("reading", 2, 2), ("area", 2, 2), ("idea", 2, 2), ("one", 1, 1), ("eye", 1, 1)])
def test_syllables(word, f, r):
    assert measures.syllables(word) == f and text._syllables_r(word) == r


def test_bands(spark):
    got = [one(spark, text.band(F.col("s")), s=s) for s in (0.95, 0.9499, 0.8, 0.0)]
    assert got == ["≥0.95", "0.90–0.95", "0.80–0.90", "<0.80"]


def test_empty_text_has_no_scores(spark):
    assert text.counts_f("") == (0, 1, 0, 0, 0, 0) and text.counts_r(None) == (0, 0, 0, 0, 0, 0)
    n = dict(zip(("n_words", "n_sentences", "n_syllables", "n_poly", "n_long", "n_letters"), map(F.lit, text.counts_f(""))))
    assert spark.range(1).select(text.scores_f(n)["grade"].alias("g")).first().g is None


def test_dictionary_keeps_unknown_tokens(spark):
    assert one(spark, rewrite.dictionary(F.split("t", " "), {"the": "a"}), t="the cat the") == ["a", "cat", "a"]


def test_auc_with_ties_and_wilson(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0), (0.2, 0)], "s double, y int")
    assert evaluation.auc(df, "s", "y").first().auc == 1.0
    flat = spark.createDataFrame([(0.5, 1), (0.5, 0)], "s double, y int")
    assert evaluation.auc(flat, "s", "y").first().auc == 0.5
    assert evaluation.auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first().auc is None
    p, low, high = evaluation.wilson(F.lit(5.0), F.lit(10.0))
    row = spark.range(1).select(p.alias("p"), low.alias("l"), high.alias("h")).first()
    assert row.l < row.p == 0.5 < row.h


def test_pareto_keeps_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (2, 1.0, 5), (3, 2.0, 4), (4, 2.0, 6)], "i int, low double, high int")
    assert sorted(r.i for r in evaluation.pareto(df, "low", "high").collect()) == [1, 2, 4]


def test_alpha_of_agreement(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 5.0), (2, 5.0), (3, 2.0)], "u int, v double")
    assert evaluation.interval_alpha(df, "u", "v").first().alpha == 1.0


def test_hex_mod(spark):
    digest = "ff" * 32
    assert one(spark, corpus.hex_mod(F.col("d"), 10), d=digest) == int(digest, 16) % 10


def test_first_by_key(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("b", 2, "x")], "k string, o int, v string")
    assert {tuple(r) for r in corpus.first_by_key(df, ["k"], "o").collect()} == {("a", 1, "y"), ("b", 2, "x")}


def test_loaders(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    (tmp_path / "a.tsv").write_text('1\t"q\tx\n2\n')
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("id", StringType())])
    assert loaders.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).count() == 2
    assert loaders.read_jsonl_lenient(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    assert [tuple(r) for r in loaders.read_tsv(spark, str(tmp_path / "a.tsv"), {0: "i", 1: "t"}, 3).collect()] == [("1", '"q')]
    assert loaders.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).first().b == "x\ny"
    with pytest.raises(ValueError):
        loaders.read_csv(spark, str(tmp_path / "a.csv"), ["c"])


def test_html_blocks(spark):
    page = "<head><title>t</title></head><p>One <b>two</b></p><script>x</script><table><tr><td>no</td></tr></table><div>Three &amp; four</div>"
    assert one(spark, loaders.html_blocks(F.col("h")), h=page) == ["t", "One two", "Three & four"]
