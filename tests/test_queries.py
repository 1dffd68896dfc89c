import pytest

from lexaria.plans import catalog
from tests.oracle import SMALL, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert df.count() >= (name != "acronym_conflicts") and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _tables(spark, folder, documents, benchmark=()):
    spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_rare_bigrams_count(spark, tmp_path):
    got = {tuple(r) for r in catalog.QUERIES["bigram_lm"](spark, _tables(spark, tmp_path, ["a b a", "b", None])).collect()}
    two = {("<s>", "a", 1), ("a", "b", 1), ("b", "a", 1), ("a", "</s>", 1), ("<s>", "b", 1), ("b", "</s>", 1)}
    assert got == two | {("<s>", None, 2), ("a", None, 2), ("b", None, 2), ("</s>", None, 2), (None, None, 4)}


def test_rare_words_are_in_the_lexicon(spark, tmp_path):
    got = {
        r.word: (r.value, r.known) for r in catalog.QUERIES["lexicon_lookup"](
            spark, _tables(spark, tmp_path, ["cat cat dog", "tree tree tree"], ["cat dog fish"])
        ).collect()
    }
    assert got == {"cat": (2.0, True), "dog": (1.0, True), "fish": (2.0, False)}


def test_rare_words_have_a_zipf_value(spark, tmp_path):
    got = {r.word: (r.n, r.zipf) for r in catalog.QUERIES["corpus_zipf"](spark, _tables(spark, tmp_path, ["cat " * 9 + "dog"])).collect()}
    assert got == {"cat": (9, 8.954243), "dog": (1, 8.0)}


def test_documents_are_scored_by_all_documents(spark, tmp_path):
    got = {r.doc_id: (r.n, r.score) for r in catalog.QUERIES["bigram_context_score"](spark, _tables(spark, tmp_path, ["a", "a", "b"])).collect()}
    # <s> a 2 of 3, a </s> 2 of 2, <s> b 1 of 3, b </s> 1 of 1; three words begin a pair
    assert got == {0: (2, -0.271478), 1: (2, -0.271478), 2: (2, -0.632833)}


def test_phrases_of_test_items(spark, tmp_path):
    """Six-word phrases of items: the even item is the first source; of overlapping places of one source the first stays, and the first source beats the second."""
    docs = ["x a b c d e f g h i j k l", "q r s t u v w a b c d e f", "a b c d e"]
    items = ["a b c d e f g h i j k l m", "c d e f g h q r s t u v"]
    got = {tuple(r) for r in catalog.QUERIES["phrase_match"](spark, _tables(spark, tmp_path, docs, items)).collect()}
    assert got == {(0, 1, "a b c d e f", 0), (0, 7, "g h i j k l", 0), (1, 7, "a b c d e f", 0), (1, 0, "q r s t u v", 1)}
