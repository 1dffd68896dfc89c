"""Empty and null texts, with and without labels: an empty text's share of letters is 0 / 0."""

from zlib import crc32

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexaria.plans import catalog
from tests.oracle import same

TEXTS = ["", *(f"Words {'and more of them ' * (i % 7)}{'1;2; ' * (i % 5)}end. {i}" for i in range(60)), "", None, "no language here"]
SOURCES = [*(f"source {i % 20}" for i in range(63)), None]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents 0 (empty) and 61 on (empty, null, of no language or source); all of them labelled, or those between."""
    at = tmp_path_factory.mktemp("empty")
    lang = [None if i == 63 else "en" for i in range(len(TEXTS))]
    rows = [(i, t, lang[i], SOURCES[i], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    for name, labelled in (("all", range(len(TEXTS))), ("some", range(1, 61))):
        (at / name).mkdir()
        columns = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*rows, strict=True)), strict=True))
        pq.write_table(pa.table(columns), f"{at}/{name}/documents.parquet")
        labels = pa.table({"doc_id": list(labelled), "quality": pa.array([int(i % 7 < 3) for i in labelled], pa.int32()), "toxic": pa.array([i % 2 for i in labelled], pa.int32())})
        pq.write_table(labels, f"{at}/{name}/labels.parquet")
    return at


@pytest.mark.parametrize("labelled", ["some", "all"])
def test_boosted_quality_of_empty_texts(spark, folder, labelled):
    got = catalog.QUERIES["boosted_quality"](spark, f"{folder}/{labelled}").collect()
    ids = range(len(TEXTS)) if labelled == "all" else range(1, 61)
    assert sorted(r.doc_id for r in got) == [i for i in ids if crc32((SOURCES[i] or "").encode()) % 5 == 0] != []
    assert all(0 <= p <= 1 for r in got for p in (r.boosted, r.logistic))


@pytest.mark.parametrize("labelled", ["some", "all"])
@pytest.mark.parametrize("name", ["calibration_report", "calibration_bins", "weighted_precision", "band_means", "youden_threshold"])
def test_scores_of_empty_texts_are_those_of_sql(spark, folder, name, labelled):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name], f"{folder}/{labelled}")


@pytest.mark.parametrize("labelled", ["some", "all"])
def test_logistic_quality_judges_every_labelled_text(spark, folder, labelled):
    got = {r.doc_id for r in catalog.QUERIES["logistic_quality"](spark, f"{folder}/{labelled}").collect()}
    assert got == {i for i in (range(len(TEXTS)) if labelled == "all" else range(1, 61)) if i % 5 == 0}


@pytest.mark.parametrize("labelled", ["some", "all"])
def test_out_of_fold_has_every_labelled_text(spark, folder, labelled):
    got = [r.doc_id for r in catalog.QUERIES["out_of_fold"](spark, f"{folder}/{labelled}").collect()]
    assert sorted(got) == list(range(len(TEXTS)) if labelled == "all" else range(1, 61))
