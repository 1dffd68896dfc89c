"""Rows of fits in parts of bounded size, whatever the files."""

from pyspark.sql import functions as F

from lexaria.functions import batches
from lexaria.plans import model_queries


def _parts(spark, path, files, rows=4000):
    spark.range(rows).select(
        (F.col("id") + 1).alias("p_partkey"), F.concat(F.lit("part "), (F.col("id") % 977).cast("string")).alias("p_name"),
        F.concat(F.lit("Brand#"), (F.col("id") % 25).cast("string")).alias("p_brand"), F.element_at(F.array(*map(F.lit, ("TIN", "STEEL", "COPPER"))), (F.col("id") % 3 + 1).cast("int")).alias("p_type"),
        (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"), (900.0 + F.col("id") * 131 % 1009).alias("p_retailprice")
    ).repartition(files, "p_brand").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_parts_of_a_fit_are_bounded_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(batches, "FIT_ROWS", 100)
    one_file = spark.range(2000).coalesce(1).withColumn("x", F.col("id") * 3)
    parts = batches.dealt_for_fit(one_file, "id", 2000).rdd.glom().map(lambda p: [r.id for r in p]).collect()
    assert len(parts) == 20 and max(map(len, parts)) < 200
    assert all(p == sorted(p) for p in parts) and sorted(i for p in parts for i in p) == list(range(2000))


def test_boosted_price_fits_bounded_parts_whatever_the_files(spark, tmp_path, monkeypatch):
    """The fit took a file's rows in one task; and the prices don't hang on how the rows lie in files."""
    from pyspark.ml.regression import GBTRegressor

    monkeypatch.setattr(batches, "FIT_ROWS", 500)
    seen, fit = [], GBTRegressor.fit

    def watched(self, rows, *more):
        seen.append(max(rows.rdd.glom().map(len).collect()))
        return fit(self, rows, *more)

    monkeypatch.setattr(GBTRegressor, "fit", watched)
    got = [sorted(map(tuple, model_queries.boosted_price(spark, _parts(spark, tmp_path / str(n), n)).collect())) for n in (1, 5)]
    assert max(seen) < 1000 and len(got[0]) == 800 and got[0] == got[1]
