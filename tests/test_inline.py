from pyspark.sql import functions as F

from reedmill.operators import inline


def test_reactive_lines(spark):
    df = inline.reactive_lines(spark, {"sky": ["a", "b", "c"], "sea": []}, 2)
    assert sorted(tuple(r) for r in df.collect()) == [("sky", 0, "a"), ("sky", 1, "b")]


def test_grid(spark):
    assert inline.grid(spark.range(3), temp=[0.0, 0.9], sample=[1, 2, 3]).distinct().count() == 18


def test_permutation_split(spark):
    out = inline.permutation_split(spark.range(200), "id", 0.1, 3)
    assert out.where("split = 'val'").count() == 20 and out.count() == 200
    assert inline.permutation_split(spark.range(3), "id", 0.1, 3).where(F.col("split") == "val").count() == 1
    assert inline.permutation_split(spark.range(0), "id", 0.1, 3).count() == 0
