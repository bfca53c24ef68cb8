import pytest
from pyspark.sql import functions as F

from wareloom.operators import facts, paired


def test_one_to_one_contract(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    assert paired.join_one_to_one(a, b, "k").count() == 2
    for bad in (b.where("k = 1"), b.union(b)):
        with pytest.raises(ValueError):
            paired.join_one_to_one(a, bad, "k")


def test_variants_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", None), (2, "b", None), (3, "a", 1), (1, "a", 1), (1, "c", 9)], "k int, v string, n int")
    got = {r["k"]: (r["n_a"], r["n_b"], r["differs"]) for r in paired.pair_variants(df, "k", "v", "a", "b", ["n"]).collect()}
    assert got == {1: (1, 2, True), 2: (None, None, False)}


def test_text_and_map_projections(spark):
    row = spark.sql("SELECT ' a ' AS x, '' AS y, CAST(null AS string) AS z, map('m', array('No'), 'big型号', array('b'), '型号', array('a', 'c')) AS m").select(
        paired.joined_text(F.col("x"), F.col("y"), F.col("z")).alias("t"), paired.joined_text(F.col("y"), F.col("z")).alias("n"),
        paired.native_position(F.lit("xABc"), F.lit("bC")).alias("p"), paired.native_position(F.col("z"), F.lit("b")).alias("q"),
        F.map_keys(paired.active_entries(F.col("m"), ("no",))).alias("k"), paired.first_of_suffix(F.col("m"), "型号").alias("f"), paired.first_of_suffix(F.col("m"), "zzz").alias("g"),
    ).head()
    assert (row["t"], row["n"], row["p"], row["q"], sorted(row["k"]), row["f"], row["g"]) == ("a", None, 2, 1_000_000_000, ["big型号", "型号"], "a", None)


def test_value_shape(spark):
    df = spark.createDataFrame([("1.5kg",), ("0kg",), ("kg",), ("1.5kg x",), (None,)], "v string")
    assert [r[0] for r in df.select(facts.value_shape(F.col("v"), r"[0-9.]*kg")).collect()] == [True, False, True, False, False]
