from wareloom.functions import text


def test_ngrams_of_any_characters(spark):
    rows = ["a😀b😀c", "", "ab", None, "abc", "一二三四", "x\ny z"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r["g"] for r in df.select(text.ngrams(df.t, 3).alias("g")).collect()]
    assert got == [[t[i : i + 3] for i in range(len(t) - 2)] if t else [] for t in rows]


def test_ngrams_of_a_very_long_text(spark):
    df = spark.range(1).selectExpr("repeat('abcdefghij', 100000) AS t")
    assert df.selectExpr("length(t) AS n").head()["n"] - 9 == len(df.select(text.ngrams(df.t, 10).alias("g")).head()["g"])
