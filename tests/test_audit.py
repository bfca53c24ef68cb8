import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wareloom.operators import audit, claims, facts

USAGE, PRAISE = "(?:适合|用于)([^，。]+)", "舒适|大容量"


def test_first_reason_and_null_rules(spark):
    rows = spark.createDataFrame([(1, None), (2, 0), (3, 9)], "id int, v int")
    got = rows.select("id", audit.first_reason([("zero", F.col("v") == 0), ("big", F.col("v") > 5)], "kept").alias("r"))
    assert {r["id"]: r["r"] for r in got.collect()} == {1: "kept", 2: "zero", 3: "big"}
    assert rows.select(audit.first_reason([], "kept").alias("r")).head()["r"] == "kept"


def test_values_runs_and_strict_forms(spark):
    rows = spark.createDataFrame([(1, ["ABS"]), (2, ["abs", "12g"]), (3, []), (4, None), (5, ["abs", "红"])], "id int, v array<string>")
    every = {r["id"]: r["x"] for r in rows.select("id", audit.every_value(F.col("v"), ("abs",), "[0-9]+g").alias("x")).collect()}
    assert every == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert {r["id"] for r in rows.where(audit.any_value_in(F.col("v"), ("ABS", "红"))).collect()} == {1, 5}
    run = lambda a, b: spark.range(1).select(audit.contains_run(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")).alias("x")).head()["x"]
    assert run("abc", "bc") and run("abc", "") and not run("abc", "ac") and not run(["ab"], ["a"])
    assert [r["x"] for r in spark.createDataFrame([("12",), (" 12",), ("1.0",), (None,)], "v string").select(audit.strict(F.col("v"), "[0-9]+").alias("x")).collect()] == ["12", None, None, None]


def test_worst_cases_break_ties_by_key(spark):
    rows = spark.createDataFrame([("a", i, i % 2, None if i == 3 else 1) for i in range(6)] + [("b", 9, 0, 0)], "g string, id int, errors int, missed int")
    got = audit.worst_cases(rows, ["g"], ["errors", "missed"], "id", 2).collect()
    assert sorted((r["g"], r["place"], r["id"]) for r in got) == [("a", 1, 1), ("a", 2, 5), ("b", 1, 9)]


def test_same_order_over_many_bins_and_empty(spark):
    a = spark.range(0, 20000, 3).select(F.col("id").alias("k"), F.col("id").alias("o"))
    assert audit.same_order(a, a, "k", "o", "o").count() == 0
    b = a.withColumn("k", F.when(F.col("o") == 9999, -1).otherwise(F.col("k")))
    assert [tuple(r) for r in audit.same_order(a, b, "k", "o", "o").collect()] == [(3334, 9999, -1)]
    assert audit.same_order(a.limit(0), a.limit(0), "k", "o", "o").count() == 0


def test_guard_fails_on_negative_and_missing(spark):
    rows = spark.createDataFrame([(0.5,), (0.0,)], "s double")
    assert audit.require_not_negative(rows, "s").count() == 2 and {r["s"] for r in audit.require_not_negative(rows, "s").collect()} == {0.5, 0.0}
    for bad in (-0.1, None):
        with pytest.raises(PySparkException):
            audit.require_not_negative(spark.createDataFrame([(bad,)], "s double"), "s").collect()


def test_claims(spark):
    texts = spark.createDataFrame(
        [(1, "t", "适合露营，大容量，不支持静音，30度以上使用"), (2, "t", "适合卧室床头使用，舒适。"), (3, "t", None), (4, "t", ""), (1, "t", "适合露营，大容量，不支持静音，30度以上使用")], "text_id int, part string, text string"
    ).withColumn("value", F.lit("clash"))
    known = spark.createDataFrame([(1, "功能", "静音"), (1, "温度", "30度以下"), (2, "场景", "卧室 床头"), (2, "说明", "舒适手感"), (2, "x", None)], "text_id int, field string, value string")
    got = {(r["text_id"], r["class"], r["span"]) for r in claims.claim_findings(texts, known, USAGE, ("场景",), PRAISE, ("不支持",), (("以下", "以上"),)).collect()}
    assert got == {(1, "unsupported_usage", "露营"), (1, "unsupported_praise", "大容量"), (1, "denied_fact", "不支持静音"), (1, "turned_direction", "30度以上")}
    assert claims.claim_findings(texts.limit(0), known, USAGE, (), PRAISE, ("无",), (("以下", "以上"),)).count() == 0


def test_marks_in_any_packing_and_spelling(spark):
    policy = spark.createDataFrame([("牌子", "品牌"), ("品牌", "品牌")], "name string, field string")
    rows = spark.createDataFrame([(1, '["牌子", "电压/频率"]', "CONFLICT"), (2, "「品牌」；颜色", "REVIEW"), (3, " ", "PASS"), (4, None, "REVIEW")], "record_id int, blocked_fields string, status string")
    got = {(r["record_id"], r["field"], r["status"]) for r in facts.audit_marks(rows, policy).collect()}
    assert got == {(1, "品牌", "CONFLICT"), (1, "电压/频率", "CONFLICT"), (2, "品牌", "REVIEW"), (2, "颜色", "REVIEW")}


def test_image_metadata(spark):
    rows = [(800, 600, "JPEG", 9000), (63, 600, "jpeg", 1), (9000, 9000, "png", 1), (800, 600, "gif", 1), (800, 600, "png", 20 << 20), (None, 600, "png", 1), (800, 600, "png", 0)]
    df = spark.createDataFrame(rows, "w int, h int, k string, s int").coalesce(1)
    got = [r["x"] for r in df.select(audit.image_issue(df.w, df.h, df.k, df.s, ("jpeg", "png", "webp")).alias("x")).collect()]
    assert got == [None, "too_small", "too_many_pixels", "format", "size", "unknown", "size"]
