import pytest
from pyspark.sql import functions as F

from wareloom.operators import rerank


def test_evidence_from_what_is_stated(spark):
    candidates = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (1, 12, "c"), (2, 10, None)], "query_id int, item_id int, product string").withColumn("value", F.lit("clash"))
    constraints = spark.createDataFrame([(1, "wood", "材质", "实木"), (1, "800ml", None, "800ml"), (3, "x", None, "x")], "query_id int, concept string, field string, term string")
    stated = spark.createDataFrame([("a", "材质", "实木"), ("a", "容量", "800ml"), ("b", "材质", "abs"), ("b", "材质", "abs"), ("b", "颜色", "实木"), ("b", "x", None)], "product string, field string, value string")
    got = {(r["query_id"], r["item_id"], r["concept"]): (r["supports"], r["conflicts"]) for r in rerank.stated_evidence(candidates.drop("value"), constraints, stated).collect()}
    assert got == {
        (1, 10, "wood"): (True, False), (1, 10, "800ml"): (True, False), (1, 11, "wood"): (False, True), (1, 11, "800ml"): (False, False), (1, 12, "wood"): (False, False), (1, 12, "800ml"): (False, False),
    }
    assert rerank.stated_evidence(candidates.drop("value").limit(0), constraints, stated).count() == 0


def test_category_factor(spark):
    rows = spark.createDataFrame([(None, None, "灯", "家"), ("灯", "家", "灯", "家"), ("壶", "家", "灯", "家"), ("壶", "厨", "灯", "家"), ("壶", None, None, None)], "n string, na string, o string, oa string")
    assert [r["f"] for r in rows.select(rerank.category_factor("n", "na", "o", "oa").alias("f")).collect()] == [1.0, 1.0, 0.7, 0.4, 0.4]


def test_full_grid_prefers_metrics_then_small_parameters(spark):
    rows = [(1, 1, 1, 0.9, 0, True, 2, 0, 2), (1, 2, 2, 0.8, 2, True, 2, 2, 0), (1, 3, 3, 0.7, 1, None, 0, 0, 0), (2, 1, 1, 0.5, 0, True, 1, 0, 0)]
    candidates = spark.createDataFrame(rows, "query_id int, item_id int, rank int, score double, grade int, same_category boolean, wanted int, supported int, conflicting int")
    grid = spark.createDataFrame([(2, 0.0, 0.0), (2, 0.2, 0.0), (2, 0.0, 0.2), (1, 0.2, 0.2)], "depth int, support_weight double, conflict_weight double")
    got = {(r["depth"], r["support_weight"], r["conflict_weight"]): r for r in rerank.full_grid(candidates, grid, 1).collect()}
    # query 2 has nothing relevant and counts nowhere
    assert got[(2, 0.2, 0.0)]["precision"] == got[(2, 0.0, 0.2)]["mrr"] == 1.0 and got[(2, 0.0, 0.0)]["precision"] == 0.0 == got[(1, 0.2, 0.2)]["ndcg"]
    assert got[(2, 0.0, 0.2)]["place"] == 1 and got[(2, 0.2, 0.0)]["place"] == 2 and got[(2, 0.2, 0.0)]["recall"] == pytest.approx(0.5)
