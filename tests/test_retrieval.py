import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareloom.functions import vectors as V
from wareloom.operators import rerank, retrieval


@pytest.mark.parametrize("block_values", [8_000_000, 20])
def test_top_k_matches_numpy_with_ties_and_bad_vectors(spark, monkeypatch, block_values):
    monkeypatch.setattr(retrieval, "BROADCAST_VALUES", block_values)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((60, 8)).astype(float)
    vectors[7] = vectors[3]
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(vectors)] + [(100, None, ""), (101, [0.0] * 8, ""), (102, [1.0] * 3, ""), (103, [float("nan")] * 8, "")]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, score string")
    got = {}
    for r in retrieval.exact_top_k(df.where("id % 10 = 0 OR id > 99"), df, 5, dim=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:5]
        assert [i for _, i in sorted(got[q])] == order
    assert set(got) == set(range(0, 60, 10))


def model(ranking, ideal, k):
    gain, hits = lambda g: 2**g - 1, sum(g >= 1 for g in ranking[:k])
    idcg = sum(gain(g) / math.log2(i + 2) for i, g in enumerate(sorted(ideal, reverse=True)[:k]))
    return (
        hits / k, hits / sum(g >= 1 for g in ideal), next((1 / (i + 1) for i, g in enumerate(ranking[:k]) if g >= 1), 0.0),
        sum(gain(g) / math.log2(i + 2) for i, g in enumerate(ranking[:k])) / idcg,
    )


def test_metrics_match_model(spark):
    rng = random.Random(2)
    lists = {q: [rng.choice([0, 0, 1, 2]) for _ in range(rng.randrange(2, 9))] for q in range(12)}
    lists[99] = [0, 0, 0]
    df = spark.createDataFrame([(q, i + 1, g) for q, gs in lists.items() for i, g in enumerate(gs)], "query_id bigint, rank int, grade int")
    got = {r["query_id"]: r for r in retrieval.ranking_metrics(df, df.select("query_id", "grade"), 4).collect()}
    for q, grades in lists.items():
        if not any(grades):
            assert q not in got
            continue
        want = model(grades, grades, 4)
        assert [got[q][m] for m in ("precision", "recall", "mrr", "ndcg")] == pytest.approx(want, abs=1e-6)
    assert retrieval.contiguous_ranks(df).count() == 0
    assert retrieval.contiguous_ranks(df.where("rank <> 1")).count() > 0


def test_fusion_and_breakdown(spark):
    df = spark.createDataFrame([("r", "x", "a", 1), ("r", "x", "b", 3), ("r", "y", "a", 2), ("r", "z", "b", 1)], "rec string, item string, list string, rank int")
    got = {r["item"]: (r["fused"], r["position"]) for r in retrieval.reciprocal_rank_fusion(df, "rec", "item").collect()}
    assert got["x"] == (round(1 / 61 + 1 / 63, 12), 1) and got["z"] == (round(1 / 61, 12), 2) and got["y"][1] == 3
    per = spark.createDataFrame([(1, "a", None, 0.5), (2, "b", "x", 1.0)], "query_id bigint, l1 string, l2 string, m double")
    rows = {(r["level"], r["value"]): r["m"] for r in retrieval.breakdown(per, ["l1", "l2"], ["m"]).collect()}
    assert rows == {("overall", "all"): 0.75, ("l1", "a"): 0.5, ("l1", "b"): 1.0, ("l2", None): 0.5, ("l2", "x"): 1.0}


def test_rerank_promotes_inside_the_pool_only(spark):
    rows = [("q", f"p{i}", i, round(1 - i / 100, 6), None, 1, int(i in (11, 14)), 0) for i in range(1, 16)]
    df = spark.createDataFrame(rows, "query_id string, item_id string, rank int, score double, same_category boolean, wanted int, supported int, conflicting int")
    order = [r["item_id"] for r in rerank.rerank(df, 12, 0.24, 0.12).orderBy("new_rank").collect()]
    assert order[0] == "p11" and order[12:] == ["p13", "p14", "p15"]
    zero = rerank.rerank(df.withColumn("wanted", F.lit(0)), 12, 0.24, 0.12).orderBy("new_rank").collect()
    assert [r["item_id"] for r in zero] == [f"p{i}" for i in range(1, 16)]


def test_signals_longest_alias_scoped_concepts_null_text(spark):
    aliases = spark.createDataFrame([("灯", "其他", 1), ("台灯", "灯具", 2)], "alias string, category string, ord int")
    concepts = spark.createDataFrame([("wood", "实木", "灯具", 2), ("steel", "实木", "水壶", 1), ("quiet", "静音", None, 3)], "concept string, term string, category string, ord int")
    asked = spark.createDataFrame([(1, "12W实木静音台灯"), (2, None), (3, "静音")], "query_id bigint, text string")
    got = {r["query_id"]: (r["category"], r["concepts"], r["tokens"]) for r in rerank.query_signals(asked, aliases, concepts).collect()}
    assert got == {1: ("灯具", "wood,quiet", "12w"), 2: (None, "", ""), 3: (None, "quiet", "")}


def test_fuse_checks_weights(spark):
    with pytest.raises(ValueError):
        V.fuse([F.col("a")], [-1.0])


def shuffled_rows(df):
    """Rows written to shuffles by the plan that ran."""
    seen, total, left = set(), 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().get("shuffleRecordsWritten").get().value()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        left += inner
    return total


def judged(queries, items):
    out = []
    for name in {q[0] for q in queries}:
        met = [(i[2], i[0]) for q in queries if q[0] == name for i in items if None not in (q[1], q[2], i[1], i[2]) and q[1] == i[1] and q[2] != i[2]]
        out += [(name, item, product, place) for place, (product, item) in enumerate(sorted(met), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 8_192])
def test_category_judgments_against_a_model(spark, block):
    rng = random.Random(3)
    items = [(i, rng.choice(["a", "b", "b", "b", None]), rng.choice(["p1", "p2", "p3", "P1", None])) for i in range(40)] + [(41, "b", "p2"), (41, "b", "p2")]
    queries = [(1, "a", "p1"), (2, "b", "p2"), (3, "b", ""), (4, None, "p1"), (5, "a", None), (6, "b", "p9"), (7, "c", "p1"),
               (8, "b", "p1"), (8, "b", "p1"), (9, "b", "p3"), (9, "a", "p1"), (9, "a", "p1"), (None, "b", "p1"), (None, "a", "p1")]
    found = retrieval.category_judgments(
        spark.createDataFrame(queries, "query_id long, category string, own string"), spark.createDataFrame(items, "item_id long, category string, product_id string"), block
    )
    assert found.schema["place"].dataType.simpleString() == "int"
    assert sorted(map(tuple, found.collect()), key=str) == judged(queries, items)


def test_category_judgments_shuffle_no_pairs(spark):
    queries = spark.range(300).selectExpr("id AS query_id", "'b' AS category", "concat('p', id % 50) AS own")
    items = spark.range(400).selectExpr("id AS item_id", "'b' AS category", "concat('p', id % 100) AS product_id")
    found = retrieval.category_judgments(queries, items)
    assert len(found.collect()) == 300 * 396
    assert shuffled_rows(found) < 10_000
