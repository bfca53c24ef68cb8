"""Explainable reranking of a candidate pool by signals read from the query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.functions.replies import figures


def query_signals(queries: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """``query_id, category, concepts, tokens`` from the text of each query.

    ``aliases``: ``alias, category, ord``; the longest alias in the text names the category,
    the first in order on ties. ``concepts``: ``concept, term, category, ord``; a concept
    with a category counts only for queries of it. Both are small declared tables. Null
    texts have no signals.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    base = queries.select("query_id", text.alias("text"), F.col("text").alias("raw"))
    named = (
        base.join(F.broadcast(aliases), F.expr("contains(text, lower(alias))"))
        .groupBy("query_id")
        .agg(F.min_by("category", F.struct(-F.length("alias"), "ord")).alias("category"))
    )
    known = base.join(named, "query_id", "left")
    scoped = F.expr("contains(text, lower(term)) AND (scope IS NULL OR scope <=> category)")
    met = (
        known.join(F.broadcast(concepts.withColumnRenamed("category", "scope")), scoped)
        .groupBy("query_id", "concept").agg(F.min("ord").alias("ord"))
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "concept"))).alias("c"))
        .select("query_id", F.array_join("c.concept", ",").alias("concepts"))
    )
    return known.join(met, "query_id", "left").select(
        "query_id", "category", F.coalesce("concepts", F.lit("")).alias("concepts"), F.coalesce(F.array_join(figures(F.col("raw")), ","), F.lit("")).alias("tokens")
    )


def evidence(pairs: DataFrame) -> DataFrame:
    """Verdict per (query, item, concept): conflict beats support, else unknown.

    ``pairs``: ``query_id, item_id, concept, supports, conflicts`` (booleans, nulls count as
    false), several rows per triple allowed.
    """
    return pairs.groupBy("query_id", "item_id", "concept").agg(
        F.when(F.max(F.coalesce("conflicts", F.lit(False))), "conflict").when(F.max(F.coalesce("supports", F.lit(False))), "support").otherwise("unknown").alias("verdict")
    )


def rerank(candidates: DataFrame, depth: int, support_weight: float, conflict_weight: float) -> DataFrame:
    """Reorder the first ``depth`` candidates of each query; the tail keeps its order.

    ``candidates``: ``query_id, item_id, rank, score, same_category`` (null if the query
    names none), ``wanted, supported, conflicting`` (counts). The new score is the rounded
    similarity times a category factor (1 for the same or an unnamed category, else 0.4)
    plus the weighted share of supported minus that of conflicting concepts.
    """
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.nullif(F.col("wanted"), F.lit(0))), F.lit(0.0))
    factor = F.when(F.coalesce("same_category", F.lit(True)), 1.0).otherwise(0.4)
    score = F.round(F.col("score") * factor + support_weight * share("supported") - conflict_weight * share("conflicting"), 6)
    pooled = candidates.withColumn("in_pool", F.col("rank") <= depth).withColumn("new_score", F.when(F.col("in_pool"), score))
    order = W.partitionBy("query_id").orderBy(F.desc("in_pool"), F.desc_nulls_last("new_score"), "rank", "item_id")
    return pooled.withColumn("new_rank", F.row_number().over(order)).drop("in_pool")


def grid_search(candidates: DataFrame, grid: DataFrame, k: int, depth: int) -> DataFrame:
    """``support_weight, conflict_weight, precision`` for every row of the parameter grid, best first by ``place``.

    ``candidates`` also has ``grade``. The grid is a small declared table.
    """
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.nullif(F.col("wanted"), F.lit(0))), F.lit(0.0))
    tried = candidates.where(F.col("rank") <= depth).crossJoin(F.broadcast(grid))
    factor = F.when(F.coalesce("same_category", F.lit(True)), 1.0).otherwise(0.4)
    score = F.round(F.col("score") * factor + F.col("support_weight") * share("supported") - F.col("conflict_weight") * share("conflicting"), 6)
    params = ["support_weight", "conflict_weight"]
    order = W.partitionBy(*params, "query_id").orderBy(F.desc("s"), "rank", "item_id")
    per_query = (
        tried.withColumn("s", score).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        .groupBy(*params, "query_id").agg((F.count_if(F.col("grade") >= 1) / F.lit(float(k))).alias("p"))
    )
    scored = per_query.groupBy(*params).agg(F.round(F.avg("p"), 6).alias("precision"))
    return scored.withColumn("place", F.row_number().over(W.orderBy(F.desc("precision"), *params)))  # one row a parameter pair


def dispatch(image_rows: DataFrame, text_rows: DataFrame) -> DataFrame:
    """Image queries pass unchanged with a null new score; text queries come reranked."""
    passed = image_rows.select("query_id", "item_id", "rank", "score", F.lit(None).cast("double").alias("new_score"), F.col("rank").alias("new_rank"))
    return passed.withColumn("mode", F.lit("image")).unionByName(
        text_rows.select("query_id", "item_id", "rank", "score", "new_score", "new_rank").withColumn("mode", F.lit("text"))
    )


def category_factor(named: str, named_above: str, own: str, own_above: str) -> Column:
    """1 for the named category or none named, 0.7 for one under the same parent, else 0.4."""
    named_col, own_col = F.col(named), F.col(own)
    return (
        F.when(named_col.isNull() | F.coalesce(named_col == own_col, F.lit(False)), 1.0)
        .when(F.coalesce(F.col(named_above) == F.col(own_above), F.lit(False)), 0.7)
        .otherwise(0.4)
    )


def stated_evidence(candidates: DataFrame, constraints: DataFrame, stated: DataFrame) -> DataFrame:
    """``query_id, item_id, concept, supports, conflicts`` from what the candidates state of themselves.

    ``candidates``: ``query_id, item_id, product``; ``constraints``: ``query_id, concept, field, term``
    (a null field is a figure, which may stand anywhere and never conflicts); ``stated``:
    ``product, field, value``. A value equal to the term supports; other values of the field
    without it conflict; a candidate that states nothing of the field does neither.
    """
    wanted = candidates.join(constraints, "query_id")
    said = stated.where("value IS NOT NULL").select("product", F.col("field").alias("said_field"), "value").distinct()
    met = wanted.join(said, "product", "left")
    same = F.coalesce(F.col("value") == F.col("term"), F.lit(False))
    in_field = F.coalesce(F.col("said_field") == F.col("field"), F.lit(False))
    supports = F.max(same & (F.col("field").isNull() | in_field))
    return met.groupBy("query_id", "item_id", "concept").agg(supports.alias("supports"), F.max(in_field).alias("_says")).select(
        "query_id", "item_id", "concept", "supports", (F.col("_says") & ~F.col("supports")).alias("conflicts")
    )


def full_grid(candidates: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """Every ``depth, support_weight, conflict_weight`` of the grid with four metrics, best first by ``place``.

    Precision, recall within the pool, NDCG and reciprocal rank at ``k``, means over the queries
    with a relevant candidate; then the smaller weights and the smaller depth win. ``candidates``: ``query_id, item_id,
    rank, score, grade, same_category, wanted, supported, conflicting``; the grid is a small declared table.
    """
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.nullif(F.col("wanted"), F.lit(0))), F.lit(0.0))
    factor = F.when(F.coalesce("same_category", F.lit(True)), 1.0).otherwise(0.4)
    score = F.round(F.col("score") * factor + F.col("support_weight") * share("supported") - F.col("conflict_weight") * share("conflicting"), 6)
    params = ["depth", "support_weight", "conflict_weight"]
    tried = candidates.crossJoin(F.broadcast(grid)).withColumn("in_pool", F.col("rank") <= F.col("depth")).withColumn("s", F.when(F.col("in_pool"), score))
    place = F.row_number().over(W.partitionBy(*params, "query_id").orderBy(F.desc("in_pool"), F.desc_nulls_last("s"), "rank", "item_id"))
    best = F.row_number().over(W.partitionBy(*params, "query_id").orderBy(F.desc("grade")))
    ranked = tried.withColumn("r", place).withColumn("b", best)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    good = (F.col("grade") >= 1).cast("int")
    top = F.col("r") <= k
    per_query = ranked.groupBy(*params, "query_id").agg(
        (F.sum(F.when(top, good).otherwise(0)) / F.lit(float(k))).alias("p"), (F.sum(F.when(top, good).otherwise(0)) / F.nullif(F.sum(good), F.lit(0))).alias("rec"),
        (F.sum(F.when(top, gain / F.log2(F.col("r") + 1.0)).otherwise(0.0)) / F.nullif(F.sum(F.when(F.col("b") <= k, gain / F.log2(F.col("b") + 1.0)).otherwise(0.0)), F.lit(0.0))).alias("n"),
        F.max(F.when(top & (good == 1), 1.0 / F.col("r")).otherwise(0.0)).alias("m"), F.sum(good).alias("relevant"),
    ).where("relevant > 0")
    scored = per_query.groupBy(*params).agg(*[F.round(F.avg(a), 6).alias(b) for a, b in (("p", "precision"), ("rec", "recall"), ("n", "ndcg"), ("m", "mrr"))])
    order = W.orderBy(*[F.desc(c) for c in ("precision", "recall", "ndcg", "mrr")], "support_weight", "conflict_weight", "depth")  # one row a parameter set
    return scored.withColumn("place", F.row_number().over(order))
