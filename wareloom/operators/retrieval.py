"""Exact vector search and graded retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.functions import vectors as V

#: Most query values (rows x dimensions) to broadcast.
BROADCAST_VALUES = 8_000_000
#: Rows of either side of a block of pairs.
PAIR_BLOCK = 8_192


def exact_top_k(queries: DataFrame, gallery: DataFrame, k: int, dim: int = 64, exclude_self: bool = True) -> DataFrame:
    """``query_id, item_id, score, rank``: the ``k`` best of the gallery for each query.

    Both sides have ``id, embedding``. Scores are cosines rounded to 6 decimals, ties go to
    the smaller id. The stated query set is compared with all gallery rows in blocks of at
    most ``BROADCAST_VALUES`` numbers, one pass over the gallery a block, as products of
    matrices; each batch of the gallery keeps its own best rows before the shuffle. Unusable vectors of either side
    take no part.
    """
    def sound(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(name), V.doubles(F.col("embedding")).alias("v")).where(V.usable(F.col("v"), dim))

    asked, stored = sound(queries, "query_id"), sound(gallery, "item_id")
    blocks = max(1, -(-asked.count() * dim // BROADCAST_VALUES))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    id_types = [df.schema["id"].dataType.simpleString() for df in (queries, gallery)]

    def unit(rows) -> np.ndarray:
        values = np.vstack(rows).astype(np.float64)
        return values / np.sqrt((values * values).sum(axis=1, keepdims=True))

    def search(part: DataFrame) -> DataFrame:
        block = part.collect()  # at most BROADCAST_VALUES numbers
        ids = np.array([r["query_id"] for r in block])
        shared = part.sparkSession.sparkContext.broadcast((ids, unit([r["v"] for r in block]) if block else np.zeros((0, dim))))

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, wanted = shared.value
            for batch in batches:
                if not len(batch) or not len(own):
                    continue
                batch = batch.sort_values("item_id", kind="stable")  # ties then fall to the smaller id
                items, vectors = batch["item_id"].to_numpy(), unit(batch["v"])
                for start in range(0, len(own), 256):
                    names = own[start : start + 256]
                    scores = np.round(wanted[start : start + 256] @ vectors.T, 6)
                    if exclude_self:
                        scores[names[:, None] == items[None, :]] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    rows = np.repeat(np.arange(len(names)), best.shape[1])
                    found = scores[rows, best.ravel()]
                    kept = found > -np.inf
                    yield pd.DataFrame({"query_id": names[rows][kept], "item_id": items[best.ravel()][kept], "score": found[kept] + 0.0})

        near = stored.mapInPandas(compare, f"query_id {id_types[0]}, item_id {id_types[1]}, score double")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = search(asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == 0))
    for block_no in range(1, blocks):
        found = found.unionByName(search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block_no)))
    return found


def category_judgments(queries: DataFrame, items: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """``query_id, item_id, product_id, place``: all items of a query's category but those of its own product, numbered.

    ``queries``: ``query_id, category, own``; ``items``: ``item_id, category, product_id``. Places
    follow product and item. The items are numbered once a category; a place is that number less
    the items of the own product before it, which stand together, so no pair is sorted or
    shuffled. Both sides are cut into blocks, so no category can swell a task. Equal rows of one
    query take places side by side; only queries that stand for several categories or products are
    numbered pair by pair.
    """
    items = items.where("category IS NOT NULL AND product_id IS NOT NULL")
    asked = queries.where("category IS NOT NULL AND own IS NOT NULL").groupBy("query_id", "category", "own").agg(F.count("*").alias("copies"))
    asked = asked.withColumn("meanings", F.count("*").over(W.partitionBy("query_id")))
    numbered = items.withColumn("number", F.row_number().over(W.partitionBy("category").orderBy("product_id", "item_id")))
    own = numbered.groupBy("category", F.col("product_id").alias("own")).agg(F.min("number").alias("first"), F.max("number").alias("last"))
    single = asked.where("meanings = 1").drop("meanings").join(own, ["category", "own"], "left")

    blocks = lambda df, name: df.groupBy("category").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    cells = blocks(items, "across").join(blocks(asked, "down"), "category")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("query_id", "own"), F.col(n)).cast("int")
    at, parts = ["category", "x", "y"], int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a few small rows make many pairs: the number of tasks must not follow their size
    left = single.join(cells, "category").select("query_id", "copies", "first", "last", "category", part("down").alias("y"), every("across").alias("x")).repartition(parts, *at)
    right = numbered.join(cells, "category").select("item_id", "product_id", "number", "category", ((F.col("number") - 1) / block).cast("int").alias("x"), every("down").alias("y")).repartition(parts, *at)
    place = F.col("number") - F.when(F.col("number") > F.col("last"), F.col("last") - F.col("first") + 1).otherwise(0)
    once = left.join(right, at).where("first IS NULL OR number < first OR number > last").select("query_id", "item_id", "product_id", place.alias("n"), "copies")
    beside = F.sequence((F.col("n") - 1) * F.col("copies") + 1, F.col("n") * F.col("copies"))
    columns = ["query_id", "item_id", "product_id"]
    plain = once.where("copies = 1").select(*columns, F.col("n").cast("int").alias("place"))
    repeated = once.where("copies > 1").select(*columns, F.explode(beside.cast("array<int>")).alias("place"))

    order = F.row_number().over(W.partitionBy("query_id").orderBy("product_id", "item_id"))
    mixed = asked.where("meanings > 1").join(items, "category").where("product_id <> own").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return plain.unionByName(repeated).unionByName(mixed.select(*columns, order.alias("place")))


def ranking_metrics(ranking: DataFrame, ideal: DataFrame, k: int, relevant: int = 1) -> DataFrame:
    """Per-query precision, recall, reciprocal rank and NDCG at ``k``, rounded to 6 decimals.

    ``ideal`` may also hold ``n``, the number of judgments of a grade: the ideal order then
    follows from the counts, and no judgment is spelt out or ranked.

    ``ranking``: ``query_id, rank, grade`` (unjudged rows have grade 0). ``ideal``:
    ``query_id, grade`` of everything that recall and the ideal order are taken from: the
    ranking's own pool, or all judgments. Precision divides by ``k`` even where fewer rows
    were returned. Queries without relevant rows in ``ideal`` give no row.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    discount = F.log2(F.col("rank") + 1.0)
    hit = (F.col("grade") >= relevant).cast("int")
    seen = ranking.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum(hit).alias("hits"),
        F.max(F.when(F.col("grade") >= relevant, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"),
        F.sum(gain / discount).alias("dcg"),
    )
    counted = ideal if "n" in ideal.columns else ideal.withColumn("n", F.lit(1))
    # one row a grade: its judgments take the places after those of all higher grades
    grades = counted.groupBy("query_id", "grade").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda p: F.when((p > F.col("above")) & (p <= F.col("above") + F.col("n")), 1.0 / F.log2(p + 1.0)).otherwise(0.0))
    best = (
        grades.withColumn("above", above)
        .groupBy("query_id")
        .agg(F.sum(F.when(F.col("grade") >= relevant, F.col("n")).otherwise(0)).alias("relevant"), F.sum(gain * F.aggregate(places, F.lit(0.0), lambda s, x: s + x)).alias("idcg"))
        .where("relevant > 0")
    )
    joined = best.join(seen, "query_id", "left").fillna({"hits": 0, "rr": 0.0, "dcg": 0.0})
    return joined.select(
        "query_id",
        F.round(F.col("hits") / F.lit(float(k)), 6).alias("precision"),
        F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"),
        F.round("rr", 6).alias("mrr"),
        F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"),
    )


def breakdown(per_query: DataFrame, levels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Macro means over all queries and over each level: ``level, value, queries, metrics``."""
    sets = [[], *[[level] for level in levels]]
    flat = per_query.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in levels]).agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in metrics]
    )
    n = len(levels)
    level = F.when(F.col("_gid") == (1 << n) - 1, "overall")
    value = F.lit("all")
    for i, name in enumerate(levels):
        only = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        level = level.when(F.col("_gid") == only, name)
        value = F.when(F.col("_gid") == only, F.col(name)).otherwise(value)
    return flat.select(level.alias("level"), value.alias("value"), "queries", *metrics)


def grade_histogram(judged: DataFrame) -> DataFrame:
    """``query_id, histogram``: counts by grade as ``grade:count`` in grade order."""
    counts = judged.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    return counts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("grade", "n"))).alias("h")).select(
        "query_id", F.array_join(F.transform("h", lambda x: F.concat(x["grade"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("histogram")
    )


def contiguous_ranks(ranking: DataFrame) -> DataFrame:
    """Queries whose ranks are not exactly 1..n: an assertion that should give no row."""
    return (
        ranking.groupBy("query_id")
        .agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"), F.count_distinct("rank").alias("d"))
        .where("lo <> 1 OR hi <> n OR d <> n")
    )


def reciprocal_rank_fusion(rankings: DataFrame, group: str, item: str, constant: int = 60) -> DataFrame:
    """Fuse several rankings (``list, rank``) of a group's items: ``group, item, fused, rank_sum, position``.

    The score is the sum of 1 / (constant + rank) rounded to 12 decimals; ties go to the
    smaller rank sum and then to the smaller item. An item missing from a list adds nothing.
    """
    fused = rankings.groupBy(group, item).agg(
        F.round(F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))), 12).alias("fused"), F.sum("rank").alias("rank_sum")
    )
    order = W.partitionBy(group).orderBy(F.desc("fused"), "rank_sum", item)
    return fused.withColumn("position", F.row_number().over(order))
