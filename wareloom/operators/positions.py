"""Ranks over groups of any size.

A window over a whole group puts the group into one task. Here the order is by a hash, so
rows can be binned by the hash's leading digits: a row's position is the number of rows in
earlier bins plus its position in its own bin. Only counts per bin are ranked group-wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_positions(df: DataFrame, groups: Sequence[str], rank: str, tie: str, digits: int = 3) -> DataFrame:
    """Add ``position`` (from 1) and ``group_size``; ``rank`` holds hexadecimal hashes.

    Null group keys form a group of their own. An empty input stays empty.
    """
    keyed = df.withColumn("_bin", F.substring(rank, 1, digits)).withColumn("_group", F.to_json(F.struct(*groups)) if groups else F.lit(""))
    counts = keyed.groupBy("_group", "_bin").agg(F.count("*").alias("_n"))
    by_group = W.partitionBy("_group")
    placed = counts.select(
        "_group", "_bin",
        F.coalesce(F.sum("_n").over(by_group.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("group_size"),
    )
    inside = F.row_number().over(W.partitionBy("_group", "_bin").orderBy(rank, tie))
    return (
        keyed.withColumn("_inside", inside).join(placed, ["_group", "_bin"])
        .withColumn("position", F.col("_before") + F.col("_inside")).drop("_group", "_bin", "_before", "_inside")
    )


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; groups are cut down before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, tuple[float, bool]], bins: int = 256) -> DataFrame:
    """``groups`` and one column a wanted quantile: ``name -> (share, interpolated)``; nearest rank if not interpolated.

    Exact for groups of any size: equal values are counted first, the distinct ones are cut
    into bins at approximate quantiles of the group, and only counts per bin are ranked
    group-wide. Null values are left out; a group without values gives no row. Null group keys
    form a group of their own.
    """
    key = F.to_json(F.struct(*groups)) if groups else F.lit("")
    counted = df.where(F.col(value).isNotNull()).groupBy(key.alias("_group"), *groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    edges = counted.groupBy("_group").agg(F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10_000).alias("_edges"), F.sum("_n").alias("_total"))
    binned = counted.join(edges, "_group").withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    per_bin = binned.groupBy("_group", "_bin").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy("_group").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_n").over(W.partitionBy("_group", "_bin").orderBy("_v"))
    placed = binned.withColumn("_inside", inside).join(per_bin.select("_group", "_bin", before.alias("_before")), ["_group", "_bin"]).withColumn("_upto", F.col("_before") + F.col("_inside"))

    def at(rank: Column) -> Column:
        """The value that stands at a rank counted from 1."""
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_v")))

    total, out = F.col("_total"), []
    for name, (share, interpolated) in wanted.items():
        if interpolated:
            place = (total - 1) * F.lit(share)
            part = F.max(place - F.floor(place))
            out.append((at(F.floor(place) + 1) * (1 - part) + at(F.ceil(place) + 1) * part).alias(name))
        else:
            out.append(at(F.greatest(F.lit(1), F.ceil(total * F.lit(share)))).alias(name))
    return placed.groupBy("_group", *groups).agg(*out).drop("_group")
