"""Deterministic samples, splits and blind assignments by hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.functions.hashing import hash_rank, seed31
from wareloom.operators.positions import first_per_group, hash_positions


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42, namespace: str = "sample") -> DataFrame:
    """The first ``n`` rows of each group by hash rank; groups with fewer give all they have."""
    ranked = df.withColumn("hash", hash_rank(namespace, seed, F.col(key).cast("string")))
    return first_per_group(ranked, [group], ["hash", key], n).drop("hash")


def stratified_split(df: DataFrame, group: str, key: str, train: float = 0.8, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: per group, floors of the shares for training and validation, the rest for test."""
    ranked = hash_positions(df.withColumn("hash", hash_rank("split", seed, F.col(key).cast("string"))), [group], "hash", key)
    n_train, n_validation = F.floor(F.col("group_size") * F.lit(train)), F.floor(F.col("group_size") * F.lit(validation))
    split = (
        F.when(F.col("position") <= n_train, "train")
        .when(F.col("position") <= n_train + n_validation, "validation")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("hash")


def holdout_split(df: DataFrame, group: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Add ``split``: per group the rounded share, one row at least, is validation."""
    rank = hash_rank("holdout", seed, F.coalesce(F.col(group).cast("string"), F.lit("")), F.col(key).cast("string"))
    ranked = hash_positions(df.withColumn("hash", rank), [group], "hash", key)
    n = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(share) + 0.5))
    return ranked.withColumn("split", F.when(F.col("position") <= n, "validation").otherwise("train")).drop("hash")


def quota_selection(df: DataFrame, quotas: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """``quota`` rows of each group of the quota table by hash rank; ``short`` marks groups that lack rows."""
    top = quotas.agg(F.max("quota")).head()[0] or 0
    ranked = first_per_group(df.withColumn("hash", hash_rank("quota", seed, F.col(key).cast("string"))), [group], ["hash", key], top)
    chosen = ranked.join(F.broadcast(quotas), group).where("rank <= quota").drop("hash")
    return chosen.withColumn("short", F.count("*").over(W.partitionBy(group)) < F.col("quota"))


def replace_selected(selected: DataFrame, replacements: DataFrame, key: str, group: str) -> DataFrame:
    """Swap selected keys by a map ``old, new, new_group``; rows keep their position.

    A replacement counts only within its group and if its target is neither selected
    already nor the target of two replacements; other rows stay.
    """
    free = replacements.join(selected.select(F.col(key).alias("new")), "new", "left_anti")
    unique = free.withColumn("_uses", F.count("*").over(W.partitionBy("new"))).where("_uses = 1").drop("_uses")
    joined = selected.join(unique, (selected[key] == unique["old"]) & (selected[group] == unique["new_group"]), "left")
    return joined.select(*[F.coalesce("new", key).alias(key) if c == key else selected[c] for c in selected.columns], F.col("new").isNotNull().alias("replaced"))


def round_robin(df: DataFrame, outer: str, inner: str, order: list[str | Column], limit: int) -> DataFrame:
    """The first row of each inner group, then one of each outer group in turn, up to ``limit``."""
    firsts = first_per_group(df, [outer, inner], order, 1).drop("rank")
    turn = F.row_number().over(W.partitionBy(outer).orderBy(inner))
    return firsts.withColumn("turn", turn).orderBy("turn", outer).limit(limit)


def blind_assignment(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``left_is`` (``A`` for half of the rows) and ``pair_id``, a number in an order of its own."""
    halves = hash_positions(df.withColumn("hash", hash_rank("blind", seed, F.col(key).cast("string"))), [], "hash", key)
    assigned = halves.withColumn("left_is", F.when(F.col("position") <= F.floor(F.col("group_size") / 2), "A").otherwise("B")).drop("hash", "position", "group_size")
    ordered = hash_positions(assigned.withColumn("hash", hash_rank("order", seed, F.col(key).cast("string"))), [], "hash", key)
    return ordered.withColumn("pair_id", F.concat(F.lit("P"), F.lpad(F.col("position").cast("string"), 7, "0"))).drop("hash", "position", "group_size")


def balanced_assignment(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """Add ``left_is``: half of every group is ``A``; groups of odd size take the odd row in turn."""
    ranked = hash_positions(df.withColumn("hash", hash_rank("balance", seed, F.col(key).cast("string"))), [group], "hash", key).drop("hash")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    odd = sizes.where("_n % 2 = 1").withColumn("_turn", F.row_number().over(W.orderBy(hash_rank("odd", seed, F.col(group)), group)))  # one row a group
    quotas = sizes.join(odd.select(group, "_turn"), group, "left").select(group, (F.floor(F.col("_n") / 2) + F.coalesce(F.col("_turn") % 2, F.lit(0))).alias("_quota"))
    return ranked.join(quotas, group).withColumn("left_is", F.when(F.col("position") <= F.col("_quota"), "A").otherwise("B")).drop("_quota", "position", "group_size")


def paired_seeds(df: DataFrame, *parts: str, base: int = 42) -> DataFrame:
    """Add ``seed``: the same for both variants of a sample, from the sample's own fields."""
    return df.withColumn("seed", seed31("seed", base, *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def epoch_groups(df: DataFrame, key: str, epoch: int, size: int, seed: int = 42) -> DataFrame:
    """A seeded order for one epoch and groups of ``size`` rows; the last may be smaller."""
    ranked = hash_positions(df.withColumn("hash", hash_rank("epoch", seed, epoch, F.col(key).cast("string"))), [], "hash", key)
    return ranked.withColumn("step", F.floor((F.col("position") - 1) / size)).drop("hash", "group_size")
