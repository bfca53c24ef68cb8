"""De-duplication on one or several keys, near pairs of bit hashes, leaks between splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.session import checkpoint


def greedy_multikey(df: DataFrame, ordinal: str, keys: Sequence[str]) -> DataFrame:
    """First row wins over several keys: ``ordinal, kept, reason``.

    A row is dropped if and only if it shares a key with a row already kept, and ``reason``
    is the first such key. This depends on the order, so dropping duplicates key by key is
    wrong. Each round keeps the rows that come first under all of their keys and drops those
    that share a key with them; a round costs one aggregation a key and no pairs. The first
    open row is always kept, so rounds end when nothing is open. Null keys match nothing.
    """
    rows = checkpoint(df.select(F.col(ordinal).alias("ordinal"), *[F.col(k).cast("string").alias(k) for k in keys]))
    left, winners, done = rows, rows.limit(0), 0
    while not left.isEmpty():
        # the first row of every key value that is still open
        firsts = left
        for key in keys:
            lead = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ordinal").alias(f"_first_{key}"))
            firsts = firsts.join(lead, key, "left")
        leads = reduce(lambda a, b: a & b, [F.col(k).isNull() | (F.col(f"_first_{k}") == F.col("ordinal")) for k in keys])
        marked = checkpoint(firsts.select("ordinal", *keys, leads.alias("kept")))
        kept = marked.where("kept").select("ordinal", *keys)
        winners = checkpoint(winners.unionByName(kept)) if done % 20 == 19 else winners.unionByName(kept)
        done += 1
        left = checkpoint(_clashes(marked.where("NOT kept").select("ordinal", *keys), kept, keys).where("reason IS NULL").select("ordinal", *keys))
    # a kept value is kept once, so these joins add no rows
    losers = _clashes(rows.join(winners.select("ordinal"), "ordinal", "left_anti"), winners, keys)
    return (
        winners.select(F.col("ordinal").alias(ordinal), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason"))
        .unionByName(losers.select(F.col("ordinal").alias(ordinal), F.lit(False).alias("kept"), "reason"))
    )


def _clashes(rows: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``reason``: the first key that an earlier kept row shares, or null."""
    for key in keys:
        taken = kept.where(F.col(key).isNotNull()).select(F.col(key), F.col("ordinal").alias(f"_kept_{key}"))
        rows = rows.join(taken, key, "left")
    return rows.select("ordinal", *keys, F.coalesce(*[F.when(F.col(f"_kept_{k}") < F.col("ordinal"), F.lit(k)) for k in keys]).alias("reason"))


def first_wins(df: DataFrame, signature: str, ordinal: str) -> DataFrame:
    """``kept`` ordinal of every signature and the number of rows that bear it."""
    return df.where(F.col(signature).isNotNull()).groupBy(signature).agg(F.min(ordinal).alias("kept"), F.count("*").alias("copies"))


def near_hash_pairs(df: DataFrame, group: str, key: str, bits: str, distance: int, width: int = 63) -> DataFrame:
    """Pairs of different hashes of a group within a Hamming distance, once each.

    ``group, id_a, id_b, distance, copies_a, copies_b``: ids are the smallest of all rows
    with the hash, so equal hashes cost nothing. Two hashes that differ in at most d bits
    agree on two of d + 2 bands at least; each pair of bands is a key, so a key has twice a
    band's bits and few hashes. A pair is told by the first two bands it agrees on, so it comes
    once, and it is checked in full.
    """
    folded = df.where(F.col(bits).isNotNull()).groupBy(group, bits).agg(F.min(key).alias("id"), F.count("*").alias("copies"))
    bands, step = distance + 2, -(-width // (distance + 2))
    masks = [(((1 << step) - 1) << (b * step)) & ((1 << 63) - 1) for b in range(bands)]
    pairs = [(x, y) for x in range(bands) for y in range(x + 1, bands)]
    keys = F.array(*[F.struct(F.lit(n).alias("no"), F.col(bits).bitwiseAND(F.lit(masks[x] | masks[y])).alias("value")) for n, (x, y) in enumerate(pairs)])
    cut = folded.withColumn("band", F.explode(keys))
    a, b = cut.alias("a"), cut.alias("b")
    unlike = F.col(f"a.{bits}").bitwiseXOR(F.col(f"b.{bits}"))
    apart = F.bit_count(unlike)
    # the bands below the second one of the key, but for its first, all differ
    earlier = F.element_at(F.array(*[F.array(*[F.lit(masks[m]) for m in range(y) if m != x]).cast("array<bigint>") for x, y in pairs]), F.col("a.band.no") + 1)
    first = F.forall(earlier, lambda m: unlike.bitwiseAND(m) != 0)
    return (
        a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")))
        .where((apart <= distance) & first)
        .select(F.col(f"a.{group}").alias(group), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), apart.alias("distance"),
                F.col("a.copies").alias("copies_a"), F.col("b.copies").alias("copies_b"))
    )


def repeated_groups(df: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """Groups of two or more rows: size, number of splits, whether all rows are frozen."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys])
    return (
        df.where(known).groupBy(*keys)
        .agg(F.count("*").alias("rows"), F.count_distinct(split).alias("splits"),
             F.coalesce(F.bool_and(F.col(split).isin("validation", "test")), F.lit(False)).alias("frozen_only"))
        .where("rows >= 2")
    )


def leak_evidence(df: DataFrame, keys: Sequence[str], key: str, split: str) -> DataFrame:
    """``train_id`` and the frozen rows of its group: how many, the first, and their splits.

    The frozen side is aggregated by group before the join, so no pairs arise.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys])
    frozen = (
        df.where(known & F.col(split).isin("validation", "test")).groupBy(*keys)
        .agg(F.count_distinct(key).alias("frozen_rows"), F.min(key).alias("first_frozen"),
             F.array_join(F.array_sort(F.collect_set(split)), ";").alias("frozen_splits"))
    )
    train = df.where(known & (F.col(split) == "train")).select(F.col(key).alias("train_id"), *keys).distinct()
    return train.join(frozen, list(keys)).select("train_id", *keys, "frozen_rows", "first_frozen", "frozen_splits")


def without_leaks(df: DataFrame, evidence: DataFrame, key: str, split: str) -> DataFrame:
    """The rows without the training rows that the evidence names; frozen rows all stay."""
    named = evidence.select(F.col("train_id").alias(key)).distinct()
    train, frozen = df.where(F.col(split) == "train"), df.where(~F.coalesce(F.col(split) == "train", F.lit(False)))
    return train.join(named, key, "left_anti").unionByName(frozen)


def ordered_values(df: DataFrame, keys: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """Distinct values of each group in order of first appearance, as one array."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(ordinal).alias("_at"))
    gathered = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_list"))
    return gathered.select(*keys, F.col(f"_list.{value}").alias("values"))


def smallest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each group: the first in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
