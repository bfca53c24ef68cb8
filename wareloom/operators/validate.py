"""Assertion queries: each gives the rows that break a rule, and no row when all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field`` for every null or blank required field."""
    blank = [F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*blank))).alias("field"))


def keys_in_several_splits(df: DataFrame, key: str, split: str) -> DataFrame:
    """``key, splits`` of keys that more than one split holds; null splits are none."""
    return (
        df.where(F.col(split).isNotNull() & F.col(key).isNotNull()).groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("_n"))
        .where("_n > 1").drop("_n")
    )


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys that only one of two tables holds; no row means equal sets."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("only_first"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("only_second"))
    return left.unionByName(right)


def in_several_zones(df: DataFrame, keys: Sequence[str], zone: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(zone).alias("zones")).where("zones > 1")


def outside_domain(df: DataFrame, key: str, field: str, domain: Sequence[str]) -> DataFrame:
    """``key, field value`` where the value is null or not in the domain."""
    return df.where(~F.coalesce(F.col(field).isin(*domain), F.lit(False))).select(key, field)


def broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for every rule a row breaks; a rule that is null counts as broken."""
    names = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*names))).alias("rule"))


def raise_if_any(violations: DataFrame, message: str) -> None:
    """Strict form of an assertion query: raises with one example."""
    row = violations.head()
    if row is not None:
        raise ValueError(f"{message}: {row.asDict()}")
