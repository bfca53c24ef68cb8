"""Strict and paired joins, and projections of text and map columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.operators.validate import raise_if_any, repeated_keys, set_difference


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join that first proves both sides to hold the same keys, once each."""
    raise_if_any(repeated_keys(a, [key]), "repeated key on the first side")
    raise_if_any(repeated_keys(b, [key]), "repeated key on the second side")
    raise_if_any(set_difference(a, b, key), "keys differ")
    return a.join(b, key)


def pair_variants(df: DataFrame, key: str, variant: str, a: str, b: str, fields: Sequence[str]) -> DataFrame:
    """``key``, each field of both variants as ``field_a, field_b``, and ``differs``.

    One shuffle: both variants are gathered per key instead of being joined. Keys that lack
    a variant give no row; of repeated rows the smallest values by field order count.
    """
    row = F.struct(*fields)
    picked = df.where(F.col(variant).isin(a, b)).groupBy(key).agg(
        F.min(F.when(F.col(variant) == a, row)).alias("_a"), F.min(F.when(F.col(variant) == b, row)).alias("_b")
    )
    both = picked.where("_a IS NOT NULL AND _b IS NOT NULL")
    columns = [F.col(f"{side}.{f}").alias(f"{f}{side}") for f in fields for side in ("_a", "_b")]
    return both.select(key, *columns, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("differs"))


def joined_text(*parts: Column) -> Column:
    """Trimmed parts that are not blank, one a line; null if there is none."""
    text = F.concat_ws("\n", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])
    return F.when(text != "", text)


def native_position(text: Column, term: Column, missing: int = 1_000_000_000) -> Column:
    """Where a term first stands in a text, from 0, case aside; ``missing`` if nowhere or null."""
    at = F.position(F.lower(term), F.lower(text))
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(missing)


def active_entries(attributes: Column, negative: Sequence[str]) -> Column:
    """Entries of a map of which at least one value is not negative."""
    return F.map_filter(attributes, lambda k, v: F.exists(v, lambda x: ~F.lower(x).isin(*negative)))


def first_of_suffix(attributes: Column, suffix: str) -> Column:
    """First value of the first key, by name, that ends with the suffix; the exact key is preferred."""
    keys = F.array_sort(F.filter(F.map_keys(attributes), lambda k: k.endswith(suffix)))
    key = F.when(F.array_contains(keys, suffix), F.lit(suffix)).otherwise(F.try_element_at(keys, F.lit(1)))
    return F.try_element_at(F.try_element_at(attributes, key), F.lit(1))
