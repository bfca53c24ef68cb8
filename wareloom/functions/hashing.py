"""Deterministic hashes used as ranks, identities and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_rank(*parts: Column | str | int) -> Column:
    """A namespaced SHA-256 rank; the same parts rank the same on any cluster."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *columns), 256)


def short_hash(col: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(col, 256), 1, digits)


def seed31(*parts: Column | str | int) -> Column:
    """A 31-bit seed from the first eight hex digits of the rank."""
    return F.conv(F.substring(hash_rank(*parts), 1, 8), 16, 10).cast("long") % 2147483647


def map_fingerprint(title: Column, attributes: Column) -> Column:
    """Equal for equal titles (case aside) and equal attributes, whatever their order."""
    entries = F.transform(
        F.array_sort(F.map_keys(attributes)),
        lambda k: F.concat(k, F.lit("="), F.array_join(F.array_sort(F.element_at(attributes, k)), ",")),
    )
    return F.sha2(F.concat(F.coalesce(F.lower(title), F.lit("")), F.lit("\n"), F.coalesce(F.array_join(entries, ";"), F.lit(""))), 256)
