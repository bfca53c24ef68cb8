"""Counts: labels, field presence, cross-tabs, ordered reject cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions.text import trim_blanks


def label_census(df: DataFrame, label: str) -> DataFrame:
    """``label, rows`` with nulls counted; sort it as needed."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))


def field_presence(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, present, empty``: rows with a value, and rows whose value is blank text; one pass."""
    counts = df.agg(
        *[F.count(f).alias(f"p_{f}") for f in fields],
        *[F.count_if(F.coalesce(trim_blanks(F.col(f).cast("string")) == "", F.lit(False))).alias(f"e_{f}") for f in fields],
    )
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").alias("present"), F.col(f"e_{f}").alias("empty")) for f in fields])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` by the named values of ``column``; missing combinations count 0."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def first_failure(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reason", accepted: str = "accepted") -> DataFrame:
    """Add the name of the first rule a row fails, or ``accepted``. A rule that is null has not failed."""
    verdict: Column | None = None
    for name, failed in rules:
        test = F.coalesce(failed, F.lit(False))
        verdict = F.when(test, name) if verdict is None else verdict.when(test, name)
    return df.withColumn(out, verdict.otherwise(accepted))


def contains_any(col: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms is in the text; null text holds none."""
    found = F.lit(False)
    for term in terms:
        found = found | F.coalesce(col.contains(term), F.lit(False))
    return found


def lookup_unique(df: DataFrame, table: DataFrame, key: str, limit: int = 100_000) -> DataFrame:
    """Inner join with a lookup table whose keys must be unique; broadcast up to ``limit`` rows."""
    sizes = table.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).head()
    if sizes["n"] != sizes["d"]:
        raise ValueError(f"{sizes['n'] - sizes['d']} repeated or null keys in the lookup table")
    return df.join(F.broadcast(table) if sizes["n"] <= limit else table, key)


def trace_sources(df: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Add ``found_in``: the sorted names of the sources that hold the row's key."""
    marked = None
    for name, source in sources.items():
        part = source.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("source", F.lit(name))
        marked = part if marked is None else marked.unionByName(part)
    by_key = marked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("found_in"))
    return df.join(by_key, key, "left").withColumn("found_in", F.coalesce("found_in", F.lit("")))


def overlap_matrix(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """``set_a, set_b, shared`` for every pair of named key sets, in one shuffle."""
    members = None
    for i, (name, df) in enumerate(sets.items()):
        part = df.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct().withColumn("no", F.lit(i))
        members = part if members is None else members.unionByName(part)
    names = list(sets)
    patterns = members.groupBy("key").agg(F.array_sort(F.collect_set("no")).alias("nos")).groupBy("nos").agg(F.count("*").alias("n"))
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), c + 1)
    return (
        patterns.select("n", "nos", F.explode("nos").alias("a")).select("n", "a", F.explode("nos").alias("b")).where("a < b")
        .groupBy(name(F.col("a")).alias("set_a"), name(F.col("b")).alias("set_b")).agg(F.sum("n").alias("shared"))
    )
