"""Audits of datasets and runs: exclusive reasons, summaries per variant, worst cases, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null rule does not."""
    verdict: Column | None = None
    for name, rule in rules:
        holds = F.coalesce(rule, F.lit(False))
        verdict = F.when(holds, name) if verdict is None else verdict.when(holds, name)
    return F.lit(otherwise) if verdict is None else verdict.otherwise(otherwise)


def any_value_in(values: Column, forbidden: Sequence[str]) -> Column:
    """Whether an array holds one of the forbidden values; null holds none."""
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(v) for v in forbidden])), F.lit(False))


def every_value(values: Column, exact: Sequence[str], pattern: str) -> Column:
    """Whether all values are of an exact set or match a pattern as a whole; an empty array does not."""
    known = F.array(*[F.lit(v) for v in exact])
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: F.array_contains(known, F.lower(v)) | v.rlike(f"^(?:{pattern})$")), F.lit(False))


def one_meaning(col: Column, pattern: str) -> Column:
    """Distinct matches of a pattern in a text, case aside, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)))


def contains_run(whole: Column, part: Column) -> Column:
    """Whether one array of strings stands in another as a contiguous run; an empty run does."""
    mark = "\x1f"
    joined = lambda c: F.concat(F.lit(mark), F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(mark))), ""))
    return F.coalesce((F.size(part) == 0) | joined(whole).contains(joined(part)), F.lit(False))


def strict(col: Column, pattern: str) -> Column:
    """A value if it has the strict form, else null; no trimming, no coercion."""
    return F.when(col.rlike(f"^(?:{pattern})$"), col)


def worst_cases(df: DataFrame, groups: Sequence[str], badness: Sequence[str], key: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the most of ``badness``, compared in order; ties to the smaller key."""
    order = W.partitionBy(*groups).orderBy(*[F.desc_nulls_last(b) for b in badness], key)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def ordered_class(path: Column, rules: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    """The class of the first pattern that matches a path."""
    return first_reason([(name, path.rlike(pattern)) for name, pattern in rules], otherwise)


def same_order(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """``place, a_key, b_key`` of places at which two tables do not hold the same key.

    Places are counted without a single-task sort: each range of the order is numbered
    from the count of the ranges before it.
    """

    def placed(df: DataFrame, order: str, name: str) -> DataFrame:
        # a range is a prefix of the order's rank in its bin; bins are counted first
        binned = df.select(F.col(key).alias(name), F.col(order).alias("o")).withColumn("bin", F.floor(F.col("o") / 4096))
        sizes = binned.groupBy("bin").agg(F.count("*").alias("n"))
        before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
        return binned.join(before, "bin").select(name, (F.col("before") + F.row_number().over(W.partitionBy("bin").orderBy("o", name))).alias("place"))

    both = placed(a, order_a, "a_key").join(placed(b, order_b, "b_key"), "place", "full")
    return both.where("NOT (a_key <=> b_key)").select("place", "a_key", "b_key")


def require_not_negative(df: DataFrame, column: str) -> DataFrame:
    """The table itself, failing at run time on the first negative or missing value."""
    bad = F.col(column).isNull() | (F.col(column) < 0)
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit(f"{column} is negative or missing")).cast("double")).otherwise(F.col(column)))


def image_issue(width: Column, height: Column, kind: Column, size: Column, kinds: Sequence[str], least_side: int = 64, most_pixels: int = 24_000_000, most_bytes: int = 12 << 20) -> Column:
    """The first thing wrong with an image by its metadata, or null: unknown, too small, too many pixels, format, too heavy."""
    unknown = width.isNull() | height.isNull() | kind.isNull() | size.isNull()
    return (
        F.when(unknown, "unknown").when(F.least(width, height) < least_side, "too_small").when(width.cast("long") * height.cast("long") > most_pixels, "too_many_pixels")
        .when(~F.lower(kind).isin(*kinds), "format").when((size > most_bytes) | (size <= 0), "size")
    )
