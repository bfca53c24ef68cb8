"""Human labels, blind paired preferences, latency statistics, gates and experiment logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.operators.positions import exact_quantiles


def micro_rates(df: DataFrame, groups: Sequence[str], ratios: dict[str, tuple[Column, Column]], means: dict[str, Column]) -> DataFrame:
    """Ratios of sums and means per group, rounded to 6 decimals; a zero denominator gives null."""
    sums = [F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b)), 6).alias(name) for name, (a, b) in ratios.items()]
    avgs = [F.round(F.avg(c), 6).alias(name) for name, c in means.items()]
    return df.groupBy(*groups).agg(F.count("*").alias("rows"), *sums, *avgs)


def unblind(votes: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Replace the side of a vote by the variant behind it; ties pass, unknown sides become null.

    ``votes``: ``key, dimension, choice`` (``A``, ``B`` or ``tie``); ``mapping``: ``key, a_is, b_is``.
    """
    winner = F.when(F.col("choice") == "tie", "tie").when(F.col("choice") == "A", F.col("a_is")).when(F.col("choice") == "B", F.col("b_is"))
    return votes.join(mapping, key).withColumn("winner", winner).drop("a_is", "b_is")


def vote_table(votes: DataFrame, dimension: str, choice: str, choices: Sequence[str]) -> DataFrame:
    """``dimension, choice, votes`` with a zero row for every choice of the domain nobody made."""
    spark = votes.sparkSession
    domain = spark.createDataFrame([(c,) for c in choices], f"{choice} string")
    counted = votes.groupBy(dimension, choice).agg(F.count("*").alias("votes"))
    full = counted.select(dimension).distinct().crossJoin(F.broadcast(domain))
    return full.join(counted, [dimension, choice], "left").fillna({"votes": 0})


def latency_summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean, interpolated P50 and P95, nearest-rank P95, extremes; nulls are left out.

    Groups of any size: quantiles are exact and found by counts per bin, not by gathering a group.
    """
    v = F.col(value)
    flat = df.groupBy(*groups).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"))
    found = exact_quantiles(df, groups, value, {"p50": (0.5, True), "p95": (0.95, True), "p95_nearest": (0.95, False)})
    quantiles = found.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p95_nearest")])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.lit(True))
    return flat.join(quantiles, same, "left").select(*groups, "n", "mean", "p50", "p95", "p95_nearest", "low", "high")


def running_best(df: DataFrame, groups: Sequence[str], order: str, value: str) -> DataFrame:
    """Add ``best_so_far``: the least value up to each row, over one row per (groups, order)."""
    w = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("best_so_far", F.min(value).over(w))


def target_gates(observed: DataFrame, targets: Sequence[tuple[str, float, str]]) -> DataFrame:
    """``metric, observed, target, passed`` for one row of metrics; ``>=`` or ``<=`` by target."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed"), F.lit(float(t)).alias("target"), F.lit(op).alias("op")) for m, t, op in targets]
    flat = observed.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    met = F.when(F.col("op") == ">=", F.col("observed") >= F.col("target")).otherwise(F.col("observed") <= F.col("target"))
    return flat.select("metric", "observed", "target", F.coalesce(met, F.lit(False)).alias("passed"))


def upsert_log(log: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The log with new rows in the place of old ones of the same key; within either side the last by all columns wins."""
    both = log.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.desc_nulls_last(c) for c in log.columns if c not in keys]
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new"), *rest))).where("_r = 1").drop("_r", "_new")


def baseline_deltas(log: DataFrame, scope: Sequence[str], version: str, baseline: str, metric: str) -> DataFrame:
    """Add ``delta`` to the only baseline of the row's scope and ``note``: compared, is_baseline, no_baseline or several_baselines."""
    bases = log.where(F.col(baseline)).groupBy(*scope).agg(F.count("*").alias("_n"), F.first(metric).alias("_base"))
    joined = log.join(bases, list(scope), "left")
    note = (
        F.when(F.col(baseline), "is_baseline")
        .when(F.col("_n").isNull(), "no_baseline")
        .when(F.col("_n") > 1, "several_baselines")
        .otherwise("compared")
    )
    delta = F.when(note == "compared", F.round(F.col(metric) - F.col("_base"), 6))
    return joined.select(*scope, version, baseline, metric, note.alias("note"), delta.alias("delta"))


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows, digest``: independent of row order; equal tables give equal digests.

    Row hashes are summed in 31-bit slices instead of being gathered, so any size fits.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    row = F.sha2(text, 256)
    slices = [F.sum(F.conv(F.substring(row, 1 + 7 * i, 7), 16, 10).cast("long")).alias(f"s{i}") for i in range(4)]
    sums = df.agg(F.count("*").alias("rows"), *slices)
    return sums.select("rows", F.sha2(F.concat_ws(":", *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)]), 256).alias("digest"))


def verify_manifest(expected: DataFrame, observed: DataFrame, key: str = "name") -> DataFrame:
    """``name, status``: equal, changed, missing or unexpected, by digest."""
    e = expected.select(F.col(key), F.col("digest").alias("_e"))
    o = observed.select(F.col(key), F.col("digest").alias("_o"))
    status = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_e") == F.col("_o"), "equal").otherwise("changed")
    return e.join(o, key, "full").select(key, status.alias("status"))


def cell_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, old, new`` for every cell that differs, null-safe; rows on one side only differ in all set cells."""
    b = before.select(F.col(key), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    a = after.select(F.col(key), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("old"), F.col(f"a_{f}").alias("new")) for f in fields])
    return b.join(a, key, "full").select(key, F.explode(cells).alias("c")).select(key, "c.*").where("NOT (old <=> new)")
