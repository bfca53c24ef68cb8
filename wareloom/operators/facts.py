"""Attribute records to typed fact units, value gates, task rankings and context zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.functions.hashing import short_hash
from wareloom.functions.text import trim_blanks
from wareloom.operators.packed import packed_list


def parse_multimap(packed: Column) -> Column:
    """``k#:#v;...`` packing to ``array<struct<name, values>>``: names and values distinct, in order.

    Incomplete parts are left out; :func:`multimap_issues` names them. Null gives null.
    """
    parts = F.split(packed, "#;#")
    pairs = F.filter(
        F.transform(parts, lambda p: F.struct(trim_blanks(F.substring_index(p, "#:#", 1)).alias("k"),
                                              F.when(p.contains("#:#"), trim_blanks(F.substring(p, F.locate("#:#", p) + 3, F.length(p)))).otherwise("").alias("v"))),
        lambda e: (e["k"] != "") & (e["v"] != ""),
    )
    names = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
    return F.transform(
        names,
        lambda n: F.struct(n.alias("name"), F.array_distinct(F.transform(F.filter(pairs, lambda e: e["k"] == n), lambda e: e["v"])).alias("values")),
    )


def multimap_issues(packed: Column) -> Column:
    """Sorted distinct issues of a packed field: ``not_text``, ``empty_part``, ``bad_separator``, ``empty_name``, ``empty_value``."""
    def issue(p: Column) -> Column:
        n = F.size(F.split(p, "#:#"))
        return (
            F.when(trim_blanks(p) == "", "empty_part")
            .when(n != 2, "bad_separator")
            .when(trim_blanks(F.element_at(F.split(p, "#:#"), 1)) == "", "empty_name")
            .when(trim_blanks(F.try_element_at(F.split(p, "#:#"), F.lit(2))) == "", "empty_value")
        )

    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(packed, "#;#"), issue), lambda x: x.isNotNull())))
    return F.when(packed.isNull(), F.array(F.lit("not_text"))).otherwise(found)


def is_placeholder(value: Column, placeholders: Sequence[str], separators: str = r"[/、,，;；|]") -> Column:
    """A placeholder, or a composite of two or more of them."""
    known = F.array(*[F.lit(p) for p in placeholders])
    plain = F.lower(trim_blanks(value))
    parts = F.filter(F.transform(F.split(plain, separators), trim_blanks), lambda p: p != "")
    return F.array_contains(known, plain) | ((F.size(parts) >= 2) & F.forall(parts, lambda p: F.array_contains(known, p)))


def fact_units(records: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per (record, field): ``record_id, field, role, field_order, fact_id, values, n_values``.

    ``records``: ``record_id, attributes`` (map to arrays). ``policy``: ``name, field, role,
    field_order``, a small declared table of spellings; where a record has several spellings
    of a field, the canonical one counts. Fields outside the policy give no row; blank values
    are left out. The id holds a short hash of the values, so it changes with them.
    """
    pairs = records.select("record_id", F.explode("attributes").alias("name", "given"))
    clean = F.array_distinct(F.filter(F.transform("given", trim_blanks), lambda v: v.isNotNull() & (v != "")))
    named = pairs.withColumn("values", clean).where(F.size("values") > 0).join(F.broadcast(policy), "name")
    canonical = F.when(F.col("name") == F.col("field"), 0).otherwise(1)
    best = named.groupBy("record_id", "field", "role", "field_order").agg(
        F.min_by("values", F.struct(canonical, "name")).alias("values")
    )
    text = F.array_join("values", ",")
    return best.select(
        "record_id", "field", "role", "field_order",
        F.concat_ws(":", F.col("record_id").cast("string"), "field", short_hash(text)).alias("fact_id"),
        text.alias("values"), F.size("values").alias("n_values"),
    )


def audit_marks(audit: DataFrame, policy: DataFrame) -> DataFrame:
    """``record_id, field, status``: one row per field that an audit row marks.

    ``audit``: ``record_id, blocked_fields, status``, the fields packed in any way
    ``packed_list`` reads. A spelling of the policy marks its canonical field, other names
    stand for themselves; null, blank and empty lists mark nothing.
    """
    names = policy.select("name", F.col("field").alias("canonical"))
    listed = audit.select("record_id", "status", F.explode(packed_list(F.col("blocked_fields"))).alias("name"))
    return listed.join(F.broadcast(names), "name", "left").select("record_id", F.coalesce("canonical", "name").alias("field"), "status")


def fact_quality(facts: DataFrame, blocked: DataFrame, set_fields: Sequence[str], identity: str = "identity") -> DataFrame:
    """Add ``quality``: ``blocked``, ``withheld`` or ``usable``.

    ``blocked``: ``record_id, field, status`` rows of the audit. A blocked identity field in
    conflict blocks the whole record; a blocked field in conflict is blocked, one under
    review withheld; several values in a field that takes one are withheld.
    """
    marks = blocked.groupBy("record_id", "field").agg(
        F.max((F.col("status") == "CONFLICT").cast("int")).alias("conflict"), F.max((F.col("status") == "REVIEW").cast("int")).alias("review")
    )
    joined = facts.join(marks, ["record_id", "field"], "left")
    bad_identity = (
        joined.where((F.col("role") == identity) & (F.col("conflict") == 1)).select("record_id").distinct().withColumn("identity_blocked", F.lit(True))
    )
    several = (F.col("n_values") > 1) & ~F.col("field").isin(*set_fields)
    return joined.join(bad_identity, "record_id", "left").withColumn(
        "quality",
        F.when(F.coalesce("identity_blocked", F.lit(False)) | F.coalesce(F.col("conflict") == 1, F.lit(False)), "blocked")
        .when(F.coalesce(F.col("review") == 1, F.lit(False)) | several, "withheld")
        .otherwise("usable"),
    ).drop("identity_blocked", "conflict", "review")


def task_rankings(facts: DataFrame, priorities: DataFrame) -> DataFrame:
    """``record_id, fact_id, list, rank``: the usable facts of a record ranked for each task.

    ``priorities``: ``list, role, priority``; roles without a priority come last.
    """
    tasks = priorities.select("list").distinct()
    ranked = facts.where("quality = 'usable'").crossJoin(F.broadcast(tasks)).join(F.broadcast(priorities), ["list", "role"], "left")
    order = W.partitionBy("record_id", "list").orderBy(F.coalesce("priority", F.lit(1_000_000)), "field_order", "field", "fact_id")
    return ranked.withColumn("rank", F.row_number().over(order)).select("record_id", "fact_id", "list", "rank")


def zones(facts: DataFrame, fused: DataFrame, negative_values: Sequence[str], mandatory: Sequence[str], k: int) -> DataFrame:
    """Four disjoint zones of a record's usable facts: ``record_id, fact_id, zone``.

    Identity first, then facts whose values are all negative, then the mandatory fields,
    then the best ``k`` of the rest by fused rank.
    """
    negatives = F.array(*[F.lit(v) for v in negative_values])
    negative = F.forall(F.split("values", ","), lambda v: F.array_contains(negatives, F.lower(v)))
    first = F.when(F.col("role") == "identity", "identity").when(negative, "negative").when(F.col("field").isin(*mandatory), "mandatory")
    placed = facts.where("quality = 'usable'").select("record_id", "fact_id", first.alias("zone"))
    rest = placed.where("zone IS NULL").drop("zone").join(fused.select("record_id", "fact_id", "position"), ["record_id", "fact_id"])
    best = rest.withColumn("_r", F.row_number().over(W.partitionBy("record_id").orderBy("position"))).where(F.col("_r") <= k)
    return placed.where("zone IS NOT NULL").unionByName(best.select("record_id", "fact_id", F.lit("supplemental").alias("zone")))


def value_gates(df: DataFrame, key: str, field: str, value: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Each value with the first gate that holds it back (``kept`` if none), later spellings of a kept value dropped.

    Values of a (key, field) that differ only in case are one; the first by spelling stays.
    """
    verdict: Column | None = None
    for name, failed in rules:
        test = F.coalesce(failed, F.lit(False))
        verdict = F.when(test, name) if verdict is None else verdict.when(test, name)
    judged = df.withColumn("gate", verdict.otherwise("kept") if verdict is not None else F.lit("kept"))
    order = W.partitionBy(key, field, F.lower(value), "gate").orderBy(value)
    return judged.withColumn("_r", F.row_number().over(order)).withColumn(
        "gate", F.when((F.col("gate") == "kept") & (F.col("_r") > 1), "repeated").otherwise(F.col("gate"))
    ).drop("_r")


def mandatory_status(facts: DataFrame, core: Sequence[str], negative_values: Sequence[str]) -> DataFrame:
    """Add ``mandatory``: the first that holds of not_core, withheld, identity, negative, else mandatory."""
    negatives = F.array(*[F.lit(v) for v in negative_values])
    return facts.withColumn(
        "mandatory",
        F.when(~F.col("field").isin(*core), "not_core")
        .when(F.col("quality") != "usable", "withheld")
        .when(F.col("role") == "identity", "identity")
        .when(F.forall(F.split("values", ","), lambda v: F.array_contains(negatives, F.lower(v))), "negative")
        .otherwise("mandatory"),
    )


def value_shape(value: Column, pattern: str) -> Column:
    """Whether a whole value has the shape and its leading number, if any, is above zero."""
    number = F.regexp_extract(value, r"^([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(value.rlike(f"^(?:{pattern})$") & ((number == "") | (number.try_cast("double") > 0)), F.lit(False))
