"""Claims of generated text held against long-form facts: usage, praise, denials, directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("unsupported_usage", "unsupported_praise", "denied_fact", "turned_direction")


def plain(col: Column) -> Column:
    """Lower case without blanks and punctuation: the form claims are compared in."""
    return F.lower(F.regexp_replace(col, r"[\s，。；;：:、,.!?！？()（）\[\]【】]", ""))


def claim_findings(texts: DataFrame, facts: DataFrame, usage: str, usage_fields: Sequence[str], praise: str, denials: Sequence[str],
                   turned: Sequence[tuple[str, str]]) -> DataFrame:
    """``text_id, part, class, span``: each distinct finding once.

    ``texts``: ``text_id, part, text``; ``facts``: ``text_id, field, value`` in long form.
    ``usage`` is a pattern whose group is the claimed use: it must hold a value of a usage
    field, or be held by one. ``praise`` matches words that only stand if a value holds them. A
    value that follows a word of ``denials`` is denied, and a value that ends in the first word of a
    ``turned`` pair must not occur with the second. Null texts have no findings; a text
    without facts has nothing to lean on. Every text meets its own facts only.
    """
    values = facts.where("value IS NOT NULL").select("text_id", "field", plain(F.col("value")).alias("value")).where("value <> ''")
    kept = texts.where("text IS NOT NULL").select("text_id", "part", "text", plain(F.col("text")).alias("compact"))
    said = lambda pattern, group, kind: kept.select(
        "text_id", "part", F.lit(kind).alias("class"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))).alias("span")
    )
    uses = said(usage, 1, CLASSES[0]).withColumn("target", plain(F.col("span"))).where("target <> ''")
    held = values.withColumn("usable", F.col("field").isin(*usage_fields))
    near = F.col("usable") & (F.col("target").contains(F.col("value")) | F.col("value").contains(F.col("target")))
    keys = ["text_id", "part", "class", "span"]
    open_uses = uses.join(held, "text_id", "left").groupBy(*keys).agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("ok")).where("NOT ok").select(*keys)
    praised = said(praise, 0, CLASSES[1]).withColumn("target", plain(F.col("span")))
    open_praise = (
        praised.join(values, "text_id", "left").groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("value").contains(F.col("target")), F.lit(False))).alias("ok")).where("NOT ok").select(*keys)
    )
    met = kept.join(values, "text_id")
    denied = met.select("text_id", "part", F.lit(CLASSES[2]).alias("class"), F.explode(F.filter(F.array(*[F.concat(F.lit(d), F.col("value")) for d in denials]), lambda s: F.col("compact").contains(s))).alias("span"))
    opposite = [F.when(F.col("value").endswith(a), F.concat(F.regexp_replace("value", f"{a}$", ""), F.lit(b))) for a, b in turned]
    turns = met.select("text_id", "part", F.lit(CLASSES[3]).alias("class"), F.explode(F.filter(F.array_compact(F.array(*opposite)), lambda s: F.col("compact").contains(s))).alias("span"))
    return open_uses.unionByName(open_praise).unionByName(denied.distinct()).unionByName(turns.distinct())
