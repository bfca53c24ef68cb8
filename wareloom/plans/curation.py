"""The curation funnel as one lazy plan: parse, reject, de-duplicate, sample, trace, split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions.urls import canonical_url
from wareloom.operators import census, dedup, packed, sampling
from wareloom.session import checkpoint


@dataclass(frozen=True)
class Funnel:
    """What the plan yields: the selected rows with their split, and the counts by reason."""

    selected: DataFrame
    reasons: DataFrame


def curate(feed: DataFrame, categories: DataFrame, rules: Sequence[tuple[str, Column]], per_category: int,
           sources: dict[str, DataFrame] | None = None, seed: int = 42) -> Funnel:
    """``feed``: ``row_id, product_id, label, url, attributes``; ``categories``: ``label, category``.

    Labels outside the table are out of scope. The rules are tried in order, then repeated
    products, contents and images are dropped, first row first. Each category gives its
    hash sample, split in itself; ``sources`` are traced by product id.
    """
    scoped = census.lookup_unique(feed, categories, "label")
    judged = checkpoint(census.first_failure(scoped, rules))
    accepted = judged.where("reason = 'accepted'")
    keys = accepted.select(
        "row_id", "product_id", F.sha2("attributes", 256).alias("content"), F.sha2(canonical_url(F.col("url")), 256).alias("image")
    )
    verdict = dedup.greedy_multikey(keys, "row_id", ["product_id", "content", "image"])
    kept = accepted.join(verdict.where("kept").select("row_id"), "row_id", "left_semi")
    sample = sampling.sample_per_group(kept, "category", "row_id", per_category, seed).drop("rank", "reason")
    split = sampling.stratified_split(sample, "category", "row_id", seed=seed).drop("position", "group_size")
    selected = census.trace_sources(split, "product_id", sources) if sources else split
    dropped = verdict.where("NOT kept").select(F.concat(F.lit("repeated_"), "reason").alias("reason"))
    reasons = judged.where("reason <> 'accepted'").select("reason").unionByName(dropped).groupBy("reason").agg(F.count("*").alias("rows"))
    return Funnel(selected, reasons)


def standard_rules() -> list[tuple[str, Column]]:
    blank = F.col("attributes").isNull() | (F.trim("attributes") == "")
    return [
        ("no_attributes", blank),
        ("few_entries", F.size(packed.packed_pairs(F.col("attributes"))) < 3),
        ("bad_url", canonical_url(F.col("url")).isNull()),
    ]
