"""Checks of generated text against the facts it may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.functions.replies import figures


def findings(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``text_id, class, span, n``: every pattern hit outside the text's facts, counted per span.

    ``texts``: ``text_id, text, facts`` (one string of allowed content); ``patterns``:
    ``class, pattern``, a small declared table. A span that the facts hold is no finding;
    null texts have none, null facts allow nothing.
    """
    hits = texts.crossJoin(F.broadcast(patterns)).select(
        "text_id", "class", F.coalesce("facts", F.lit("")).alias("facts"), F.explode(F.expr("regexp_extract_all(text, pattern, 0)")).alias("span")
    )
    return hits.where(~F.col("facts").contains(F.col("span"))).groupBy("text_id", "class", "span").agg(F.count("*").alias("n"))


def status(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``text_id, status, findings``: every text, ``FAIL`` where anything was found."""
    counted = found.groupBy("text_id").agg(F.sum("n").alias("findings"))
    joined = texts.select("text_id").join(counted, "text_id", "left")
    return joined.select("text_id", F.when(F.col("findings") > 0, "FAIL").otherwise("PASS").alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))


def unsupported_figures(texts: DataFrame) -> DataFrame:
    """``text_id, figure``: figures with units in a text that its source lacks."""
    extra = F.array_except(figures(F.col("text")), figures(F.col("source")))
    return texts.select("text_id", F.explode(extra).alias("figure"))


def coverage(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text_id, wanted, covered``: values of a text's facts that it states literally.

    ``wanted``: ``text_id, value``. Texts of which nothing is wanted give no row.
    """
    joined = wanted.join(texts.select("text_id", "text"), "text_id", "left")
    return joined.groupBy("text_id").agg(
        F.count("*").alias("wanted"), F.count_if(F.coalesce(F.col("text").contains(F.col("value")), F.lit(False))).alias("covered")
    )
