"""Evaluation texts leaking into training text.

Each held-out item is cut into character n-grams of its comparable form (width and case
folded, letters and digits only), weighted by how few items share them, so stock sentences
and sentence patterns count little. The set of n-grams is broadcast after its size has been
checked, the windows of every document are looked up in it, and a document carries an item
when the n-grams found cover enough of the item's weight, in one piece or several.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.functions.text import letters_only, ngrams
from wareloom.session import checkpoint, spread

#: Characters of a window.
WINDOW = 10
#: Least share of an item's weight a document must hold.
COVERAGE = 0.38
#: Most n-grams to broadcast (about 60 bytes each); larger sets are joined by shuffle.
BROADCAST_GRAMS = 1_000_000


def item_grams(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """``item_id, gram, key, weight, total``: distinct n-grams of each item with their weight.

    Items shorter than the window count as one n-gram; null and empty items have none.
    """
    form = letters_only(F.col(text))
    grams = (
        items.select(F.col(item_id).alias("item_id"), form.alias("form"))
        .where("form <> ''")
        .select("item_id", F.explode(F.when(F.length("form") < window, F.array("form")).otherwise(ngrams(F.col("form"), window))).alias("gram"))
        .distinct()
    )
    n_items = grams.agg(F.count_distinct("item_id").alias("n_items"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("df"))
    weighted = grams.join(shared, "gram").crossJoin(F.broadcast(n_items)).select(
        "item_id", "gram", F.xxhash64("gram").alias("key"), F.log1p(F.col("n_items") / F.col("df")).alias("weight")
    )
    return weighted.withColumn("total", F.sum("weight").over(W.partitionBy("item_id")))


def _windows(docs: DataFrame, doc_id: str, text: str, window: int, positions: bool) -> DataFrame:
    forms = spread(docs.select(doc_id, text)).select(F.col(doc_id).alias("doc_id"), letters_only(F.col(text)).alias("form")).where("form <> ''")
    grams = F.when(F.length("form") < window, F.array("form")).otherwise(ngrams(F.col("form"), window))
    if positions:
        exploded = forms.select("doc_id", F.posexplode(grams).alias("pos", "gram"))
    else:
        exploded = forms.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram"))
    return exploded.withColumn("key", F.xxhash64("gram"))


def _hits(docs: DataFrame, doc_id: str, text: str, grams: DataFrame, window: int, positions: bool) -> DataFrame:
    """Windows found among the items' n-grams; hash hits are verified on the n-gram itself."""
    small = grams.agg(F.count("*")).head()[0] <= BROADCAST_GRAMS
    side = F.broadcast(grams) if small else grams
    found = _windows(docs, doc_id, text, window, positions).withColumnRenamed("gram", "seen")
    return found.join(side, "key").where("seen = gram")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
          window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, coverage`` for every document that carries enough of an item.

    Null, blank and letterless texts on either side match nothing; repeated documents are
    reported each; only the named columns of the inputs are read.
    """
    return _covered(docs, doc_id, text, item_grams(items, item_id, text, window), window, coverage)


def _covered(docs: DataFrame, doc_id: str, text: str, grams: DataFrame, window: int, coverage: float) -> DataFrame:
    hits = _hits(docs, doc_id, text, grams, window, positions=False)
    return (
        hits.groupBy("doc_id", "item_id")
        .agg((F.sum("weight") / F.first("total")).alias("coverage"))
        .where(F.col("coverage") >= coverage)
    )


def leak_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
               window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, start, length``: merged leaked spans, counted in comparable characters."""
    # both are read several times below
    grams = checkpoint(item_grams(items, item_id, text, window))
    found = checkpoint(_covered(docs, doc_id, text, grams, window, coverage))
    suspects = docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_semi")
    hits = _hits(suspects, doc_id, text, grams, window, positions=True).join(found, ["doc_id", "item_id"], "left_semi")
    order = W.partitionBy("doc_id", "item_id").orderBy("pos")
    islands = hits.select("doc_id", "item_id", "pos", F.length("gram").alias("width")).distinct().withColumn(
        "new", (F.col("pos") > F.lag("pos", 1, -(10**9)).over(order) + F.col("width")).cast("int")
    )
    return (
        islands.withColumn("island", F.sum("new").over(order))
        .groupBy("doc_id", "item_id", "island")
        .agg(F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("width")) - F.min("pos")).alias("length"))
        .drop("island")
    )


def cut_leaks(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, cleaned, n_cut``: the text of each suspect document without its leaked spans."""
    import unicodedata

    marks = spans.groupBy(F.col("doc_id").alias(doc_id)).agg(F.collect_set(F.struct("start", "length")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cleaned, counts = [], []
            for raw, found in zip(batch["text"], batch["spans"]):
                # spans of several items may overlap: sorted, they are walked beside the text
                marks = sorted((span["start"], span["start"] + span["length"]) for span in found)
                at, kept, cutting, n_cut, until, nth = 0, [], False, 0, 0, 0
                for ch in raw:
                    if any(unicodedata.category(c)[0] in "LN" for c in unicodedata.normalize("NFKC", ch).lower()):
                        while nth < len(marks) and marks[nth][0] <= at:
                            until, nth = max(until, marks[nth][1]), nth + 1
                        n_cut += at < until and not cutting
                        cutting = at < until
                        at += 1
                    if not cutting:
                        kept.append(ch)
                cleaned.append("".join(kept))
                counts.append(n_cut)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "cleaned": cleaned, "n_cut": counts})

    joined = docs.select(F.col(doc_id), F.col(text).alias("text")).join(marks, doc_id)
    return joined.select(F.col(doc_id).alias("doc_id"), "text", "spans").mapInPandas(cut, "doc_id long, cleaned string, n_cut long")
