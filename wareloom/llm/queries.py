"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.llm import confusables, contamination, knn, listings, mixing, overlap, pairs, residue
from wareloom.session import checkpoint, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = pairs.conversation_pairs(table(spark, sf_dir, "lora_data", ["row_id", "messages"]), table(spark, sf_dir, "smoke_test", ["row_id", "prompt", "raw_output"]))
    return pairs.main_defect(pairs.broken_pairs(talks))


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels above their cutoffs, several a record."""
    talks = pairs.conversation_pairs(table(spark, sf_dir, "lora_data", ["row_id", "messages"]), table(spark, sf_dir, "smoke_test", ["row_id", "prompt", "raw_output"]))
    return pairs.broken_pairs(talks).withColumn("posterior", F.round("posterior", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbour_pairs(knn.nearest(table(spark, sf_dir, "feature_library", ["vec_id", "embedding"])))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.same_product_pairs(checkpoint(p3_groups(spark, sf_dir)))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = table(spark, sf_dir, "week2_train_consistency_review", ["product_id", "title", "attribute_evidence", "category_l2"])
    return listings.listing_groups(review, table(spark, sf_dir, "lora_data", ["product_id", "attributes", "category_l2"]))


def _overlap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "lora_data", ["row_id", "product_id", "split", "attributes", "category_l2", "messages"]),
        table(spark, sf_dir, "week2_train_consistency_review", ["product_id", "title", "attribute_evidence", "category_l2"]),
        table(spark, sf_dir, "retrieval_test_queries", ["row_id", "query_id", "product_id", "query_image_path", "query_text"]),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_overlaps(*_overlap_inputs(spark, sf_dir)).select("eval_source", "eval_split", "row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(*_overlap_inputs(spark, sf_dir))


def _seen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title"])
    texts = table(spark, sf_dir, "rag", ["row_id", "attributes"])
    return titles.select(F.lit("week2_train_consistency_review").alias("record_source"), "row_id", F.col("title").alias("text")).unionByName(
        texts.select(F.lit("rag").alias("record_source"), "row_id", F.col("attributes").alias("text"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.same_looking_pairs(_seen_texts(spark, sf_dir), "record_source", "row_id", "text")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: its class of texts that read the same, and its spelling."""
    return confusables.same_looking_classes(_seen_texts(spark, sf_dir), "record_source", "row_id", "text")


def _leak_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "eval_items", ["item_id", "text"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(*_leak_inputs(spark, sf_dir)).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaking document with its leaked spans removed."""
    docs, items = _leak_inputs(spark, sf_dir)
    return contamination.cut_leaks(docs, contamination.leak_spans(docs, items))


#: Domains of the sources in the tree of targets (declared).
SOURCE_DOMAINS = {
    "detail_page": "shop", "spec_sheet": "shop", "shop_faq": "shop", "user_manual": "shop", "care_note": "shop", "export_copy": "shop",
    "buyer_review": "public", "forum_post": "public", "buying_guide": "public", "live_script": "public", "dealer_memo": "trade", "recall_notice": "trade",
}


def _mixed(spark: SparkSession, sf_dir: str, times: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree of domain, language and source; the budget is all usable tokens, so none is cut to the scarcest."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text", "lang"])
    file = os.path.join(mixing.TOKENIZER_FOLDER, mixing.TOKENIZER_FILE)
    return mixing.mix_tree(docs, table(spark, sf_dir, "mix_targets"), file, domain_of=SOURCE_DOMAINS, levels=("lang",), all_usable=True, times=times)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the tree for 1.6 times the usable tokens: leaves run short and are filled by siblings, then by other domains."""
    return _mixed(spark, sf_dir, times=1.6)[2]


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].withColumn("tokenizer", F.lit(mixing.TOKENIZER_FILE))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_labels, p2_found, p3_found, p3_groups, p4_found, p4_report, p6_found, p6_classes, p7_found, p7_cleaned, p8_report, p8_tree, p8_selection, p9_found)
}

ORACLE_SQL: dict[str, str] = {}
