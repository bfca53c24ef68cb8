"""Samples, splits, assignments, leak control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.functions.text import letters_only, width_map
from wareloom.operators import census, dedup, sampling, validate
from wareloom.queries.registry import query
from wareloom.session import table

SPLITS = ("train", "validation", "test")


def _split_name(col: str):
    plain = F.lower(F.trim(col))
    return F.when(plain.isin("train", "training", "trn"), "train").when(plain.isin("val", "valid", "validation", "dev"), "validation").when(plain.isin("test", "testing", "eval"), "test")


_SPLIT_SQL = """CASE WHEN lower(trim(split)) IN ('train', 'training', 'trn') THEN 'train'
    WHEN lower(trim(split)) IN ('val', 'valid', 'validation', 'dev') THEN 'validation' WHEN lower(trim(split)) IN ('test', 'testing', 'eval') THEN 'test' END"""


@query(
    """SELECT doc_id, category_l2, rank::INT AS rank FROM (SELECT doc_id, category_l2, row_number() OVER (PARTITION BY category_l2
         ORDER BY sha256('sample:42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 20"""
)
def hash_sample_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_group(table(spark, sf_dir, "documents", ["doc_id", "category_l2"]), "category_l2", "doc_id", 20)


_STRATIFIED = """SELECT doc_id, category_l2, CASE WHEN position <= floor(n * 0.8::DOUBLE) THEN 'train'
    WHEN position <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT doc_id, category_l2, row_number() OVER (PARTITION BY category_l2 ORDER BY sha256('split:42:' || doc_id), doc_id) AS position,
                 count(*) OVER (PARTITION BY category_l2) AS n FROM documents)"""


@query(_STRATIFIED)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "category_l2"])
    return sampling.stratified_split(docs, "category_l2", "doc_id").select("doc_id", "category_l2", "split")


@query(
    f"""SELECT category_l2, count_if(split = 'train')::BIGINT AS train, count_if(split = 'validation')::BIGINT AS validation,
        count_if(split = 'test')::BIGINT AS test FROM ({_STRATIFIED}) GROUP BY 1"""
)
def split_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.cross_tab(stratified_split(spark, sf_dir), "category_l2", "split", SPLITS)


@query(
    """SELECT p_partkey, p_brand, CASE WHEN position <= greatest(1, floor(n * 0.15::DOUBLE + 0.5)) THEN 'validation' ELSE 'train' END AS split
       FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('holdout:42:' || p_brand || ':' || p_partkey), p_partkey) AS position,
             count(*) OVER (PARTITION BY p_brand) AS n FROM part)"""
)
def grouped_split_round_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    return sampling.holdout_split(parts, "p_brand", "p_partkey", 0.15).select("p_partkey", "p_brand", "split")


_QUOTAS = [("电热水壶", 8), ("桌面台灯", 6), ("蓝牙音箱", 5)]
_QUOTA_SQL = f"""SELECT vec_id, category_l2, rank::INT AS rank, quota, (count(*) OVER (PARTITION BY category_l2)) < quota AS short FROM (
    SELECT f.vec_id, f.category_l2, q.quota, row_number() OVER (PARTITION BY f.category_l2 ORDER BY sha256('quota:42:' || f.vec_id), f.vec_id) AS rank
    FROM feature_library f JOIN (VALUES {", ".join(f"('{c}', {n})" for c, n in _QUOTAS)}) q(category_l2, quota) USING (category_l2)) WHERE rank <= quota"""


@query(_QUOTA_SQL)
def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = spark.createDataFrame(_QUOTAS, "category_l2 string, quota int")
    rows = table(spark, sf_dir, "feature_library", ["vec_id", "category_l2"])
    return sampling.quota_selection(rows, quotas, "category_l2", "vec_id").select("vec_id", "category_l2", "rank", "quota", "short")


@query(
    f"""WITH s AS ({_QUOTA_SQL}), spare AS (SELECT category_l2, min(vec_id) AS new FROM feature_library WHERE vec_id NOT IN (SELECT vec_id FROM s) GROUP BY 1)
        SELECT coalesce(spare.new, s.vec_id) AS vec_id, s.category_l2, s.rank, spare.new IS NOT NULL AS replaced
        FROM s LEFT JOIN spare ON s.rank = 1 AND s.category_l2 = spare.category_l2"""
)
def query_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = quota_selection(spark, sf_dir).select("vec_id", "category_l2", "rank")
    spare = (
        table(spark, sf_dir, "feature_library", ["vec_id", "category_l2"]).join(chosen.select("vec_id"), "vec_id", "left_anti")
        .groupBy("category_l2").agg(F.min("vec_id").alias("new"))
    )
    swaps = chosen.where("rank = 1").join(spare, "category_l2").select(F.col("vec_id").alias("old"), "new", F.col("category_l2").alias("new_group"))
    return sampling.replace_selected(chosen, swaps, "vec_id", "category_l2")


@query(
    """WITH firsts AS (SELECT category_l1, category_l2, product_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY category_l1, category_l2
             ORDER BY product_id, vec_id) AS r FROM feature_library WHERE split = 'train') WHERE r = 1),
       turns AS (SELECT *, row_number() OVER (PARTITION BY category_l1 ORDER BY category_l2) AS turn FROM firsts)
       SELECT category_l1, category_l2, product_id, vec_id, turn::INT AS turn FROM turns ORDER BY turn, category_l1 LIMIT 5"""
)
def round_robin_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_library", ["category_l1", "category_l2", "product_id", "vec_id", "split"]).where("split = 'train'").drop("split")
    return sampling.round_robin(rows, "category_l1", "category_l2", ["product_id", "vec_id"], 5)


@query(
    """WITH h AS (SELECT row_id, row_number() OVER (ORDER BY sha256('blind:42:' || row_id), row_id) AS p, count(*) OVER () AS n,
             row_number() OVER (ORDER BY sha256('order:42:' || row_id), row_id) AS o FROM smoke_test)
       SELECT row_id, CASE WHEN p <= floor(n / 2.0) THEN 'A' ELSE 'B' END AS left_is, 'P' || lpad(o::VARCHAR, 7, '0') AS pair_id FROM h"""
)
def blind_ab_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.blind_assignment(table(spark, sf_dir, "smoke_test", ["row_id"]), "row_id")


@query(
    """WITH r AS (SELECT vec_id, category_l2, row_number() OVER (PARTITION BY category_l2 ORDER BY sha256('balance:42:' || vec_id), vec_id) AS p,
             count(*) OVER (PARTITION BY category_l2) AS n FROM feature_library WHERE category_l2 IS NOT NULL),
       odd AS (SELECT category_l2, row_number() OVER (ORDER BY sha256('odd:42:' || category_l2), category_l2) AS turn
               FROM (SELECT DISTINCT category_l2, n FROM r) WHERE n % 2 = 1)
       SELECT vec_id, category_l2, CASE WHEN p <= floor(n / 2.0) + coalesce(turn % 2, 0) THEN 'A' ELSE 'B' END AS left_is FROM r LEFT JOIN odd USING (category_l2)"""
)
def balanced_ab_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_library", ["vec_id", "category_l2"]).where("category_l2 IS NOT NULL")
    return sampling.balanced_assignment(rows, "category_l2", "vec_id")


@query(
    """SELECT row_id, ('0x' || substr(sha256('seed:42:' || product_id || ':' || coalesce(task_type, '')), 1, 8))::BIGINT % 2147483647 AS seed
       FROM lora_data WHERE product_id IS NOT NULL"""
)
def paired_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lora_data", ["row_id", "product_id", "task_type"]).where("product_id IS NOT NULL")
    return sampling.paired_seeds(rows, "product_id", "task_type").select("row_id", "seed")


@query(
    """SELECT row_id, position, floor((position - 1) / 8.0)::BIGINT AS step FROM (
         SELECT row_id, row_number() OVER (ORDER BY sha256('epoch:42:1:' || row_id), row_id) AS position FROM lora_data)"""
)
def epoch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.epoch_groups(table(spark, sf_dir, "lora_data", ["row_id"]), "row_id", epoch=1, size=8)


#: Spellings of the two attributes that identify a product (declared).
_BRANDS, _MODELS = ("品牌", "牌子", "Brand"), ("型号", "产品型号", "货号")


def _plain_sql(names: tuple[str, ...]) -> str:
    first = ", ".join(f"map_extract(attributes, '{n}')[1][1]" for n in names)
    source, target = (text.replace("'", "''") for text in width_map())
    return f"regexp_replace(lower(translate(coalesce({first}), '{source}', '{target}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_BM = f"SELECT row_id, product_id, {_SPLIT_SQL} AS split, {_plain_sql(_BRANDS)} AS brand, {_plain_sql(_MODELS)} AS model FROM lora_data"


def _brand_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and model in comparable letters, whatever the attribute is called and however wide it is set."""
    first = lambda names: letters_only(F.coalesce(*[F.try_element_at(F.try_element_at("attributes", F.lit(n)), F.lit(1)) for n in names]))
    rows = table(spark, sf_dir, "lora_data", ["row_id", "product_id", "split", "attributes"])
    return rows.select("row_id", "product_id", _split_name("split").alias("split"), first(_BRANDS).alias("brand"), first(_MODELS).alias("model"))


@query(
    f"""SELECT brand, model, count(*) AS rows, count(DISTINCT split) AS splits, coalesce(bool_and(split IN ('validation', 'test')), false) AS frozen_only
        FROM ({_BM}) WHERE brand <> '' AND model <> '' GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def brand_model_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated_groups(_brand_model(spark, sf_dir), ["brand", "model"], "split")


@query(
    f"""SELECT count(*) AS groups, count_if(splits > 1)::BIGINT AS cross_split, count_if(frozen_only)::BIGINT AS frozen_only FROM (
        SELECT count(DISTINCT split) AS splits, bool_and(split IN ('validation', 'test')) AS frozen_only FROM ({_BM})
        WHERE brand <> '' AND model <> '' GROUP BY brand, model HAVING count(*) >= 2)"""
)
def group_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = brand_model_groups(spark, sf_dir)
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("splits") > 1).alias("cross_split"), F.count_if("frozen_only").alias("frozen_only"))


_EVIDENCE = f"""SELECT t.product_id AS train_id, t.brand, t.model, f.frozen_rows, f.first_frozen, f.frozen_splits FROM
    (SELECT DISTINCT product_id, brand, model FROM ({_BM}) WHERE split = 'train' AND brand <> '' AND model <> '') t JOIN
    (SELECT brand, model, count(DISTINCT product_id) AS frozen_rows, min(product_id) AS first_frozen, string_agg(DISTINCT split, ';' ORDER BY split) AS frozen_splits
     FROM ({_BM}) WHERE split IN ('validation', 'test') AND brand <> '' AND model <> '' GROUP BY 1, 2) f USING (brand, model)"""


@query(_EVIDENCE)
def leak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.leak_evidence(_brand_model(spark, sf_dir), ["brand", "model"], "product_id", "split")


@query(
    f"""SELECT row_id, product_id, split FROM ({_BM}) WHERE split IS DISTINCT FROM 'train'
        OR product_id NOT IN (SELECT train_id FROM ({_EVIDENCE}))"""
)
def leak_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _brand_model(spark, sf_dir)
    return dedup.without_leaks(rows, dedup.leak_evidence(rows, ["brand", "model"], "product_id", "split"), "product_id", "split").select("row_id", "product_id", "split")


@query(
    f"""SELECT brand, string_agg(DISTINCT model, ';' ORDER BY model) AS models, count(DISTINCT product_id) AS products FROM ({_BM})
        WHERE brand <> '' AND model <> '' GROUP BY brand"""
)
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _brand_model(spark, sf_dir).where("brand <> '' AND model <> ''")
    return rows.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_set("model")), ";").alias("models"), F.count_distinct("product_id").alias("products"))


@query(
    f"""SELECT product_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM ({_BM}) WHERE split IS NOT NULL AND product_id IS NOT NULL
        GROUP BY 1 HAVING count(DISTINCT split) > 1"""
)
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.keys_in_several_splits(_brand_model(spark, sf_dir), "product_id", "split")


@query(
    """SELECT product_id, 'only_first' AS side FROM (SELECT product_id FROM lora_data EXCEPT SELECT product_id FROM rag)
       UNION ALL SELECT product_id, 'only_second' FROM (SELECT product_id FROM rag EXCEPT SELECT product_id FROM lora_data)"""
)
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.set_difference(table(spark, sf_dir, "lora_data", ["product_id"]), table(spark, sf_dir, "rag", ["product_id"]), "product_id")


@query("SELECT row_id, split FROM lora_data WHERE split IS NULL OR split NOT IN ('train', 'validation', 'test')")
def split_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.outside_domain(table(spark, sf_dir, "lora_data", ["row_id", "split"]), "row_id", "split", SPLITS)
