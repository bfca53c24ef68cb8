"""Vector checks, exact search, graded metrics, rule rerank.

Embeddings and their labels play gallery and judgments: a result of the query's own label
has grade 2, one of the next label grade 1. Queries are the rows whose id 100 divides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.functions import vectors as V
from wareloom.operators import dedup, rerank, retrieval
from wareloom.queries.registry import query
from wareloom.session import table

_USABLE = """len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""
_UNIT = f"""SELECT vec_id, category_l2, product_id, split, list_transform(embedding::DOUBLE[],
    lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM feature_library WHERE {_USABLE}"""
_DOT = "list_sum(list_transform(list_zip(q.u, g.u), lambda p: p[1] * p[2]))"


@query(
    f"""SELECT vec_id, coalesce({_USABLE}, false) AS usable,
        CASE WHEN {_USABLE} THEN abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) <= 0.0001 ELSE false END AS unit FROM feature_library"""
)
def vector_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_library", ["vec_id", "embedding"]).withColumn("v", V.doubles(F.col("embedding")))
    usable = V.usable(F.col("v"), 64)
    return rows.select("vec_id", usable.alias("usable"), F.when(usable, V.is_unit(F.col("v"))).otherwise(False).alias("unit"))


@query(f"SELECT vec_id, round(u[1], 6) AS first, round(u[64], 6) AS last, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS size FROM ({_UNIT})")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_library", ["vec_id", "embedding"]).withColumn("v", V.doubles(F.col("embedding"))).where(V.usable(F.col("v"), 64))
    u = rows.select("vec_id", V.normalise(F.col("v")).alias("u"))
    return u.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"), F.round(V.dot(F.col("u"), F.col("u")), 6).alias("size"))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feature_library", ["vec_id", "embedding", "split"]).select(F.col("vec_id").alias("id"), "embedding", "split")


_TOPK = f"""WITH u AS ({_UNIT}), s AS (SELECT q.vec_id AS query_id, g.vec_id AS item_id, round({_DOT}, 6) AS score
    FROM u q JOIN u g ON q.vec_id <> g.vec_id WHERE q.vec_id % 100 = 0 {{filter}})
    SELECT query_id, item_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10"""


@query(_TOPK.format(filter=""))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _library(spark, sf_dir)
    return retrieval.exact_top_k(rows.where("id % 100 = 0"), rows, 10)


@query(_TOPK.format(filter="AND g.split = 'train'"))
def gallery_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gallery is filtered before the ranking, never after it."""
    rows = _library(spark, sf_dir)
    return retrieval.exact_top_k(rows.where("id % 100 = 0"), rows.where("split = 'train'"), 10)


@query(
    f"""WITH u AS ({_UNIT}), f AS (SELECT a.vec_id, list_transform(list_zip(a.u, b.u), lambda p: 0.7 * p[1] + 0.3 * p[2]) AS m FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS first,
               round(m[64] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS last FROM f"""
)
def feature_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_library", ["vec_id", "embedding"]).withColumn("v", V.doubles(F.col("embedding"))).where(V.usable(F.col("v"), 64))
    u = rows.select("vec_id", V.normalise(F.col("v")).alias("u"))
    both = u.join(u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w")), "vec_id")
    fused = both.select("vec_id", V.fuse([F.col("u"), F.col("w")], [0.7, 0.3]).alias("m"))
    return fused.select("vec_id", F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.element_at("m", 64), 6).alias("last"))


_BITS = " + ".join(f"(CASE WHEN embedding[{i}] > embedding[{i + 1}] THEN {1 << (63 - i)} ELSE 0 END)" for i in range(1, 64))


@query(
    f"""WITH h AS (SELECT category_l2, min(vec_id) AS id, count(*) AS copies, b FROM (SELECT category_l2, vec_id, ({_BITS})::BIGINT AS b FROM feature_library
          WHERE {_USABLE} AND category_l2 IS NOT NULL) GROUP BY category_l2, b)
        SELECT a.category_l2, a.id AS id_a, b.id AS id_b, bit_count(xor(a.b, b.b))::INT AS distance, a.copies AS copies_a, b.copies AS copies_b
        FROM h a JOIN h b ON a.category_l2 = b.category_l2 AND a.id < b.id WHERE bit_count(xor(a.b, b.b)) <= 6"""
)
def hamming_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_library", ["vec_id", "category_l2", "embedding"]).where("category_l2 IS NOT NULL")
    hashed = rows.where(V.usable(F.col("embedding"), 64)).select("vec_id", "category_l2", V.difference_bits(F.col("embedding")).alias("bits"))
    return dedup.near_hash_pairs(hashed, "category_l2", "vec_id", "bits", 6)


_E_TOP = """WITH s AS (SELECT q.vec_id AS query_id, g.vec_id AS item_id, q.label AS ql, g.label AS gl,
      round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), lambda p: p[1] * p[2]))
        / (sqrt(list_sum(list_transform(q.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(g.embedding::DOUBLE[], lambda x: x * x)))), 6) AS score
      FROM embeddings q JOIN embeddings g ON q.vec_id <> g.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank,
      CASE WHEN ql = gl THEN 2 WHEN gl = (ql + 1) % 10 THEN 1 ELSE 0 END AS grade FROM s)"""
_METRICS = """ideal AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rank FROM {ideal}),
    i AS (SELECT query_id, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS relevant,
      sum(CASE WHEN rank <= 10 THEN (2.0::DOUBLE ** grade - 1) / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS idcg FROM ideal GROUP BY 1),
    t AS (SELECT query_id, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS hits, max(CASE WHEN grade >= 1 THEN 1.0::DOUBLE / rank ELSE 0 END) AS rr,
      sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1.0::DOUBLE)) AS dcg FROM r WHERE rank <= 10 GROUP BY 1),
    m AS (SELECT i.query_id, round(hits / 10.0::DOUBLE, 6) AS precision, round(hits / relevant::DOUBLE, 6) AS recall, round(rr, 6) AS mrr, round(dcg / idcg, 6) AS ndcg
      FROM i JOIN t USING (query_id) WHERE relevant > 0)"""


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(judged top 50 of every query, all judgments)."""
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]).withColumnRenamed("vec_id", "id")
    asked = rows.where("id % 100 = 0")
    grade = lambda q, g: F.when(F.col(q) == F.col(g), 2).when(F.col(g) == (F.col(q) + 1) % 10, 1).otherwise(0)
    ql, gl = asked.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), rows.select(F.col("id").alias("item_id"), F.col("label").alias("gl"))
    top = retrieval.exact_top_k(asked, rows, 50).join(ql, "query_id").join(gl, "item_id").withColumn("grade", grade("ql", "gl"))
    # judgments over the stated query set: counts by label
    counts = gl.groupBy("gl").agg(F.count("*").alias("n"))
    judged = ql.crossJoin(F.broadcast(counts)).withColumn("n", F.col("n") - (F.col("ql") == F.col("gl")).cast("int")).withColumn("grade", grade("ql", "gl"))
    return top, judged.where("n > 0").select("query_id", "grade", "n")


@query(f"{_E_TOP}, {_METRICS.format(ideal='r WHERE rank <= 50')} SELECT query_id, precision, recall, mrr, ndcg FROM m")
def ir_metrics_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and the ideal order come from the candidate pool of 50."""
    top, _ = _graded(spark, sf_dir)
    return retrieval.ranking_metrics(top, top.select("query_id", "grade"), 10)


@query(f"{_E_TOP}, {_METRICS.format(ideal='r')} SELECT query_id, precision, recall, mrr, ndcg FROM m")
def ir_metrics_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and the ideal order come from all judgments."""
    top, judged = _graded(spark, sf_dir)
    return retrieval.ranking_metrics(top, judged, 10)


@query(
    f"""{_E_TOP}, {_METRICS.format(ideal='r')}, x AS (SELECT m.*, 'L' || (e.label % 2)::VARCHAR AS l1, 'C' || e.label::VARCHAR AS l2 FROM m JOIN embeddings e ON e.vec_id = query_id)
        SELECT CASE WHEN l1 IS NOT NULL THEN 'l1' WHEN l2 IS NOT NULL THEN 'l2' ELSE 'overall' END AS level, coalesce(l1, l2, 'all') AS value, count(*) AS queries,
        round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
        FROM x GROUP BY GROUPING SETS ((), (l1), (l2))"""
)
def ir_metrics_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings", ["vec_id", "label"]).select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("L"), F.col("label") % 2).alias("l1"), F.concat(F.lit("C"), F.col("label")).alias("l2")
    )
    per_query = ir_metrics_complete(spark, sf_dir).join(labels, "query_id")
    return retrieval.breakdown(per_query, ["l1", "l2"], ["precision", "recall", "mrr", "ndcg"])


@query(
    f"""{_E_TOP} SELECT query_id, string_agg(grade::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY grade) AS histogram
        FROM (SELECT query_id, grade, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1, 2) GROUP BY 1"""
)
def grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.grade_histogram(_graded(spark, sf_dir)[0].where("rank <= 10"))


@query(f"{_E_TOP} SELECT query_id, min(rank) AS lo, max(rank) AS hi, count(*) AS n, count(DISTINCT rank) AS d FROM r WHERE rank <= 50 GROUP BY 1 HAVING min(rank) <> 1 OR max(rank) <> count(*)")
def rank_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.contiguous_ranks(_graded(spark, sf_dir)[0])


@query(
    """SELECT q.row_id, f.vec_id, f.product_id AS item_id, (row_number() OVER (PARTITION BY q.row_id ORDER BY f.product_id, f.vec_id))::INT AS place
       FROM retrieval_test_queries q JOIN feature_library f ON q.category_l2 = f.category_l2 AND f.product_id <> regexp_extract(q.query_image_path, '([0-9]+)\\.', 1)"""
)
def relevance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gallery picture of the query's category but its own product's, numbered, for all test queries."""
    own = F.regexp_extract("query_image_path", r"([0-9]+)\.", 1)
    asked = table(spark, sf_dir, "retrieval_test_queries").select(F.col("row_id").alias("query_id"), F.col("category_l2").alias("category"), own.alias("own"))
    items = table(spark, sf_dir, "feature_library").select(F.col("vec_id").alias("item_id"), F.col("category_l2").alias("category"), "product_id")
    found = retrieval.category_judgments(asked, items)
    return found.select(F.col("query_id").alias("row_id"), F.col("item_id").alias("vec_id"), F.col("product_id").alias("item_id"), "place")



_ALIASES = [("壶", "电热水壶", 1), ("电热水壶", "电热水壶", 2), ("灯", "桌面台灯", 3), ("台灯", "桌面台灯", 4), ("音箱", "蓝牙音箱", 5), ("音响", "蓝牙音箱", 6), ("风扇", "手持风扇", 7), ("加湿器", "加湿器", 8)]
_CONCEPTS = [("travel", "出差旅行", None, 1), ("kitchen", "厨房台面", None, 2), ("wood", "实木", "桌面台灯", 3), ("steel", "食品级钢", "电热水壶", 4), ("quiet", "静音运行", None, 5), ("base", "磁吸底座", None, 6)]
_V = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


@query(
    f"""WITH q AS (SELECT row_id AS query_id, lower(coalesce(query_text, '')) AS text FROM retrieval_test_queries),
        c AS (SELECT query_id, category FROM (SELECT query_id, category, row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, ord) AS r
              FROM q JOIN (VALUES {_V(_ALIASES)}) a(alias, category, ord) ON contains(text, alias)) WHERE r = 1),
        m AS (SELECT query_id, string_agg(concept, ',' ORDER BY ord) AS concepts FROM q LEFT JOIN c USING (query_id)
              JOIN (VALUES {_V(_CONCEPTS)}) k(concept, term, scope, ord) ON contains(text, term) AND (scope IS NULL OR scope = category) GROUP BY 1)
        SELECT q.query_id, category, coalesce(concepts, '') AS concepts FROM q LEFT JOIN c USING (query_id) LEFT JOIN m USING (query_id)"""
)
def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(_ALIASES, "alias string, category string, ord int")
    concepts = spark.createDataFrame(_CONCEPTS, "concept string, term string, category string, ord int")
    asked = table(spark, sf_dir, "retrieval_test_queries", ["row_id", "query_text"]).select(F.col("row_id").alias("query_id"), F.col("query_text").alias("text"))
    return rerank.query_signals(asked, aliases, concepts).drop("tokens")


_C_SQL = """c AS (SELECT query_id, item_id, rank, score, grade, (ql % 2 = gl % 2) AS same_category, 3 AS wanted, (item_id % 4)::INT AS supported, (item_id % 3)::INT AS conflicting
    FROM r WHERE rank <= 20)"""
_SCORE = "round(score * CASE WHEN same_category THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END + {a} * (supported / wanted::DOUBLE) - {b} * (conflicting / wanted::DOUBLE), 6)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, _ = _graded(spark, sf_dir)
    return top.where("rank <= 20").select(
        "query_id", "item_id", "rank", "score", "grade", (F.col("ql") % 2 == F.col("gl") % 2).alias("same_category"),
        F.lit(3).alias("wanted"), (F.col("item_id") % 4).cast("int").alias("supported"), (F.col("item_id") % 3).cast("int").alias("conflicting"),
    )


@query(
    f"""{_E_TOP}, {_C_SQL}, sc AS (SELECT *, CASE WHEN rank <= 15 THEN {_SCORE.format(a="0.24::DOUBLE", b="0.12::DOUBLE")} END AS new_score FROM c)
        SELECT query_id, item_id, rank, score, new_score, (row_number() OVER (PARTITION BY query_id ORDER BY rank <= 15 DESC, new_score DESC NULLS LAST, rank, item_id))::INT AS new_rank FROM sc"""
)
def rule_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.rerank(_candidates(spark, sf_dir), 15, 0.24, 0.12).select("query_id", "item_id", "rank", "score", "new_score", "new_rank")


@query(
    f"""{_E_TOP}, {_C_SQL}, g AS (SELECT a / 10.0::DOUBLE AS support_weight, b / 10.0::DOUBLE AS conflict_weight FROM range(0, 4) x(a), range(0, 3) y(b)),
        sc AS (SELECT support_weight, conflict_weight, query_id, grade, row_number() OVER (PARTITION BY support_weight, conflict_weight, query_id
              ORDER BY {_SCORE.format(a="support_weight", b="conflict_weight")} DESC, rank, item_id) AS n FROM c, g),
        p AS (SELECT support_weight, conflict_weight, query_id, count_if(grade >= 1) / 10.0::DOUBLE AS p FROM sc WHERE n <= 10 GROUP BY 1, 2, 3),
        t AS (SELECT support_weight, conflict_weight, round(avg(p), 6) AS precision FROM p GROUP BY 1, 2)
        SELECT *, (row_number() OVER (ORDER BY precision DESC, support_weight, conflict_weight))::INT AS place FROM t"""
)
def rerank_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(a / 10, b / 10) for a in range(4) for b in range(3)], "support_weight double, conflict_weight double")
    return rerank.grid_search(_candidates(spark, sf_dir), grid, 10, 20)


@query(
    f"""{_E_TOP}, {_C_SQL}, sc AS (SELECT *, CASE WHEN rank <= 15 THEN {_SCORE.format(a="0.24::DOUBLE", b="0.12::DOUBLE")} END AS new_score FROM c)
        SELECT query_id, item_id, rank, score, NULL::DOUBLE AS new_score, rank AS new_rank, 'image' AS mode FROM c WHERE query_id % 200 = 0
        UNION ALL SELECT query_id, item_id, rank, score, new_score, (row_number() OVER (PARTITION BY query_id ORDER BY rank <= 15 DESC, new_score DESC NULLS LAST, rank, item_id))::INT, 'text'
        FROM sc WHERE query_id % 200 <> 0"""
)
def rerank_mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even query numbers play image queries: they pass through."""
    rows = _candidates(spark, sf_dir)
    return rerank.dispatch(rows.where("query_id % 200 = 0"), rerank.rerank(rows.where("query_id % 200 <> 0"), 15, 0.24, 0.12))


_EV = """p AS (SELECT query_id, item_id, 'c' || (item_id % 2)::VARCHAR AS concept, item_id % 4 = 0 AS supports, item_id % 3 = 0 AS conflicts FROM r WHERE rank <= 20
    UNION ALL SELECT query_id, item_id, 'c' || (item_id % 2)::VARCHAR, item_id % 5 = 0, NULL FROM r WHERE rank <= 20)"""


@query(
    f"""{_E_TOP}, {_EV} SELECT query_id, item_id, concept, CASE WHEN bool_or(coalesce(conflicts, false)) THEN 'conflict'
        WHEN bool_or(coalesce(supports, false)) THEN 'support' ELSE 'unknown' END AS verdict FROM p GROUP BY 1, 2, 3"""
)
def attribute_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("query_id", "item_id", F.concat(F.lit("c"), F.col("item_id") % 2).alias("concept"))
    said = rows.withColumn("supports", F.col("item_id") % 4 == 0).withColumn("conflicts", F.col("item_id") % 3 == 0)
    more = rows.withColumn("supports", F.col("item_id") % 5 == 0).withColumn("conflicts", F.lit(None).cast("boolean"))
    return rerank.evidence(said.unionByName(more))


@query(
    f"""WITH u AS ({_UNIT}), s AS (SELECT q.vec_id AS query_id, q.product_id = g.product_id AS same_product, coalesce(q.category_l2 = g.category_l2, false) AS same_category,
          row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 6) DESC, g.vec_id) AS rank FROM u q JOIN u g ON q.vec_id <> g.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, coalesce(bool_or(same_product AND rank = 1), false) AS top1, coalesce(bool_or(same_product AND rank <= 10), false) AS top10,
               count_if(same_category AND rank <= 10)::BIGINT AS same_category FROM s GROUP BY 1"""
)
def smoke_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another picture of the query's product comes first or in the first ten."""
    rows = _library(spark, sf_dir)
    top = retrieval.exact_top_k(rows.where("id % 100 = 0"), rows, 10)
    about = table(spark, sf_dir, "feature_library", ["vec_id", "product_id", "category_l2"])
    query_side = about.select(F.col("vec_id").alias("query_id"), F.col("product_id").alias("qp"), F.col("category_l2").alias("qc"))
    item_side = about.select(F.col("vec_id").alias("item_id"), F.col("product_id").alias("ip"), F.col("category_l2").alias("ic"))
    joined = top.join(query_side, "query_id").join(item_side, "item_id")
    hit = F.coalesce(F.col("qp") == F.col("ip"), F.lit(False))
    return joined.groupBy("query_id").agg(
        F.bool_or(hit & (F.col("rank") == 1)).alias("top1"), F.bool_or(hit).alias("top10"), F.count_if(F.col("qc") == F.col("ic")).alias("same_category")
    )
