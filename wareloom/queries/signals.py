"""Reranking on what queries ask for and candidates state: real texts, pictures and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.operators import rerank, retrieval
from wareloom.queries.registry import query
from wareloom.queries.retrieval import _ALIASES, _C_SQL, _DOT, _E_TOP, _SCORE, _UNIT, _V, _candidates
from wareloom.session import table

#: concept, field, term (folded) (declared).
_TERMS = [
    ("travel", "场景", "出差旅行"), ("kitchen", "场景", "厨房台面"), ("dorm", "场景", "学生宿舍"), ("bedside", "场景", "卧室床头"), ("camping", "场景", "露营野餐"), ("desk", "场景", "办公桌面"), ("table", "场景", "客厅茶几"), ("balcony", "场景", "阳台角落"),
    ("ceramic", "材质", "陶瓷"), ("wood", "材质", "实木"), ("abs", "材质", "abs"), ("pp", "材质", "pp"), ("silicone", "材质", "硅胶"), ("alloy", "材质", "铝合金"),
    ("quiet", "功能", "静音运行"), ("base", "功能", "磁吸底座"), ("clean", "功能", "一键清洁"), ("timer", "功能", "定时关闭"),
]
#: spelling of an attribute, field (declared).
_NAMES = [("适用场景", "场景"), ("使用场景", "场景"), ("材质", "材质"), ("用料", "材质"), ("主要材质", "材质"), ("功能", "功能"), ("附加功能", "功能")]
#: unit alias, unit (declared).
_UNITS = [("毫升", "ml"), ("毫安时", "mah"), ("千克", "kg"), ("公斤", "kg"), ("厘米", "cm"), ("毫米", "mm"), ("升", "l"), ("瓦", "w"), ("克", "g")]
_FIGURE = r"[0-9]+(?:\.[0-9]+)?(?:mah|ml|kg|cm|mm|gb|tb|l|w|g)"


def _folded_sql(col: str) -> str:
    text = f"lower({col})"
    for alias, unit in _UNITS:
        text = f"replace({text}, '{alias}', '{unit}')"
    return rf"regexp_replace({text}, '\s+', '', 'g')"


def _folded(col):
    text = F.lower(col)
    for alias, unit in _UNITS:
        text = F.replace(text, F.lit(alias), F.lit(unit))
    return F.regexp_replace(text, r"\s+", "")


_SIGNALS = rf"""q AS (SELECT row_id AS query_id, {_folded_sql("coalesce(query_text, '')")} AS text, regexp_extract(query_image_path, '([0-9]+)[.]', 1) AS product FROM retrieval_test_queries),
    cat AS (SELECT query_id, category FROM (SELECT query_id, category, row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, ord) AS r FROM q JOIN (VALUES {_V(_ALIASES)}) a(alias, category, ord) ON contains(text, alias)) WHERE r = 1),
    con AS (SELECT query_id, concept, field, term FROM q JOIN (VALUES {_V(_TERMS)}) t(concept, field, term) ON contains(text, term)
      UNION SELECT query_id, x AS concept, NULL AS field, x AS term FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(text, '{_FIGURE}'))) AS x FROM q))"""


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "retrieval_test_queries", ["row_id", "query_text", "query_image_path"])
    asked = rows.select(F.col("row_id").alias("query_id"), _folded(F.coalesce("query_text", F.lit(""))).alias("text"), F.regexp_extract("query_image_path", "([0-9]+)[.]", 1).alias("product"))
    aliases = spark.createDataFrame(_ALIASES, "alias string, category string, ord int")
    named = asked.join(F.broadcast(aliases), F.expr("contains(text, alias)")).groupBy("query_id").agg(F.min_by("category", F.struct(-F.length("alias"), "ord")).alias("category"))
    terms = spark.createDataFrame(_TERMS, "concept string, field string, term string")
    concepts = asked.join(F.broadcast(terms), F.expr("contains(text, term)")).select("query_id", "concept", "field", "term")
    found = asked.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_FIGURE), F.lit(0)))).alias("concept"))
    return asked, named, concepts.unionByName(found.select("query_id", "concept", F.lit(None).cast("string").alias("field"), F.col("concept").alias("term"))).distinct()


@query(f"WITH {_SIGNALS} SELECT q.query_id, category, concept, field, term FROM q LEFT JOIN cat USING (query_id) LEFT JOIN con USING (query_id)")
def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category a query names and every concept and figure it asks for."""
    asked, named, wanted = _signals(spark, sf_dir)
    return asked.select("query_id").join(named, "query_id", "left").join(wanted, "query_id", "left").select("query_id", "category", "concept", "field", "term")


_POOL = f"""{_SIGNALS}, u AS (SELECT x.*, category_l1 FROM ({_UNIT}) x JOIN (SELECT vec_id, category_l1 FROM feature_library) USING (vec_id)),
    own AS (SELECT query_id, min(u.vec_id) AS vec_id FROM q JOIN u ON u.product_id = q.product GROUP BY 1),
    asked AS (SELECT q.* FROM u q JOIN (SELECT DISTINCT vec_id FROM own) USING (vec_id)),
    sc AS (SELECT q.vec_id, g.vec_id AS item_id, round({_DOT}, 6) AS score FROM asked q JOIN u g ON q.vec_id <> g.vec_id),
    top AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item_id))::INT AS rank FROM sc) WHERE rank <= 20),
    pool AS (SELECT own.query_id, top.item_id, top.rank, top.score, u.product_id AS product, u.category_l2, u.category_l1 FROM own JOIN top USING (vec_id) JOIN u ON u.vec_id = top.item_id),
    nm(name, field) AS (VALUES {_V(_NAMES)}),
    said AS (SELECT DISTINCT product, coalesce(nm.field, name) AS field, value FROM (SELECT product_id AS product, name, {_folded_sql("v")} AS value FROM
      (SELECT product_id, name, unnest(vs) AS v FROM (SELECT product_id, unnest(map_keys(attributes)) AS name, unnest(map_values(attributes)) AS vs FROM lora_data WHERE product_id IS NOT NULL))) LEFT JOIN nm USING (name) WHERE value IS NOT NULL),
    ev AS (SELECT pool.query_id, item_id, concept, bool_or(coalesce(value = term, false) AND (con.field IS NULL OR coalesce(said.field = con.field, false))) AS supports,
      bool_or(coalesce(said.field = con.field, false)) AS says FROM pool JOIN con USING (query_id) LEFT JOIN said ON said.product = pool.product GROUP BY 1, 2, 3)"""


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates by picture, the categories named, and evidence for every constraint."""
    asked, named, wanted = _signals(spark, sf_dir)
    library = table(spark, sf_dir, "feature_library", ["vec_id", "product_id", "category_l1", "category_l2", "embedding"])
    from wareloom.functions import vectors as V

    sound = library.where(V.usable(V.doubles(F.col("embedding")), 64))
    own = asked.join(sound, sound["product_id"] == asked["product"]).groupBy("query_id").agg(F.min("vec_id").alias("vec_id"))
    vectors = sound.select(F.col("vec_id").alias("id"), "embedding")
    top = retrieval.exact_top_k(vectors.join(own.select(F.col("vec_id").alias("id")).distinct(), "id"), vectors, 20).withColumnRenamed("query_id", "vec_id")
    about = sound.select(F.col("vec_id").alias("item_id"), F.col("product_id").alias("product"), "category_l1", "category_l2")
    pool = own.join(top, "vec_id").drop("vec_id").join(about, "item_id")
    names = spark.createDataFrame(_NAMES, "name string, canonical string")
    listed = table(spark, sf_dir, "lora_data", ["product_id", "attributes"]).where("product_id IS NOT NULL").select(F.col("product_id").alias("product"), F.explode("attributes").alias("name", "vs")).distinct()
    said = listed.join(F.broadcast(names), "name", "left").select("product", F.coalesce("canonical", "name").alias("field"), F.explode("vs").alias("v")).select("product", "field", _folded(F.col("v")).alias("value")).distinct()
    return pool, named, rerank.stated_evidence(pool.select("query_id", "item_id", "product"), wanted, said)


@query(f"WITH {_POOL} SELECT query_id, item_id, concept, CASE WHEN supports THEN 'support' WHEN says THEN 'conflict' ELSE 'unknown' END AS verdict FROM ev")
def stated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every candidate says to every constraint of its query."""
    _, _, told = _pool(spark, sf_dir)
    return rerank.evidence(told).select("query_id", "item_id", "concept", "verdict")


@query(
    f"""WITH {_POOL}, l1 AS (SELECT category_l2 AS category, min(category_l1) AS above FROM feature_library WHERE category_l2 IS NOT NULL GROUP BY 1),
        agg AS (SELECT query_id, item_id, count(*) AS wanted, count_if(supports) AS supported, count_if(says AND NOT supports) AS conflicting FROM ev GROUP BY 1, 2),
        x AS (SELECT p.query_id, p.item_id, rank, score, CASE WHEN category IS NULL OR category = category_l2 THEN 1.0::DOUBLE WHEN coalesce(above = category_l1, false) THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS factor,
          coalesce(supported, 0) AS supported, coalesce(conflicting, 0) AS conflicting, coalesce(wanted, 0) AS wanted
          FROM pool p LEFT JOIN cat USING (query_id) LEFT JOIN l1 USING (category) LEFT JOIN agg ON agg.query_id = p.query_id AND agg.item_id = p.item_id),
        y AS (SELECT *, floor((score * factor + 0.24::DOUBLE * (CASE WHEN wanted > 0 THEN supported / wanted::DOUBLE ELSE 0 END) - 0.12::DOUBLE * (CASE WHEN wanted > 0 THEN conflicting / wanted::DOUBLE ELSE 0 END)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS new_score FROM x)
        SELECT query_id, item_id, rank, factor, new_score, (row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank, item_id))::INT AS new_rank FROM y"""
)
def signal_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by picture reordered by category, supported and conflicting constraints."""
    from pyspark.sql import Window as W

    pool, named, told = _pool(spark, sf_dir)
    counts = told.groupBy("query_id", "item_id").agg(F.count("*").alias("wanted"), F.count_if("supports").alias("supported"), F.count_if("conflicts").alias("conflicting"))
    above = table(spark, sf_dir, "feature_library", ["category_l1", "category_l2"]).where("category_l2 IS NOT NULL").groupBy(F.col("category_l2").alias("category")).agg(F.min("category_l1").alias("above"))
    joined = pool.join(named, "query_id", "left").join(above, "category", "left").join(counts, ["query_id", "item_id"], "left")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("wanted"), F.lit(0)), F.lit(0.0))
    scored = joined.withColumn("factor", rerank.category_factor("category", "above", "category_l2", "category_l1")).withColumn(
        # rounded by the same floating-point steps everywhere, so that ties are ties in every engine
        "new_score", F.floor((F.col("score") * F.col("factor") + 0.24 * share("supported") - 0.12 * share("conflicting")) * 1e6 + 0.5) / 1e6
    )
    order = W.partitionBy("query_id").orderBy(F.desc("new_score"), "rank", "item_id")
    return scored.select("query_id", "item_id", "rank", "factor", "new_score", F.row_number().over(order).alias("new_rank"))


@query(
    f"""{_E_TOP}, {_C_SQL}, g AS (SELECT d AS depth, a / 10.0::DOUBLE AS support_weight, b / 10.0::DOUBLE AS conflict_weight FROM (VALUES (15), (20)) z(d), range(0, 11) x(a), range(0, 9) y(b)),
        t AS (SELECT c.*, depth, support_weight, conflict_weight, rank <= depth AS in_pool, CASE WHEN rank <= depth THEN {_SCORE.format(a="support_weight", b="conflict_weight")} END AS s FROM c, g),
        o AS (SELECT *, row_number() OVER (PARTITION BY depth, support_weight, conflict_weight, query_id ORDER BY in_pool DESC, s DESC NULLS LAST, rank, item_id) AS rr,
          row_number() OVER (PARTITION BY depth, support_weight, conflict_weight, query_id ORDER BY grade DESC) AS bb FROM t),
        p AS (SELECT depth, support_weight, conflict_weight, query_id, sum(CASE WHEN rr <= 10 AND grade >= 1 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS p,
          sum(CASE WHEN rr <= 10 AND grade >= 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum((grade >= 1)::INT), 0) AS rec,
          sum(CASE WHEN rr <= 10 THEN (2.0::DOUBLE ** grade - 1) / log2(rr + 1.0::DOUBLE) ELSE 0 END) / nullif(sum(CASE WHEN bb <= 10 THEN (2.0::DOUBLE ** grade - 1) / log2(bb + 1.0::DOUBLE) ELSE 0 END), 0) AS n,
          max(CASE WHEN rr <= 10 AND grade >= 1 THEN 1.0::DOUBLE / rr ELSE 0 END) AS m FROM o GROUP BY 1, 2, 3, 4 HAVING sum((grade >= 1)::INT) > 0),
        a AS (SELECT depth, support_weight, conflict_weight, round(avg(p), 6) AS precision, round(avg(rec), 6) AS recall, round(avg(n), 6) AS ndcg, round(avg(m), 6) AS mrr FROM p GROUP BY 1, 2, 3)
        SELECT *, (row_number() OVER (ORDER BY precision DESC, recall DESC, ndcg DESC, mrr DESC, support_weight, conflict_weight, depth))::INT AS place FROM a"""
)
def rerank_grid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 198 parameter sets with four metrics, in the order of choice."""
    grid = spark.createDataFrame([(d, a / 10, b / 10) for d in (15, 20) for a in range(11) for b in range(9)], "depth int, support_weight double, conflict_weight double")
    return rerank.full_grid(_candidates(spark, sf_dir), grid, 10)
