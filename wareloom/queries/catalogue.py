"""Raw feed: census, reject cascade, URLs, fingerprints, packed fields, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.functions.hashing import map_fingerprint
from wareloom.functions.replies import FIGURE_PATTERN
from wareloom.functions.text import letters_only, width_map
from wareloom.functions.urls import canonical_url, host_allowed, id_from_path
from wareloom.operators import census, dedup, facts, packed, review, validate
from wareloom.plans import curation
from wareloom.queries.registry import query
from wareloom.session import table

HOSTS = tuple(f"img{i}.shelfpics.example" for i in range(4))
_HOSTS_SQL = ", ".join(f"'{h}'" for h in HOSTS)


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.packed_items(
        table(spark, sf_dir, "pv_parser", ["row_id", "attributes"]), table(spark, sf_dir, "rag", ["row_id", "blocked_fields"])
    )


@query("SELECT label, count(*) AS rows FROM pv_parser GROUP BY label")
def label_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.label_census(table(spark, sf_dir, "pv_parser", ["label"]), "label")


@query(
    """SELECT field, count(v) AS present, count_if(trim(v) = '')::BIGINT AS empty FROM (
         SELECT 'label' AS field, label AS v FROM pv_parser UNION ALL SELECT 'attributes', attributes FROM pv_parser
         UNION ALL SELECT 'url', url FROM pv_parser UNION ALL SELECT 'seller_id', seller_id FROM pv_parser) GROUP BY field"""
)
def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["label", "attributes", "url", "seller_id"]
    return census.field_presence(table(spark, sf_dir, "pv_parser", fields), fields)


@query(
    """WITH lookup AS (SELECT category_l2, min(category_l1) AS category_l1 FROM feature_library WHERE category_l2 IS NOT NULL GROUP BY 1)
       SELECT l.category_l1, d.source, count(*) AS docs, sum(d.n_chars)::BIGINT AS chars
       FROM documents d JOIN lookup l USING (category_l2) GROUP BY 1, 2"""
)
def category_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = (
        table(spark, sf_dir, "feature_library", ["category_l1", "category_l2"]).where("category_l2 IS NOT NULL")
        .groupBy("category_l2").agg(F.min("category_l1").alias("category_l1"))
    )
    docs = table(spark, sf_dir, "documents", ["category_l2", "source", "n_chars"])
    joined = census.lookup_unique(docs, lookup, "category_l2")
    return joined.groupBy("category_l1", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


_CASCADE = f"""SELECT row_id, CASE
    WHEN label IS NULL OR trim(label) = '' THEN 'no_label'
    WHEN url IS NULL OR lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) NOT IN ('http', 'https')
      OR lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) NOT IN ({_HOSTS_SQL}) THEN 'bad_url'
    WHEN attributes IS NULL OR trim(attributes) = '' THEN 'no_attributes'
    WHEN length(attributes) > 220 THEN 'attributes_too_long'
    WHEN contains(attributes, '详见主图') OR contains(attributes, '咨询后下单') THEN 'excluded_term'
    ELSE 'accepted' END AS reason FROM pv_parser"""


@query(_CASCADE)
def reject_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "pv_parser", ["row_id", "label", "url", "attributes"])
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules = [
        ("no_label", blank("label")),
        ("bad_url", ~host_allowed(F.col("url"), HOSTS)),
        ("no_attributes", blank("attributes")),
        ("attributes_too_long", F.char_length("attributes") > 220),
        ("excluded_term", census.contains_any(F.col("attributes"), ["详见主图", "咨询后下单"])),
    ]
    return census.first_failure(feed, rules).select("row_id", "reason")


@query(f"SELECT reason, count(*) AS rows FROM ({_CASCADE}) GROUP BY reason")
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_cascade(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("rows"))


_CANON = """'https://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)
    || regexp_extract(url, '(\\?[^#]*)', 1)"""


@query(f"SELECT row_id, {_CANON} AS canonical FROM pv_parser")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pv_parser", ["row_id", "url"]).select("row_id", canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT sha256({_CANON}) AS url_hash, count(*) AS copies, min(row_id) AS kept FROM pv_parser WHERE url IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def url_fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "pv_parser", ["row_id", "url"]).select("row_id", F.sha2(canonical_url(F.col("url")), 256).alias("url_hash"))
    return dedup.first_wins(feed, "url_hash", "row_id").where("copies >= 2")


@query(
    """WITH f AS (SELECT row_id, sha256(chr(10) || array_to_string(list_transform(list_sort(map_keys(attributes)),
              lambda k: k || '=' || array_to_string(list_sort(map_extract(attributes, k)[1]), ',')), ';')) AS fingerprint FROM lora_data
              WHERE attributes IS NOT NULL)
       SELECT fingerprint, count(*) AS copies, min(row_id) AS kept FROM f GROUP BY 1"""
)
def content_fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lora_data", ["row_id", "attributes"]).where("attributes IS NOT NULL")
    marked = rows.select("row_id", map_fingerprint(F.lit(None).cast("string"), F.col("attributes")).alias("fingerprint"))
    return dedup.first_wins(marked, "fingerprint", "row_id")


# one row after the other, with what was kept so far: the rule as it is stated
_GREEDY = r"""WITH RECURSIVE feed AS (SELECT row_number() OVER (ORDER BY row_id) AS i, row_id, product_id, sha256(attributes) AS content, {image} AS image FROM pv_parser),
    walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS ordinal, ['']::VARCHAR[] AS p, ['']::VARCHAR[] AS c, ['']::VARCHAR[] AS m, NULL::VARCHAR AS reason
      UNION ALL SELECT i, ordinal, CASE WHEN reason IS NULL THEN list_append(p, coalesce(product_id, '')) ELSE p END, CASE WHEN reason IS NULL THEN list_append(c, coalesce(content, '')) ELSE c END,
        CASE WHEN reason IS NULL THEN list_append(m, coalesce(image, '')) ELSE m END, reason
      FROM (SELECT f.i, f.row_id AS ordinal, w.p, w.c, w.m, f.product_id, f.content, f.image, CASE WHEN coalesce(list_contains(w.p, f.product_id), false) THEN 'product_id'
        WHEN coalesce(list_contains(w.c, f.content), false) THEN 'content' WHEN coalesce(list_contains(w.m, f.image), false) THEN 'image' END AS reason FROM walk w JOIN feed f ON f.i = w.i + 1))
    SELECT ordinal AS row_id, reason IS NULL AS kept, reason FROM walk WHERE ordinal IS NOT NULL"""


@query(_GREEDY.format(image=f"sha256({_CANON})"))
def greedy_multikey_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent; checked against a sequential model in the tests."""
    feed = table(spark, sf_dir, "pv_parser", ["row_id", "product_id", "attributes", "url"]).select(
        "row_id", "product_id", F.sha2("attributes", 256).alias("content"), F.sha2(canonical_url(F.col("url")), 256).alias("image")
    )
    return dedup.greedy_multikey(feed, "row_id", ["product_id", "content", "image"])


@query(
    """SELECT sha256(text) AS signature, min(doc_id) AS kept, count(*) AS copies FROM documents
       WHERE text IS NOT NULL AND text <> '' GROUP BY 1"""
)
def single_key_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"]).where("text <> ''")
    return dedup.first_wins(docs.select("doc_id", F.sha2("text", 256).alias("signature")), "signature", "doc_id")


@query(
    """WITH feed AS (SELECT DISTINCT product_id FROM pv_parser WHERE product_id IS NOT NULL),
       s AS (SELECT DISTINCT product_id, 'lora_data' AS source FROM lora_data UNION SELECT DISTINCT product_id, 'rag' FROM rag
             UNION SELECT DISTINCT product_id, 'review' FROM week2_train_consistency_review)
       SELECT feed.product_id, coalesce(string_agg(source, ',' ORDER BY source), '') AS found_in
       FROM feed LEFT JOIN s USING (product_id) GROUP BY 1"""
)
def source_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "pv_parser", ["product_id"]).where("product_id IS NOT NULL").distinct()
    names = {"lora_data": "lora_data", "rag": "rag", "review": "week2_train_consistency_review"}
    return census.trace_sources(feed, "product_id", {k: table(spark, sf_dir, v, ["product_id"]) for k, v in names.items()})


@query(
    """WITH s AS (SELECT DISTINCT product_id AS k, 'lora_data' AS s FROM lora_data WHERE product_id IS NOT NULL
             UNION ALL SELECT DISTINCT product_id, 'pv_parser' FROM pv_parser WHERE product_id IS NOT NULL
             UNION ALL SELECT DISTINCT product_id, 'rag' FROM rag WHERE product_id IS NOT NULL
             UNION ALL SELECT DISTINCT product_id, 'smoke_test' FROM smoke_test WHERE product_id IS NOT NULL)
       SELECT a.s AS set_a, b.s AS set_b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2"""
)
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["lora_data", "pv_parser", "rag", "smoke_test"]
    return census.overlap_matrix({n: table(spark, sf_dir, n, ["product_id"]) for n in names}, "product_id")


@query(
    """SELECT row_id, regexp_replace(lower(title), '[^0-9a-z一-鿿]+', '', 'g') AS form FROM week2_train_consistency_review WHERE title IS NOT NULL"""
)
def comparable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title"]).where("title IS NOT NULL")
    return rows.select("row_id", F.regexp_replace(F.lower("title"), r"[^0-9a-z一-鿿]+", "").alias("form"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    f"""SELECT form, count(*) AS rows, min(row_id) AS first FROM (SELECT row_id, regexp_replace(lower(translate(title, {_literal(width_map()[0])}, {_literal(width_map()[1])})), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS form
        FROM week2_train_consistency_review WHERE title IS NOT NULL) GROUP BY 1"""
)
def comparable_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width-folded comparable forms and how many rows share each."""
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title"]).where("title IS NOT NULL")
    return rows.select("row_id", letters_only(F.col("title")).alias("form")).groupBy("form").agg(F.count("*").alias("rows"), F.min("row_id").alias("first"))


_ISSUES = """WITH parts AS (SELECT row_id, unnest(string_split(attributes, '#;#')) AS p FROM pv_parser WHERE attributes IS NOT NULL),
    judged AS (SELECT row_id, CASE WHEN trim(p) = '' THEN 'empty_part' WHEN len(string_split(p, '#:#')) <> 2 THEN 'bad_separator'
        WHEN trim(string_split(p, '#:#')[1]) = '' THEN 'empty_name' WHEN trim(string_split(p, '#:#')[2]) = '' THEN 'empty_value' END AS issue FROM parts)
    SELECT row_id, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues FROM judged WHERE issue IS NOT NULL GROUP BY row_id
    UNION ALL SELECT row_id, 'not_text' FROM pv_parser WHERE attributes IS NULL"""


@query(_ISSUES)
def multimap_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pv_parser", ["row_id", "attributes"])
    found = rows.select("row_id", facts.multimap_issues(F.col("attributes")).alias("i")).where(F.size("i") > 0)
    return found.select("row_id", F.array_join("i", ",").alias("issues"))


@query(
    """WITH parts AS (SELECT row_id, unnest(string_split(attributes, '#;#')) AS p, generate_subscripts(string_split(attributes, '#;#'), 1) AS place
             FROM pv_parser WHERE contains(attributes, '#:#')),
       pairs AS (SELECT row_id, place, trim(left(p, strpos(p, '#:#') - 1)) AS name, trim(substr(p, strpos(p, '#:#') + 3)) AS value FROM parts WHERE contains(p, '#:#')),
       firsts AS (SELECT row_id, name, value, min(place) AS place FROM pairs WHERE name <> '' AND value <> '' GROUP BY 1, 2, 3)
       SELECT row_id, name, string_agg(value, '|' ORDER BY place) AS item_values FROM firsts GROUP BY 1, 2"""
)
def multimap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pv_parser", ["row_id", "attributes"]).where(F.col("attributes").contains("#:#"))
    pairs = rows.select("row_id", F.explode(facts.parse_multimap(F.col("attributes"))).alias("e"))
    return pairs.select("row_id", F.col("e.name").alias("name"), F.array_join("e.values", "|").alias("item_values"))


@query(
    """SELECT row_id, product_id, regexp_extract(query_image_path, '([0-9]+)\\.[^./]+$', 1) AS restored FROM retrieval_test_queries
       WHERE product_id IS NULL OR product_id <> regexp_extract(query_image_path, '([0-9]+)\\.[^./]+$', 1)"""
)
def id_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_test_queries", ["row_id", "product_id", "query_image_path"])
    restored = rows.withColumn("restored", id_from_path(F.col("query_image_path"))).where("restored IS NOT NULL AND NOT (product_id <=> restored)")
    return restored.select("row_id", "product_id", "restored")


@query(
    f"""WITH t AS (SELECT row_id, unnest(list_distinct(list_transform(regexp_extract_all(title, '{FIGURE_PATTERN}'), lambda x: lower(x)))) AS figure
             FROM week2_train_consistency_review) SELECT figure, count(*) AS rows FROM t GROUP BY 1"""
)
def figure_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wareloom.functions.replies import figures

    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title"])
    return rows.select(F.explode(figures(F.col("title"))).alias("figure")).groupBy("figure").agg(F.count("*").alias("rows"))


@query(
    """SELECT row_id, 'label' AS field FROM pv_parser WHERE label IS NULL OR trim(label) = ''
       UNION ALL SELECT row_id, 'attributes' FROM pv_parser WHERE attributes IS NULL OR trim(attributes) = ''
       UNION ALL SELECT row_id, 'url' FROM pv_parser WHERE url IS NULL OR trim(url) = ''"""
)
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.missing_fields(table(spark, sf_dir, "pv_parser", ["row_id", "label", "attributes", "url"]), "row_id", ["label", "attributes", "url"])


@query("SELECT product_id, count(*) AS rows FROM feature_library GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated_keys(table(spark, sf_dir, "feature_library", ["product_id"]), ["product_id"])


@query(
    """SELECT n_name, o_orderpriority, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY GROUPING SETS ((n_name), (o_orderpriority), ())"""
)
def star_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"])
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    customer, nation = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]), table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    sets = [[F.col("n_name")], [F.col("o_orderpriority")], []]
    return joined.groupingSets(sets, "n_name", "o_orderpriority").agg(
        F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query()
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a whole table; equal for any order and partitioning (tested)."""
    columns = ["row_id", "product_id", "label", "url", "seller_id", "attributes"]
    return review.table_digest(table(spark, sf_dir, "pv_parser", columns), columns)


def _funnel(spark: SparkSession, sf_dir: str) -> curation.Funnel:
    feed = table(spark, sf_dir, "pv_parser", ["row_id", "product_id", "label", "url", "attributes"])
    labels = table(spark, sf_dir, "feature_library", ["category_l2"]).where("category_l2 IS NOT NULL").distinct()
    categories = labels.select(F.col("category_l2").alias("label"), F.col("category_l2").alias("category"))
    sources = {"lora_data": table(spark, sf_dir, "lora_data", ["product_id"]), "rag": table(spark, sf_dir, "rag", ["product_id"])}
    return curation.curate(feed, categories, curation.standard_rules(), 50, sources)


@query()
def curation_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole funnel; its parts have SQL of their own."""
    return _funnel(spark, sf_dir).selected.select("row_id", "product_id", "category", "split", "found_in")


@query()
def curation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).reasons
