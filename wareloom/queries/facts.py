"""Fact units, gates, fused rankings, zones, grounding, instruction records.

The records are the feature rows of the audit table (``rag``), whose attributes are JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.functions.replies import FIGURE_PATTERN, listed_points, reply_status
from wareloom.operators import dedup, facts, grounding, paired, retrieval, validate
from wareloom.queries.registry import query
from wareloom.session import table

#: spelling, field, role, order
_POLICY = [
    ("品牌", "品牌", "identity", 1), ("牌子", "品牌", "identity", 1), ("Brand", "品牌", "identity", 1),
    ("型号", "型号", "identity", 2), ("产品型号", "型号", "identity", 2), ("货号", "型号", "identity", 2),
    ("系列", "系列", "identity", 3), ("产品系列", "系列", "identity", 3),
    ("功率", "功率", "spec", 4), ("额定功耗", "功率", "spec", 4), ("容量", "容量", "spec", 5), ("净容量", "容量", "spec", 5),
    ("净重", "净重", "spec", 6), ("重量", "净重", "spec", 6), ("单品重量", "净重", "spec", 6), ("材质", "材质", "material", 7),
    ("用料", "材质", "material", 7), ("主要材质", "材质", "material", 7), ("颜色", "颜色", "choice", 8), ("色系", "颜色", "choice", 8),
    ("颜色分类", "颜色", "choice", 8), ("功能", "功能", "usage", 9), ("附加功能", "功能", "usage", 9), ("适用场景", "场景", "usage", 10), ("使用场景", "场景", "usage", 10),
]
_POLICY_SCHEMA = "name string, field string, role string, field_order int"
_SETS = ("颜色", "功能", "场景")
_PRIORITY = [("title", "identity", 1), ("title", "spec", 2), ("points", "usage", 1), ("points", "spec", 2), ("points", "material", 3), ("text", "identity", 1), ("text", "material", 2), ("text", "usage", 3)]
_V = lambda rows: ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)

_PAIRS_SQL = """pairs AS (SELECT row_id AS record_id, k AS name, json_extract(attributes, '$."' || k || '"')::VARCHAR[] AS given
    FROM (SELECT row_id, attributes, unnest(json_keys(attributes)) AS k FROM rag WHERE json_valid(attributes)))"""
_FACTS_SQL = f"""{_PAIRS_SQL},
    clean AS (SELECT record_id, name, list_filter(list_transform(given, lambda v: trim(v)), lambda v: v IS NOT NULL AND v <> '') AS vs FROM pairs),
    policy(name, field, role, field_order) AS (VALUES {_V(_POLICY)}),
    ranked AS (SELECT record_id, field, role, field_order, vs, row_number() OVER (PARTITION BY record_id, field
        ORDER BY CASE WHEN name = field THEN 0 ELSE 1 END, name) AS r FROM clean JOIN policy USING (name) WHERE len(vs) > 0),
    facts AS (SELECT record_id, field, role, field_order, array_to_string(vs, ',') AS item_values, len(vs)::INT AS n_values,
        concat_ws(':', record_id::VARCHAR, field, substr(sha256(array_to_string(vs, ',')), 1, 12)) AS fact_id FROM ranked WHERE r = 1)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "rag", ["row_id", "attributes"])
    return rows.select(F.col("row_id").alias("record_id"), F.from_json("attributes", "map<string,array<string>>").alias("attributes")).where("attributes IS NOT NULL")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fact_units(_records(spark, sf_dir), spark.createDataFrame(_POLICY, _POLICY_SCHEMA))


@query(f"WITH {_FACTS_SQL} SELECT record_id, field, role, field_order, fact_id, item_values, n_values FROM facts")
def fact_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).withColumnRenamed("values", "item_values")


# an own parse of the packed list: quoted pieces, declared compounds, pieces with brackets, plain pieces
_LISTED = r"""\s*"(?:[^"]|"")*"|\s*“[^”]*”|\s*‘[^’]*’|\s*「[^」]*」|\s*『[^』]*』|\s*\x27[^\x27]*\x27|\s*(?:电压/频率|认证\|备案号|档位;模式)|[^;；,，、|/\t\n\r()（）]*[(（][^()（）]*[)）][^;；,，、|/\t\n\r()（）]*|[^;；,，、|/\t\n\r]+"""
_QUALITY_SQL = f"""{_FACTS_SQL},
    bf AS (SELECT row_id, status, trim(blocked_fields) AS t FROM rag WHERE blocked_fields IS NOT NULL),
    pieces AS (SELECT row_id, status, regexp_replace(unnest(regexp_extract_all(CASE WHEN t LIKE '[%]' THEN t[2:-2] ELSE t END, '{_LISTED}')), '^[\\s　]+|[\\s　]+$', '', 'g') AS piece FROM bf),
    named AS (SELECT row_id AS record_id, status, trim(CASE WHEN regexp_matches(piece, '^(?:".*"|“.*”|‘.*’|「.*」|『.*』|''.*'')$') AND length(piece) > 1 THEN replace(piece[2:-2], '""', '"') ELSE piece END) AS name FROM pieces),
    marks AS (SELECT DISTINCT record_id, coalesce(p.field, named.name) AS field, status FROM named LEFT JOIN policy p ON p.name = named.name),
    m AS (SELECT record_id, field, max((status = 'CONFLICT')::INT) AS conflict, max((status = 'REVIEW')::INT) AS review FROM marks WHERE field <> '' GROUP BY 1, 2),
    j AS (SELECT f.*, conflict, review FROM facts f LEFT JOIN m USING (record_id, field)),
    bad AS (SELECT DISTINCT record_id FROM j WHERE role = 'identity' AND conflict = 1),
    q AS (SELECT j.*, CASE WHEN bad.record_id IS NOT NULL OR coalesce(conflict = 1, false) THEN 'blocked'
        WHEN coalesce(review = 1, false) OR (n_values > 1 AND field NOT IN ('颜色', '功能', '场景')) THEN 'withheld' ELSE 'usable' END AS quality
        FROM j LEFT JOIN bad USING (record_id))"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "rag", ["row_id", "blocked_fields", "status"])
    marks = facts.audit_marks(rows.withColumnRenamed("row_id", "record_id"), spark.createDataFrame(_POLICY, _POLICY_SCHEMA))
    return facts.fact_quality(_facts(spark, sf_dir), marks, _SETS)


@query(f"WITH {_QUALITY_SQL} SELECT record_id, field, status FROM marks WHERE field <> ''")
def audit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields every audit row marks, under their canonical names."""
    rows = table(spark, sf_dir, "rag", ["row_id", "blocked_fields", "status"])
    return facts.audit_marks(rows.withColumnRenamed("row_id", "record_id"), spark.createDataFrame(_POLICY, _POLICY_SCHEMA)).distinct()


@query(f"WITH {_QUALITY_SQL} SELECT role, quality, count(*) AS facts, count(DISTINCT record_id) AS records FROM q GROUP BY 1, 2")
def fact_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).groupBy("role", "quality").agg(F.count("*").alias("facts"), F.count_distinct("record_id").alias("records"))


_RANK_SQL = f"""{_QUALITY_SQL}, pr(list, role, priority) AS (VALUES {_V(_PRIORITY)}),
    ranks AS (SELECT record_id, fact_id, t.list, row_number() OVER (PARTITION BY record_id, t.list ORDER BY coalesce(priority, 1000000), field_order, field, fact_id) AS rank
        FROM q CROSS JOIN (SELECT DISTINCT list FROM pr) t LEFT JOIN pr ON pr.list = t.list AND pr.role = q.role WHERE quality = 'usable')"""


def _ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    quality = _quality(spark, sf_dir)
    return quality, facts.task_rankings(quality, spark.createDataFrame(_PRIORITY, "list string, role string, priority int"))


@query(f"WITH {_RANK_SQL} SELECT record_id, list, fact_id, rank::INT AS rank FROM ranks WHERE rank <= 3")
def task_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer facts than asked for stay fewer."""
    return _ranks(spark, sf_dir)[1].where("rank <= 3").select("record_id", "list", "fact_id", "rank")


_FUSED_SQL = f"""{_RANK_SQL}, f0 AS (SELECT record_id, fact_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused, sum(rank)::BIGINT AS rank_sum FROM ranks GROUP BY 1, 2),
    fu AS (SELECT *, (row_number() OVER (PARTITION BY record_id ORDER BY fused DESC, rank_sum, fact_id))::INT AS position FROM f0)"""


@query(f"WITH {_FUSED_SQL} SELECT record_id, fact_id, fused, rank_sum, position FROM fu WHERE position <= 3")
def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(_ranks(spark, sf_dir)[1], "record_id", "fact_id").where("position <= 3")


_ZONES_SQL = f"""{_FUSED_SQL}, p AS (SELECT record_id, fact_id, CASE WHEN role = 'identity' THEN 'identity'
      WHEN len(list_filter(string_split(item_values, ','), lambda v: lower(v) NOT IN ('pp', 'abs'))) = 0 THEN 'negative'
      WHEN field IN ('功率', '容量') THEN 'mandatory' END AS zone FROM q WHERE quality = 'usable'),
    rest AS (SELECT record_id, fact_id, row_number() OVER (PARTITION BY record_id ORDER BY position) AS r FROM p JOIN fu USING (record_id, fact_id) WHERE zone IS NULL),
    z AS (SELECT record_id, fact_id, zone FROM p WHERE zone IS NOT NULL UNION ALL SELECT record_id, fact_id, 'supplemental' FROM rest WHERE r <= 3)"""


@query(f"WITH {_ZONES_SQL} SELECT record_id, fact_id, zone FROM z")
def four_zone_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality, ranks = _ranks(spark, sf_dir)
    fused = retrieval.reciprocal_rank_fusion(ranks, "record_id", "fact_id")
    return facts.zones(quality, fused, ("pp", "abs"), ("功率", "容量"), 3)


@query(f"WITH {_ZONES_SQL} SELECT record_id, fact_id, count(DISTINCT zone) AS zones FROM z GROUP BY 1, 2 HAVING count(DISTINCT zone) > 1")
def zone_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.in_several_zones(four_zone_context(spark, sf_dir), ["record_id", "fact_id"], "zone")


_VALUES_SQL = f"{_PAIRS_SQL}, v AS (SELECT record_id, name, unnest(given) AS value FROM pairs)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("record_id", F.explode("attributes").alias("name", "given")).select("record_id", "name", F.explode("given").alias("value"))


@query(
    f"""WITH {_VALUES_SQL}, parts AS (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(trim(value)), '[/、,，;；|]'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM v)
        SELECT record_id, name, value FROM parts WHERE lower(trim(value)) IN ('其他', '无', 'abs', 'pp') OR (len(ps) >= 2 AND len(list_filter(ps, lambda x: x NOT IN ('其他', '无', 'abs', 'pp'))) = 0)"""
)
def placeholder_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).where(facts.is_placeholder(F.col("value"), ("其他", "无", "abs", "pp")))


@query(
    f"""WITH {_VALUES_SQL}, g AS (SELECT record_id, name, value, CASE WHEN trim(value) = '' THEN 'blank' WHEN name IN ('产地', '生产地') THEN 'excluded_field'
          WHEN name IN ('功率', '容量', '净重') AND NOT regexp_matches(value, '[0-9]') THEN 'no_digit' WHEN length(value) > 12 THEN 'too_long' ELSE 'kept' END AS gate FROM v),
        r AS (SELECT *, row_number() OVER (PARTITION BY record_id, name, lower(value), gate ORDER BY value) AS n FROM g)
        SELECT CASE WHEN gate = 'kept' AND n > 1 THEN 'repeated' ELSE gate END AS gate, name, count(*) AS values_held FROM r GROUP BY 1, 2"""
)
def value_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rules = [
        ("blank", F.trim(v) == ""), ("excluded_field", F.col("name").isin("产地", "生产地")),
        ("no_digit", F.col("name").isin("功率", "容量", "净重") & ~v.rlike("[0-9]")), ("too_long", F.char_length(v) > 12),
    ]
    gated = facts.value_gates(_values(spark, sf_dir), "record_id", "name", "value", rules)
    return gated.groupBy("gate", "name").agg(F.count("*").alias("values_held"))


_TURNS = "SELECT row_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS turn FROM lora_data"


@query(f"SELECT row_id, turn::INT AS turn, m.role AS role, length(m.content) AS chars FROM ({_TURNS})")
def instruction_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lora_data", ["row_id", "messages"]).select("row_id", F.posexplode("messages").alias("at", "m"))
    return rows.select("row_id", (F.col("at") + 1).alias("turn"), F.col("m.role").alias("role"), F.char_length("m.content").cast("long").alias("chars"))


@query("SELECT task_type, category_l1, count(*) AS rows, count(DISTINCT product_id) AS products FROM lora_data GROUP BY GROUPING SETS ((task_type), (category_l1), (task_type, category_l1), ())")
def instruction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lora_data", ["task_type", "category_l1", "product_id"])
    sets = [[F.col("task_type")], [F.col("category_l1")], [F.col("task_type"), F.col("category_l1")], []]
    return rows.groupingSets(sets, "task_type", "category_l1").agg(F.count("*").alias("rows"), F.count_distinct("product_id").alias("products"))


@query(
    """SELECT product_id, count(DISTINCT task_type) AS tasks, count(DISTINCT lower(trim(split))) AS splits FROM lora_data WHERE product_id IS NOT NULL
       GROUP BY 1 HAVING count(DISTINCT task_type) <> 3 OR count(DISTINCT lower(trim(split))) > 1"""
)
def instruction_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without exactly three tasks or in several splits."""
    rows = table(spark, sf_dir, "lora_data", ["product_id", "task_type", "split"]).where("product_id IS NOT NULL")
    counted = rows.groupBy("product_id").agg(F.count_distinct("task_type").alias("tasks"), F.count_distinct(F.lower(F.trim("split"))).alias("splits"))
    return counted.where("tasks <> 3 OR splits > 1")


@query(
    f"""WITH t AS ({_TURNS}), a AS (SELECT row_id, sum(CASE WHEN m.role <> 'assistant' THEN length(m.content) ELSE 0 END)::BIGINT AS prompt_chars,
            sum(CASE WHEN m.role = 'assistant' THEN length(m.content) ELSE 0 END)::BIGINT AS target_chars, max(turn) AS last_turn,
            max(CASE WHEN m.role = 'assistant' THEN turn END) AS answer_turn FROM t GROUP BY 1)
        SELECT row_id, prompt_chars, target_chars, coalesce(answer_turn = last_turn, false) AS ends_with_answer FROM a"""
)
def chat_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is prompt and how much is supervised, counted in characters."""
    rows = table(spark, sf_dir, "lora_data", ["row_id", "messages"]).where(F.size("messages") > 0)

    def chars(keep):
        return F.aggregate(F.filter("messages", keep), F.lit(0).cast("long"), lambda s, m: s + F.coalesce(F.char_length(m["content"]).cast("long"), F.lit(0)))

    return rows.select(
        "row_id", chars(lambda m: m["role"] != "assistant").alias("prompt_chars"), chars(lambda m: m["role"] == "assistant").alias("target_chars"),
        (F.element_at("messages", -1)["role"] == "assistant").alias("ends_with_answer"),
    )


@query()
def reply_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reply holds the object asked for; JSON leniency differs between engines, so no SQL."""
    rows = table(spark, sf_dir, "smoke_test", ["row_id", "raw_output"])
    return rows.select("row_id", F.coalesce(reply_status(F.col("raw_output")), F.lit("no_object")).alias("status"))


@query(
    r"""WITH t AS (SELECT row_id, trim(messages[-1].content) AS text FROM lora_data WHERE task_type = 'selling_points' AND len(messages) > 0)
        SELECT row_id, CASE WHEN text IS NULL THEN NULL WHEN starts_with(text, '[') AND json_valid(text) THEN json_array_length(text)
          ELSE len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[ \t]*(?:[-*·•]|[0-9]+[.、)])[ \t]*', ''))), lambda x: x <> '')) END::INT AS points FROM t"""
)
def listed_points_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of list replies in JSON, bulleted or numbered form."""
    rows = table(spark, sf_dir, "lora_data", ["row_id", "task_type", "messages"]).where("task_type = 'selling_points' AND size(messages) > 0")
    return rows.select("row_id", F.size(listed_points(F.element_at("messages", -1)["content"])).alias("points"))


_PATTERNS = [("figure", "[0-9]+(?:ml|mAh|W|kg|g|cm)"), ("evaluative", "最好|第一|顶级|完美"), ("code", "[A-Z]{2}[0-9]{4}[A-Z]{2}")]
_FIND_SQL = f"""hits AS (SELECT row_id AS text_id, class, coalesce(generation_input, '') AS facts, unnest(regexp_extract_all(raw_output, pattern)) AS span
      FROM smoke_test CROSS JOIN (VALUES {_V(_PATTERNS)}) p(class, pattern)),
    found AS (SELECT text_id, class, span, count(*) AS n FROM hits WHERE NOT contains(facts, span) GROUP BY 1, 2, 3)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "smoke_test", ["row_id", "raw_output", "generation_input"])
    return rows.select(F.col("row_id").alias("text_id"), F.col("raw_output").alias("text"), F.col("generation_input").alias("facts"))


@query(f"WITH {_FIND_SQL.replace('regexp_extract_all(raw_output, pattern)', 'regexp_extract_all(raw_output, pattern, 0)')} SELECT text_id, class, span, n FROM found")
def grounding_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.findings(_texts(spark, sf_dir), spark.createDataFrame(_PATTERNS, "class string, pattern string"))


@query(
    f"""WITH {_FIND_SQL}, c AS (SELECT text_id, sum(n)::BIGINT AS findings FROM found GROUP BY 1)
        SELECT row_id AS text_id, CASE WHEN findings > 0 THEN 'FAIL' ELSE 'PASS' END AS status, coalesce(findings, 0)::BIGINT AS findings
        FROM smoke_test LEFT JOIN c ON c.text_id = row_id"""
)
def grounding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return grounding.status(texts, grounding.findings(texts, spark.createDataFrame(_PATTERNS, "class string, pattern string")))


@query(
    f"""WITH f AS (SELECT row_id AS text_id, list_distinct(list_transform(regexp_extract_all(raw_output, '{FIGURE_PATTERN}'), lambda x: lower(x))) AS said,
          list_transform(regexp_extract_all(generation_input, '{FIGURE_PATTERN}'), lambda x: lower(x)) AS known FROM smoke_test WHERE raw_output IS NOT NULL AND generation_input IS NOT NULL)
        SELECT text_id, unnest(list_filter(said, lambda x: NOT list_contains(known, x))) AS figure FROM f"""
)
def unsupported_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a reply that its input lacks."""
    return grounding.unsupported_figures(_texts(spark, sf_dir).withColumnRenamed("facts", "source"))


@query(
    """WITH w AS (SELECT row_id AS text_id, unnest(json_extract(generation_input, '$."' || k || '"')::VARCHAR[]) AS value FROM
         (SELECT row_id, generation_input, unnest(json_keys(generation_input)) AS k FROM smoke_test WHERE json_valid(generation_input)))
       SELECT text_id, count(*) AS wanted, count_if(coalesce(contains(raw_output, value), false))::BIGINT AS covered
       FROM w JOIN smoke_test ON row_id = text_id GROUP BY 1"""
)
def mandatory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    values = texts.select("text_id", F.explode(F.from_json("facts", "map<string,array<string>>")).alias("name", "vs")).select("text_id", F.explode("vs").alias("value"))
    return grounding.coverage(texts, values)


@query(
    f"""WITH {_PAIRS_SQL} SELECT record_id, string_agg(name || '=' || array_to_string(given, ','), ' | ' ORDER BY name) AS line FROM pairs GROUP BY 1"""
)
def flattened_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a record as one line, names in order."""
    entries = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return _records(spark, sf_dir).where(F.size("attributes") > 0).select("record_id", F.array_join(entries, " | ").alias("line"))


@query(
    f"""WITH {_PAIRS_SQL} SELECT record_id, name, array_to_string(given, ',') AS item_values FROM pairs WHERE name IN ('品牌', '系列', '型号')"""
)
def identity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named keys of a map only."""
    kept = F.map_filter("attributes", lambda k, v: k.isin("品牌", "系列", "型号"))
    return _records(spark, sf_dir).select("record_id", F.explode(kept).alias("name", "given")).select("record_id", "name", F.array_join("given", ",").alias("item_values"))




@query(
    f"""WITH {_QUALITY_SQL} SELECT CASE WHEN field NOT IN ('品牌', '功率', '容量', '材质') THEN 'not_core' WHEN quality <> 'usable' THEN 'withheld'
        WHEN role = 'identity' THEN 'identity' WHEN len(list_filter(string_split(item_values, ','), lambda v: lower(v) NOT IN ('pp', 'abs'))) = 0 THEN 'negative'
        ELSE 'mandatory' END AS mandatory, field, count(*) AS facts FROM q GROUP BY 1, 2"""
)
def mandatory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = facts.mandatory_status(_quality(spark, sf_dir), ("品牌", "功率", "容量", "材质"), ("pp", "abs"))
    return marked.groupBy("mandatory", "field").agg(F.count("*").alias("facts"))


@query(
    f"""WITH {_VALUES_SQL} SELECT record_id, value FROM v WHERE name IN ('净重', '重量', '单品重量') AND NOT coalesce(
        regexp_full_match(value, '[0-9]+(\\.[0-9]+)?(g|kg|克)') AND coalesce(try_cast(regexp_extract(value, '^[0-9]+(\\.[0-9]+)?', 0) AS DOUBLE) > 0, true), false)"""
)
def value_shape_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _values(spark, sf_dir).where(F.col("name").isin("净重", "重量", "单品重量"))
    return weights.where(~facts.value_shape(F.col("value"), r"[0-9]+(?:\.[0-9]+)?(?:g|kg|克)")).select("record_id", "value")


@query(
    f"""WITH {_PAIRS_SQL} SELECT record_id, name, array_to_string(given, ',') AS item_values FROM pairs
        WHERE len(list_filter(given, lambda x: lower(x) NOT IN ('abs', 'pp'))) > 0"""
)
def active_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _records(spark, sf_dir).select("record_id", F.explode(paired.active_entries(F.col("attributes"), ("abs", "pp"))).alias("name", "given"))
    return kept.select("record_id", "name", F.array_join("given", ",").alias("item_values"))


@query(
    f"""WITH {_PAIRS_SQL}, k AS (SELECT record_id, name, given, row_number() OVER (PARTITION BY record_id ORDER BY name = '型号' DESC, name) AS r
        FROM pairs WHERE suffix(name, '型号')) SELECT record_id, given[1] AS model FROM k WHERE r = 1"""
)
def model_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _records(spark, sf_dir).select("record_id", paired.first_of_suffix(F.col("attributes"), "型号").alias("model"))
    return found.where("model IS NOT NULL")


@query(
    f"""WITH {_PAIRS_SQL}, v AS (SELECT record_id, name, unnest(given) AS value, generate_subscripts(given, 1) AS pos FROM pairs),
        f AS (SELECT record_id, name, value, min(pos) AS first FROM v WHERE value IS NOT NULL GROUP BY 1, 2, 3)
        SELECT record_id, name, string_agg(value, '|' ORDER BY first, value) AS item_values FROM f GROUP BY 1, 2"""
)
def ordered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of every attribute of a record, in the order they were first given."""
    listed = _records(spark, sf_dir).select("record_id", F.explode("attributes").alias("name", "given")).select("record_id", "name", F.posexplode("given").alias("at", "value"))
    found = dedup.ordered_values(listed, ["record_id", "name"], "value", "at")
    return found.select("record_id", "name", F.array_join("values", "|").alias("item_values"))
