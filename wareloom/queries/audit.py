"""Dataset and run audits: exclusion reasons, automatic summaries, claims, guards, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.functions.replies import reply_status
from wareloom.operators import audit, claims, sampling, validate
from wareloom.queries.facts import _FACTS_SQL, _PAIRS_SQL, _QUALITY_SQL, _VALUES_SQL, _facts, _quality, _records, _values
from wareloom.queries.registry import query
from wareloom.queries.selection import _SPLIT_SQL, _split_name
from wareloom.session import table

_CAPACITY = r"[0-9]+(?:\.[0-9]+)?(?:ml|l|升|毫升)"


@query(f"WITH {_PAIRS_SQL} SELECT record_id, name FROM pairs WHERE len(list_filter(given, lambda v: v IN ('ABS', 'PP', '硅胶'))) > 0")
def forbidden_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of which any value is in a forbidden set."""
    listed = _records(spark, sf_dir).select("record_id", F.explode("attributes").alias("name", "given"))
    return listed.where(audit.any_value_in(F.col("given"), ("ABS", "PP", "硅胶"))).select("record_id", "name")


@query(
    f"""SELECT row_id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' WHEN NOT contains(title, category_l2) THEN 'no_alias'
          WHEN regexp_matches(title, '包邮|爆款|特惠|同款') THEN 'boundary_term'
          WHEN len(list_distinct(list_transform(regexp_extract_all(title, '{_CAPACITY}'), lambda x: lower(x)))) > 1 THEN 'several_capacities' ELSE 'ok' END AS issue
        FROM week2_train_consistency_review"""
)
def title_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing wrong with a title."""
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title", "category_l2"])
    t = F.col("title")
    rules = [
        ("no_title", t.isNull() | (F.trim(t) == "")), ("no_alias", ~t.contains(F.col("category_l2"))), ("boundary_term", t.rlike("包邮|爆款|特惠|同款")),
        ("several_capacities", F.size(audit.one_meaning(t, _CAPACITY)) > 1),
    ]
    return rows.select("row_id", audit.first_reason(rules, "ok").alias("issue"))


@query(
    f"""WITH {_FACTS_SQL}, core AS (SELECT record_id, count(*) AS core FROM facts WHERE field IN ('品牌', '功率', '容量', '材质', '净重')
          AND len(list_filter(string_split(item_values, ','), lambda v: lower(v) IN ('abs', 'pp'))) = 0 GROUP BY 1) SELECT * FROM core WHERE core >= 4"""
)
def core_attribute_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with four core fields or more, fields with an excluded value left out."""
    kept = _facts(spark, sf_dir).where(F.col("field").isin("品牌", "功率", "容量", "材质", "净重"))
    kept = kept.where(~audit.any_value_in(F.transform(F.split("values", ","), F.lower), ("abs", "pp")))
    return kept.groupBy("record_id").agg(F.count("*").alias("core")).where("core >= 4")


_SUPPLEMENTAL = r"[0-9]+(?:\.[0-9]+)?(?:g|kg|克|千克)"


@query(
    f"""WITH {_PAIRS_SQL} SELECT record_id, name FROM pairs WHERE len(given) > 0
        AND len(list_filter(given, lambda v: NOT coalesce(lower(v) IN ('abs', 'pp') OR regexp_full_match(v, '{_SUPPLEMENTAL}'), false))) = 0"""
)
def supplemental_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of which every value is of an exact set or a plain weight."""
    listed = _records(spark, sf_dir).select("record_id", F.explode("attributes").alias("name", "given"))
    return listed.where(audit.every_value(F.col("given"), ("abs", "pp"), _SUPPLEMENTAL)).select("record_id", "name")


@query(
    f"""WITH {_QUALITY_SQL}, held AS (SELECT DISTINCT record_id, field FROM q WHERE quality <> 'usable' AND field IN ('品牌', '功率', '容量', '材质')),
        gone AS (SELECT DISTINCT record_id FROM q WHERE role = 'identity' AND quality = 'blocked')
        SELECT field, count(*) AS facts FROM q WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.record_id = q.record_id AND h.field = q.field)
          AND record_id NOT IN (SELECT record_id FROM gone) GROUP BY 1"""
)
def gate_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts left once withheld core fields and records of blocked identity are gone."""
    quality = _quality(spark, sf_dir)
    held = quality.where((F.col("quality") != "usable") & F.col("field").isin("品牌", "功率", "容量", "材质")).select("record_id", "field").distinct()
    gone = quality.where("role = 'identity' AND quality = 'blocked'").select("record_id").distinct()
    left = quality.join(held, ["record_id", "field"], "left_anti").join(gone, "record_id", "left_anti")
    return left.groupBy("field").agg(F.count("*").alias("facts"))


_IMAGES_SQL = """img AS (SELECT product_id, min(vec_id) AS vec_id, count(*) AS pictures FROM feature_library WHERE image_path IS NOT NULL AND embedding IS NOT NULL
      AND len(embedding) = 64 GROUP BY 1), p AS (SELECT product_id, min(category_l2) AS category_l2, count(*) AS tasks FROM lora_data WHERE product_id IS NOT NULL GROUP BY 1)"""


def _image_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    good = table(spark, sf_dir, "feature_library", ["vec_id", "product_id", "image_path", "embedding"]).where("image_path IS NOT NULL AND embedding IS NOT NULL AND size(embedding) = 64")
    images = good.groupBy("product_id").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("pictures"))
    products = table(spark, sf_dir, "lora_data", ["product_id", "category_l2"]).where("product_id IS NOT NULL").groupBy("product_id").agg(F.min("category_l2").alias("category_l2"), F.count("*").alias("tasks"))
    return products, images


@query(f"WITH {_IMAGES_SQL} SELECT p.product_id, category_l2, vec_id, pictures, tasks FROM p JOIN img USING (product_id)")
def image_result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a usable picture, found by id; the others are dropped."""
    products, images = _image_rows(spark, sf_dir)
    return products.join(images, "product_id").select("product_id", "category_l2", "vec_id", "pictures", "tasks")


@query(f"WITH {_IMAGES_SQL} SELECT category_l2, count(*) AS products, count(vec_id) AS ready, sum(coalesce(pictures, 0))::BIGINT AS pictures FROM p LEFT JOIN img USING (product_id) GROUP BY 1")
def image_ready_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and products ready for export per category."""
    products, images = _image_rows(spark, sf_dir)
    return products.join(images, "product_id", "left").groupBy("category_l2").agg(
        F.count("*").alias("products"), F.count("vec_id").alias("ready"), F.sum(F.coalesce("pictures", F.lit(0))).alias("pictures")
    )


@query(
    """WITH a AS (SELECT product_id AS a_key, row_number() OVER (ORDER BY row_id, product_id) AS place FROM retrieval_test_queries),
       b AS (SELECT regexp_extract(query_image_path, '([0-9]+)[.]', 1) AS b_key, row_number() OVER (ORDER BY row_id, regexp_extract(query_image_path, '([0-9]+)[.]', 1)) AS place FROM retrieval_test_queries)
       SELECT place, a_key, b_key FROM a FULL JOIN b USING (place) WHERE a_key IS DISTINCT FROM b_key"""
)
def positional_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which the ids of two columns, each in its own order, are not the same: none in a sound export."""
    rows = table(spark, sf_dir, "retrieval_test_queries", ["row_id", "product_id", "query_image_path"])
    named = rows.select("row_id", F.regexp_extract("query_image_path", r"([0-9]+)[.]", 1).alias("product_id"))
    return audit.same_order(rows.select("row_id", "product_id"), named, "product_id", "row_id", "row_id")


@query(
    """WITH j AS (SELECT product_id, scope, min_by(status, audited_at) AS first_status, max_by(status, audited_at) AS last_status, count(*) AS audits FROM rag GROUP BY 1, 2)
       SELECT t.row_id, j.scope, first_status, last_status, audits FROM retrieval_test_queries t JOIN j ON j.product_id = regexp_extract(t.query_image_path, '([0-9]+)[.]', 1)
       WHERE first_status <> last_status OR last_status <> 'PASS'"""
)
def bad_case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose product has a bad or changed audit, by composite key, with the first judgment."""
    audits = table(spark, sf_dir, "rag", ["product_id", "scope", "status", "audited_at"]).groupBy("product_id", "scope").agg(
        F.min_by("status", "audited_at").alias("first_status"), F.max_by("status", "audited_at").alias("last_status"), F.count("*").alias("audits")
    )
    asked = table(spark, sf_dir, "retrieval_test_queries", ["row_id", "query_image_path"]).select("row_id", F.regexp_extract("query_image_path", r"([0-9]+)[.]", 1).alias("product_id"))
    return asked.join(audits, "product_id").where("first_status <> last_status OR last_status <> 'PASS'").select("row_id", "scope", "first_status", "last_status", "audits")


_BUILD_SQL = f"""t AS (SELECT row_id, product_id, task_type, {_SPLIT_SQL} AS name, messages, attributes, row_number() OVER (PARTITION BY product_id, task_type ORDER BY exported_at, row_id) AS turn FROM lora_data),
    a AS (SELECT DISTINCT product_id FROM rag WHERE status = 'CONFLICT'),
    b AS (SELECT row_id, task_type, name, CASE WHEN t.product_id IS NULL THEN 'no_product' WHEN name IS NULL THEN 'no_split' WHEN turn > 1 THEN 'exported_again'
      WHEN coalesce(len(messages), 0) = 0 OR messages[-1].role <> 'assistant' OR trim(coalesce(messages[-1].content, '')) = '' THEN 'no_answer'
      WHEN coalesce(cardinality(attributes), 0) < 3 THEN 'few_fields' WHEN a.product_id IS NOT NULL THEN 'audit_conflict' ELSE 'kept' END AS reason FROM t LEFT JOIN a ON a.product_id = t.product_id)"""


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lora_data", ["row_id", "product_id", "task_type", "split", "messages", "attributes", "exported_at"])
    turn = F.row_number().over(W.partitionBy("product_id", "task_type").orderBy("exported_at", "row_id"))
    conflicts = table(spark, sf_dir, "rag", ["product_id", "status"]).where("status = 'CONFLICT'").select("product_id").distinct().withColumn("conflict", F.lit(True))
    last = F.try_element_at("messages", F.lit(-1))
    rules = [
        ("no_product", F.col("product_id").isNull()), ("no_split", F.col("name").isNull()), ("exported_again", F.col("turn") > 1),
        ("no_answer", (F.coalesce(F.size("messages"), F.lit(0)) <= 0) | (last["role"] != "assistant") | (F.trim(F.coalesce(last["content"], F.lit(""))) == "")),
        ("few_fields", F.coalesce(F.size("attributes"), F.lit(0)) < 3), ("audit_conflict", F.col("conflict")),
    ]
    return rows.withColumn("name", _split_name("split")).withColumn("turn", turn).join(conflicts, "product_id", "left").select("row_id", "task_type", "name", audit.first_reason(rules, "kept").alias("reason"))


@query(f"WITH {_BUILD_SQL} SELECT row_id, reason FROM b")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one reason for which an instruction record is left out, or ``kept``."""
    return _build(spark, sf_dir).select("row_id", "reason")


@query(f"WITH {_BUILD_SQL} SELECT task_type, name AS split, reason, count(*) AS records FROM b GROUP BY 1, 2, 3")
def instruction_build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(spark, sf_dir).groupBy("task_type", F.col("name").alias("split"), "reason").agg(F.count("*").alias("records"))


_REPLY_SQL = """r AS (SELECT row_id, run_id, product_id, prompt_version, raw_output, generated_tokens, latency_seconds, created_at,
      coalesce(contains(raw_output, 'generated_title') AND contains(raw_output, 'selling_points') AND contains(raw_output, 'short_description'), false) AS complete FROM smoke_test),
    w AS (SELECT row_id, unnest(json_extract(generation_input, '$."' || k || '"')::VARCHAR[]) AS value FROM (SELECT row_id, generation_input, unnest(json_keys(generation_input)) AS k FROM smoke_test WHERE json_valid(generation_input))),
    cov AS (SELECT w.row_id, count(*) AS wanted, count_if(coalesce(contains(raw_output, value), false))::BIGINT AS covered FROM w JOIN r USING (row_id) GROUP BY 1)"""


def _replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "smoke_test", ["row_id", "run_id", "product_id", "prompt_version", "raw_output", "generation_input", "generated_tokens", "latency_seconds", "created_at"])
    parts = [F.col("raw_output").contains(k) for k in ("generated_title", "selling_points", "short_description")]
    replies = rows.withColumn("complete", F.coalesce(parts[0] & parts[1] & parts[2], F.lit(False)))
    wanted = rows.select("row_id", "raw_output", F.explode(F.from_json("generation_input", "map<string,array<string>>")).alias("name", "vs")).select("row_id", "raw_output", F.explode("vs").alias("value"))
    covered = wanted.groupBy("row_id").agg(F.count("*").alias("wanted"), F.count_if(F.coalesce(F.col("raw_output").contains(F.col("value")), F.lit(False))).alias("covered"))
    return replies.drop("generation_input"), covered


@query(
    f"""WITH {_REPLY_SQL} SELECT prompt_version, count(*) AS replies, round(avg(complete::INT), 6) AS complete_rate, round(sum(covered)::DOUBLE / nullif(sum(wanted), 0), 6) AS coverage,
        round(avg(latency_seconds), 6) AS mean_latency, round(max(latency_seconds), 6) AS max_latency, round(avg(generated_tokens), 6) AS mean_tokens, count(DISTINCT run_id) AS runs
        FROM r LEFT JOIN cov USING (row_id) GROUP BY 1"""
)
def automatic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, literal coverage, latency and tokens of every variant."""
    replies, covered = _replies(spark, sf_dir)
    return replies.join(covered, "row_id", "left").groupBy("prompt_version").agg(
        F.count("*").alias("replies"), F.round(F.avg(F.col("complete").cast("int")), 6).alias("complete_rate"), F.round(F.try_divide(F.sum("covered").cast("double"), F.sum("wanted")), 6).alias("coverage"),
        F.round(F.avg("latency_seconds"), 6).alias("mean_latency"), F.round(F.max("latency_seconds"), 6).alias("max_latency"), F.round(F.avg("generated_tokens"), 6).alias("mean_tokens"),
        F.count_distinct("run_id").alias("runs"),
    )


@query(
    f"""WITH {_REPLY_SQL}, x AS (SELECT prompt_version, row_id, (NOT complete)::INT AS errors, (coalesce(wanted, 0) - coalesce(covered, 0))::BIGINT AS missed FROM r LEFT JOIN cov USING (row_id)),
        n AS (SELECT *, (row_number() OVER (PARTITION BY prompt_version ORDER BY errors DESC, missed DESC, row_id))::INT AS place FROM x) SELECT * FROM n WHERE place <= 8"""
)
def worst_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight worst replies of every variant: errors, then missed values, then the id."""
    replies, covered = _replies(spark, sf_dir)
    missed = (F.coalesce("wanted", F.lit(0)) - F.coalesce("covered", F.lit(0))).alias("missed")
    scored = replies.join(covered, "row_id", "left").select("prompt_version", "row_id", (~F.col("complete")).cast("int").alias("errors"), missed)
    return audit.worst_cases(scored, ["prompt_version"], ["errors", "missed"], "row_id", 8)


@query(
    f"""WITH {_REPLY_SQL}, f AS (SELECT product_id, count(*) AS audits, max_by(status, struct_pack(a := audited_at, r := row_id)) AS status FROM rag GROUP BY 1),
        l AS (SELECT product_id, count(*) AS tasks FROM lora_data GROUP BY 1)
        SELECT r.row_id, complete, coalesce(covered, 0)::BIGINT AS covered, coalesce(wanted, 0)::BIGINT AS wanted, coalesce(f.status, 'none') AS audit_status, coalesce(audits, 0)::BIGINT AS audits,
          coalesce(tasks, 0)::BIGINT AS tasks, CASE WHEN NOT complete THEN 'unparsable' WHEN coalesce(covered, 0) * 2 < coalesce(wanted, 0) THEN 'thin' WHEN coalesce(f.status, '') = 'CONFLICT' THEN 'disputed' ELSE 'sound' END AS draft
        FROM r LEFT JOIN cov USING (row_id) LEFT JOIN f ON f.product_id = r.product_id LEFT JOIN l ON l.product_id = r.product_id"""
)
def draft_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies joined with coverage, audit and instruction records by product, and a first verdict."""
    replies, covered = _replies(spark, sf_dir)
    audits = table(spark, sf_dir, "rag", ["row_id", "product_id", "status", "audited_at"]).groupBy("product_id").agg(F.count("*").alias("audits"), F.max_by("status", F.struct("audited_at", "row_id")).alias("status"))
    tasks = table(spark, sf_dir, "lora_data", ["product_id"]).groupBy("product_id").agg(F.count("*").alias("tasks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = [("unparsable", ~F.col("complete")), ("thin", zero("covered") * 2 < zero("wanted")), ("disputed", F.col("status") == "CONFLICT")]
    return replies.join(covered, "row_id", "left").join(audits, "product_id", "left").join(tasks, "product_id", "left").select(
        "row_id", "complete", zero("covered").alias("covered"), zero("wanted").alias("wanted"), F.coalesce("status", F.lit("none")).alias("audit_status"), zero("audits").alias("audits"),
        zero("tasks").alias("tasks"), audit.first_reason(rules, "sound").alias("draft"),
    )


@query("SELECT run_id, prompt_version, round(avg(latency_seconds), 6) AS mean, count(latency_seconds) AS n FROM smoke_test GROUP BY GROUPING SETS ((), (prompt_version), (run_id, prompt_version))")
def means_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over all rows, per variant and per run of a variant, in one pass."""
    rows = table(spark, sf_dir, "smoke_test", ["run_id", "prompt_version", "latency_seconds"])
    sets = [[], [F.col("prompt_version")], [F.col("run_id"), F.col("prompt_version")]]
    return rows.groupingSets(sets, "run_id", "prompt_version").agg(F.round(F.avg("latency_seconds"), 6).alias("mean"), F.count("latency_seconds").alias("n"))


_CLASSES = [("missing", r"^\s*$"), ("archive", r"/(?:old|archive|bak)/"), ("lot_a", "/lot_a/"), ("lot_b", "/lot_b/"), ("webp", r"\.webp$"), ("photo", r"\.jpe?g$")]


@query(
    f"""SELECT CASE WHEN path IS NULL THEN 'missing' {" ".join(f"WHEN regexp_matches(path, '{p}') THEN '{n}'" for n, p in _CLASSES)} ELSE 'other' END AS class, count(*) AS files, coalesce(sum(length(path)), 0)::BIGINT AS chars
        FROM (SELECT image_path AS path FROM feature_library UNION ALL SELECT query_image_path FROM retrieval_test_queries) GROUP BY 1"""
)
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sizes per class of path, by ordered rules."""
    a = table(spark, sf_dir, "feature_library", ["image_path"]).toDF("path")
    both = a.unionByName(table(spark, sf_dir, "retrieval_test_queries", ["query_image_path"]).toDF("path"))
    kind = F.when(F.col("path").isNull(), "missing").otherwise(audit.ordered_class(F.col("path"), _CLASSES))
    return both.groupBy(kind.alias("class")).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.char_length("path")), F.lit(0)).cast("long").alias("chars"))


@query("SELECT row_id, regexp_replace(replace(replace(replace(lower(title), '毫升', 'ml'), '千克', 'kg'), '公斤', 'kg'), '\\s+', '', 'g') AS form FROM week2_train_consistency_review WHERE title IS NOT NULL AND regexp_full_match(title, '[ -~一-鿿]*')")
def unit_alias_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, unit aliases replaced, blanks gone; titles of plain characters, for which engines agree on case."""
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title"]).where(F.col("title").rlike("^[ -~一-鿿]*$"))
    form = F.lower("title")
    for alias, unit in (("毫升", "ml"), ("千克", "kg"), ("公斤", "kg")):
        form = F.replace(form, F.lit(alias), F.lit(unit))
    return rows.select("row_id", F.regexp_replace(form, r"\s+", "").alias("form"))


@query("SELECT row_id, lower(regexp_replace(query_text, '[\\s，。；;：:、,.!?！？()（）\\[\\]【】]', '', 'g')) AS form FROM retrieval_test_queries WHERE query_text IS NOT NULL")
def stripped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts without blanks and punctuation."""
    rows = table(spark, sf_dir, "retrieval_test_queries", ["row_id", "query_text"]).where("query_text IS NOT NULL")
    return rows.select("row_id", claims.plain(F.col("query_text")).alias("form"))


@query("SELECT row_id, CASE WHEN regexp_full_match(product_id, '[0-9]{12}') THEN product_id END AS strict_id, CASE WHEN product_id IS NULL THEN 'missing' WHEN regexp_full_match(product_id, '[0-9]{12}') THEN 'ok' ELSE 'malformed' END AS verdict FROM retrieval_test_queries")
def strict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that have the strict form; nothing is trimmed or coerced."""
    rows = table(spark, sf_dir, "retrieval_test_queries", ["row_id", "product_id"])
    value = audit.strict(F.col("product_id"), "[0-9]{12}")
    return rows.select("row_id", value.alias("strict_id"), F.when(F.col("product_id").isNull(), "missing").when(value.isNotNull(), "ok").otherwise("malformed").alias("verdict"))


@query(
    """WITH t AS (SELECT row_id, list_transform(messages, lambda m: m.role) AS roles FROM lora_data WHERE messages IS NOT NULL)
       SELECT row_id, contains('|' || array_to_string(roles, '|') || '|', '|user|assistant|') AS asked_and_answered FROM t"""
)
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question is followed by its answer at once: a contiguous run of roles."""
    rows = table(spark, sf_dir, "lora_data", ["row_id", "messages"]).where("messages IS NOT NULL")
    return rows.select("row_id", audit.contains_run(F.transform("messages", lambda m: m["role"]), F.array(F.lit("user"), F.lit("assistant"))).alias("asked_and_answered"))


@query(
    """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, list_sum(list_transform(list_zip(q.e, g.e), lambda p: p[1] * p[2])) AS d
         FROM u q JOIN u g ON q.label = g.label AND q.vec_id <> g.vec_id WHERE q.vec_id % 100 = 0)
       SELECT query_id, count(*) AS candidates, count_if(round(d, 6) < 0)::BIGINT AS negative FROM s GROUP BY 1"""
)
def similarity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the same label with a negative similarity, per stated query; ``require_not_negative`` fails on them."""
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"])
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = rows.join(F.broadcast(asked), "label").where("vec_id <> query_id").select("query_id", dot.alias("d"))
    return scored.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.round("d", 6) < 0).alias("negative"))


@query(
    f"""SELECT product_id, {_SPLIT_SQL} AS stored, CASE WHEN regexp_matches(right(sha256('holdout:' || product_id), 1), '[0-1]') THEN 'test' ELSE 'train' END AS drawn, count(*) AS rows FROM lora_data
        WHERE product_id IS NOT NULL GROUP BY 1, 2, 3 HAVING stored = 'test' AND drawn <> 'test'"""
)
def holdout_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products stored as held out that the rule does not draw."""
    rows = table(spark, sf_dir, "lora_data", ["product_id", "split"]).where("product_id IS NOT NULL")
    drawn = F.when(F.right(F.sha2(F.concat(F.lit("holdout:"), "product_id"), 256), F.lit(1)).rlike("[0-1]"), "test").otherwise("train")
    told = rows.groupBy("product_id", _split_name("split").alias("stored"), drawn.alias("drawn")).agg(F.count("*").alias("rows"))
    return told.where("stored = 'test' AND drawn <> 'test'")


_SCORES_SQL = f"WITH {_REPLY_SQL}, s AS (SELECT r.row_id, product_id, coalesce(wanted, 0) AS core, coalesce(covered, 0) AS matched, latency_seconds FROM r LEFT JOIN cov USING (row_id))"


@query(f"{_SCORES_SQL} SELECT row_id, CASE WHEN core = 0 THEN 'no_core' WHEN matched > core THEN 'too_many' ELSE 'no_latency' END AS rule FROM s WHERE core = 0 OR matched > core OR latency_seconds IS NULL")
def score_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows that break a bound: nothing to match, more matched than there is, no latency."""
    replies, covered = _replies(spark, sf_dir)
    both = replies.join(covered, "row_id", "left").fillna(0, ["wanted", "covered"])
    rules = [("no_core", F.col("wanted") == 0), ("too_many", F.col("covered") > F.col("wanted")), ("no_latency", F.col("latency_seconds").isNull())]
    return both.select("row_id", audit.first_reason(rules, "fine").alias("rule")).where("rule <> 'fine'")


@query(
    f"""WITH {_QUALITY_SQL} SELECT record_id, count(*) AS facts, count_if(quality <> 'usable')::BIGINT AS ineligible, count_if(split_part(fact_id, ':', 1) <> record_id::VARCHAR)::BIGINT AS of_others
        FROM q GROUP BY 1 HAVING count(*) > 8 OR count_if(quality <> 'usable') > 0 OR count_if(split_part(fact_id, ':', 1) <> record_id::VARCHAR) > 0"""
)
def context_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with more than eight facts, with ineligible ones or with facts of another record."""
    marked = _quality(spark, sf_dir).groupBy("record_id").agg(
        F.count("*").alias("facts"), F.count_if(F.col("quality") != "usable").alias("ineligible"),
        F.count_if(F.split_part("fact_id", F.lit(":"), F.lit(1)) != F.col("record_id").cast("string")).alias("of_others"),
    )
    return marked.where("facts > 8 OR ineligible > 0 OR of_others > 0")


@query("SELECT product_id, prompt_version, count(*) AS rows FROM smoke_test GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products a variant was tried on more than once."""
    return validate.repeated_keys(table(spark, sf_dir, "smoke_test", ["product_id", "prompt_version"]), ["product_id", "prompt_version"])


@query(
    """WITH s AS (SELECT run_id, prompt_version, count(*) AS n FROM smoke_test GROUP BY 1, 2), t AS (SELECT run_id, sum(n)::BIGINT AS total, max(n) AS hi, min(n) AS lo, count(*) AS variants FROM s GROUP BY 1)
       SELECT run_id, total, variants, hi = lo AS balanced FROM t"""
)
def sample_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run holds the same number of rows of every variant."""
    counted = table(spark, sf_dir, "smoke_test", ["run_id", "prompt_version"]).groupBy("run_id", "prompt_version").agg(F.count("*").alias("n"))
    told = counted.groupBy("run_id").agg(F.sum("n").alias("total"), F.count("*").alias("variants"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    return told.select("run_id", "total", "variants", (F.col("hi") == F.col("lo")).alias("balanced"))


@query("SELECT audit_version, count(*) AS rows, count_if(status = 'PASS' OR issue_code IS NOT NULL)::BIGINT AS judged, count(*) = count_if(status = 'PASS' OR issue_code IS NOT NULL) AS loggable FROM rag GROUP BY 1")
def loggable_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every row of an audit is judged in full, so that its metrics may be logged."""
    judged = F.count_if((F.col("status") == "PASS") | F.col("issue_code").isNotNull())
    rows = table(spark, sf_dir, "rag", ["audit_version", "status", "issue_code"])
    return rows.groupBy("audit_version").agg(F.count("*").alias("rows"), judged.alias("judged")).withColumn("loggable", F.col("rows") == F.col("judged"))


@query(
    f"""WITH {_QUALITY_SQL}, g AS (SELECT scope, quality, count(*) AS facts FROM q JOIN rag ON row_id = record_id GROUP BY 1, 2)
        SELECT scope, quality, facts, round(facts::DOUBLE / sum(facts) OVER (PARTITION BY scope), 6) AS share FROM g"""
)
def gate_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit gate computed anew on every scope: shares of the verdicts."""
    from pyspark.sql import Window as W

    scopes = table(spark, sf_dir, "rag", ["row_id", "scope"]).withColumnRenamed("row_id", "record_id")
    counted = _quality(spark, sf_dir).join(scopes, "record_id").groupBy("scope", "quality").agg(F.count("*").alias("facts"))
    return counted.withColumn("share", F.round(F.col("facts") / F.sum("facts").over(W.partitionBy("scope")), 6))


_USAGE, _PRAISE = "(?:适用于|适合放在|适合|用于)([^，。；;！？!?\"、,]+)", "高效|精准|舒适|便捷|安全|耐用|省力|可靠|优质|大容量"
_DENIALS, _TURNED = ("不支持", "没有", "无", "未配备"), (("以下", "以上"), ("以上", "以下"))
_CLAIM_SQL = rf"""plainf AS (SELECT row_id, k AS field, lower(regexp_replace(v, '[\s，。；;：:、,.!?！？()（）\[\]【】]', '', 'g')) AS value FROM
      (SELECT row_id, k, unnest(json_extract(generation_input, '$."' || k || '"')::VARCHAR[]) AS v FROM (SELECT row_id, generation_input, unnest(json_keys(generation_input)) AS k FROM smoke_test WHERE json_valid(generation_input))) WHERE v IS NOT NULL),
    f AS (SELECT * FROM plainf WHERE value <> ''),
    t AS (SELECT row_id, raw_output AS text, lower(regexp_replace(raw_output, '[\s，。；;：:、,.!?！？()（）\[\]【】]', '', 'g')) AS compact FROM smoke_test WHERE raw_output IS NOT NULL),
    u AS (SELECT *, lower(regexp_replace(span, '[\s，。；;：:、,.!?！？()（）\[\]【】]', '', 'g')) AS target FROM (SELECT row_id, unnest(list_distinct(regexp_extract_all(text, '{_USAGE}', 1))) AS span FROM t)),
    p AS (SELECT row_id, unnest(list_distinct(regexp_extract_all(text, '{_PRAISE}'))) AS span FROM t),
    found AS (SELECT row_id, 'unsupported_usage' AS class, span FROM u WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.row_id = u.row_id AND field IN ('适用场景', '使用场景') AND (contains(target, value) OR contains(value, target)))
      UNION ALL SELECT row_id, 'unsupported_praise', span FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.row_id = p.row_id AND contains(value, span))
      UNION ALL SELECT DISTINCT row_id, 'denied_fact', d || value FROM t JOIN f USING (row_id) CROSS JOIN (VALUES {", ".join(f"('{d}')" for d in _DENIALS)}) x(d) WHERE contains(compact, d || value)
      UNION ALL SELECT DISTINCT row_id, 'turned_direction', regexp_replace(value, a || '$', '') || b FROM t JOIN f USING (row_id) CROSS JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TURNED)}) x(a, b)
        WHERE suffix(value, a) AND contains(compact, regexp_replace(value, a || '$', '') || b))"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "smoke_test", ["row_id", "raw_output", "generation_input"])
    texts = rows.select(F.col("row_id").alias("text_id"), F.lit("reply").alias("part"), F.col("raw_output").alias("text"))
    facts = rows.select(F.col("row_id").alias("text_id"), F.explode(F.from_json("generation_input", "map<string,array<string>>")).alias("field", "vs")).select("text_id", "field", F.explode("vs").alias("value"))
    return claims.claim_findings(texts, facts, _USAGE, ("适用场景", "使用场景"), _PRAISE, _DENIALS, _TURNED)


@query(f"WITH {_CLAIM_SQL} SELECT row_id, class, span FROM found")
def claim_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and praise without support, denied facts and turned directions in replies."""
    return _claims(spark, sf_dir).select(F.col("text_id").alias("row_id"), "class", "span")


@query(f"WITH {_CLAIM_SQL}, c AS (SELECT row_id, count(*) AS n, count(DISTINCT class) AS classes FROM found GROUP BY 1) SELECT s.row_id, coalesce(n, 0)::BIGINT AS findings, coalesce(classes, 0)::BIGINT AS classes, CASE WHEN raw_output IS NULL OR n > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM smoke_test s LEFT JOIN c USING (row_id)")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every reply; one that is missing cannot be grounded."""
    counted = _claims(spark, sf_dir).groupBy(F.col("text_id").alias("row_id")).agg(F.count("*").alias("findings"), F.count_distinct("class").alias("classes"))
    rows = table(spark, sf_dir, "smoke_test", ["row_id", "raw_output"]).join(counted, "row_id", "left").fillna(0, ["findings", "classes"])
    return rows.select("row_id", "findings", "classes", F.when(F.col("raw_output").isNull() | (F.col("findings") > 0), "FAIL").otherwise("PASS").alias("verdict"))


@query(
    f"""WITH {_CLAIM_SQL}, c AS (SELECT row_id, count_if(class IN ('denied_fact', 'turned_direction')) AS grounding, count_if(class IN ('unsupported_usage', 'unsupported_praise')) AS unsupported, count(*) AS errors FROM found GROUP BY 1)
        SELECT row_id, errors, grounding::BIGINT AS grounding, unsupported::BIGINT AS unsupported, errors = grounding + unsupported AS adds_up FROM c"""
)
def attribution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a reply are those of grounding and those without support, and no others."""
    kind = F.col("class").isin("denied_fact", "turned_direction")
    counted = _claims(spark, sf_dir).groupBy(F.col("text_id").alias("row_id")).agg(F.count("*").alias("errors"), F.count_if(kind).alias("grounding"), F.count_if(F.col("class").isin("unsupported_usage", "unsupported_praise")).alias("unsupported"))
    return counted.withColumn("adds_up", F.col("errors") == F.col("grounding") + F.col("unsupported"))
