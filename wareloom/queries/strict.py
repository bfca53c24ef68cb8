"""Strict forms: evaluation that names what is wrong, digests, spans with places, masks, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.operators import audit, sampling
from wareloom.queries.audit import _CLAIM_SQL, _claims
from wareloom.queries.facts import _ZONES_SQL, _ranks, four_zone_context
from wareloom.queries.registry import query
from wareloom.queries.retrieval import _E_TOP, _graded
from wareloom.queries.selection import _SPLIT_SQL, _split_name
from wareloom.session import table

_RULES = """CASE WHEN bool_or(grade IS NULL OR grade NOT IN (0, 1, 2)) THEN 'bad_grade' WHEN count(*) < 50 THEN 'too_few'
    WHEN min(rank) <> 1 OR max(rank) <> count(*) OR count(DISTINCT rank) <> count(*) THEN 'rank_gap' WHEN count_if(grade >= 1) = 0 THEN 'nothing_relevant' ELSE 'sound' END"""


@query(f"{_E_TOP} SELECT query_id, {_RULES} AS verdict, count(*) AS candidates, count_if(grade >= 1)::BIGINT AS relevant FROM r WHERE rank <= 50 AND query_id % 300 <> 0 OR rank <= 20 GROUP BY 1")
def strict_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a ranking may not be evaluated: every third query lacks candidates here, so the rule is seen to fire."""
    top = _graded(spark, sf_dir)[0].where("rank <= 50 AND query_id % 300 <> 0 OR rank <= 20")
    per_query = top.groupBy("query_id").agg(
        F.bool_or(~F.coalesce(F.col("grade").isin(0, 1, 2), F.lit(False))).alias("bad"), F.count("*").alias("candidates"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.count_distinct("rank").alias("ranks"), F.count_if(F.col("grade") >= 1).alias("relevant"),
    )
    rules = [
        ("bad_grade", F.col("bad")), ("too_few", F.col("candidates") < 50), ("rank_gap", (F.col("lo") != 1) | (F.col("hi") != F.col("candidates")) | (F.col("ranks") != F.col("candidates"))),
        ("nothing_relevant", F.col("relevant") == 0),
    ]
    return per_query.select("query_id", audit.first_reason(rules, "sound").alias("verdict"), "candidates", "relevant")


@query(
    f"""{_E_TOP}, t AS (SELECT query_id, item_id, rank, grade FROM r WHERE rank <= 10), j AS (SELECT query_id, item_id, grade FROM r WHERE grade = 2 AND rank <= 50)
        SELECT coalesce(t.query_id, j.query_id) AS query_id, coalesce(t.item_id, j.item_id) AS item_id, t.rank, coalesce(j.grade, 0) AS judged, t.rank IS NULL AS missed FROM t FULL JOIN j ON t.query_id = j.query_id AND t.item_id = j.item_id"""
)
def judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their judgments, unjudged ones at grade 0, and judged items that were not found."""
    top, _ = _graded(spark, sf_dir)
    found = top.where("rank <= 10").select("query_id", "item_id", "rank")
    judged = top.where("grade = 2 AND rank <= 50").select("query_id", "item_id", "grade")
    both = found.join(judged, ["query_id", "item_id"], "full")
    return both.select("query_id", "item_id", "rank", F.coalesce("grade", F.lit(0)).alias("judged"), F.col("rank").isNull().alias("missed"))


@query("SELECT prompt_version, round_even(avg(generated_tokens), 2) AS tokens, round_even(sum(generated_tokens) / 8.0::DOUBLE, 2) AS eighths FROM smoke_test GROUP BY 1")
def half_even_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means rounded half to even."""
    rows = table(spark, sf_dir, "smoke_test", ["prompt_version", "generated_tokens"])
    return rows.groupBy("prompt_version").agg(F.bround(F.avg("generated_tokens"), 2).alias("tokens"), F.bround(F.sum("generated_tokens") / F.lit(8.0), 2).alias("eighths"))


@query(
    f"""WITH {_CLAIM_SQL}, e AS (SELECT prompt_version, count(*) AS replies, count_if(row_id IN (SELECT row_id FROM found)) AS bad FROM smoke_test GROUP BY 1),
        b AS (SELECT min_by(bad / replies::DOUBLE, prompt_version) AS base FROM e)
        SELECT prompt_version, replies, bad::BIGINT AS bad, round(bad / replies::DOUBLE, 6) AS rate, CASE WHEN base = 0 THEN NULL ELSE round((base - bad / replies::DOUBLE) / base, 6) END AS reduction FROM e, b"""
)
def error_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of replies with a finding per variant, and its reduction against the first variant."""
    bad = _claims(spark, sf_dir).select(F.col("text_id").alias("row_id")).distinct().withColumn("is_bad", F.lit(True))
    rates = table(spark, sf_dir, "smoke_test", ["row_id", "prompt_version"]).join(bad, "row_id", "left").groupBy("prompt_version").agg(F.count("*").alias("replies"), F.count("is_bad").alias("bad"))
    base = rates.agg(F.min_by(F.col("bad") / F.col("replies"), "prompt_version").alias("base"))
    rate = F.col("bad") / F.col("replies")
    return rates.crossJoin(F.broadcast(base)).select("prompt_version", "replies", "bad", F.round(rate, 6).alias("rate"), F.round(F.try_divide(F.col("base") - rate, F.col("base")), 6).alias("reduction"))


@query(f"WITH {_CLAIM_SQL} SELECT f.row_id, class, span, strpos(raw_output, span) AS place FROM found f JOIN smoke_test USING (row_id) WHERE class IN ('unsupported_usage', 'unsupported_praise')")
def claim_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an unsupported claim first stands in its reply."""
    texts = table(spark, sf_dir, "smoke_test", ["row_id", "raw_output"])
    found = _claims(spark, sf_dir).where("class IN ('unsupported_usage', 'unsupported_praise')").select(F.col("text_id").alias("row_id"), "class", "span")
    return found.join(texts, "row_id").select("row_id", "class", "span", F.instr("raw_output", F.col("span")).cast("long").alias("place"))


_PARTS = r"[，。；;！!？?\n、,]+"


@query(rf"SELECT row_id, len(list_filter(regexp_split_to_array(raw_output, '{_PARTS}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')))::INT AS clauses, length(raw_output) AS chars FROM smoke_test WHERE raw_output IS NOT NULL")
def clause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of a reply that hold a letter or a figure."""
    rows = table(spark, sf_dir, "smoke_test", ["row_id", "raw_output"]).where("raw_output IS NOT NULL")
    return rows.select("row_id", F.size(F.filter(F.split("raw_output", _PARTS), lambda x: x.rlike(r"[\p{L}\p{N}]"))).alias("clauses"), F.char_length("raw_output").cast("long").alias("chars"))


@query(
    """WITH p AS (SELECT row_id, k, json_extract(generation_input, '$."' || k || '"')::VARCHAR[] AS vs FROM (SELECT row_id, generation_input, unnest(json_keys(generation_input)) AS k FROM smoke_test WHERE json_valid(generation_input)))
       SELECT row_id, sha256(string_agg(k || '=' || array_to_string(vs, ','), ';' ORDER BY k || '=' || array_to_string(vs, ','))) AS digest FROM p GROUP BY 1"""
)
def json_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a JSON object that does not depend on the order of its keys."""
    rows = table(spark, sf_dir, "smoke_test", ["row_id", "generation_input"])
    lines = F.transform(F.map_entries(F.from_json("generation_input", "map<string,array<string>>")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return rows.select("row_id", lines.alias("lines")).where("size(lines) > 0").select("row_id", F.sha2(F.array_join(F.array_sort("lines"), ";"), 256).alias("digest"))


_RENDERED = """SELECT row_id, turn, role, chars, sum(chars) OVER (PARTITION BY row_id ORDER BY turn) - chars AS start FROM
    (SELECT row_id, turn, m.role AS role, (length(coalesce(m.role, '')) + length(coalesce(m.content, '')) + 2)::BIGINT AS chars FROM (SELECT row_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS turn FROM lora_data))"""


@query(f"SELECT row_id, start::BIGINT AS start, chars AS length FROM ({_RENDERED}) WHERE role = 'assistant'")
def supervision_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of a rendered record that are supervised: what precedes the answer is masked, and is its prefix."""
    rows = table(spark, sf_dir, "lora_data", ["row_id", "messages"]).where("size(messages) > 0")
    size = lambda m: (F.char_length(F.coalesce(m["role"], F.lit(""))) + F.char_length(F.coalesce(m["content"], F.lit(""))) + 2).cast("long")
    spans = F.aggregate(
        "messages", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + size(m)).alias("at"),
            F.when(m["role"] == "assistant", F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), size(m).alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ), lambda acc: acc["spans"],
    )
    return rows.select("row_id", F.explode(spans).alias("s")).select("row_id", "s.start", "s.length")


@query(
    f"""WITH {_ZONES_SQL}, v AS (SELECT 'control' AS variant, record_id, 0 AS facts FROM (SELECT DISTINCT record_id FROM q)
          UNION ALL SELECT 'ranked', record_id, count(*) FROM ranks WHERE list = 'title' AND rank <= 3 GROUP BY record_id UNION ALL SELECT 'zones', record_id, count(*) FROM z GROUP BY record_id)
        SELECT variant, count(*) AS records, sum(facts)::BIGINT AS facts, max(facts)::BIGINT AS most FROM v GROUP BY 1"""
)
def context_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of what a prompt is given: nothing, the best facts of a task, the four zones."""
    quality, ranks = _ranks(spark, sf_dir)
    none = quality.select("record_id").distinct().select(F.lit("control").alias("variant"), "record_id", F.lit(0).cast("long").alias("facts"))
    ranked = ranks.where("list = 'title' AND rank <= 3").groupBy("record_id").agg(F.count("*").alias("facts")).select(F.lit("ranked").alias("variant"), "record_id", "facts")
    zoned = four_zone_context(spark, sf_dir).groupBy("record_id").agg(F.count("*").alias("facts")).select(F.lit("zones").alias("variant"), "record_id", "facts")
    return none.unionByName(ranked).unionByName(zoned).groupBy("variant").agg(F.count("*").alias("records"), F.sum("facts").alias("facts"), F.max("facts").alias("most"))


@query(
    """WITH first AS (SELECT vec_id, category_l2 FROM (SELECT vec_id, category_l2, row_number() OVER (PARTITION BY category_l2 ORDER BY sha256('sample:42:' || vec_id), vec_id) AS r FROM feature_library) WHERE r <= 5)
       SELECT vec_id, category_l2, rank::INT AS rank FROM (SELECT vec_id, category_l2, row_number() OVER (PARTITION BY category_l2 ORDER BY sha256('sample:43:' || vec_id), vec_id) AS rank FROM feature_library
         WHERE vec_id NOT IN (SELECT vec_id FROM first)) WHERE rank <= 5"""
)
def sample_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sample that leaves out the rows of the first."""
    rows = table(spark, sf_dir, "feature_library", ["vec_id", "category_l2"])
    first = sampling.sample_per_group(rows, "category_l2", "vec_id", 5)
    return sampling.sample_per_group(rows.join(first.select("vec_id"), "vec_id", "left_anti"), "category_l2", "vec_id", 5, seed=43).select("vec_id", "category_l2", "rank")


@query(
    f"""SELECT review_status, count(*) AS rows, count_if(issue_code IS NOT NULL AND review_status = 'PASS')::BIGINT AS contradictory, count_if(coalesce(trim(title), '') = '')::BIGINT AS untitled,
        count_if(issue_code IS NOT NULL AND review_status = 'PASS') = 0 AND count_if(coalesce(trim(title), '') = '') = 0 AS publishable FROM week2_train_consistency_review GROUP BY 1"""
)
def publishable_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the reviews of a status may be published; a contradiction or a missing title refuses."""
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["review_status", "issue_code", "title"])
    counted = rows.groupBy("review_status").agg(
        F.count("*").alias("rows"), F.count_if(F.col("issue_code").isNotNull() & (F.col("review_status") == "PASS")).alias("contradictory"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("untitled")
    )
    return counted.withColumn("publishable", (F.col("contradictory") == 0) & (F.col("untitled") == 0))


@query(
    f"""WITH s AS (SELECT product_id, {_SPLIT_SQL} AS name FROM lora_data WHERE product_id IS NOT NULL)
        SELECT 'lora_data' AS source, name AS split, count(DISTINCT product_id) AS products, count(DISTINCT CASE WHEN product_id IN (SELECT product_id FROM s WHERE name = 'train') THEN product_id END) AS also_trained FROM s GROUP BY 2
        UNION ALL SELECT 'rag', scope, count(DISTINCT product_id), count(DISTINCT CASE WHEN product_id IN (SELECT product_id FROM s WHERE name = 'train') THEN product_id END) FROM rag WHERE product_id IS NOT NULL GROUP BY 2"""
)
def leak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of every split and scope, and those of them that are trained on, in one table."""
    lora = table(spark, sf_dir, "lora_data", ["product_id", "split"]).where("product_id IS NOT NULL").select(F.lit("lora_data").alias("source"), _split_name("split").alias("split"), "product_id")
    rag = table(spark, sf_dir, "rag", ["product_id", "scope"]).where("product_id IS NOT NULL").select(F.lit("rag").alias("source"), F.col("scope").alias("split"), "product_id")
    trained = lora.where("split = 'train'").select("product_id").distinct().withColumn("trained", F.lit(True))
    told = lora.unionByName(rag).distinct().join(trained, "product_id", "left")
    return told.groupBy("source", "split").agg(F.count("*").alias("products"), F.count("trained").alias("also_trained"))
