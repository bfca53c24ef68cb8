"""Review progress, human metrics, blind preferences, latency, experiment log, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.operators import paired, review
from wareloom.queries.registry import query
from wareloom.session import table


@query(
    """SELECT review_status, count(*) AS rows, count_if(issue_code IS NOT NULL)::BIGINT AS with_issue, count_if(review_note IS NULL OR trim(review_note) = '')::BIGINT AS no_note
       FROM week2_train_consistency_review GROUP BY 1"""
)
def annotation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["review_status", "issue_code", "review_note"])
    return rows.groupBy("review_status").agg(
        F.count("*").alias("rows"), F.count_if(F.col("issue_code").isNotNull()).alias("with_issue"), F.count_if(F.col("review_note").isNull() | (F.trim("review_note") == "")).alias("no_note")
    )


_HUMAN = """count(*) AS rows, round(sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0), 6) AS pass_rate,
    round(sum(CASE WHEN issue_code IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN status <> 'PASS' THEN 1 ELSE 0 END), 0), 6) AS issue_ratio,
    round(avg(length(attributes)), 6) AS mean_chars"""


def _human(rows: DataFrame, groups: list[str]) -> DataFrame:
    flag = lambda c: F.when(c, 1).otherwise(0)
    ratios = {
        "pass_rate": (flag(F.col("status") == "PASS"), F.lit(1)),
        "issue_ratio": (flag(F.col("issue_code").isNotNull()), flag(F.col("status") != "PASS")),
    }
    return review.micro_rates(rows, groups, ratios, {"mean_chars": F.char_length("attributes")})


@query(f"SELECT {_HUMAN} FROM rag")
def human_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _human(table(spark, sf_dir, "rag", ["status", "issue_code", "attributes"]), [])


@query(f"SELECT audit_version, category_l1, {_HUMAN} FROM rag GROUP BY audit_version, category_l1")
def human_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _human(table(spark, sf_dir, "rag", ["status", "issue_code", "attributes", "audit_version", "category_l1"]), ["audit_version", "category_l1"])


_VOTES = """SELECT row_id, d AS dimension, CASE (row_id * 7 + d_no * 3) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS choice,
    CASE WHEN row_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS a_is, CASE WHEN row_id % 2 = 0 THEN 'tuned' ELSE 'base' END AS b_is
    FROM smoke_test CROSS JOIN (VALUES ('fluency', 1), ('facts', 2), ('style', 3)) v(d, d_no)"""


def _votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "smoke_test", ["row_id"])
    dims = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).alias("no")) for d, n in (("fluency", 1), ("facts", 2), ("style", 3))])
    pick = (F.col("row_id") * 7 + F.col("v.no") * 3) % 3
    votes = rows.select("row_id", F.explode(dims).alias("v")).select("row_id", F.col("v.d").alias("dimension"), F.when(pick == 0, "A").when(pick == 1, "B").otherwise("tie").alias("choice"))
    even = F.col("row_id") % 2 == 0
    mapping = rows.select("row_id", F.when(even, "base").otherwise("tuned").alias("a_is"), F.when(even, "tuned").otherwise("base").alias("b_is"))
    return votes, mapping


@query(
    f"""WITH d AS (SELECT DISTINCT dimension FROM ({_VOTES})), c AS (SELECT dimension, choice, count(*) AS votes FROM ({_VOTES}) GROUP BY 1, 2)
        SELECT d.dimension, x.choice, coalesce(votes, 0) AS votes FROM d CROSS JOIN (VALUES ('A'), ('B'), ('tie'), ('none')) x(choice)
        LEFT JOIN c ON c.dimension = d.dimension AND c.choice = x.choice"""
)
def preference_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.vote_table(_votes(spark, sf_dir)[0], "dimension", "choice", ["A", "B", "tie", "none"])


@query(
    f"""SELECT dimension, CASE choice WHEN 'tie' THEN 'tie' WHEN 'A' THEN a_is ELSE b_is END AS winner, count(*) AS votes FROM ({_VOTES}) GROUP BY 1, 2"""
)
def unblinded_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes, mapping = _votes(spark, sf_dir)
    return review.unblind(votes, mapping, "row_id").groupBy("dimension", "winner").agg(F.count("*").alias("votes"))


@query(
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_disc(value, 0.95), 6) AS p95_nearest, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latency_summary(table(spark, sf_dir, "events", ["event_type", "value"]), ["event_type"], "value")


@query(
    """SELECT prompt_version, count(latency_seconds) AS n, round(avg(latency_seconds), 6) AS mean, round(quantile_cont(latency_seconds, 0.5), 6) AS p50,
       round(quantile_cont(latency_seconds, 0.95), 6) AS p95, round(quantile_disc(latency_seconds, 0.95), 6) AS p95_nearest, round(min(latency_seconds), 6) AS low,
       round(max(latency_seconds), 6) AS high FROM smoke_test GROUP BY 1"""
)
def generation_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latency_summary(table(spark, sf_dir, "smoke_test", ["prompt_version", "latency_seconds"]), ["prompt_version"], "latency_seconds")


@query(
    """WITH d AS (SELECT event_type, cast(ts AS DATE)::VARCHAR AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2)
       SELECT event_type, day, loss, min(loss) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM d"""
)
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events", ["event_type", "ts", "value"]).groupBy("event_type", F.col("ts").cast("date").cast("string").alias("day"))
    return review.running_best(daily.agg(F.round(F.avg("value"), 6).alias("loss")), ["event_type"], "day", "loss")


@query(
    """SELECT event_type, count(*) AS rows, min((props->>'k')::BIGINT) AS low, max((props->>'k')::BIGINT) AS high, round(avg((props->>'k')::BIGINT), 6) AS mean
       FROM events GROUP BY 1"""
)
def json_props_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", ["event_type", "props"]).select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"), F.round(F.avg("k"), 6).alias("mean"))


_LOG = """SELECT run_id AS version, prompt_version AS scope, round(avg(latency_seconds), 6) AS metric FROM smoke_test WHERE run_id IS NOT NULL AND prompt_version IS NOT NULL GROUP BY 1, 2"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "smoke_test", ["run_id", "prompt_version", "latency_seconds"]).where("run_id IS NOT NULL AND prompt_version IS NOT NULL")
    return rows.groupBy(F.col("run_id").alias("version"), F.col("prompt_version").alias("scope")).agg(F.round(F.avg("latency_seconds"), 6).alias("metric"))


@query(f"WITH l AS ({_LOG}) SELECT version, scope, CASE WHEN scope = (SELECT min(scope) FROM l) THEN round(metric + 1, 6) ELSE metric END AS metric FROM l")
def experiment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New figures for the runs of one scope take the place of the old."""
    log = _log(spark, sf_dir)
    first = log.agg(F.min("scope").alias("scope"))
    new = log.join(F.broadcast(first), "scope").select("version", "scope", F.round(F.col("metric") + 1, 6).alias("metric"))
    return review.upsert_log(log, new, ["version", "scope"])


@query(
    f"""WITH l AS (SELECT *, version = (SELECT min(version) FROM ({_LOG})) AS is_base FROM ({_LOG})), b AS (SELECT scope, count(*) AS n, min(metric) AS base FROM l WHERE is_base GROUP BY 1)
        SELECT scope, version, is_base, metric, CASE WHEN is_base THEN 'is_baseline' WHEN n IS NULL THEN 'no_baseline' WHEN n > 1 THEN 'several_baselines' ELSE 'compared' END AS note,
        CASE WHEN NOT is_base AND n = 1 THEN round(metric - base, 6) END AS delta FROM l LEFT JOIN b USING (scope)"""
)
def experiment_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    marked = log.crossJoin(F.broadcast(log.agg(F.min("version").alias("_v")))).withColumn("is_base", F.col("version") == F.col("_v")).drop("_v")
    return review.baseline_deltas(marked, ["scope"], "version", "is_base", "metric")


@query(
    """WITH o AS (SELECT avg(latency_seconds) AS mean_latency, avg(generated_tokens) AS mean_tokens FROM smoke_test)
       SELECT 'mean_latency' AS metric, mean_latency AS observed, 12.0::DOUBLE AS target, mean_latency <= 12.0 AS passed FROM o
       UNION ALL SELECT 'mean_tokens', mean_tokens, 500.0::DOUBLE, mean_tokens >= 500.0 FROM o"""
)
def target_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = table(spark, sf_dir, "smoke_test", ["latency_seconds", "generated_tokens"]).agg(
        F.avg("latency_seconds").alias("mean_latency"), F.avg("generated_tokens").alias("mean_tokens")
    )
    return review.target_gates(observed, [("mean_latency", 12.0, "<="), ("mean_tokens", 500.0, ">=")]).withColumn("observed", F.round("observed", 6))


@query(
    """WITH e AS (SELECT product_id AS name, min(sha256(title)) AS d FROM week2_train_consistency_review WHERE product_id IS NOT NULL GROUP BY 1),
       o AS (SELECT product_id AS name, max(sha256(title)) AS d FROM week2_train_consistency_review WHERE product_id IS NOT NULL AND row_id % 5 <> 0 GROUP BY 1)
       SELECT name, CASE WHEN o.d IS NULL THEN 'missing' WHEN e.d IS NULL THEN 'unexpected' WHEN e.d = o.d THEN 'equal' ELSE 'changed' END AS status
       FROM e FULL JOIN o USING (name)"""
)
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against observed digests; every fifth row plays a lost observation."""
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "product_id", "title"]).where("product_id IS NOT NULL")
    digest = F.sha2("title", 256)
    expected = rows.groupBy(F.col("product_id").alias("name")).agg(F.min(digest).alias("digest"))
    observed = rows.where("row_id % 5 <> 0").groupBy(F.col("product_id").alias("name")).agg(F.max(digest).alias("digest"))
    return review.verify_manifest(expected, observed)


_LATEST = """SELECT product_id, issue_code, status, scope FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY row_id {o}) AS r FROM rag
    WHERE product_id IS NOT NULL AND audit_version = '{v}') WHERE r = 1"""


@query(
    f"""WITH b AS ({_LATEST.format(o='', v='audit_v1')}), a AS ({_LATEST.format(o='', v='audit_v2')}),
        j AS (SELECT coalesce(b.product_id, a.product_id) AS product_id, b.issue_code AS b1, a.issue_code AS a1, b.status AS b2, a.status AS a2
              FROM b FULL JOIN a ON a.product_id = b.product_id)
        SELECT product_id, 'issue_code' AS field, b1 AS old, a1 AS new FROM j WHERE b1 IS DISTINCT FROM a1
        UNION ALL SELECT product_id, 'status', b2, a2 FROM j WHERE b2 IS DISTINCT FROM a2"""
)
def audit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ between two audits of a product."""
    from wareloom.operators.dedup import smallest_by

    rows = table(spark, sf_dir, "rag", ["row_id", "product_id", "issue_code", "status", "audit_version"]).where("product_id IS NOT NULL")
    first = lambda v: smallest_by(rows.where(F.col("audit_version") == v), ["product_id"], ["row_id"])
    return review.cell_changes(first("audit_v1"), first("audit_v2"), "product_id", ["issue_code", "status"])


@query(
    """WITH a AS (SELECT product_id, min({'s': status, 'i': issue_code}) AS x FROM rag WHERE audit_version = 'audit_v1' AND product_id IS NOT NULL GROUP BY 1),
       b AS (SELECT product_id, min({'s': status, 'i': issue_code}) AS x FROM rag WHERE audit_version = 'audit_v2' AND product_id IS NOT NULL GROUP BY 1)
       SELECT product_id, a.x.s AS status_a, b.x.s AS status_b, a.x.s IS DISTINCT FROM b.x.s AS differs FROM a JOIN b USING (product_id)"""
)
def paired_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both audits of a product side by side."""
    rows = table(spark, sf_dir, "rag", ["product_id", "audit_version", "status"]).where("product_id IS NOT NULL")
    return paired.pair_variants(rows, "product_id", "audit_version", "audit_v1", "audit_v2", ["status"])


@query(
    """SELECT row_id, trim(title) || CASE WHEN trim(review_note) <> '' THEN chr(10) || trim(review_note) ELSE '' END AS text
       FROM week2_train_consistency_review WHERE trim(title) <> ''"""
)
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title", "review_note"]).where("trim(title) <> ''")
    return rows.select("row_id", paired.joined_text(F.col("title"), F.col("review_note")).alias("text"))


@query(
    """SELECT row_id, CASE WHEN strpos(lower(title), lower(category_l2)) > 0 THEN strpos(lower(title), lower(category_l2)) - 1 ELSE 1000000000 END AS place
       FROM week2_train_consistency_review"""
)
def native_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "week2_train_consistency_review", ["row_id", "title", "category_l2"])
    return rows.select("row_id", paired.native_position(F.col("title"), F.col("category_l2")).cast("long").alias("place"))


@query("SELECT prompt_version, coalesce(printf('%.6f', avg(latency_seconds)), '') AS latency, coalesce(printf('%.6f', avg(generated_tokens)), '') AS tokens FROM smoke_test GROUP BY 1")
def formatted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text with six decimals, blank for null."""
    rows = table(spark, sf_dir, "smoke_test", ["prompt_version", "latency_seconds", "generated_tokens"]).groupBy("prompt_version").agg(
        F.avg("latency_seconds").alias("a"), F.avg("generated_tokens").alias("b")
    )
    text = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", c))
    return rows.select("prompt_version", text("a").alias("latency"), text("b").alias("tokens"))
