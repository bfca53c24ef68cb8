import pytest
from pyspark.sql import functions as F

from wareloom.functions import replies, text, urls
from wareloom.functions.hashing import map_fingerprint
from wareloom.operators import census, facts, grounding, review, validate


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).head()["r"]


@pytest.mark.parametrize("url, want", [
    ("http://A.example:80/x?q=1#f", "https://a.example:80/x?q=1"), ("https://a.example", "https://a.example"), ("nonsense", None), (None, None), ("http://[bad", None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonical_url) == want


def test_hosts_and_paths(spark):
    allowed = lambda c: urls.host_allowed(c, ["a.example"])
    assert [one(spark, u, allowed) for u in ("HTTP://A.example/x", "ftp://a.example/", "http://b.example", None)] == [True, False, False, False]
    assert [one(spark, p, urls.id_from_path) for p in ("x/500.webp", "x/5e3a.webp", None)] == ["500", None, None]


def test_text_forms(spark):
    assert one(spark, "ＡＢ　c\u00a0d⽔", text.fold_width) == "AB c d水"
    assert one(spark, " ＡＢ-1\u200b中！", text.letters_only) == "ab1中"
    assert one(spark, "abcd", lambda c: text.ngrams(c, 3)) == ["abc", "bcd"] and one(spark, "ab", lambda c: text.ngrams(c, 3)) == []


def test_replies(spark):
    good = '```json\n{"generated_title": "t", "selling_points": ["a", "b", "c"], "short_description": "d"}\n```'
    cases = {good: "ok", "sorry": "no_object", good.replace('"b", ', ""): "wrong_points", good.replace('"t"', '" "'): "missing_field"}
    for reply, want in cases.items():
        assert one(spark, reply, replies.reply_status) == want
    for reply in ('["a", "b"]', "1. a\n2. b", "- a\n\n- b"):
        assert one(spark, reply, replies.listed_points) == ["a", "b"]


def test_fingerprint_ignores_order_and_case(spark):
    df = spark.sql("SELECT 'T' AS t, map('a', array('1', '2'), 'b', array('3')) AS m UNION ALL SELECT 't', map('b', array('3'), 'a', array('2', '1')) UNION ALL SELECT 't', map('b', array('4'))")
    assert df.select(map_fingerprint(F.col("t"), F.col("m")).alias("f")).distinct().count() == 2


def test_multimap(spark):
    packed = "a#:#1#;#b#:#2#;#a#:#3#;#a#:#1#;#bad#;##;#c#:#"
    assert [(e["name"], e["values"]) for e in one(spark, packed, facts.parse_multimap)] == [("a", ["1", "3"]), ("b", ["2"])]
    assert one(spark, packed, facts.multimap_issues) == ["bad_separator", "empty_part", "empty_value"]
    assert one(spark, None, facts.multimap_issues) == ["not_text"] and one(spark, None, facts.parse_multimap) is None


def test_placeholders(spark):
    rule = lambda c: facts.is_placeholder(c, ("无", "other"))
    assert [one(spark, v, rule) for v in ("无", "Other / 无", "无 / 红", "红")] == [True, True, False, False]


def test_fact_quality_and_zones(spark):
    policy = spark.createDataFrame([("品牌", "品牌", "identity", 1), ("Brand", "品牌", "identity", 1), ("功率", "功率", "spec", 2), ("功能", "功能", "usage", 3)], "name string, field string, role string, field_order int")
    records = spark.createDataFrame([(1, {"Brand": ["x"], "品牌": ["y"], "功率": ["1W", "2W"], "功能": ["a", "b"], "?": ["z"]}), (2, {"品牌": ["q", None, " "]}), (3, {"功能": []})], "record_id bigint, attributes map<string,array<string>>")
    units = facts.fact_units(records, policy)
    assert {(r["record_id"], r["field"]): r["values"] for r in units.collect()} == {(1, "品牌"): "y", (1, "功率"): "1W,2W", (1, "功能"): "a,b", (2, "品牌"): "q"}
    marks = spark.createDataFrame([(2, "品牌", "CONFLICT"), (1, "功能", "REVIEW")], "record_id bigint, field string, status string")
    quality = {(r["record_id"], r["field"]): r["quality"] for r in facts.fact_quality(units, marks, ("功能",)).collect()}
    assert quality == {(1, "品牌"): "usable", (1, "功率"): "withheld", (1, "功能"): "withheld", (2, "品牌"): "blocked"}


def test_cascade_takes_the_first_failure_and_nulls_do_not_fail(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "xy")], "id int, t string")
    rules = [("short", F.length("t") < 2), ("has_x", F.col("t").contains("x"))]
    assert {r["id"]: r["reason"] for r in census.first_failure(df, rules).collect()} == {1: "accepted", 2: "short", 3: "has_x"}


def test_lookup_must_be_unique(spark):
    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError):
        census.lookup_unique(df, spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), "k")


def test_upsert_deltas_digest(spark):
    schema = "version string, scope string, is_base boolean, metric double"
    log = spark.createDataFrame([("v1", "s", True, 1.0), ("v2", "s", False, 1.5), ("v3", "t", False, 2.0), ("a", "u", True, 1.0), ("b", "u", True, 1.0), ("c", "u", False, 3.0)], schema)
    new = spark.createDataFrame([("v2", "s", False, 1.25)], schema)
    merged = review.upsert_log(log, new, ["version", "scope"])
    assert merged.count() == 6 and merged.where("version = 'v2'").head()["metric"] == 1.25
    notes = {r["version"]: (r["note"], r["delta"]) for r in review.baseline_deltas(merged, ["scope"], "version", "is_base", "metric").collect()}
    assert notes["v2"] == ("compared", 0.25) and notes["v3"] == ("no_baseline", None) and notes["c"] == ("several_baselines", None) and notes["v1"][0] == "is_baseline"
    digest = lambda d: review.table_digest(d, ["version", "metric"]).head()
    assert digest(log) == digest(log.orderBy("metric").repartition(3)) and digest(log) != digest(merged)
    assert digest(log.limit(0))["rows"] == 0


def test_review_tables(spark):
    votes = spark.createDataFrame([(1, "d", "A"), (2, "d", "tie"), (3, "d", "?")], "k int, dimension string, choice string")
    mapping = spark.createDataFrame([(i, "x", "y") for i in (1, 2, 3)], "k int, a_is string, b_is string")
    assert {r["k"]: r["winner"] for r in review.unblind(votes, mapping, "k").collect()} == {1: "x", 2: "tie", 3: None}
    assert {r["choice"]: r["votes"] for r in review.vote_table(votes, "dimension", "choice", ["A", "B"]).collect()} == {"A": 1, "B": 0}
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k int, f string, g int")
    b = spark.createDataFrame([(1, "x", 5), (3, "z", None)], "k int, f string, g int")
    assert {(r["k"], r["field"]) for r in review.cell_changes(a, b, "k", ["f", "g"]).collect()} == {(1, "g"), (2, "f"), (2, "g"), (3, "f")}


def test_grounding_and_validators(spark):
    texts = spark.createDataFrame([(1, "功率12W，最好", "12W"), (2, None, None), (3, "9kg", None)], "text_id int, text string, facts string")
    patterns = spark.createDataFrame([("figure", "[0-9]+(?:W|kg)"), ("praise", "最好")], "class string, pattern string")
    found = grounding.findings(texts, patterns)
    assert {(r["text_id"], r["span"]) for r in found.collect()} == {(1, "最好"), (3, "9kg")}
    assert {r["text_id"]: r["status"] for r in grounding.status(texts, found).collect()} == {1: "FAIL", 2: "PASS", 3: "FAIL"}
    assert {r["text_id"] for r in grounding.unsupported_figures(texts.withColumnRenamed("facts", "source")).collect()} <= {3}
    df = spark.createDataFrame([(1, "a"), (1, None), (2, " ")], "k int, v string")
    assert validate.repeated_keys(df, ["k"]).count() == 1 and validate.missing_fields(df, "k", ["v"]).count() == 2
    assert validate.broken(df, "k", {"set": F.col("v") == "a"}).count() == 2
    with pytest.raises(ValueError):
        validate.raise_if_any(validate.repeated_keys(df, ["k"]), "repeated")
