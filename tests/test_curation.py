from wareloom.plans import curation


def test_funnel(spark):
    good = [(i, f"p{i}", "A" if i % 2 else "B", f"http://h.example/{i}", f"k{i}a:1;k{i}b:2;k{i}c:3") for i in range(24)]
    bad = [
        (100, "p0", "A", "http://h.example/x", "a:1;b:2;c:3"), (101, "q1", "A", "http://h.example/y", good[3][4]), (102, "q2", "A", "https://H.example/5", "x:1;y:2;z:3"),
        (103, "q3", "A", "http://h.example/z", "x:1"), (104, "q4", "other", "http://h.example/w", "x:1;y:2;z:3"), (105, "q5", "A", None, "m:1;n:2;o:3"), (106, "q6", "A", "http://h.example/v", None),
    ]
    feed = spark.createDataFrame(good + bad, "row_id bigint, product_id string, label string, url string, attributes string")
    categories = spark.createDataFrame([("A", "A"), ("B", "B")], "label string, category string")
    traced = spark.createDataFrame([("p0",), ("p1",)], "product_id string")
    funnel = curation.curate(feed, categories, curation.standard_rules(), 12, {"old": traced})
    rows = funnel.selected.collect()
    assert len(rows) == 24 and sum(r["found_in"] == "old" for r in rows) == 2
    assert {r["reason"]: r["rows"] for r in funnel.reasons.collect()} == {
        "repeated_product_id": 1, "repeated_content": 1, "repeated_image": 1, "few_entries": 1, "bad_url": 1, "no_attributes": 1,
    }
