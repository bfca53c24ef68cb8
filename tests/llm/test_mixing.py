import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wareloom.llm import mixing

FILE = os.path.join(mixing.TOKENIZER_FOLDER, mixing.TOKENIZER_FILE)
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")


def test_shortage_goes_to_siblings_first():
    tree = mixing.Node("", 1, children=[mixing.Node("d1", 0.5, children=[mixing.Node("a", 1, 10), mixing.Node("b", 1, 1000)]), mixing.Node("c", 0.5, 1000)])
    assert mixing.hand_down(tree, 200) == pytest.approx({"a": 10, "b": 90, "c": 100})
    tree.children[0].children[1].capacity = 40
    assert mixing.hand_down(tree, 200) == pytest.approx({"a": 10, "b": 40, "c": 150})
    assert mixing.largest_total(tree) == pytest.approx(40)


@given(st.lists(st.tuples(st.floats(0.01, 1), st.floats(0, 1000)), min_size=1, max_size=8), st.floats(0, 5000))
@settings(max_examples=200, deadline=None)
def test_budgets_fill_what_there_is_and_no_more(leaves, budget):
    tree = mixing.Node("", 1, children=[mixing.Node(str(i), w, c) for i, (w, c) in enumerate(leaves)])
    got = mixing.hand_down(tree, budget)
    assert all(got[str(i)] <= c + 1e-6 for i, (_, c) in enumerate(leaves))
    assert sum(got.values()) == pytest.approx(min(budget, sum(c for _, c in leaves)), abs=1e-6)


@needs_file
def test_selection_meets_shares_and_caps(spark):
    rows = [(i, "big", f"词语 number {i} " * 5) for i in range(600)] + [(1000 + i, "small", f"说明 {i} " * 4) for i in range(40)]
    rows += [(2000, None, "no source"), (2001, "big", None), (2002, "big", " 　"), (2003, "unknown", "text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("epoch", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(docs, targets, FILE)
    got = {r["source"]: r for r in report.collect()}
    assert got["big"]["actual_share"] == pytest.approx(0.7, abs=0.02) and got["small"]["max_use"] <= 3 and got["absent"]["selected_tokens"] == 0
    uses = selection.groupBy("source", "doc_id").count()
    assert uses.where("source = 'big'").agg(F.max("count")).head()[0] == 1
    assert uses.where("source = 'small'").agg((F.max("count") - F.min("count"))).head()[0] <= 1
    assert not {r["doc_id"] for r in selection.collect()} & {2000, 2001, 2002, 2003}
    again, _ = mixing.mix(docs.repartition(5), targets, FILE)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))


def test_a_weightless_or_full_leaf_keeps_no_tokens_from_others():
    tree = mixing.Node("", 1, children=[mixing.Node("d1", 0.5, children=[mixing.Node("a", 1, 10), mixing.Node("b", 0, 1000)]), mixing.Node("c", 0.5, 1000)])
    assert mixing.hand_down(tree, 200) == pytest.approx({"a": 10, "b": 0, "c": 190})
    assert mixing.wanted_tokens(tree, 200) == pytest.approx({"a": 100, "b": 0, "c": 100})
    gone = mixing.Node("", 1, children=[mixing.Node("a", 0.5, 0), mixing.Node("b", 0.3, 60), mixing.Node("c", 0.2, 60)])
    assert mixing.largest_total(gone) == pytest.approx(100)


@needs_file
def test_a_source_with_a_share_and_no_documents_is_filled_up_by_the_others(spark):
    rows = [(i, "big", f"词语 number {i} " * 5) for i in range(300)] + [(1000 + i, "scarce", f"说明 {i} " * 4) for i in range(10)]
    docs = spark.createDataFrame(rows + [(2000 + i, "mid", f"text {i} " * 6) for i in range(200)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("scarce", 0.2, 2), ("mid", 0.2, 3), ("absent", 0.2, 4)], "source string, target_share double, max_repeats int")
    for options in ({}, {"all_usable": True}, {"total_tokens": 3000}):
        selection, report = mixing.mix(docs, targets, FILE, **options)
        got = {r["source"]: r for r in report.collect()}
        assert got["absent"]["selected_tokens"] == 0 and got["absent"]["shortage_tokens"] == got["absent"]["target_tokens"] > 0
        assert all(r["max_use"] <= r["max_repeats"] for r in got.values())
        total = sum(r["selected_tokens"] for r in got.values())
        assert total > 0 and sum(r["actual_share"] for r in got.values()) == pytest.approx(1.0)
        wanted = 3000 if "total_tokens" in options else sum(r["available_tokens"] for r in got.values()) if options else total
        assert total == pytest.approx(wanted, rel=0.02)
    # "scarce" fills what it can and the two others share the rest as 2 to 1, as far as they go
    assert got["scarce"]["selected_tokens"] == min(600, 2 * got["scarce"]["available_tokens"])
    assert got["big"]["selected_tokens"] == pytest.approx(2 * got["mid"]["selected_tokens"], rel=0.05)


@needs_file
def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(docs, targets, FILE)
    assert selection.count() == 0 and report.head()["actual_share"] == 0.0
    assert mixing.mix(docs, targets.limit(0), FILE)[1].count() == 0


@needs_file
def test_token_counts_agree_with_an_exact_round_trip():
    import base64

    import tiktoken

    with open(FILE, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    enc = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    text = "加湿器 2.5L mit Leuchte, すぐ使える"
    assert enc.decode(enc.encode_ordinary(text)) == text and 0 < mixing.token_counter("x.tiktoken", data)(text) <= len(text.encode())


def test_tree_by_domain_language_and_source_against_hand_figures():
    leaves = [
        (("d1", "zh", "a"), 0.3, 100.0), (("d1", "zh", "b"), 0.1, 1000.0), (("d1", "en", "a"), 0.1, 40.0), (("d2", "zh", "c"), 0.5, 300.0),
    ]
    top = mixing.build_tree(leaves, {})
    assert mixing.wanted_tokens(top, 400) == pytest.approx({"d1/zh/a": 120, "d1/zh/b": 40, "d1/en/a": 40, "d2/zh/c": 200})
    # a short leaf is filled by its sibling b, within the domain's 200
    assert mixing.hand_down(top, 400) == pytest.approx({"d1/zh/a": 100, "d1/zh/b": 60, "d1/en/a": 40, "d2/zh/c": 200})
    # at 800 the domain d2 (400 wanted, 300 there) and the language en run short: zh of d1 takes both
    assert mixing.hand_down(top, 800) == pytest.approx({"d1/zh/a": 100, "d1/zh/b": 360, "d1/en/a": 40, "d2/zh/c": 300})


@needs_file
def test_tree_report_adds_up_and_null_levels_have_a_leaf(spark):
    rows = [(i, "big", f"词语 number {i} " * 5, "zh" if i % 3 else "en") for i in range(300)] + [(1000 + i, "scarce", f"说明 {i} " * 4, None) for i in range(10)]
    docs = spark.createDataFrame(rows + [(2000 + i, "mid", f"text {i} " * 6, " ZH") for i in range(200)], "doc_id bigint, source string, text string, lang string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("scarce", 0.3, 2), ("mid", 0.3, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    selection, report, tree = mixing.mix_tree(docs, targets, FILE, domain_of={"big": "d1", "mid": "d1", "scarce": "d2"}, levels=("lang",), all_usable=True)
    at = {r["path"]: r for r in tree.collect()}
    assert {p for p, r in at.items() if r["level"] == 1} == {"d1", "d2"} and "d2/unknown/scarce" in at and "d1/zh/mid" in at
    assert at["d2"]["budget_tokens"] == at["d2"]["capacity_tokens"] < at["d2"]["target_tokens"] and at["d1"]["budget_tokens"] > at["d1"]["target_tokens"]
    assert at["d1"]["selected_tokens"] + at["d2"]["selected_tokens"] == selection.agg(F.sum("n_tokens")).head()[0]
    assert sum(r["actual_share"] for r in report.collect()) == pytest.approx(1.0)
