import numpy as np
import pytest

from wareloom.llm import pairs

ASK = "请根据下列可靠属性撰写一段简短介绍。\n品类：数码电器/桌面台灯\n属性：\n- 品牌：北苔\n- 功率：12W\n- 型号：AB{n}CD\n输出要求：八十字以内，只用给出的属性。"


def good(n):
    return f"这款桌面台灯来自北苔的{'雾山海川'[n % 4]}系列，型号AB{1000 + n}CD，功率为12W，机身使用铝合金，净重约{n}g，电源线固定在底部，无法自行更换。"


CASES = {
    1000: (None, "empty"), 1001: (" ​\n", "empty"), 1002: ("```json\n{}\n```", "empty"), 1003: ('["", " "]', "empty"), 1004: ("null", "empty"),
    1010: (ASK.format(n=1010), "copies_question"), 1011: ("好的，" + ASK.format(n=1011)[:70], "copies_question"),
    1020: ("抱歉，我无法完成这项写作，建议联系客服。", "refusal"), 1021: ("I'm sorry, but I can't help with writing this listing.", "refusal"), 1022: ("申し訳ありませんが、お手伝いできません。", "refusal"),
    1030: ("This lamp from the north line keeps its settings after power loss and fits every desk in the house.", "other_language"),
    1031: ("このデスクランプは丈夫な素材を使い、寝室でもオフィスでも使いやすいです。", "other_language"),
    1040: ("这款桌面台灯来自北苔的雾系列，型号AB1040CD，电源线固定在", "truncated"), 1041: ('["功率为12W", "机身使用铝合', "truncated"),
    1042: ("这款桌面台灯来自北苔的雾系列，功率为12W，", "truncated"), 1043: ('["功率为12W", "机身使用铝合金",', "truncated"), 1044: ("这款桌面台灯来自北苔的雾系列，机身使用铝合金，净重约", "truncated"),
    1012: ('{"generated_title": "' + ASK.format(n=1012).replace("\n", "\\n") + '", "selling_points": ["' + ASK.format(n=1012).replace("\n", "\\n") + '"]}', "copies_question"),
    1050: ("这款桌面台灯来自北苔的雾系列，型号AB1050CD，功率为12W", None),  # no closing mark, but whole
    1051: ("- 型号AB1051CD\n- 功率为12W\n- 机身使用铝合金", None),
    1052: ("如遇运输破损我们深表抱歉并安排补发，净重约9g，功率为12W。", None),
}


@pytest.fixture(scope="module")
def talks(spark):
    rows = [("lora_data", n, ASK.format(n=1000 + n), good(n)) for n in range(300)]
    rows += [("smoke_test", n, ASK.format(n=n), reply) for n, (reply, _) in CASES.items()]
    rows += [("smoke_test", 1060, ASK.format(n=1060).replace("八十字以内", "请用英文输出"), "This lamp keeps its settings after power loss and fits the desk."), ("smoke_test", 1061, None, good(7))]
    return spark.createDataFrame(rows, "record_source string, row_id bigint, prompt string, reply string")


def test_each_defect(talks):
    got = {(r["record_source"], r["row_id"]): r["defect_type"] for r in pairs.main_defect(pairs.broken_pairs(talks)).collect()}
    assert got == {("smoke_test", n): d for n, (_, d) in CASES.items() if d}


def test_cutoffs_chosen_on_one_half_hold_on_the_other(talks):
    scored = {r["row_id"]: r for r in pairs.label_posteriors(talks).where("record_source = 'smoke_test' AND row_id < 1060").collect()}
    told = [({d: scored[n][d] for d in pairs.DEFECTS}, defect) for n, (_, defect) in sorted(CASES.items())]
    chosen = pairs.choose_cutoffs(told[::2])
    first_above = lambda p, limits: next((d for d in pairs.DEFECTS if p[d] > limits[d]), None)
    for limits in (chosen, pairs.CUTOFFS):
        assert [first_above(p, limits) for p, _ in told[1::2]] == [d for _, d in told[1::2]]


def test_functions_of_a_defect_are_different_witnesses(spark, talks):
    more = [("x", 1, ASK.format(n=1), ASK.format(n=1) + good(1) * 5), ("x", 2, ASK.format(n=2), "品牌：北苔"), ("x", 4, ASK.format(n=4), ASK.format(n=4)[14:]), ("x", 6, ASK.format(n=6), "抱歉让您久等了，这款台灯功率为12W，型号AB1006CD。"), ("x", 7, ASK.format(n=7), "Ask me again for the lamp."), ("x", 8, ASK.format(n=8), "Der Lampenschirm leuchtet."), ("x", 5, ASK.format(n=5), "好的。" + "".join(sorted(ASK.format(n=5)))), ("x", 3, ASK.format(n=3), "抱歉，北苔品牌这款灯的功率为12W，型号为AB1003CD，我不能说更多。")]
    table, functions = pairs.votes(talks.unionByName(spark.createDataFrame(more, talks.schema)))
    rows = [r.asDict() for r in table.collect()]
    for names in functions.values():
        for a in range(len(names)):
            for b in range(a):
                assert any(r[names[a]] != r[names[b]] for r in rows), (names[a], names[b])


def test_several_labels_are_kept_above_their_cutoffs(talks):
    many = pairs.broken_pairs(talks, {d: 0.0 for d in pairs.DEFECTS}).groupBy("record_source", "row_id").count()
    assert many.where("count > 1").count() > 0
    assert pairs.broken_pairs(talks, {d: 1.0 for d in pairs.DEFECTS}).count() == 0


def test_very_long_and_empty_input(spark, talks):
    long = spark.createDataFrame([("x", 1, "请写介绍", good(1) * 4000)], talks.schema)
    assert pairs.broken_pairs(talks.unionByName(long)).where("record_source = 'x' AND defect_type <> 'refusal'").count() == 0
    assert pairs.broken_pairs(talks.limit(0)).count() == 0


def test_label_model_finds_the_planted_class():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.08
    votes = np.stack([np.where(rng.random(20000) < 0.15, 0, np.where(truth, np.where(rng.random(20000) < a, 1, -1), np.where(rng.random(20000) < b, 1, -1))) for a, b in ((0.9, 0.02), (0.7, 0.05), (0.8, 0.1))], axis=1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    said = pairs.fit_label_model(patterns, counts.astype(float))[where] > 0.5
    assert (said == truth).mean() > 0.97 and said[truth].mean() > 0.8
