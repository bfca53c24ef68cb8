import pytest
from pyspark.sql import functions as F

from wareloom.operators.packed import packed_items, packed_list, packed_pairs

PAIRS = {
    "品牌#:#北苔#;#颜色#:#黑;白#;##;#产地#:##;#详见主图#;# 净重 #:# 850克 #;#": [("品牌", "北苔"), ("颜色", "黑;白"), ("净重", "850克")],
    "颜色:黑;白;尺寸:7\";定时:10:30开启": [("颜色", "黑;白"), ("尺寸", '7"'), ("定时", "10:30开启")],
    "尺寸:\"8.4\"\"\",材质='AB''S'": [("尺寸", '8.4"'), ("材质", "AB'S")],
    '"品牌:北苔;尺寸:7"""': [("品牌", "北苔"), ("尺寸", '7"')],
    "型号::A1||颜色::「黑||白」||备注::请以“实物”为准|谢谢": [("型号", "A1"), ("颜色", "黑||白"), ("备注", "请以“实物”为准|谢谢")],
    "a = 1 ;  ; b=“x;y=z”;c=;=d;a = 1": [("a", "1"), ("b", "x;y=z"), ("a", "1")],
    "品牌:甲 / 系列: 乙 /  / 定时:08:30开启 /": [("品牌", "甲"), ("系列", "乙"), ("定时", "08:30开启")],
    "产品=红,蓝\n重量:3斤\t长度：2m": [("产品", "红,蓝"), ("重量", "3斤"), ("长度", "2m")],
    "颜色:红": [("颜色", "红")],
    "": [],
    " \u3000\n": [],
    "没有分隔": [],
    None: [],
}
LISTS = {
    "净重|认证|备案号|型号": ["净重", "认证|备案号", "型号"],
    '["净重", "尺寸(长,宽,高)"]': ["净重", "尺寸(长,宽,高)"],
    "[颜色]": ["颜色"],
    "“电池容量”|\"认证|备案号\"||适用场景": ["电池容量", "认证|备案号", "适用场景"],
    "档位;模式;净重；电压/频率/功率": ["档位;模式", "净重", "电压/频率", "功率"],
    "充电接口(输入/输出)、 '材质' ,": ["充电接口(输入/输出)", "材质"],
    "净重;净重": ["净重", "净重"],
    " ": [],
    None: [],
}


@pytest.mark.parametrize("text", list(PAIRS))
def test_pairs(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(packed_pairs(F.col("t")).alias("p")).head()
    assert [(e["name"], e["value"]) for e in row["p"]] == PAIRS[text]


@pytest.mark.parametrize("text", list(LISTS))
def test_lists(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(packed_list(F.col("t")).alias("p")).head()
    assert row["p"] == LISTS[text]


def test_very_long_field_is_linear(spark):
    text = ";".join(f"n{i}x:\"v;{i}\"" for i in range(20000))
    row = spark.createDataFrame([(text, '"' + "x" * 200000)], "t string, u string").select(packed_pairs(F.col("t")).alias("p"), packed_pairs(F.col("u")).alias("q")).head()
    assert len(row["p"]) == 20000 and row["p"][-1]["value"] == "v;19999" and row["q"] == []


def test_items_repeats_nulls_clashing_columns(spark):
    feed = spark.createDataFrame([(1, "a:1;b:2", "x"), (1, "a:1;b:2", "y"), (2, None, "z")], "row_id bigint, attributes string, item_name string")
    audit = spark.createDataFrame([(5, "净重|型号", 1)], "row_id bigint, blocked_fields string, pos int")
    got = sorted(tuple(r) for r in packed_items(feed, audit).collect())
    assert got == sorted([("pv_parser", 1, 1, "a", "1"), ("pv_parser", 1, 2, "b", "2")] * 2 + [("rag", 5, 1, "blocked_field", "净重"), ("rag", 5, 2, "blocked_field", "型号")])
    assert packed_items(feed.limit(0), audit.limit(0)).count() == 0
