import random

import pytest
from pyspark.sql import functions as F

from wareloom.llm import listings

REVIEW = "product_id string, title string, attribute_evidence string, category_l2 string, group_id int"
LORA = "product_id string, attributes map<string,array<string>>, category_l2 string, node string"


def review(spark, rows):
    return spark.createDataFrame([(p, t, e, c, 1) for p, t, e, c in rows], REVIEW)


def lora(spark, rows):
    return spark.createDataFrame([(p, a, c, "clash") for p, a, c in rows], LORA)


@pytest.fixture(scope="module")
def tables(spark):
    titles = [
        ("p1", "Vélmora 杏粟涵|20W|硅胶|3.6Ah|XU2213RF-max|蓝牙音箱", '{"净重": ["350克"]}', "蓝牙音箱"),
        ("p1", "Vélmora 杏粟涵|20W|硅胶|3.6Ah|XU2213RF-max|蓝牙音箱", '{"净重": ["350克"]}', "蓝牙音箱"),
        ("p2", "【包邮】薇摩岚 ｘｕ ２２１３ ｒｆ MAX 无线音响 爆款", None, "蓝牙音箱"),
        ("p3", "Vélmora 杏粟涵 XU2213RF 蓝牙音箱", None, "蓝牙音箱"),
        ("p4", "薇摩岚 杏粟涵 0.35千克 20瓦 3600毫安时 便携音箱 2025升级", "broken json", "蓝牙音箱"),
        ("p5", "适用Vélmora XU2213RF-max 蓝牙音箱 收纳包 家用 松石款", None, "配件"),
        ("p6", "Vélmora 杏粟涵 60W 3600mAh 350g 蓝牙音箱", None, "蓝牙音箱"),
        ("p7", None, None, None),
        (None, "Vélmora XU2213RF-max", None, None),
        ("p8", "", None, None),
    ]
    sets = [
        ("p2", {"Brand": ["Vélmora/薇摩岚"], "系列": ["杏粟涵"], "电池容量": ["3600毫安"], "型号": ["XU_2213RFmax"]}, "蓝牙音箱"),
        ("p4", {"牌子": ["薇摩岚"], "产品系列": ["杏粟涵"], "净重": ["350g"]}, "蓝牙音箱"),
        ("p9", {"品牌": ["北苔"], "系列": ["杏粟涵"], "输出功率": ["20W"], "净重": ["350g"], "电池容量": ["3.6Ah"]}, "蓝牙音箱"),
        ("p10", None, None),
    ]
    return review(spark, titles), lora(spark, sets)


def test_groups(tables):
    pairs = {(r["product_id_a"], r["product_id_b"]) for r in listings.same_product_pairs(listings.listing_groups(*tables)).collect()}
    assert pairs == {("p1", "p2"), ("p1", "p4"), ("p2", "p4")}


def test_copies_larger_than_a_window_and_a_third_of_all_rows(spark):
    titles = [(f"a{i:03}", f"北苔 雾山海 {i % 7} 600g 12W AB1234CD 台灯", None, "桌面台灯") for i in range(60)]
    titles += [(f"n{i:03}", f"北苔 雾山海 60{i % 2}g 12W 台灯 {i}", None, "桌面台灯") for i in range(40)]
    sets = [("a000", {"品牌": ["北苔"], "系列": ["雾山海"]}, "桌面台灯")]
    groups = {r["product_id"]: r["group_id"] for r in listings.listing_groups(review(spark, titles), lora(spark, sets), window=3).collect()}
    assert len({groups[f"a{i:03}"] for i in range(60)}) == 1
    assert len(groups) == 100


@pytest.mark.parametrize("seed", range(2))
def test_every_pair_that_aligns_is_met_in_a_hot_series(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        series = ["雾山海"] if rng.random() < 0.7 else rng.sample(["雾山海", "杏粟涵", "云"], rng.randrange(3))
        figures = sorted(f"{d}:{rng.randrange(3)}" for d in rng.sample(["g", "w", "ml", "mm"], rng.randrange(5)))
        code = f"AB{i:04}CD" if rng.random() < 0.6 else None
        rows.append((f"n{i}", code, rng.random() < 0.1, rng.choice([[], ["北苔"], ["薇摩岚"]]), sorted(series), figures, 1))
    schema = "node string, code string, accessory boolean, brands array<string>, series array<string>, figures array<string>, n bigint"
    folded = spark.createDataFrame(rows, schema)
    body = F.struct(*folded.columns)
    everything = folded.select(body.alias("a")).crossJoin(folded.select(body.alias("b"))).where("a.node < b.node")
    scored = everything.select("a.node", F.col("b.node").alias("other"), listings._alignment("a", "b").alias("w"), F.expr("size(array_intersect(a.figures, b.figures)) = least(size(a.figures), size(b.figures))").alias("whole"))
    all_pairs = {(r["node"], r["other"]): (r["w"], r["whole"]) for r in scored.collect()}
    got = {(r["a"], r["b"]): r["weight"] for r in listings.compare(folded, window=4, block=16).collect()}
    assert all(w == pytest.approx(all_pairs[pair][0]) for pair, w in got.items()) and any(w < 0 for w in got.values())
    # figures that agree in full: none is lost, whatever the window
    want = {pair for pair, (w, whole) in all_pairs.items() if w > 0 and whole}
    assert want <= got.keys() and len(want) > 150
    assert listings.compare(folded.limit(0)).count() == 0


def test_listings_with_some_figures_meet_their_product_in_a_hot_series(spark):
    titles = [(f"c{i:03}", f"北苔 雾山海 {100 + i % 9}g {200 + i % 7}W {300 + i // 3}ml {400 + i}毫安 AB{i:04}CD 台灯", None, "桌面台灯") for i in range(90)]
    titles += [(f"n{i:03}", f"北苔 雾山海 {400 + i}毫安 {300 + i // 3}ml 台灯", None, "桌面台灯") for i in range(0, 90, 3)]
    sets = [("c000", {"品牌": ["北苔"], "系列": ["雾山海"]}, "桌面台灯")]
    groups = {r["product_id"]: r["group_id"] for r in listings.listing_groups(review(spark, titles), lora(spark, sets)).collect()}
    assert all(groups[f"n{i:03}"] == groups[f"c{i:03}"] for i in range(0, 90, 3))


def test_clusters_settle_a_chain_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(listings, "checkpoint", lambda df: spark.createDataFrame(df.toArrow()))
    # a path whose nodes come in the order of their ranks settles two nodes a round
    nodes = spark.range(70).select(F.concat(F.lit("n"), "id").alias("node"), F.lpad(F.hex(F.xxhash64("id")), 16, "0").alias("rank"))
    path = [r["node"] for r in nodes.orderBy("rank").collect()]
    edges = spark.createDataFrame([(*sorted(pair), 1.0) for pair in zip(path, path[1:])], "a string, b string, weight double")
    got = {r["node"]: r["cluster"] for r in listings.pivot_clusters(nodes.coalesce(1), edges.coalesce(1)).collect()}
    assert got == {node: path[i - i % 2] for i, node in enumerate(path)}


PROFILE = "node string, n bigint, code string, accessory boolean, brands array<string>, series array<string>, figures array<string>"


def _weight(spark, a, b):
    rows = spark.createDataFrame([("x", 1, *a), ("y", 1, *b)], PROFILE)
    return listings._scored(rows, spark.createDataFrame([("x", "y")], "a string, b string")).head()["weight"]


def test_alignment_is_soft_and_weighs_the_code_as_one_token(spark):
    full = ("AB1234CD", False, ["北苔"], ["雾山海"], ["g:350", "w:20"])
    assert _weight(spark, full, ("AB1234CD", False, [], [], [])) > 0
    # an equal code is outweighed by another series, another brand and other figures
    assert _weight(spark, full, ("AB1234CD", False, ["薇摩岚"], ["杏粟涵"], ["g:900", "w:60"])) < 0
    assert _weight(spark, full, ("AB1234CD-PRO", False, ["北苔"], ["雾山海"], ["g:350", "w:20"])) < 0
    # without a code: a misspelt series and a rounded figure still align, another figure does not
    assert _weight(spark, full, (None, False, ["北苔"], ["雾山诲"], ["g:350", "w:20"])) > 0
    assert _weight(spark, full, (None, False, ["北苔"], ["雾山海"], ["g:351", "w:20"])) > 0
    assert _weight(spark, full, (None, False, ["北苔"], ["雾山海"], ["g:380", "w:20"])) < 0
    assert _weight(spark, full, (None, False, ["北苔"], ["杏粟涵"], ["g:350", "w:20"])) < 0


def test_negative_edges_part_clusters_and_keep_them_apart(spark):
    who = (None, False, ["北苔"], ["雾山海"], ["g:350", "w:20"])
    folded = spark.createDataFrame([(f"n{i}", 1, *who) for i in range(5)], PROFILE)
    edge = lambda a, b, w: (f"n{a}", f"n{b}", float(w))
    edges = [edge(0, 1, 2), edge(0, 2, 2), edge(1, 2, 2), edge(2, 3, 1), edge(0, 3, -4), edge(1, 3, -4), edge(3, 4, 2)]
    got = {r["node"]: r["cluster"] for r in listings.settle(folded, spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    assert got["n0"] == got["n1"] == got["n2"] != got["n3"]


def test_one_code_in_more_profiles_than_a_window_is_one_product(spark):
    titles = [(f"c{i:03}", f"北苔 雾山海 {100 + i % 5}g {200 + i}W {300 + 2 * i}ml AB1234CD 台灯", None, "桌面台灯") for i in range(60)]
    titles += [(f"d{i:03}", f"北苔 雾山海 {100 + i % 5}g {200 + i}W {300 + 2 * i}ml AB1234CE 台灯", None, "桌面台灯") for i in range(60)]
    groups = {r["product_id"]: r["group_id"] for r in listings.listing_groups(review(spark, titles), lora(spark, [("c000", {"品牌": ["北苔"], "系列": ["雾山海"]}, "桌面台灯")]), window=5).collect()}
    assert len({g for p, g in groups.items() if p[0] == "c"}) == 1 and len(set(groups.values())) == 2


def test_empty_tables(tables):
    review_rows, sets = tables
    assert listings.listing_groups(review_rows.limit(0), sets.limit(0)).count() == 0


def test_figures_and_codes():
    assert listings._figures("1.12斤 2.4米 3千克 5Ah 1.5L") == ["g:560", "mm:2400", "g:3000", "mah:5000", "ml:1500"]
    assert listings._figures("2025升级") == []
    assert listings._codes("PX-6811-QR 2")[0] == "PX6811QR-2" and listings._codes("PX6811QR 2斤") == ["PX6811QR"]
    assert "CW5735CK-S" in listings._codes("CW5735CKS")
