import random

from wareloom.functions.text import letters_only  # noqa: F401  (the form under test)
from wareloom.llm import contamination as C

WORDS = [f"{a}{b}{c}" for a in "山水火木金" for b in "东南西北中" for c in "红绿蓝白黑"]


def passage(rng, n):
    return "，".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n)) + "。"


def test_whole_part_scattered_edited_and_stock(spark):
    rng = random.Random(0)
    stock = "如有疑问请联系售后服务团队。"
    items = {i: passage(rng, 30) + stock for i in range(12)}
    other = lambda: passage(rng, 40)
    half = items[1][: len(items[1]) * 6 // 10]
    thirds = items[2].split("，")
    docs = {
        1: other() + items[0] + other(), 2: other() + half, 3: "，".join(thirds[16:26]) + other() + "，".join(thirds[:9]) + other(),
        4: items[3].replace("，", " , ").upper(), 5: other() + stock, 6: "，".join(items[4].split("，")[:4]) + other(), 7: None, 8: "", 9: "！？", 10: items[5] + items[6],
        11: items[5] + items[6],
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "'x' AS gram")
    e = spark.createDataFrame([*items.items(), (99, None), (98, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in C.leaks(d, e).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (10, 5), (10, 6), (11, 5), (11, 6)}
    spans = C.leak_spans(d, e)
    assert spans.where("doc_id = 1").count() == 1 and spans.where("doc_id = 3").count() >= 2
    cleaned = {r["doc_id"]: r["cleaned"] for r in C.cut_leaks(d.select("doc_id", "text"), spans).collect()}
    assert items[0][:-20] not in cleaned[1] and cleaned[1].startswith(docs[1][:60]) and len(cleaned[10]) < 20
    assert C.leaks(d.limit(0), e).count() == 0 and C.leaks(d, e.limit(0)).count() == 0


def test_large_item_sets_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_GRAMS", 1)
    rng = random.Random(1)
    text = passage(rng, 20)
    d, e = spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(7, text)], "item_id bigint, text string")
    assert [tuple(r) for r in C.leaks(d, e).collect()] == [(1, 7, 1.0)]
