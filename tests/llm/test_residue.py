"""The bank is the fit part; the texts here are held out: none is in the bank, most are worded otherwise."""

from wareloom.llm import residue

SOUND = [
    "The kettle holds enough for four cups and the lid closes with a click.", "换了新的滤芯之后水流大了不少，味道也淡了。", "这盏灯的底座很重，放在书桌上不会晃。",
    "Die Tasche passt unter den Sitz und ist leicht zu reinigen.", "风扇开到三档有一点声音，晚上睡觉开一档就够。", "We compared two chargers and kept the smaller one for travel.",
]
HELD_OUT = {
    1: "尊敬的{{member.name}}，您的包裹{{parcel_no}}正在派送。", 2: SOUND[1] + "感谢您选择${brand}，祝您使用${product}愉快。" + SOUND[2] * 4, 3: "库存null件，月销undefined件",
    4: SOUND[4] + "尺寸：None 颜色：undefined 产地：null", 5: "Dear __first_name__, your parcel __tracking__ will arrive on %delivery_date%.", 6: "Lorem ipsum dolor sit amet, sed do eiusmod tempor.",
    7: "placeholder text. your text here. asdf asdf. TBD", 8: "此处为占位内容，请替换此文本。测试内容", 9: "首页 > 全部分类\nError 404: the page you requested could not be found\nAll rights reserved",
    10: "503 Service Unavailable. The server is down for maintenance, please try again later.", 11: "抱歉，您要访问的页面不存在，请返回首页。", 12: "登录 | 注册\n您的浏览器不支持JavaScript，请更换浏览器后继续访问。",
    13: "JavaScript is disabled. You need to enable JavaScript to view this page.", 14: "Exception in thread main java.lang.NullPointerException\n\tat com.store.web.Page.render(Page.java:17)\n\tat com.store.core.Main.main(Main.java:4)",
    15: "访问过于频繁，请输入验证码后继续", 16: "Diese Seite wurde nicht gefunden. Bitte prüfen Sie die Adresse.",
}
HARD_NEGATIVES = {
    101: "".join(SOUND), 102: "开发文档说占位符 {name} 会在发送之前换成收件人的名字，我们店一直这样用，没有出过错。" + SOUND[1], 103: SOUND[2] + "遥控器要在网页后台启用JavaScript之后才能配对，配好就不用管了，平时直接按就行。",
    104: SOUND[4] + "朋友住在404房间，快递总是送错楼层，但箱子没有破。", 105: "写错了，包装上的50%印成了%50，重量倒是没错。" + SOUND[2], 106: "Our review of the shop software: the field <colour> is optional, everything else has to be typed in before the label prints." + SOUND[0],
    107: None, 108: "", 109: " \n", 110: "音量降低30%，亮度提高20%，电池多用15%。", 111: "太可爱了[哈哈]，想再买一个送给妹妹当礼物。", 112: "None of the straps came loose after a month of daily use on the bike.",
}


def _corpus(spark, extra=()):
    plain = [(1000 + i, SOUND[i % 6] + SOUND[(i + 1) % 6] + f"第{i}次下单，{chr(0x4E00 + 7 * i)}色") for i in range(120)]
    return spark.createDataFrame([*extra, *plain], "doc_id bigint, text string").selectExpr("*", "'clash' AS window", "1 AS kind")


def test_held_out_residue_and_hard_negatives(spark):
    got = {r["doc_id"] for r in residue.residue(_corpus(spark, [*HELD_OUT.items(), *HARD_NEGATIVES.items(), (500, HELD_OUT[9]), (501, HELD_OUT[9])])).collect()}
    assert not got & HARD_NEGATIVES.keys() and not {d for d in got if d >= 1000}
    assert {500, 501} <= got or 9 not in got
    found = len(got & HELD_OUT.keys())
    assert found >= 0.9 * len(HELD_OUT), sorted(HELD_OUT.keys() - got)


def test_tokens_are_learnt_from_documents_the_bank_explains(spark):
    made_up = ["brimol", "castev", "dorunt", "felmar", "gistor"]
    filler = [(i, " ".join(["lorem ipsum dolor", *[made_up[(i * 3 + j * j) % 5] for j in range(12)]])) for i in range(20)]
    sure = [(50 + i, "lorem ipsum dolor sit amet " + made_up[i % 5]) for i in range(20)]
    got = {r["doc_id"] for r in residue.residue(_corpus(spark, filler + sure)).collect()}
    assert got >= {d for d, _ in sure + filler} and not {d for d in got if d >= 1000}


def test_no_pattern_decides_alone(spark):
    """A field in a sentence that is explained by nothing else is one token among many."""
    text = "老师傅在便签上写了 {代号} 两个字，贴在机器侧面，后来换班的人都照着这张便签来操作，从来没有弄错过顺序。"
    assert residue.residue(_corpus(spark, [(1, text)])).count() == 0


def test_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "".join(SOUND) * 3000), (2, "".join(SOUND) * 2000 + "欢迎选购${a}，本店支持${b}。"), (3, "{" * 50000)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue(docs).collect()} == {2}
    assert residue.residue(docs.limit(0)).count() == 0
