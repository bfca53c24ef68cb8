"""Template residue, filler and error-page text.

A bank of labelled exemplars (residue of several kinds, page navigation, and phrases of people
who speak about fields and templates) is indexed by tokens: character n-grams, and markers that
stand for a template field or an unrendered value in any spelling. Documents are cut into
passage windows at sentence and line ends; each window retrieves exemplars through the inverted
index and is scored by TF-IDF containment: the share of its weight that the exemplars of a kind
explain. A marker is a token like any other and weighs as often as it occurs, so a sentence
made of fields is explained by the bare field, and a sentence that merely mentions one is not.

The bank is general; what a corpus adds to it is learnt from the corpus (relevance feedback):
tokens that occur almost only in documents the bank already explains for the most part join
the kind of these documents.

A document is residue when a window is an unfilled template, or when its windows, navigation
aside, are residue for the most part. The bank is a fixed, small table (its size is checked
before it is broadcast); frequencies are counted over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.functions.text import drop_ignorables, fold_width
from wareloom.session import checkpoint, spread

#: Marker of a template field and of an unrendered value.
SLOT, VOID = "\ue010", "\ue011"
GRAM = 3
#: Least share of a window's weight that a kind must explain: residue, and an unfilled template.
WINDOW_CONTAINMENT, TEMPLATE_CONTAINMENT = 0.6, 0.25
#: Least share of an exemplar's weight a window must hold for the exemplar to explain it.
HELD = 0.3
#: Least share of the text, navigation aside, that residue must cover.
DOC_COVERAGE = 0.6
#: Feedback: the containment of a weak window, the share of weak text in a document, the share of
#: a token's documents that must be such documents, and how many there must be.
WEAK_CONTAINMENT, WEAK_COVERAGE, LEARNT_SHARE, LEARNT_DOCS = 0.2, 0.5, 0.9, 3
_MAX_BANK_ROWS = 5_000

#: Spellings of template fields (fixed values). The inside is short and has no sentence marks;
#: a per cent sign next to a figure is no delimiter.
_INSIDE = r"[^{}<>%$#@\[\]【】，。；！？\n]{1,30}"
_NAME = r"[\p{L}_][\p{L}\p{N}._]{0,28}"
SLOT_PATTERNS = (
    rf"\{{\{{\s*{_INSIDE}\s*\}}\}}", rf"\{{%\s*{_INSIDE}\s*%\}}", rf"<%=?\s*{_INSIDE}\s*%>", rf"[$#]\{{\s*{_INSIDE}\s*\}}",
    rf"\[\[\s*{_INSIDE}\s*\]\]", rf"@@{_INSIDE}@@", rf"__{_NAME}?__", rf"【请?(?:填写|输入|选择){_INSIDE}】", rf"\{{\s*{_INSIDE}\s*\}}",
    rf"(?<![0-9])%{_NAME}%(?![0-9])", rf"(?<![0-9A-Za-z])\${_NAME}\$(?![0-9])", rf"<{_NAME}>", rf"\[{_NAME}\]",
)
#: Spellings of a value that was never rendered (fixed values).
VOID_PATTERN = r"\[object Object\]|(?<![A-Za-z])(?:undefined|NaN|null|None|NULL|nil)(?![A-Za-z])"

#: kind -> exemplars (fixed values). S and V stand for a template field and an unrendered value.
EXEMPLARS: dict[str, tuple[str, ...]] = {
    "template": (
        "S", "V", "V V", "亲爱的S", "尊敬的S", "您好S", "欢迎光临S", "欢迎选购S", "您的订单S已发货", "您关注的S已到货", "您购买的S", "本店支持S", "由S提供",
        "由S发货", "售后请联系S", "现价S元", "原价S元", "到手价V元", "库存V件", "V次好评", "适合S", "采用S", "品牌：S", "型号：S", "价格：V", "容量：V", "功率：V",
        "Dear S", "Hello S", "Hi S", "Welcome to S", "Your order S has shipped", "Price: S", "Only S left in stock", "Best regards, S", "Sehr geehrte S", "S 様",
    ),
    "filler": (
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
        "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat",
        "lorem", "ipsum", "dolor", "sit amet", "aliqua", "占位", "占位文字", "占位符文本", "此处为占位内容", "占位段落", "示例文本", "示例文字请替换", "请替换此文本", "正文正文",
        "文字内容文字内容", "标题标题", "测试测试", "测试文本", "测试内容", "默认描述", "默认文本", "默认内容", "待补充", "待完善", "待填写", "暂无描述", "暂无内容", "暂无介绍", "内容待定",
        "这里填写内容", "这里填写介绍", "请在此输入内容", "请在这里填写商品描述", "sample text", "sample text goes here", "placeholder text", "dummy text",
        "your text here", "insert text here", "test content", "test test", "content goes here", "coming soon", "asdf", "asdf asdf", "qwerty", "xxx", "xxxx", "aaaa", "TODO", "TBD",
        "Beispieltext", "Platzhaltertext", "ダミーテキスト", "ここにテキストを入力",
    ),
    "error": (
        "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "400 Bad Request",
        "Page not found", "The page you requested could not be found", "This page does not exist", "item not found", "product not found",
        "Access Denied", "You do not have permission to access this page", "You don't have permission to view this", "Service temporarily unavailable",
        "The service is unavailable, please try again later", "back in 0 minutes", "down for maintenance", "upstream timed out", "connection timed out", "Connection refused",
        "nginx", "Ref 0", "Request ID 0", "error code 0", '{"code": 0, "msg": "error", "data": V}', '{"status": 0, "message": "not found"}', "Something went wrong",
        "Fatal error: Uncaught Exception in /var/www/html/index.php on line 0", "Warning: Undefined variable in index.php on line 0",
        "Traceback (most recent call last):", 'File "main.py", line 0, in main', "KeyError: 'name'", "ValueError: invalid value", "TypeError: object is not callable",
        "java.lang.RuntimeException", "java.lang.IllegalArgumentException", "java.lang.IllegalStateException", "Exception in thread main java.lang.Exception",
        "at com.example.Main.main(Main.java:0)", "at org.app.core.Runner.run(Runner.java:0)", "at app.web.Page.render(Page.java:0)", "Caused by: java.io.IOException",
        "您访问的页面不存在", "页面不存在或已被删除", "页面找不到了", "返回首页", "该商品已下架", "很抱歉，商品不存在", "看看其他商品", "系统繁忙，请稍后再试", "系统错误，请稍后重试", "错误代码：0", "请求编号：0",
        "网络连接超时", "网络异常，请检查网络设置", "请检查网络后点击重试", "会话已过期，请重新登录", "登录已失效，请重新登录后继续", "数据加载失败", "加载失败，点击刷新", "服务器开小差了", "服务器内部错误",
        "工程师正在抢修", "页面正在维护", "Seite nicht gefunden", "Bitte prüfen Sie die Adresse", "Diese Seite existiert nicht", "Zugriff verweigert", "ページが見つかりません", "URLをご確認ください",
        "アクセスが拒否されました", "Página no encontrada", "Page introuvable", "您的访问过于频繁", "请完成安全验证", "请完成滑块验证后继续访问", "请输入验证码", "人机验证",
        "Checking your browser before accessing the site", "Please verify you are human", "Complete the captcha to continue", "Attention required",
    ),
    "script": (
        "请启用JavaScript", "请启用JavaScript后继续访问", "请开启JavaScript后刷新页面", "本页面需要开启脚本才能显示", "本站需要启用Cookie", "需要开启脚本与Cookie", "您的浏览器不支持JavaScript", "浏览器不支持脚本，部分内容无法显示",
        "请更换浏览器", "请打开浏览器的脚本功能", "检测到脚本已被禁用", "允许浏览器运行脚本", "加载中", "如长时间无响应", "noscript", "This site requires JavaScript", "This page requires JS",
        "Please enable JavaScript", "Please enable JavaScript and cookies to continue", "JavaScript is disabled in your browser", "You need to enable JavaScript to run this app",
        "turn on scripts to view this page", "Your browser does not support JavaScript", "Bitte aktivieren Sie JavaScript", "um die Seite anzuzeigen", "JavaScriptを有効にしてください",
        "このページを表示するには", "Veuillez activer JavaScript", "Por favor, active JavaScript",
    ),
    "navigation": (
        "首页 > 全部商品 > 商品详情", "首页 > 全部分类", "登录 | 注册 | 购物车", "登录 注册", "我的订单 购物车(0)", "收藏本店", "收藏 分享", "关于我们 | 联系客服 | 隐私政策", "帮助中心 联系我们",
        "版权所有 翻印必究", "版权所有 侵权必究", "Home / Shop / Item", "Home > Products > Details", "Login | Register | Cart", "About us | Contact | Privacy policy", "All rights reserved", "Startseite > Shop",
    ),
    "sound": (
        "模板里的S", "模板中的S一栏", "S一栏已经改成", "S字段", "变量S", "占位符S", "参数S", "填S或S", "填写S", "输入S", "S都能识别", "例如S", "比如S", "写成S", "显示S", "显示为S", "手册里有例子", "说明书把S写成了S", "支持S和S",
        "the field S", "the placeholder S", "the variable S", "type S or S", "written as S", "replace S with", "das Feld S", "der Platzhalter S", "屏幕显示V",
    ),
}
RESIDUE = ("filler", "error", "script")


def fold_fields(col: Column) -> Column:
    """Template fields and unrendered values become marker characters; tags and figures are folded."""
    text = drop_ignorables(col)
    text = F.regexp_replace(text, r"(?i)</?(?:html|head|body|div|span|p|br|h[1-6]|li|ul|ol|a|b|i|strong|em|table|tr|td|th)(?:\s[^<>]*)?/?>", "\n")
    text = F.regexp_replace(text, VOID_PATTERN, VOID)
    text = F.regexp_replace(text, "|".join(SLOT_PATTERNS), SLOT)
    return F.regexp_replace(F.lower(fold_width(text)), r"[0-9][0-9a-f]{6,}|[0-9]+(?:[.,][0-9]+)*|(?<![a-z])[a-f0-9]{10,}(?![a-z])", "0")


def passages(col: Column) -> Column:
    """Windows of a folded text: sentences and lines, without marks at their ends.

    A run of three fields or more is a window of its own, since a template often lacks the
    mark that parts it from the next sentence.
    """
    mark, other = f"[{SLOT}{VOID}]", f"[^{SLOT}{VOID}]"
    parts = F.split(col, r"[。！？!?；;\n]+|(?<=[a-zа-я)0-9])\.(?=\s|$)")
    run = f"^({other}*)({mark}{other}*{mark}.*{mark})({other}*)$"
    parts = F.flatten(F.transform(parts, lambda p: F.split(F.regexp_replace(p, run, "$1\n$2\n$3"), "\n")))
    clean = F.transform(parts, lambda p: F.regexp_replace(p, r"[\s\p{P}\p{S}&&[^" + SLOT + VOID + r"]]+", " "))
    return F.filter(F.transform(clean, F.trim), lambda p: p != "")


def _tokens(col: Column) -> Column:
    """``array<struct<token, tf>>``: distinct n-grams inside the words of a window, and its markers with their number.

    A window without any is one token.
    """
    words = F.translate(col, SLOT + VOID, "  ")
    within = F.array_distinct(F.regexp_extract_all(words, F.lit(rf"(?=([^ \x{{DC00}}-\x{{DFFF}}][^ ]{{{GRAM - 1}}}))"), F.lit(1)))
    as_token = lambda token, tf: F.struct(token.alias("token"), tf.cast("int").alias("tf"))
    marks = F.filter(F.array(*[as_token(F.lit(m), F.length(F.regexp_replace(col, f"[^{m}]", ""))) for m in (SLOT, VOID)]), lambda t: t["tf"] > 0)
    both = F.concat(F.transform(within, lambda g: as_token(g, F.lit(1))), marks)
    return F.when(F.size(both) > 0, both).otherwise(F.array(as_token(col, F.lit(1))))


def exemplar_index(spark: SparkSession, exemplars: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``exemplar, kind, token, tf``: the inverted index over the labelled bank."""
    rows = [(kind, text) for kind, texts in (exemplars or EXEMPLARS).items() for text in texts]
    raw = spark.createDataFrame(rows, T.StructType().add("kind", "string").add("text", "string"))
    marked = F.regexp_replace(F.regexp_replace("text", r"(?<![A-Za-z])S(?![A-Za-z])", "{{s}}"), r"(?<![A-Za-z])V(?![A-Za-z])", "null")
    return (
        raw.select("kind", F.xxhash64("kind", "text").alias("exemplar"), F.explode(passages(fold_fields(marked))).alias("window"))
        .select(F.xxhash64("exemplar", "window").alias("exemplar"), "kind", F.explode(_tokens(F.col("window"))).alias("t"))
        .select("exemplar", "kind", "t.token", "t.tf").distinct()
    )


def cut_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, wid, window``: the windows of every document, folded and cut once."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).where("text IS NOT NULL")
    cut = rows.select("doc_id", F.explode(passages(fold_fields(F.col("text")))).alias("window"))
    return checkpoint(cut.select("doc_id", F.xxhash64("window").alias("wid"), "window"))


def score_windows(distinct: DataFrame, exemplars: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """``wid, template, sound, ...`` (the share each kind explains) and ``wid, token, w``, from distinct windows.

    Only windows that hold a token of an exemplar they share enough with are scored; the
    tokens of these are handed on for feedback.
    """
    spark = distinct.sparkSession
    index = exemplar_index(spark, exemplars)
    cut = lambda df: df.select("wid", F.explode(_tokens(F.col("window"))).alias("t")).select("wid", "t.token", "t.tf")
    tokens = cut(distinct)
    total = distinct.agg(F.count("*").alias("n_windows"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    weights = checkpoint(frequency.crossJoin(F.broadcast(total)).select("token", F.log1p(F.col("n_windows") / F.col("df")).alias("idf")))
    # a token of the bank that the corpus lacks weighs as one that occurs once
    known = checkpoint(
        index.join(weights, "token", "left").crossJoin(F.broadcast(total))
        .select("exemplar", "kind", "token", (F.coalesce("idf", F.log1p(F.col("n_windows"))) * F.col("tf")).alias("w"))
    )
    small = known.count() <= _MAX_BANK_ROWS
    side = known.join(known.groupBy("exemplar").agg(F.sum("w").alias("exemplar_w")), "exemplar")
    hits = tokens.join(F.broadcast(side) if small else side, "token")
    near = (
        hits.groupBy("wid", "exemplar", "kind").agg(F.sum("w").alias("shared_w"), F.first("exemplar_w").alias("exemplar_w"))
        .where(F.col("shared_w") >= HELD * F.col("exemplar_w")).select("wid", "exemplar", "kind")
    )
    near = checkpoint(near)
    met = checkpoint(cut(distinct.join(near.select("wid").distinct(), "wid", "left_semi")).join(weights, "token").select("wid", "token", (F.col("idf") * F.col("tf")).alias("w")))
    # a window may string several exemplars of a kind together: its cover is by kind
    kinds = list(exemplars or EXEMPLARS)
    bank = known.select("exemplar", "token")
    explained = near.join(F.broadcast(bank) if small else bank, "exemplar").select("wid", "kind", "token").distinct()
    share = lambda kind: (F.coalesce(F.sum(F.when(F.array_contains("kinds", kind), F.col("w"))), F.lit(0.0)) / F.sum("w")).alias(kind)
    by_token = explained.groupBy("wid", "token").agg(F.collect_set("kind").alias("kinds"))
    scored = met.join(by_token, ["wid", "token"], "left").groupBy("wid").agg(*[share(kind) for kind in kinds])
    return scored, met


def _document_shares(windows: DataFrame, judged: DataFrame) -> DataFrame:
    """``doc_id, template, bad, content, kind`` from ``wid, kind`` of judged windows."""
    bad = F.coalesce(F.col("kind").isin(*RESIDUE), F.lit(False))
    n = F.length("window")
    return windows.join(judged, "wid", "left").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("kind") == "template", F.lit(False))).alias("template"),
        F.sum(F.when(bad, n).otherwise(0)).alias("bad"),
        F.sum(F.when(F.coalesce(F.col("kind") == "navigation", F.lit(False)), 0).otherwise(n)).alias("content"),
        F.max_by("kind", F.when(bad, n)).alias("kind"),
    )


def _best(kinds: tuple[str, ...]) -> Column:
    """``struct<share, kind>``: the kind that explains most."""
    return F.array_max(F.array(*[F.struct(F.col(k).alias("share"), F.lit(k).alias("kind")) for k in kinds]))


def learnt_tokens(windows: DataFrame, scored: DataFrame, met: DataFrame) -> DataFrame:
    """``token``: tokens that occur almost only in documents the bank explains for the most part."""
    weak = scored.withColumn("best", _best((*RESIDUE, "navigation"))).where(F.col("best.share") >= WEAK_CONTAINMENT).select("wid", "best.kind")
    seeded = _document_shares(windows, weak).where(F.col("bad") >= WEAK_COVERAGE * F.col("content")).where("content > 0").select("doc_id", F.lit(1).alias("seeded"))
    uses = windows.select("doc_id", "wid").distinct().join(seeded, "doc_id", "left").groupBy("wid").agg(F.count("*").alias("n"), F.count("seeded").alias("m"))
    return (
        met.where(~F.col("token").isin(SLOT, VOID)).join(uses, "wid").groupBy("token").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        .where((F.col("m") >= LEARNT_DOCS) & (F.col("m") >= LEARNT_SHARE * F.col("n"))).select("token")
    )


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exemplars: dict[str, tuple[str, ...]] | None = None,
            containment: float = WINDOW_CONTAINMENT, template: float = TEMPLATE_CONTAINMENT, coverage: float = DOC_COVERAGE) -> DataFrame:
    """``doc_id, kind, coverage``: documents to exclude, with the kind that covers most.

    Null, blank and unreadable texts give no row. Repeated documents are reported each.
    Windows are scored once per distinct text, so boilerplate that fills a third of the
    corpus is scored once.
    """
    windows = cut_windows(docs, doc_id, text)
    distinct = checkpoint(windows.groupBy("wid").agg(F.first("window").alias("window")))
    scored, met = score_windows(distinct, exemplars)
    scored = checkpoint(scored)
    learnt = learnt_tokens(windows, scored, met)
    more = met.join(learnt, "token", "left_semi").groupBy("wid").agg(F.sum("w").alias("learnt_w"))
    whole = met.groupBy("wid").agg(F.sum("w").alias("w"))
    # learnt tokens and the bank's may be the same ones: the larger share counts, not the sum
    best = _best(RESIDUE)
    judged = (
        scored.join(whole, "wid").join(more, "wid", "left")
        .select(
            "wid",
            F.when((F.col("template") >= template) & (F.col("template") >= F.col("sound")), "template")
            .when(F.col("navigation") > F.greatest(F.lit(0.5), best["share"]), "navigation")
            .when(F.greatest(best["share"], F.coalesce(F.col("learnt_w") / F.col("w"), F.lit(0.0))) >= containment, best["kind"])
            .alias("kind"),
        ).where("kind IS NOT NULL")
    )
    share = F.col("bad") / F.col("content")
    return _document_shares(windows, judged).where(F.col("template") | (share >= coverage)).select(
        "doc_id", F.when(F.col("template"), "template").otherwise(F.col("kind")).alias("kind"), F.coalesce(share, F.lit(0.0)).alias("coverage")
    )
