"""Broken prompt and response pairs.

For every kind of defect several noisy labelling functions vote on a pair: yes, no or
abstain. The votes of a kind are combined by a label model with one prior and a pair of
rates per function, fitted by expectation maximisation. As a posterior depends on the votes
alone, the corpus is reduced to the counts of vote patterns first (3^functions rows at
most), the model is fitted on those, and the posteriors are joined back. A label is kept
when its posterior exceeds the cutoff of its kind; a pair may keep several.

The functions of a defect are different witnesses: syntax, overlap with the question, script,
phrases, what was asked for. For replies that break off the corpus adds two more, learnt from all
replies: whether a last clause of this shape is ever closed by a mark, and how long clauses
that begin like it usually are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions.text import drop_ignorables, fold_width, letters_only, ngrams
from wareloom.session import checkpoint, spread

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
#: Posterior cutoffs; each lies where F1 is best on hand-labelled pairs (``choose_cutoffs``, run in the tests on held-out pairs).
CUTOFFS = {"empty": 0.5, "copies_question": 0.5, "refusal": 0.5, "other_language": 0.5, "truncated": 0.5}
YES, NO, ABSTAIN = 1, -1, 0

#: Phrases of declining and of opening a refusal, by language (fixed values).
REFUSAL = (
    "无法完成", "不能完成", "无法处理", "不能处理", "无法提供", "不能提供", "无法回答", "不能回答", "拒绝回答", "拒绝", "恕难从命", "不予回答", "不作回答", "没有办法", "帮不上", "帮不了", "不便", "不支持生成", "写不了", "超出了", "我无法", "我不能",
    "decline", "can't", "cannot", "can not", "won't be able", "unable to", "not able to", "outside what i", "against my guidelines", "against policy",
    "できません", "できかねます", "お断り", "kann ich nicht", "kann das nicht", "nicht möglich", "leider nicht", "no puedo", "no es posible", "je ne peux pas", "impossible de", "не могу", "할 수 없", "드릴 수 없",
)
OPENERS = (
    "抱歉", "对不起", "不好意思", "遗憾", "非常遗憾", "很遗憾", "十分抱歉", "非常抱歉", "很抱歉", "作为一个语言模型", "作为语言模型", "作为ai", "作为人工智能", "我只是一个",
    "i'm sorry", "i am sorry", "sorry", "apologies", "unfortunately", "as an assistant", "as an ai", "as a language model", "thank you for", "thanks for",
    "申し訳", "すみません", "恐れ入りますが", "es tut mir leid", "leider", "lo siento", "désolé", "извините", "к сожалению", "죄송",
)
_FIRST_PERSON = r"我(?!们)|(?<![a-z])i(?:'m|'ll)?(?![a-z])|(?<![a-z])my(?![a-z])"
#: Function words by language code (fixed values).
FUNCTION_WORDS = {
    "en": "the and with this from for is are of to in on it its your a an by that be can",
    "de": "der die das und mit von auf bei ist eine ein für zum zur den im sich nicht auch",
    "es": "el la los las de en con una un para al y por que se del es su",
    "fr": "le la les de et avec une un pour dans est sur du des ce cette",
    "it": "il la di e con una un per del della nel",
    "pt": "o a de e com uma um para do da no na",
}
#: Words in a prompt that ask for a language (fixed values).
ASKED = (
    ("en", r"英文|英语|(?i)in english"), ("ja", r"日文|日语|日本語|(?i)in japanese"), ("de", r"德文|德语|(?i)auf deutsch|in german"),
    ("ko", r"韩文|韩语|한국어|(?i)in korean"), ("ru", r"俄文|俄语|(?i)in russian"), ("fr", r"法文|法语|(?i)in french"),
    ("es", r"西班牙文|西班牙语|(?i)in spanish"),
)
_KEYS = r'"(?:generated_title|selling_points|short_description|title|description)"\s*:'
_CODE = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{4}[A-Z]{2}(?: ?(?:S|2|Pro|Plus|Max|Air|Lite|Mini|Ultra|SE))?(?![A-Za-z0-9])"


def _any_of(phrases: tuple[str, ...]) -> str:
    return "|".join(phrase.replace("'", "['’]") for phrase in phrases)


def _vote(yes: Column, no: Column | None = None) -> Column:
    yes = F.coalesce(yes, F.lit(False))
    no = F.coalesce(no, F.lit(False)) if no is not None else ~yes
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAIN).cast("byte")


def _clause_shape(col: Column) -> Column:
    """A clause with model codes, figures and foreign names masked, so that its pattern remains."""
    shape = F.regexp_replace(col, _CODE, "#c")
    shape = F.regexp_replace(shape, r"[0-9]+(?:\.[0-9]+)?", "9")
    return F.regexp_replace(shape, r"^[\s\-·•*0-9.、:：]+|[\s\"'”’]+$", "")


_MARK, _CUT = "\ue020", "\ue021"


def _clauses(col: Column) -> Column:
    """Clauses with the mark that closes each: ``array<struct<body, mark>>``."""
    marks = r'([，,。；;！!？?、\n]|\."?(?=\s|$)|"\s*[,\]}])'
    parts = F.split(F.regexp_replace(col, marks, f"{_MARK}$1{_CUT}"), _CUT)
    return F.transform(
        parts,
        lambda p: F.struct(
            _clause_shape(F.substring_index(p, _MARK, 1)).alias("body"),
            F.when(p.contains(_MARK), F.substring_index(p, _MARK, -1)).otherwise("").alias("mark"),
        ),
    )


def features(pairs: DataFrame) -> DataFrame:
    """Per-pair features; ``pairs`` has ``record_source, row_id, prompt, reply``."""
    reply = F.coalesce(F.col("reply"), F.lit(""))
    unfenced = F.regexp_replace(F.trim(drop_ignorables(reply)), r"(?s)^```[a-zA-Z]*\s*|\s*```\s*$", "")
    # what a JSON text escapes is read as it is meant
    content = F.regexp_replace(F.regexp_replace(F.regexp_replace(unfenced, _KEYS, " "), r"\\[nrt]", "\n"), r'\\(["\\/])', "$1")
    folded = F.lower(fold_width(content))
    prompt = F.coalesce(F.col("prompt"), F.lit(""))
    words = F.regexp_replace(folded, r"(?<![a-z0-9])(?:null|none|nil|nan|n/a|undefined)(?![a-z0-9])", "")
    base = spread(pairs).select(
        "record_source", "row_id", "prompt", "reply",
        prompt.alias("ask"), unfenced.alias("body"), content.alias("content"), folded.alias("folded"),
        F.regexp_replace(words, r"[^\p{L}\p{N}]+", "").alias("solid"),
        letters_only(F.col("prompt")).alias("ask_form"), letters_only(content).alias("form"),
        F.filter(F.transform(F.split(prompt, r"[\n；;]+"), letters_only), lambda x: F.length(x) >= 6).alias("ask_lines"),
    )
    grams_reply, grams_ask = F.array_distinct(ngrams(F.col("form"), 6)), F.array_distinct(ngrams(F.col("ask_form"), 6))
    shared = F.size(F.array_intersect(grams_reply, grams_ask))
    asked = F.coalesce(*[F.when(F.col("ask").rlike(pattern), F.lit(code)) for code, pattern in ASKED], F.lit("zh"))
    # Latin words that are no names, codes or units of the prompt
    latin = F.filter(
        F.regexp_extract_all(F.col("content"), F.lit(r"(?<![\p{L}\p{N}])\p{Ll}[\p{L}']{1,}(?![\p{L}\p{N}])"), F.lit(0)),
        lambda w: ~F.col("ask").contains(w),
    )
    function_words = F.lit(" " + " ".join(FUNCTION_WORDS.values()) + " ")
    count = lambda pattern: F.regexp_count(F.col("content"), F.lit(pattern))
    return base.select(
        "record_source", "row_id", "ask", "body", "content", "folded", "solid", "form", "ask_form",
        (shared / F.greatest(F.size(grams_reply), F.lit(1))).alias("of_reply"),
        (shared / F.greatest(F.size(grams_ask), F.lit(1))).alias("of_ask"),
        F.size(F.filter("ask_lines", lambda x: F.col("form").contains(x))).alias("lines_said"), F.size("ask_lines").alias("lines_asked"),
        asked.alias("asked"),
        F.size(latin).alias("latin_words"),
        F.size(F.filter(latin, lambda w: function_words.contains(F.concat(F.lit(" "), F.lower(w), F.lit(" "))))).alias("function_words"),
        count(r"\p{IsHan}").alias("han"), count(r"[぀-ヿ]").alias("kana"), count(r"[가-힯]").alias("hangul"),
        count(r"\p{IsCyrillic}").alias("cyrillic"), count(r"\p{IsLatin}").alias("latin"),
        F.try_element_at(F.filter(_clauses(F.col("content")), lambda c: (c["body"] != "") | (c["mark"] != "")), F.lit(-1)).alias("last"),
        _clauses(F.col("content")).alias("clauses"),
    )


def _edges(shape: Column) -> Column:
    """How a clause starts and ends; what stands between, such as a name, is left out."""
    return F.when(F.length(shape) <= 4, shape).otherwise(F.concat(F.substring(shape, 1, 2), F.lit("~"), F.right(shape, F.lit(2))))


def closed_shapes(feats: DataFrame, least: int = 3) -> DataFrame:
    """``shape, closings``: clause edges that close more often than they are left open.

    The last clause of a reply closes only by a sentence mark: the end of a JSON text says
    nothing, since a reply that broke off may have been mended. Counts of both kinds grow
    alike with the corpus, so the verdict does not depend on its size.
    """
    ended = F.col("last.mark").rlike("[。！!？?.]")
    bodies = F.transform(F.filter("clauses", lambda c: (c["body"] != "") & (c["mark"] != "")), lambda c: _edges(c["body"]))
    final = _edges(F.col("last.body"))
    inner = F.when(ended, bodies).otherwise(F.filter(bodies, lambda b: b != final))
    said = F.array_union(
        F.transform(F.array_distinct(inner), lambda b: F.struct(b.alias("shape"), F.lit(1).alias("closed"))),
        F.when(ended, F.array().cast("array<struct<shape:string,closed:int>>")).otherwise(F.array(F.struct(final.alias("shape"), F.lit(0).alias("closed")))),
    )
    return (
        feats.select(F.explode(said).alias("s")).where("s.shape <> ''").groupBy("s.shape")
        .agg(F.sum("s.closed").alias("closings"), F.sum(1 - F.col("s.closed")).alias("opens"))
        .where(f"closings >= {least} AND closings > opens").drop("opens")
    )


def clause_lengths(feats: DataFrame, least: int = 5) -> DataFrame:
    """``start, usual``: how long clauses of a beginning are at least, as a rule, where they are closed."""
    closed = F.filter("clauses", lambda c: (F.length(c["body"]) >= 2) & (c["mark"] != ""))
    told = feats.select(F.explode(F.transform(closed, lambda c: F.struct(F.substring(c["body"], 1, 2).alias("start"), F.length(c["body"]).alias("n")))).alias("s"))
    return told.groupBy("s.start").agg(F.count("*").alias("times"), F.percentile_approx("s.n", 0.1).alias("usual")).where(f"times >= {least}").select("start", "usual")


def votes(pairs: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """The vote of every labelling function on every pair, and the functions of each defect.

    What a pair says by itself is told first and stored; what the corpus says about its last
    clause (whether such a clause closes, how long it usually is) is joined to that.
    """
    feats = features(pairs)
    static, flags = _static_votes()
    told = checkpoint(feats.select("record_source", "row_id", "last", "clauses", *[v.alias(k) for k, v in static.items()], *[v.alias(k) for k, v in flags.items()]))
    shapes = closed_shapes(told).withColumnRenamed("shape", "last_shape")
    rows = told.drop("clauses").withColumn("last_shape", _edges(F.col("last.body"))).withColumn("start", F.substring("last.body", 1, 2))
    rows = rows.join(shapes, "last_shape", "left").join(clause_lengths(told), "start", "left")
    c = F.col
    open_end, ended, seen = c("last.mark") == "", c("last.mark").rlike("[。！!？?.]"), c("closings").isNotNull()
    # a last clause speaks for the reply only where the reply may end: not at a comma, nor inside an open JSON text
    json_end = c("last.mark").rlike('^"')
    may_end = F.when(c("json_like"), c("last.mark").rlike("[\\]}]$")).otherwise(open_end) & ~c("title_like")
    stops = (open_end | (c("json_like") & json_end)) & ~c("title_like")
    size = F.length("last.body")
    corpus = {
        "truncated__unseen_end": _vote(stops & (size > 0) & ~seen, (seen & may_end) | ended),
        "truncated__cut_short": _vote(stops & (size < 0.7 * c("usual")), ((size >= c("usual")) & may_end) | ended),
    }
    names = [*static, *corpus]
    table = rows.select("record_source", "row_id", *static, *[v.alias(k) for k, v in corpus.items()])
    return table, {defect: [x for x in names if x.startswith(f"{defect}__")] for defect in DEFECTS}


def _static_votes() -> tuple[dict[str, Column], dict[str, Column]]:
    """Votes that need the pair alone, by name, and what is needed of it later."""
    c = F.col
    n = F.length("solid")
    brief = n < 90
    squares, braces = ("[", "]"), ("{", "}")
    open_of = lambda a, b: F.length(F.regexp_replace("body", f"[^\\{a}]", "")) > F.length(F.regexp_replace("body", f"[^\\{b}]", ""))
    json_like = c("body").rlike(r"^\s*[\[{]")
    unclosed = json_like & (open_of(*squares) | open_of(*braces))
    # a bracket left open, or a mark that promises more
    dangling = (c("content").rlike(r"[（(【「『“][^）)】」』”]*$") | c("last.mark").isin("，", ",", "、")) & ~json_like
    no_mark = c("last.mark") == ""
    title_like = ~c("body").rlike(r"[，,。；;\n]") & ~json_like
    list_like = c("body").rlike(r"^\s*(?:[-·•*]|1[.、)])")
    declines = c("folded").rlike(_any_of(REFUSAL))
    opener = c("folded").rlike(r"""^(?:嗯|您好|说实话|[\s,，。.!！{\["'])*(?:""" + _any_of(OPENERS) + ")")
    first = c("folded").rlike(_FIRST_PERSON)
    figures = F.regexp_count(c("content"), F.lit(r"[0-9]{2,}")) > 0
    foreign = F.when(c("asked") == "zh", c("latin_words")).otherwise(0)
    other_script = (
        ((c("kana") >= 3) & (c("asked") != "ja")) | ((c("hangul") >= 3) & (c("asked") != "ko")) | ((c("cyrillic") >= 3) & (c("asked") != "ru"))
    )
    letters = c("han") + c("latin") + c("kana") + c("hangul") + c("cyrillic")
    wants_three = c("ask").rlike("三条|三个字符串|three")
    points = F.regexp_count(c("body"), F.lit(r'(?m)^\s*(?:[-·•*]|[1-9][.、)])')) + F.regexp_count(c("body"), F.lit(r'"\s*[,\]]'))
    structured = c("body").rlike(r"^\s*[\[{(（<\-·•*]")
    sections = c("body").rlike("^标题[：:]")
    keyed = c("body").rlike(_KEYS)
    parts_missing = (sections & ~c("body").contains("介绍")) | (keyed & ~c("body").rlike(r'"(?:short_description|description)"')) | (list_like & ~keyed & wants_three & (points < 3))
    parts_known = sections | keyed | (list_like & wants_three)
    # what the reply adds to the question, and which of its lines it repeats
    functions: dict[str, dict[str, Column]] = {
        "empty": {
            "no_letters": _vote(n == 0),
            "hardly_anything": _vote(F.length("body") <= 4, F.length("body") > 40),
            # brackets, bullets or a fence with nothing in them; says nothing of plain prose
            "hollow_structure": _vote(structured & ~c("content").rlike(r"[\p{L}\p{N}]{5}"), structured & c("content").rlike(r"[\p{L}\p{N}]{5}")),
        },
        "copies_question": {
            "nothing_new": _vote(c("of_reply") >= 0.8, c("of_reply") < 0.6),
            "most_of_it": _vote(c("of_ask") >= 0.5, c("of_ask") < 0.3),
            "same_start": _vote((F.length("ask_form") >= 12) & c("form").contains(F.substring("ask_form", 1, 12))),
            "whole_lines": _vote((c("lines_said") >= 2) & (c("lines_said") * 2 >= c("lines_asked")), c("lines_said") * 4 < c("lines_asked")),
        },
        "refusal": {
            "declines": _vote(declines),
            "opens": _vote(opener, ~opener & ~declines),
            "first_person": _vote(first & brief, ~first),
            "brief_without_figures": _vote(brief & ~figures & (n > 0) & (c("of_reply") < 0.3), figures | ~brief),
        },
        "other_language": {
            "script": _vote(other_script, (c("asked") == "zh") & (c("kana") + c("hangul") + c("cyrillic") == 0) & (foreign < 4)),
            "foreign_words": _vote(foreign >= 4, (foreign <= 1) & ~other_script),
            "function_words": _vote((c("asked") == "zh") & (c("function_words") >= 2), (c("function_words") == 0) & ~other_script),
            "share_of_script": _vote(
                F.when(c("asked") == "zh", ((c("han") < 0.35 * letters) & (letters >= 12)) | other_script).otherwise((c("han") >= 0.4 * letters) & (n > 0)),
                F.when(c("asked") == "zh", (c("han") >= 0.5 * letters) & ~other_script).otherwise(c("han") < 0.3 * letters),
            ),
        },
        "truncated": {
            # syntax, what was asked for, and how such replies end; the corpus adds its own witnesses
            "left_open": _vote(unclosed | dangling, F.lit(False)),
            "missing_parts": _vote(parts_missing, parts_known & ~parts_missing),
            "unmarked": _vote(no_mark & ~title_like & ~json_like & ~list_like & ~sections, c("last.mark").rlike("[。！!？?.]")),
        },
    }
    return {f"{defect}__{name}": vote for defect, lfs in functions.items() for name, vote in lfs.items()}, {"json_like": json_like, "title_like": title_like}


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of each vote pattern under a one-coin-per-class model fitted by EM.

    ``patterns`` is (patterns x functions) of 1, -1 and 0. Functions are taken as independent
    given the class. Rates start on the functions' side and carry pseudo-counts, so the
    classes cannot swap and an unseen case keeps a finite weight.
    """
    k = patterns.shape[1]
    prior, hit, false = 0.05, np.full((k, 2), [0.8, 0.1]), np.full((k, 2), [0.03, 0.9])
    posterior = np.zeros(len(patterns))
    yes, no = patterns == YES, patterns == NO
    for _ in range(rounds):
        log1 = np.log(prior) + yes @ np.log(hit[:, 0]) + no @ np.log(hit[:, 1])
        log0 = np.log1p(-prior) + yes @ np.log(false[:, 0]) + no @ np.log(false[:, 1])
        posterior = 1.0 / (1.0 + np.exp(np.clip(log0 - log1, -500, 500)))
        w1, w0 = counts * posterior, counts * (1 - posterior)
        prior = float(np.clip((w1.sum() + 1) / (counts.sum() + 20), 1e-6, 0.5))
        for rates, w, start in ((hit, w1, (0.8, 0.1)), (false, w0, (0.03, 0.9))):
            for j, mask in enumerate((yes, no)):
                rates[:, j] = np.clip((w @ mask + 10 * start[j]) / (w.sum() + 10), 1e-4, 1 - 1e-4)
    return posterior


def label_posteriors(pairs: DataFrame) -> DataFrame:
    """``record_source, row_id`` and one posterior column per defect.

    Only counts of vote patterns reach the driver: at most 3^5 rows a defect.
    """
    table, functions = votes(pairs)
    signatures = {defect: F.concat_ws(",", *[F.col(n).cast("string") for n in names]) for defect, names in functions.items()}
    # read twice, for the counts and for the posteriors
    signed = checkpoint(table.select("record_source", "row_id", *[s.alias(defect) for defect, s in signatures.items()]))
    stacked = signed.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in functions])).alias("v"))
    counted = stacked.groupBy("v.defect", "v.votes").agg(F.count("*").alias("n")).collect()
    out = signed
    for defect in functions:
        rows = [(r["votes"], r["n"]) for r in counted if r["defect"] == defect]
        if not rows:
            out = out.withColumn(defect, F.lit(0.0))
            continue
        patterns = np.array([[int(v) for v in key.split(",")] for key, _ in rows])
        fitted = fit_label_model(patterns, np.array([n for _, n in rows], dtype=float))
        lookup = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(float(kv[1]))], zip((k for k, _ in rows), fitted), [])
        out = out.withColumn(defect, F.coalesce(F.element_at(F.create_map(*lookup), F.col(defect)), F.lit(0.0)))
    return out


def choose_cutoffs(labelled: list[tuple[dict[str, float], str | None]], grid: tuple[float, ...] = tuple(i / 20 for i in range(1, 20))) -> dict[str, float]:
    """For each defect the cutoff with the best F1 on labelled pairs; of equal ones the middle.

    ``labelled``: the posteriors of a pair by defect, and its true defect or None. A bounded
    hand-labelled sample; the label model itself is fitted without labels.
    """

    def f1(defect: str, cutoff: float) -> float:
        said = [(p[defect] > cutoff, true == defect) for p, true in labelled]
        right = sum(a and b for a, b in said)
        return 2 * right / max(1, sum(a for a, _ in said) + sum(b for _, b in said))

    chosen = {}
    for defect in DEFECTS:
        scores = [f1(defect, c) for c in grid]
        best = [c for c, score in zip(grid, scores) if score == max(scores)]
        chosen[defect] = best[len(best) // 2]
    return chosen


def broken_pairs(pairs: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """``record_source, row_id, defect_type, posterior``: every label above its cutoff.

    A missing prompt or reply counts as empty text: no reply is defect ``empty``. Repeated
    rows are labelled each.
    """
    limits = cutoffs or CUTOFFS
    labels = F.filter(
        F.array(*[F.struct(F.lit(d).alias("defect_type"), F.col(d).alias("posterior"), F.lit(limits[d]).alias("cutoff")) for d in DEFECTS]),
        lambda x: x["posterior"] > x["cutoff"],
    )
    return label_posteriors(pairs).select("record_source", "row_id", F.explode(labels).alias("l")).select(
        "record_source", "row_id", "l.defect_type", "l.posterior"
    )


def main_defect(broken: DataFrame) -> DataFrame:
    """One defect a pair: the first in the order of ``DEFECTS``, in which each rules out the later ones."""
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect_type"))
    return broken.groupBy("record_source", "row_id").agg(F.min_by("defect_type", rank).alias("defect_type"))


def conversation_pairs(lora_data: DataFrame, smoke_test: DataFrame) -> DataFrame:
    """``record_source, row_id, prompt, reply`` from the two tables of replies."""

    def last(role: str) -> Column:
        said = F.filter(F.coalesce(F.col("messages"), F.array()), lambda m: m["role"] == role)
        return F.when(F.size(said) > 0, F.element_at(said, -1)["content"])

    lora = lora_data.select("row_id", "messages").select(F.lit("lora_data").alias("record_source"), "row_id", last("user").alias("prompt"), last("assistant").alias("reply"))
    smoke = smoke_test.select(F.lit("smoke_test").alias("record_source"), "row_id", "prompt", F.col("raw_output").alias("reply"))
    return lora.unionByName(smoke)
