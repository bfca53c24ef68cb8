"""Product listings that describe the same item.

Each listing (all titles and attribute sets of one product id) is reduced to a profile of
normalised tokens: model code with suffix, brand, series, figures in base units, kind of
article. Wholly equal profiles are folded into one before anything is compared, so a group of
copies costs one profile whatever its size. The profiles are sorted by several keys with
different token orders (multi-pass sorted neighbourhood); in each pass a sliding window
compares neighbours by a soft alignment of their tokens, in which the code is one token of
several, and the fullest profile of a run stays in the window. Where a series has more profiles
than a window, passes keyed by series and stated figures compare all that can align. The
alignments are positive and negative edges; correlation clustering (parallel pivots, then
contraction of clusters whose net weight is positive) turns them into groups. Listings that
state a code come first; what they say together then meets the listings without one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.llm.confusables import plain_text
from wareloom.session import checkpoint, drop_folder, release, stored

#: Attribute names by field (fixed values, with their synonyms).
FIELDS = {
    "brand": ("品牌", "牌子", "Brand", "brand"),
    "series": ("系列", "产品系列"),
    "model": ("型号", "产品型号", "货号"),
}
FIGURE_NAMES = (
    "净重", "重量", "单品重量", "功率", "额定功耗", "额定功率", "输出功率", "容量", "净容量", "水箱容量", "电池容量", "长度", "线长",
    "灯臂长度", "最大称重", "承重", "存储容量",
)
#: unit -> (dimension, factor to the base unit) (fixed values).
UNITS = {
    "kg": ("g", 1000), "千克": ("g", 1000), "公斤": ("g", 1000), "g": ("g", 1), "克": ("g", 1), "斤": ("g", 500),
    "kw": ("w", 1000), "千瓦": ("w", 1000), "w": ("w", 1), "瓦": ("w", 1),
    "ml": ("ml", 1), "毫升": ("ml", 1), "l": ("ml", 1000), "升": ("ml", 1000),
    "mah": ("mah", 1), "毫安时": ("mah", 1), "毫安": ("mah", 1), "ah": ("mah", 1000), "安时": ("mah", 1000),
    "mm": ("mm", 1), "毫米": ("mm", 1), "cm": ("mm", 10), "厘米": ("mm", 10), "m": ("mm", 1000), "米": ("mm", 1000),
    "gb": ("gb", 1), "g存储": ("gb", 1), "tb": ("gb", 1024), "t": ("gb", 1024),
}
SUFFIXES = ("PRO", "PLUS", "MAX", "AIR", "LITE", "MINI", "ULTRA", "SE", "S", "2", "3")
_CODE = re.compile(
    r"(?<![A-Za-z0-9])([A-Za-z]{2})[-_ ]?(\d{4})[-_ ]?([A-Za-z]{2})"
    r"(?:[-_ ]?(" + "|".join(SUFFIXES) + r")(?![A-Za-z0-9.一-鿿]))?(?![A-Za-z0-9])",
    re.I,
)
_CODE_GLUED = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})[-_ ]?(\d{4})[-_ ]?([A-Za-z]{2})(" + "|".join(SUFFIXES) + r")(?![A-Za-z0-9])", re.I)
_FIGURE = re.compile(
    r"(?<![\d.A-Za-z])(\d+(?:\.\d+)?)\s*(" + "|".join(sorted((u for u in UNITS if u != "g存储"), key=len, reverse=True)) + r")(?![A-Za-z]|级)", re.I
)
_ACCESSORY = re.compile(r"^(?:【[^】]*】)?\s*(?:适用(?:于)?|适配|专用于|兼容|for )", re.I)
_OWN_STYLE = re.compile(r"(?<![一-鿿])([一-鿿]{2,5})款(?![一-鿿])")
_SPLIT = re.compile(r"[\s|·,，、;；:：/\[\]【】()（）\"{}]+")


PARSED = (
    "product_id string, code string, code_weight int, accessory boolean, brands array<string>, series array<string>, "
    "figures array<string>, words array<string>"
)
#: The sets of tokens in a profile.
PROFILE_SETS = ("brands", "series", "figures")
PARSED_COLUMNS = [field.split()[0] for field in PARSED.split(", ")]


def _codes(text: str) -> list[str]:
    found = []
    for match in _CODE_GLUED.finditer(text):
        found.append("".join(match.groups()[:3]).upper() + "-" + match.group(4).upper())
    for match in _CODE.finditer(text):
        found.append("".join(match.groups()[:3]).upper() + (f"-{match.group(4).upper()}" if match.group(4) else ""))
    return found


def _figures(text: str, storage: bool = False) -> list[str]:
    out = []
    for number, unit in _FIGURE.findall(text):
        unit = unit.lower()
        dimension, factor = UNITS["g存储" if unit == "g" and storage else unit]
        value = (Decimal(number) * factor).normalize()
        out.append(f"{dimension}:{value:f}")
    return out


def parse_listing(title: str | None, attributes: list[tuple[str, list[str]]], category: str | None) -> dict:
    """What one record says about its product. Everything missing gives empty fields."""
    title = plain_text(title) or ""
    stated, brands, series = Counter(), set(), set()
    figures: set[str] = set()
    for name, values in attributes:
        name = plain_text(name) or ""
        for value in values if values is not None else ():
            value = (plain_text(value) or "").strip()
            if name in FIELDS["model"]:
                stated.update(_codes(value))
            elif name in FIELDS["brand"]:
                brands.update(part.strip().lower() for part in value.split("/") if part.strip())
            elif name in FIELDS["series"] and value:
                series.add(value)
            elif name in FIGURE_NAMES:
                figures.update(_figures(value, name == "存储容量"))
    accessory = category == "配件" or bool(_ACCESSORY.match(title))
    # the title of an accessory names the model it was made for, not its own
    codes = stated or (Counter() if accessory else Counter(_codes(title)))
    series.update(_OWN_STYLE.findall(title) if accessory else ())
    rest = _CODE.sub(" ", _CODE_GLUED.sub(" ", _ACCESSORY.sub("", title)))
    # a drive's capacity is often given in bare "G", which elsewhere is a weight
    drive = "硬盘" in f"{category or ''}{title}" or "存储盘" in title
    for figure in _figures(rest):
        amount = float(figure.partition(":")[2])
        is_size = drive and figure.startswith("g:") and amount >= 256 and amount.is_integer() and int(amount) & (int(amount) - 1) == 0
        figures.add(f"gb:{figure[2:]}" if is_size else figure)
    words = {t.lower() for t in _SPLIT.split(rest) if t and not _FIGURE.fullmatch(t)}
    best = min(codes.items(), key=lambda kv: (-kv[1], -len(kv[0]), kv[0]))[0] if codes else None
    return {
        "code": best, "code_weight": 3 if stated else 1, "accessory": accessory,
        "brands": sorted(brands), "series": sorted(series), "figures": sorted(figures), "words": sorted(words),
    }


def evidence(review: DataFrame, lora_data: DataFrame) -> DataFrame:
    """``product_id, title, attributes, category``: each distinct thing said about a product, once."""
    pairs = "array<struct<key:string,value:array<string>>>"
    said = F.from_json("attribute_evidence", "map<string,array<string>>")
    titles = review.select("product_id", "title", F.map_entries(said).cast(pairs).alias("attributes"), F.col("category_l2").alias("category"))
    sets = lora_data.select("product_id", F.lit(None).cast("string").alias("title"), F.map_entries("attributes").cast(pairs).alias("attributes"),
                            F.col("category_l2").alias("category"))
    return titles.unionByName(sets).where("product_id IS NOT NULL").distinct()


def profiles(review: DataFrame, lora_data: DataFrame) -> DataFrame:
    """``product_id, code, accessory, brands, series, figures, words``: one row a product."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, title, attributes, category in zip(batch["product_id"], batch["title"], batch["attributes"], batch["category"]):
                listed = [(a["key"], a["value"]) for a in attributes] if attributes is not None else []
                rows.append({"product_id": pid} | parse_listing(title, listed, category))
            yield pd.DataFrame(rows, columns=PARSED_COLUMNS)

    parsed = checkpoint(evidence(review, lora_data).mapInPandas(parse, PARSED))
    # the code most records agree on; ties go to the smaller code
    codes = (
        parsed.where("code IS NOT NULL").groupBy("product_id", "code").agg(F.sum("code_weight").alias("weight"))
        .groupBy("product_id").agg(F.min_by("code", F.struct(-F.col("weight"), "code")).alias("code"))
    )
    merged = parsed.groupBy("product_id").agg(
        F.max("accessory").alias("accessory"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name) for name in ("brands", "series", "figures", "words")],
    )
    return merged.join(codes, "product_id", "left")


def _with_lexicons(found: DataFrame) -> DataFrame:
    """Brand names of two languages become one; a series missing from the attributes is taken from the title.

    Both lexicons are learnt from the listings themselves and joined, never collected.
    """
    pairs = (
        found.where(F.size("brands") == 2)
        .select(F.col("brands")[0].alias("a"), F.col("brands")[1].alias("b"))
        .groupBy("a", "b").count()
    )
    other = (
        pairs.select(F.col("b").alias("name"), F.col("a").alias("same"), "count")
        .groupBy("name").agg(F.min_by("same", F.struct(-F.col("count"), "same")).alias("same"))
    )
    known = found.select(F.explode("series").alias("name")).groupBy("name").agg(F.lit(True).alias("is_series"))
    brand_names = found.select(F.explode("brands").alias("name")).distinct().join(other, "name", "left").select(
        "name", F.coalesce("same", "name").alias("brand")
    )
    words = found.select("product_id", F.explode(F.array_union("words", "brands")).alias("name"))
    read = (
        words.join(brand_names, "name", "left").join(known, "name", "left")
        .where("brand IS NOT NULL OR is_series")
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_set("brand")).alias("read_brands"),
             F.array_sort(F.collect_set(F.when(F.col("is_series"), F.col("name")))).alias("read_series"))
    )
    empty = F.array().cast("array<string>")
    return found.join(read, "product_id", "left").select(
        "product_id", "code", "accessory", "figures", "words",
        F.coalesce("read_brands", empty).alias("brands"),
        F.when(F.size("series") > 0, F.col("series")).otherwise(F.coalesce("read_series", empty)).alias("series"),
    )


def nodes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal profiles folded: the nodes to compare, and ``product_id, node``.

    Two listings fold if code, kind, brands, series and figures are all the same; one that
    says too little to be told apart (no code, and no series or no figures) stays alone.
    """
    said = F.concat_ws("|", *[F.array_join(x, ",") for x in PROFILE_SETS])
    tells = F.col("code").isNotNull() | ((F.size("series") > 0) & (F.col("accessory") | (F.size("figures") > 0)))
    kind = F.when(F.col("accessory"), "a|").otherwise("p|")
    signature = F.when(tells, F.concat(kind, F.coalesce("code", F.lit("")), F.lit("|"), said)).otherwise(F.concat(F.lit("alone|"), F.col("product_id")))
    # a digest of fixed length travels through all joins in place of the signature
    keyed = found.withColumn("node", F.base64(F.unhex(F.md5(signature))))
    folded = keyed.groupBy("node").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("code", "accessory", *PROFILE_SETS)])
    return folded, keyed.select("product_id", "node")


def _positions(df: DataFrame) -> DataFrame:
    """Global position of ``sort_key, node`` in sort order without a single-task sort."""
    ordered = checkpoint(
        df.repartitionByRange("sort_key", "node").sortWithinPartitions("sort_key", "node").select("node", F.monotonically_increasing_id().alias("mono"))
    )
    part = F.shiftright("mono", 33)
    sizes = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    offset, offsets = 0, []
    for row in sizes:
        offsets.append((row["part"], offset))
        offset += row["count"]
    if not offsets:
        return ordered.select("node", F.lit(0).cast("long").alias("pos"))
    starts = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair])
    return ordered.select("node", (F.element_at(starts, part) + F.col("mono").bitwiseAND((1 << 33) - 1)).alias("pos"))


def numbered(folded: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and ``product_id, node`` with numbers, in the order of the digests, in place of these.

    Pairs of numbers take a third of the room. ``seed`` is the digest's hash.
    """
    numbers = checkpoint(_positions(folded.select(F.col("node").alias("sort_key"), "node")))
    number = lambda df, *more: df.join(numbers, "node").select(*[F.col("pos").alias(c) if c == "node" else F.col(c) for c in df.columns], *more)
    return number(folded, F.xxhash64("node").alias("seed")), number(membership)


def _seed(df: DataFrame) -> Column:
    return F.col("seed") if "seed" in df.columns else F.xxhash64("node")


def _neighbours(df: DataFrame, key: Column, window: int, block: int = 2048) -> DataFrame:
    """``a, b, weight``: nodes at most ``window - 1`` apart in the order of ``key``, aligned where they meet.

    A profile travels once or twice a pass, not once a pair.

    The order is cut into blocks of rows, not of keys; a block also gets the first rows of
    the next one, so no pair is lost at a border and no key can swell a task.
    """
    placed = _positions(df.select(key.alias("sort_key"), "node"))
    home = F.floor(F.col("pos") / block)
    spots = F.when(F.col("pos") % block < window - 1, F.array(home, home - 1)).otherwise(F.array(home))
    profile = F.struct("node", "code", "accessory", *PROFILE_SETS).alias("row")
    spread_out = placed.join(df.select("node", profile), "node").withColumn("home", home).select("pos", "row", "home", F.explode(spots).alias("block"))
    following = F.collect_list("row").over(W.partitionBy("block").orderBy("pos").rowsBetween(1, window - 1))
    return _aligned(spread_out.withColumn("next", following).where("home = block").select("row", F.explode("next").alias("other")))


def _leaders(df: DataFrame) -> DataFrame:
    """``a, b, weight``: each node of a run of one code with the fullest profile of the run.

    The leader stays in the window as long as the run lasts, so a run longer than a window
    hangs together.
    """
    fullness = sum((F.size(x) for x in PROFILE_SETS), F.lit(0))
    profile = F.struct("node", "code", "accessory", *PROFILE_SETS)
    runs = df.where("code IS NOT NULL").groupBy("code", "accessory").agg(F.max_by(profile, F.struct(fullness, _seed(df), "node")).alias("other"), F.count("*").alias("run"))
    return _aligned(df.join(runs.where("run > 1"), ["code", "accessory"]).where("node <> other.node").select(profile.alias("row"), "other"))


def _likeness(a: Column, b: Column) -> Column:
    """Best similarity of two sets of names by edit distance, from 0 to 1; null if either is empty."""
    one = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y)))))


def _name_term(a: Column, b: Column, clash: float) -> Column:
    """1 for an equal name, little for a misspelt one, 0 where a side states none, ``clash`` for another."""
    like = _likeness(a, b)
    return F.when(like.isNull(), 0.0).when(like > 0.999, 1.0).when(like >= 0.6, like - 0.5).otherwise(clash)


def _figures_met(a: Column, b: Column) -> Column:
    """How many figures of ``a`` are among those of ``b``, up to half a per cent."""
    dimension, amount = (lambda f: F.split_part(f, F.lit(":"), F.lit(1))), (lambda f: F.split_part(f, F.lit(":"), F.lit(2)).cast("double"))
    close = lambda x, y: (dimension(x) == dimension(y)) & (F.abs(amount(x) - amount(y)) <= 0.005 * F.greatest(amount(x), amount(y)))
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: close(x, y))))


def _alignment(a: str, b: str) -> Column:
    """Soft alignment of two profiles: above 0 for the same product, below for different ones.

    A sum of weighted tokens less what chance would give. An equal code weighs most but can be
    outweighed by a clash of series, brand and figures; another code, or an accessory
    against its product, is decisive. Without two codes the series, the brand and the share of
    the smaller side's figures that agree must do, and figures that disagree weigh the more
    the fewer there are.
    """
    c = lambda side, f: F.col(f"{side}.{f}")
    size_a, size_b = F.size(c(a, "figures")), F.size(c(b, "figures"))
    least = F.least(size_a, size_b)
    met = F.when(size_a <= size_b, _figures_met(c(a, "figures"), c(b, "figures"))).otherwise(_figures_met(c(b, "figures"), c(a, "figures")))
    share = F.when(least > 0, met / least).otherwise(0.0)
    fuller = F.when(least > 0, met / F.greatest(size_a, size_b)).otherwise(0.0)
    names = lambda clash: 2 * _name_term(c(a, "series"), c(b, "series"), clash) + _name_term(c(a, "brands"), c(b, "brands"), clash)
    both_coded = c(a, "code").isNotNull() & c(b, "code").isNotNull()
    figures = 3 * share * share * share * F.when(least > 1, 1.0).otherwise(0.8)
    return (
        F.when(c(a, "accessory") != c(b, "accessory"), -8.0)
        .when(both_coded & (c(a, "code") != c(b, "code")), -8.0)
        .when(both_coded, 1.5 + names(-0.5) + 0.25 * met - 0.25 * (least - met))
        .when(c(a, "accessory"), names(-1.0) - 1.5)
        # of several that fit, the one with more figures in common fits best
        .otherwise(names(-1.0) + figures + 0.05 * fuller - 4.1)
    )


def _aligned(met: DataFrame) -> DataFrame:
    """``a, b, weight`` of two profiles ``row, other`` in one row."""
    first = F.col("row.node") < F.col("other.node")
    sides = met.select(F.when(first, F.col("row")).otherwise(F.col("other")).alias("row_a"), F.when(first, F.col("other")).otherwise(F.col("row")).alias("row_b"))
    return sides.select(F.col("row_a.node").alias("a"), F.col("row_b.node").alias("b"), _alignment("row_a", "row_b").alias("weight"))


def _long_runs(folded: DataFrame, window: int, block: int) -> DataFrame:
    """``a, b``: nodes that may align and that a window may miss: at least one of them has no code.

    They lie in a series of more nodes than a window, or of a node with several series. A
    node is kept under its series and each figure and each pair of figures; it asks with one
    key only, the rarest of its pairs (its figure, if it has one), since whatever states all
    its figures is kept there. Accessories align without figures and meet by series. Nodes
    under one key are cut into blocks on both sides, so no key can swell a task.
    """
    told = folded.select(F.explode("series").alias("name"), "node", "accessory", "figures", F.col("code").isNotNull().alias("coded"), F.size("series").alias("names"))
    wide = told.groupBy("name").agg(F.count("*").alias("nodes"), F.max("names").alias("most")).where((F.col("nodes") > window) | (F.col("most") > 1))
    told = checkpoint(told.join(wide.select("name"), "name", "left_semi"))
    following = lambda f, i: F.transform(F.slice("figures", i + 2, F.size("figures")), lambda g: F.concat_ws("|", f, g))
    pairs = F.flatten(F.transform("figures", following))
    alike = F.array(F.lit("accessory"))
    held = told.select("name", "node", F.col("coded").alias("side"), F.explode(F.when(F.col("accessory"), alike).otherwise(F.concat("figures", pairs))).alias("key"))
    keys = F.when(F.col("accessory"), alike).when(F.size("figures") > 1, pairs).otherwise(F.col("figures"))
    # two nodes with codes never align here
    sides = F.when(F.col("coded"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    at = ["name", "key", "side"]
    kept = checkpoint(held.groupBy(*at).agg(F.count("*").alias("kept")))
    asked = told.select("name", "node", sides.alias("sides"), F.explode(keys).alias("key")).select("name", "node", "key", F.explode("sides").alias("side"))
    rarest = (
        asked.join(kept, at).groupBy("name", "node", "key").agg(F.sum("kept").alias("meets"))
        .groupBy("name", "node").agg(F.min_by("key", F.struct("meets", "key")).alias("key"))
    )
    asking = checkpoint(asked.join(rarest, ["name", "node", "key"], "left_semi"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    cells = kept.join(asking.groupBy(*at).agg(F.count("*").alias("asking")), at).select(*at, blocks("kept").alias("across"), blocks("asking").alias("down"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asking.join(cells, at).select(*at, F.col("node").alias("a"), own("down").alias("y"), every("across").alias("x"))
    b = held.join(cells, at).select(*at, F.col("node").alias("b"), own("across").alias("x"), every("down").alias("y"))
    return a.join(b, [*at, "x", "y"]).where("a <> b").select("a", "b")


def _scored(folded: DataFrame, met: DataFrame) -> DataFrame:
    """``a, b, weight``: every pair met, once, with the alignment of its profiles."""
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    body = F.struct("code", "accessory", *PROFILE_SETS)
    side = lambda x: folded.select(F.col("node").alias(x), body.alias(f"row_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _alignment("row_a", "row_b").alias("weight"))


def compare_coded(folded: DataFrame, window: int = 12, block: int = 2048) -> DataFrame:
    """``a, b, weight``: edges, positive and negative, between the nodes with a code."""
    coded = folded.where("code IS NOT NULL")
    series, brands, figures = F.array_join("series", " "), F.array_join("brands", " "), F.array_join("figures", " ")
    keys = [F.concat_ws("|", "code", series, brands, figures), F.concat_ws("|", brands, series, "code", figures)]
    return reduce(DataFrame.unionByName, [_neighbours(coded, key, window, block) for key in keys], _leaders(coded)).dropDuplicates(["a", "b"])


def compare(folded: DataFrame, window: int = 12, block: int = 2048) -> DataFrame:
    """``a, b, weight``: edges, positive and negative, of all passes, once each."""
    series, brands, figures = F.array_join("series", " "), F.array_join("brands", " "), F.array_join("figures", " ")
    code = F.coalesce("code", F.lit(""))
    backwards = F.array_join(F.reverse("figures"), " ")
    keys = [
        F.concat_ws("|", series, brands, figures, code),
        F.concat_ws("|", brands, series, backwards, code),
        F.concat_ws("|", figures, series, brands, code),
    ]
    runs = _scored(folded, _long_runs(folded, window, block))
    return reduce(DataFrame.unionByName, [_neighbours(folded, key, window, block) for key in keys], runs).dropDuplicates(["a", "b"])


def pivot_clusters(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, cluster``: correlation clustering by parallel pivots over positive edges.

    ``ranked``: ``node, rank``. In each round the nodes that come before all their remaining
    neighbours become pivots, and their neighbours join the pivot they agree with most. The
    first node that is left is always a pivot, so rounds end when none is left.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    linked = both.select(F.col("a").alias("node")).distinct()
    alone = ranked.join(linked, "node", "left_anti").select("node", F.col("node").alias("cluster"))
    left = checkpoint(ranked.join(linked, "node", "left_semi"))
    both = checkpoint(both)
    done, number = alone, 0
    while not left.isEmpty():
        open_edges = both.join(left.select(F.col("node").alias("a"), F.col("rank").alias("rank_a")), "a").join(
            left.select(F.col("node").alias("b"), F.col("rank").alias("rank_b")), "b"
        )
        beaten = open_edges.where("rank_b < rank_a").select(F.col("a").alias("node")).distinct()
        pivots = left.join(beaten, "node", "left_anti").select("node")
        joined = (
            open_edges.join(pivots.select(F.col("node").alias("b")), "b", "left_semi")
            .groupBy(F.col("a").alias("node"))
            .agg(F.max_by("b", F.struct("weight", F.col("b"))).alias("cluster"))
        )
        settled = checkpoint(pivots.select("node", F.col("node").alias("cluster")).unionByName(joined))
        done = checkpoint(done.unionByName(settled)) if number % 20 == 19 else done.unionByName(settled)
        number += 1
        left = checkpoint(left.join(settled.select("node"), "node", "left_anti"))
    return done


def _ranks(folded: DataFrame) -> DataFrame:
    """``node, rank``: nodes with a code come first, then the fuller profiles, then a hash."""
    fullness = sum((F.size(x) for x in PROFILE_SETS), F.lit(0))
    hashed = F.lpad(F.hex(_seed(folded)), 16, "0")
    return folded.select("node", F.concat(F.col("code").isNull().cast("int").cast("string"), F.lpad((999 - F.least(fullness, F.lit(999))).cast("string"), 3, "0"), hashed).alias("rank"))


def merged_profiles(folded: DataFrame, clusters: DataFrame) -> DataFrame:
    """The profile of each cluster under its pivot's name: all its tokens, and the code most listings state."""
    inside = folded.join(clusters, "node")
    codes = (
        inside.where("code IS NOT NULL").groupBy("cluster", "code").agg(F.sum("n").alias("w"))
        .groupBy("cluster").agg(F.min_by("code", F.struct(-F.col("w"), "code")).alias("code"))
    )
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(x)))).alias(x) for x in PROFILE_SETS]
    seed = [F.max(F.when(F.col("node") == F.col("cluster"), F.col("seed"))).alias("seed")] if "seed" in folded.columns else []
    return inside.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("accessory").alias("accessory"), *sets, *seed).join(codes, "cluster", "left").withColumnRenamed("cluster", "node")


def settle(folded: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, cluster``: correlation clustering on positive and negative edges.

    Pivots cluster by the positive edges. A node that the edges of both signs push out of its
    cluster leaves it. Then clusters are contracted to nodes: two of them join where the
    sum of all edges between them and the alignment of their merged profiles are positive,
    until none do; each round joins two clusters at least.
    """
    edges, folder = stored(edges)
    try:
        return _settled(folded, edges)
    finally:
        drop_folder(folder)
        release(folded.sparkSession)


def _settled(folded: DataFrame, edges: DataFrame) -> DataFrame:
    clusters = checkpoint(pivot_clusters(_ranks(folded), edges.where("weight > 0")))
    of = lambda x: clusters.select(F.col("node").alias(x), F.col("cluster").alias(f"c{x}"))
    inside = edges.join(of("a"), "a").join(of("b"), "b").where("ca = cb")
    pushed = (
        inside.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("net")).where("net < 0").select("node", F.lit(True).alias("out"))
    )
    clusters = checkpoint(clusters.join(pushed, "node", "left").select("node", F.when(F.col("out") & (F.col("node") != F.col("cluster")), F.col("node")).otherwise(F.col("cluster")).alias("cluster")))
    while True:
        between = (
            edges.join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
            .groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("net")).where("net > 0")
        )
        between = checkpoint(between)
        if between.isEmpty():
            return clusters
        touched = clusters.join(between.select(F.explode(F.array("a", "b")).alias("cluster")).distinct(), "cluster", "left_semi")
        whole = checkpoint(merged_profiles(folded, touched))
        agreed = checkpoint(_scored(whole, between).where("weight > 0"))
        if agreed.isEmpty():
            return clusters
        joined = pivot_clusters(_ranks(whole), agreed).select(F.col("node").alias("cluster"), F.col("cluster").alias("into"))
        clusters = checkpoint(clusters.join(joined, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster")))


def listing_groups(review: DataFrame, lora_data: DataFrame, window: int = 12) -> DataFrame:
    """``product_id, group_id``: every product of either table with the product it is.

    Listings that state a code are clustered first; their merged profiles meet the others in
    a second turn of the same kind. Nulls: rows without product id give nothing; a product
    of which nothing is known is a group of its own. Repeated rows change nothing.
    """
    found = checkpoint(_with_lexicons(profiles(review, lora_data)))
    folded, membership = numbered(*nodes(found))
    folded, membership = checkpoint(folded), checkpoint(membership)
    release(review.sparkSession)
    first = settle(folded.where("code IS NOT NULL"), compare_coded(folded, window))
    whole = checkpoint(merged_profiles(folded.where("code IS NOT NULL"), first).unionByName(folded.where("code IS NULL")))
    second = settle(whole, compare(whole, window)).select(F.col("node").alias("group"), F.col("cluster").cast("string").alias("group_id"))
    return (
        membership.join(first, "node", "left").withColumn("group", F.coalesce("cluster", "node"))
        .join(second, "group").select("product_id", "group_id")
    )


def same_product_pairs(groups: DataFrame) -> DataFrame:
    """``product_id_a, product_id_b``, a < b: all pairs inside the groups."""
    a = groups.select(F.col("product_id").alias("product_id_a"), "group_id")
    b = groups.select(F.col("product_id").alias("product_id_b"), "group_id")
    return a.join(b, "group_id").where("product_id_a < product_id_b").select("product_id_a", "product_id_b")
