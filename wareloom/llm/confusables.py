"""Visually identical text with different characters: one consistent form for comparison.

A vocabulary of plainly spelled tokens is kept in tries, one per bucket. Every token with
unusual characters walks the trie of its bucket with a weighted edit automaton: look-alike
letters, width and composition variants cost nothing to substitute and ignorable characters
nothing to insert; case, accent and any other edit have a cost. The cheapest spelling within
the budget is the canonical one, the most frequent of equally cheap ones. The budget is 0 by
default, since case and accents are real differences here. A token that reaches none is
normalised by table. Texts are rebuilt from canonical tokens and compared by digest.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions.text import IGNORABLES, ODD_BLANKS
from wareloom.session import checkpoint

#: Letters of other scripts and the Latin letters they look like, best first (fixed values).
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "lI", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "Il", "Ӏ": "Il", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "Il", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c",
    "ϳ": "j", "Ϲ": "C", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "ɡ": "g", "ɑ": "a",
    "ɩ": "i", "ı": "i", "ʏ": "Y", "ѡ": "w", "ӧ": "ö", "ӓ": "ä",
}
#: Decomposition tags that change how a character is set, not what is read (fixed values).
_SAME_TO_THE_EYE = ("<wide>", "<narrow>", "<square>", "<noBreak>", "<compat>")
_BREAK = r"\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000|｜·・,，、;；:：\"{}\[\]【】()（）/\\"


_FORMS: dict[str, str] = {}


def _plain_char(ch: str) -> str:
    """The table form of one character, remembered; empty for an ignorable."""
    form = _FORMS.get(ch)
    if form is None:
        form = _FORMS[ch] = _fold_char(ch)
    return form


def _fold_char(ch: str) -> str:
    if ch in IGNORABLES:
        return ""
    if ch in ODD_BLANKS:
        return " "
    if ch in LOOKALIKES:
        return LOOKALIKES[ch][0]
    decomposition = unicodedata.decomposition(ch)
    if decomposition and (decomposition[0] != "<" or decomposition.split(" ", 1)[0] in _SAME_TO_THE_EYE):
        folded = unicodedata.normalize("NFKC", ch)
        return folded if folded == ch or len(folded) > 8 else "".join(LOOKALIKES.get(c, c)[0] for c in folded)
    return ch


def plain_text(text: str | None) -> str | None:
    """Normalisation by table: width, composition, blanks, ignorables and look-alikes."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(map(_plain_char, text)))


def _coarse(token: str) -> str:
    """A key on which every pair of tokens agrees that reads the same; used for buckets only."""
    base = unicodedata.normalize("NFD", plain_text(token) or "").lower()
    return "".join("l" if c in "i1|" else "o" if c == "0" else c for c in base if not unicodedata.combining(c))


#: Costs of the automaton's steps. Look-alikes, width, composition and ignorables are free;
#: case and accent are real differences, as is any other letter.
COSTS = {"same": 0.0, "lookalike": 0.0, "ignorable": 0.0, "case": 1.0, "accent": 1.0, "other": 2.0, "dropped": 2.0, "added": 2.0}
#: What a spelling may cost to be reached: nothing, since every step that costs is a real difference.
BUDGET = 0.0


def _bare(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)[:1]


class Trie:
    """A trie of plainly spelled tokens with their counts, walked by a weighted edit automaton."""

    def __init__(self, costs: dict[str, float] | None = None) -> None:
        self.root: dict = {}
        self.costs = costs or COSTS

    def add(self, token: str, count: int) -> None:
        node = self.root
        for ch in token:
            node = node.setdefault(ch, {})
        node[""] = node.get("", 0) + count

    def _step(self, states: dict[tuple[int, str], tuple[float, dict]], ch: str, budget: float) -> dict[tuple[int, str], tuple[float, dict]]:
        """All states reached by reading ``ch``: as itself or a look-alike, and as an edit where the budget allows one."""
        following: dict[tuple[int, str], tuple[float, dict]] = {}

        def reach(cost: float, node: dict | None, spelled: str) -> None:
            if node is not None and cost <= budget and cost < following.get((id(node), spelled), (budget + 1, None))[0]:
                following[(id(node), spelled)] = (cost, node)

        free = {_plain_char(ch): "lookalike", **dict.fromkeys(LOOKALIKES.get(ch, ""), "lookalike"), ch: "same"}
        for (_, spelled), (cost, node) in states.items():
            if ch in IGNORABLES:
                reach(cost + self.costs["ignorable"], node, spelled)
                continue
            for reading, kind in free.items():
                at: dict | None = node
                for c in reading:
                    at = at.get(c) if at else None
                if reading:
                    reach(cost + self.costs[kind], at, spelled + reading)
            if budget > cost:
                for c, at in node.items():
                    if c and c not in free:
                        kind = "case" if c.lower() == ch.lower() else "accent" if _bare(c) == _bare(ch) else "other"
                        reach(cost + self.costs[kind], at, spelled + c)
                reach(cost + self.costs["added"], node, spelled)
        return self._skipped(following, budget)

    def _skipped(self, states: dict, budget: float) -> dict:
        """States after letters of the vocabulary that the token drops."""
        queue = [item for item in states.items() if item[1][0] + self.costs["dropped"] <= budget]
        while queue:
            (_, spelled), (cost, node) = queue.pop()
            for c, at in node.items():
                key, price = (id(at), spelled + c), cost + self.costs["dropped"]
                if c and price <= budget and price < states.get(key, (budget + 1, None))[0]:
                    states[key] = (price, at)
                    queue.append((key, states[key]))
        return states

    def lookup(self, token: str, budget: float = BUDGET) -> str | None:
        """The cheapest spelling within the budget, the most frequent of equally cheap ones, or None.

        Combining marks are composed with their letter before the walk; letters whose marks
        only compose once ignorables are gone have a second chance.
        """
        for read in dict.fromkeys((unicodedata.normalize("NFC", token), unicodedata.normalize("NFC", "".join(c for c in token if c not in IGNORABLES)), plain_text(token) or "")):
            states = self._skipped({(id(self.root), ""): (0.0, self.root)}, budget)
            for ch in read:
                states = self._step(states, ch, budget)
                if not states:
                    break
            ends = [(cost, -node[""], spelled) for (_, spelled), (cost, node) in states.items() if "" in node]
            if ends:
                return min(ends)[2]
        return None


@lru_cache(maxsize=1)
def _unusual_chars() -> str:
    """Characters that have another plain form, derived from the whole Unicode database."""
    return "".join(c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and _plain_char(c) != c)


def is_unusual(col: Column) -> Column:
    """Whether a text holds a character with another plain form; a table look-up per character."""
    return (F.translate(col, _unusual_chars(), "") != col) | col.rlike(r"\p{M}")


def _tokens(col: Column) -> Column:
    """Tokens and the runs of separators between them, in order; together they are the text."""
    return F.regexp_extract_all(col, F.lit(rf"[^{_BREAK}]+|[{_BREAK}]+"), F.lit(0))


def spellings(vocabulary: DataFrame, buckets: int) -> DataFrame:
    """``token, canonical`` for each unusual token of ``vocabulary(token, n, unusual)``."""

    def bucket_of(tokens: pd.Series) -> pd.Series:
        return tokens.map(_coarse)

    coarse = F.pandas_udf(bucket_of, "string")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for token, n in zip(group.token[~group.unusual], group.n[~group.unusual]):
            trie.add(token, n)
        asked = group.token[group.unusual]
        return pd.DataFrame({"token": asked, "canonical": [trie.lookup(t) or plain_text(t) for t in asked]})

    return (
        vocabulary.withColumn("bucket", F.pmod(F.xxhash64(coarse("token")), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(walk, "token string, canonical string")
    )


#: Distinct tokens a task holds in its trie, on average.
BUCKET_TOKENS = 50_000


def canonical_texts(df: DataFrame, keys: list[str], text: str, buckets: int | None = None) -> DataFrame:
    """``keys, text, canonical``: each non-null text with the form it is compared in.

    ``keys`` must identify a row. Null texts give no row; empty texts stay empty. Rows
    without unusual characters are their own canonical form and are not shuffled.
    ``buckets`` is the number of tries; by default it follows the vocabulary, so that a task
    holds a bounded part of it.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("text"))
    plain = rows.where(~is_unusual(F.col("text")))
    odd = rows.where(is_unusual(F.col("text")))
    words = rows.select(F.explode(_tokens(F.col("text"))).alias("token"))
    vocabulary = checkpoint(words.groupBy("token").agg(F.count("*").alias("n")).withColumn("unusual", is_unusual(F.col("token"))))
    spelled = spellings(vocabulary, buckets or -(-vocabulary.count() // BUCKET_TOKENS) or 1)
    rebuilt = (
        odd.select(*keys, "text", F.posexplode(_tokens(F.col("text"))).alias("pos", "token"))
        .join(spelled, "token", "left")
        .groupBy(*keys, "text")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical", "token").alias("word")))).alias("words"))
        .select(*keys, "text", F.array_join("words.word", "").alias("canonical"))
    )
    return plain.withColumn("canonical", F.col("text")).unionByName(rebuilt)


def same_looking_classes(df: DataFrame, group: str, row_id: str, text: str, buckets: int | None = None) -> DataFrame:
    """``group, row_id, class_id, spelling_id, members``: rows whose class has several spellings.

    Rows of one class read the same; those of one spelling are equal in every character.
    Classes of one spelling are left out. Every row is told once, whatever its class's size.
    """
    forms = checkpoint(
        canonical_texts(df, [group, row_id], text, buckets)
        .select(group, row_id, F.base64(F.unhex(F.md5(F.concat_ws("\ue000", group, "canonical")))).alias("class_id"), F.base64(F.unhex(F.md5("text"))).alias("spelling_id"))
    )
    several = (
        forms.groupBy("class_id").agg(F.min("spelling_id").alias("lo"), F.max("spelling_id").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("class_id", "members")
    )
    return forms.join(several, "class_id").select(group, row_id, "class_id", "spelling_id", "members")


def same_looking_pairs(df: DataFrame, group: str, row_id: str, text: str, buckets: int | None = None, block: int = 1024) -> DataFrame:
    """Pairs of rows of one ``group`` that read the same but differ in their characters.

    Rows with equal characters are no pair. The members of a class are cut into blocks of
    about ``block`` rows on the one side and sent to every block on the other, so a class with
    a third of all rows is spread over many tasks.
    """
    told = checkpoint(same_looking_classes(df, group, row_id, text, buckets))
    blocks = F.ceil(F.col("members") / block).cast("int")
    a = told.select(F.col(group), F.col(row_id).alias("a_id"), "class_id", F.col("spelling_id").alias("a_s"), F.pmod(F.xxhash64(row_id), blocks).cast("int").alias("block"))
    b = told.select(F.col(row_id).alias("b_id"), "class_id", F.col("spelling_id").alias("b_s"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return a.join(b, ["class_id", "block"]).where("a_id < b_id AND a_s <> b_s").select(group, F.col("a_id").alias(f"{row_id}_a"), F.col("b_id").alias(f"{row_id}_b"))
