"""Mixing sources to target weights by token count.

Targets are a tree (language below source, source below domain, or any other nesting). The
token budget is handed down the tree: each child gets its weight's share; what a child
cannot fill within its capped repeats is handed to its siblings first and to its ancestors'
siblings only then. A leaf fills its budget from seeded epochs: in every epoch its documents
are put in a pseudo-random order and a prefix of their running token count is taken, so no
document is used twice before all are used once.

Token counts come from a public vocabulary file, given by path; the counts of all
documents are exact and computed where the documents are.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wareloom.functions.text import is_blank
from wareloom.session import checkpoint, spread

#: Folder and file of the public vocabulary that counts tokens, unless a path is given.
TOKENIZER_FOLDER, TOKENIZER_FILE = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
SEED = 20240229
#: Most sources a target table may have; it is read to the driver.
MAX_SOURCES = 10_000


@dataclass
class Node:
    """A target: ``weight`` among its siblings, ``capacity`` in tokens for a leaf."""

    name: str
    weight: float
    capacity: float = 0.0
    children: list["Node"] = field(default_factory=list)

    def room(self) -> float:
        """Tokens that can be placed below; a child without weight is given none."""
        return sum(c.room() for c in self.children if c.weight > 0) if self.children else self.capacity


def hand_down(node: Node, budget: float) -> dict[str, float]:
    """Budgets of the leaves below ``node``; siblings share what one of them cannot fill."""
    if not node.children:
        return {node.name: min(budget, node.capacity)}
    given = {id(c): 0.0 for c in node.children}
    open_children, left = [c for c in node.children if c.weight > 0], min(budget, node.room())
    while open_children and left > 1e-9:
        weight = sum(c.weight for c in open_children)
        full, spent = [], 0.0
        for child in open_children:
            share = left * child.weight / weight
            free = child.room() - given[id(child)]
            if share >= free:
                full.append(child)
                given[id(child)] = child.room()
            else:
                given[id(child)] += share
            spent += min(share, free)
        left -= spent
        if not full:
            break
        open_children = [c for c in open_children if c not in full]
    budgets: dict[str, float] = {}
    for child in node.children:
        for name, tokens in hand_down(child, given[id(child)]).items():
            budgets[name] = budgets.get(name, 0.0) + tokens
    return budgets


def wanted_tokens(node: Node, budget: float) -> dict[str, float]:
    """The leaves' shares of ``budget`` by weight alone, whatever they can fill."""
    if not node.children:
        return {node.name: budget}
    total = sum(c.weight for c in node.children if c.weight > 0) or 1.0
    shares: dict[str, float] = {}
    for child in node.children:
        for name, tokens in wanted_tokens(child, budget * max(child.weight, 0.0) / total).items():
            shares[name] = shares.get(name, 0.0) + tokens
    return shares


def largest_total(node: Node) -> float:
    """The largest budget at which every leaf that has anything gets its target share.

    A leaf without tokens meets its share at no budget; it is left to ``hand_down``.
    """
    def scale(at: Node, share: float) -> float:
        if not at.children:
            return at.capacity / share if share > 0 else math.inf
        filled = [c for c in at.children if c.weight > 0 and c.room() > 0]
        total = sum(c.weight for c in filled) or 1.0
        return min((scale(c, share * c.weight / total) for c in filled), default=math.inf)

    best = scale(node, 1.0)
    return 0.0 if math.isinf(best) else best


def with_token_counts(docs: DataFrame, tokenizer_file: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the token count of every text by a public vocabulary file; null texts count null.

    The file (about a megabyte, whatever the data) is read on the driver and sent along.
    """
    with open(tokenizer_file, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    name = os.path.basename(tokenizer_file)

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = token_counter(name, vocabulary.value)
        for texts in batches:
            yield pd.Series([None if t is None else count(t) for t in texts], dtype="Int64")

    counts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(counts, "long")(F.col(text)))


def token_counter(name: str, vocabulary: bytes):
    """A function from text to its number of tokens, by the kind of vocabulary file."""
    if name.endswith(".tiktoken"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if name.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        return lambda text: len(processor.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(vocabulary)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _running(df: DataFrame, bins: int = 4096) -> DataFrame:
    """``upto``: running token count within (leaf, epoch) in the seeded order.

    The order is cut into bins of equal hash range; a leaf's running count is the sum of its
    earlier bins plus the running count inside the bin, so a leaf with a third of all rows
    is spread over all bins.
    """
    binned = df.withColumn("bin", F.shiftrightunsigned("place", 64 - int(math.log2(bins))).cast("int"))
    keys = ["source", "leaf", "epoch"]
    before = (
        binned.groupBy(*keys, "bin").agg(F.sum("n_tokens").alias("s"))
        .withColumn("before", F.coalesce(F.sum("s").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("s")
    )
    inside = F.sum("n_tokens").over(W.partitionBy(*keys, "bin").orderBy(F.shiftrightunsigned("place", 1), "doc_id"))
    return binned.withColumn("inside", inside).join(before, [*keys, "bin"]).withColumn("upto", F.col("before") + F.col("inside")).drop("bin", "inside", "before")


def build_tree(leaves: list[tuple[tuple[str, ...], float, float]], domains: dict[str, float]) -> Node:
    """A tree from ``(path, weight, capacity)`` of its leaves; ``path`` starts with the domain.

    ``domains`` are the weights of the first level. Below it a node weighs what its leaves
    weigh together, so without any shortage every leaf gets its own weight's share.
    """
    top = Node("", 1.0)
    at: dict[tuple[str, ...], Node] = {(): top}
    for path, weight, capacity in sorted(leaves):
        for depth in range(1, len(path) + 1):
            key = path[:depth]
            if key not in at:
                at[key] = Node("/".join(key), 0.0)
                at[key[:-1]].children.append(at[key])
            at[key].weight += max(weight, 0.0)
        at[path].capacity += capacity
    for child in top.children:
        child.weight = domains.get(child.name, child.weight)
    return top


def mix_tree(docs: DataFrame, targets: DataFrame, tokenizer_file: str, total_tokens: float | None = None, seed: int = SEED,
             domain_of: dict[str, str] | None = None, levels: tuple[str, ...] = (), all_usable: bool = False,
             times: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selection, report by source and report by node of the tree.

    ``docs``: ``doc_id, source, text`` and the columns named by ``levels``; ``targets``:
    ``source, target_share, max_repeats``. The tree has a domain (``domain_of`` a source,
    else the source itself), the ``levels`` (the language, say), and the source as leaf. A
    source's target is parted among its leaves by the tokens they have, so all its leaves run
    short together or not at all; what a leaf cannot fill goes to its siblings (other sources
    of the same domain and language) first, then to other languages of the domain, then to
    other domains. ``total_tokens`` is the budget; with ``all_usable`` it is ``times`` as many
    tokens as the documents of all targets have, with neither the largest total at which the shares
    of all sources that have documents are met. Documents without source or text, or of a
    source without target, stay out; a null level is a level of its own.

    Selection: ``doc_id, source, epoch, n_tokens``. Report: per target ``source,
    target_share, actual_share, target_tokens, budget_tokens, selected_tokens,
    shortage_tokens, available_tokens, max_repeats, max_use, tokenizer``; the shortage is
    what the source cannot fill of its target, ``budget_tokens`` what it was given with the
    shortages of others. By node: ``path, level, weight, target_tokens, budget_tokens,
    capacity_tokens, selected_tokens``. Targets are a small declared table (one row a source,
    checked), so the leaves and their token counts are read to the driver.
    """
    spark = docs.sparkSession
    usable = spread(docs.select("doc_id", "source", "text", *levels).where(F.col("source").isNotNull() & ~is_blank(F.col("text"))))
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    usable = usable.join(F.broadcast(wanted.select("source")), "source", "left_semi")
    place = F.concat_ws("/", *[F.coalesce(F.lower(F.trim(level)), F.lit("unknown")) for level in levels], "source")
    counted = checkpoint(with_token_counts(usable, tokenizer_file).select("doc_id", "source", place.alias("leaf"), "n_tokens"))
    have = {(r["source"], r["leaf"]): r["tokens"] or 0 for r in counted.groupBy("source", "leaf").agg(F.sum("n_tokens").alias("tokens")).collect()}
    of_source: dict[str, int] = {}
    for (source, _), tokens in have.items():
        of_source[source] = of_source.get(source, 0) + tokens
    domain_of = domain_of or {}
    leaves, source_of, repeats = [], {}, {}
    for r in rows:
        source, share, uses = r["source"], float(r["target_share"] or 0), max(0, r["max_repeats"])
        total = of_source.get(source, 0)
        own = [(leaf, tokens) for (s, leaf), tokens in have.items() if s == source] if total else [("/".join(["unknown"] * len(levels) + [source]), 0)]
        for leaf, tokens in own:
            path = (domain_of.get(source, source), *leaf.split("/", len(levels)))
            leaves.append((path, share * (tokens / total if total else 1.0), float(tokens * uses)))
            source_of["/".join(path)], repeats["/".join(path)] = source, (uses, tokens)
    top = build_tree(leaves, {})
    if total_tokens is not None:
        budget = float(total_tokens)
    elif all_usable:
        budget = times * float(sum(of_source.get(r["source"], 0) for r in rows if (r["target_share"] or 0) > 0 and r["max_repeats"] > 0))
    else:
        budget = largest_total(top)
    budgets, shares = hand_down(top, budget), wanted_tokens(top, budget)
    plan = [(source, path.split("/", 1)[1], float(budgets.get(path, 0.0)), *map(int, repeats[path])) for path, source in source_of.items()]
    schema = "source string, leaf string, budget double, max_repeats int, available long"
    cells = spark.createDataFrame(plan, T._parse_datatype_string(schema))
    epochs = F.least("max_repeats", F.ceil(F.col("budget") / F.greatest(F.col("available"), F.lit(1))).cast("int"))
    drawn = (
        counted.join(F.broadcast(cells.where("budget > 0 AND available > 0").withColumn("epochs", epochs)), ["source", "leaf"])
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest("epochs", F.lit(1)))))
        .withColumn("place", F.xxhash64(F.lit(seed), "epoch", "source", "doc_id"))
    )
    # whole epochs need no order; only the last, partial one is cut at a prefix
    left = F.col("budget") - (F.col("epoch") - 1) * F.col("available")
    ranked = _running(drawn.withColumn("left", left).select("doc_id", "source", "leaf", "epoch", "n_tokens", "left", "place"))
    chosen = ranked.where("upto - n_tokens / 2.0 <= left").select("doc_id", "source", "leaf", "epoch", "n_tokens")
    used = chosen.groupBy("source", "leaf", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
    per_leaf = used.groupBy("source", "leaf").agg(F.sum("t").alias("selected_tokens"), F.max("uses").alias("max_use"))
    sums = [
        (r["source"], float(r["target_share"] or 0), float(sum(shares.get(p, 0.0) for p, s in source_of.items() if s == r["source"])),
         float(sum(budgets.get(p, 0.0) for p, s in source_of.items() if s == r["source"])), int(r["max_repeats"]), int(of_source.get(r["source"], 0)))
        for r in rows
    ]
    sources = spark.createDataFrame(sums, T._parse_datatype_string("source string, target_share double, target_tokens double, budget_tokens double, max_repeats int, available long"))
    per_source = per_leaf.groupBy("source").agg(F.sum("selected_tokens").alias("selected_tokens"), F.max("max_use").alias("max_use"))
    filled = sources.join(per_source, "source", "left").fillna({"selected_tokens": 0, "max_use": 0})
    report = filled.withColumn("all_tokens", F.sum("selected_tokens").over(W.partitionBy(F.lit(1)))).select(
        "source", "target_share",
        F.when(F.col("all_tokens") > 0, F.col("selected_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
        F.round("target_tokens").cast("long").alias("target_tokens"), F.round("budget_tokens").cast("long").alias("budget_tokens"), "selected_tokens",
        F.round(F.greatest(F.lit(0.0), F.col("target_tokens") - F.col("available") * F.greatest("max_repeats", F.lit(0)))).cast("long").alias("shortage_tokens"),
        F.col("available").alias("available_tokens"), "max_repeats", "max_use",
        F.lit(os.path.basename(tokenizer_file)).alias("tokenizer"),
    )
    flat = [(path, float(node.weight), float(node.capacity)) for path, node in _walk(top) if not node.children]
    down = [(path, "/".join(path.split("/")[: i + 1]), i + 1, w, float(shares.get(path, 0.0)), float(budgets.get(path, 0.0)), c)
            for path, w, c in flat for i in range(path.count("/") + 1)]
    every = spark.createDataFrame(down, T._parse_datatype_string("full string, path string, level int, weight double, target double, budget double, capacity double"))
    names = F.substring_index("full", "/", -len(levels) - 1).alias("leaf")
    by_node = (
        every.select("*", names).join(per_leaf.groupBy("leaf").agg(F.sum("selected_tokens").alias("t")), "leaf", "left").groupBy("path", "level").agg(
            F.sum("weight").alias("weight"), F.round(F.sum("target")).cast("long").alias("target_tokens"), F.round(F.sum("budget")).cast("long").alias("budget_tokens"),
            F.round(F.sum("capacity")).cast("long").alias("capacity_tokens"), F.coalesce(F.sum("t"), F.lit(0)).alias("selected_tokens"))
    )
    return chosen.drop("leaf"), report, by_node


def mix(docs: DataFrame, targets: DataFrame, tokenizer_file: str, **options) -> tuple[DataFrame, DataFrame]:
    """Selection and report by source; ``options`` as in ``mix_tree``."""
    return mix_tree(docs, targets, tokenizer_file, **options)[:2]


def _walk(node: Node) -> list[tuple[str, Node]]:
    return [(c.name, c) for c in node.children] + [pair for c in node.children for pair in _walk(c)]
