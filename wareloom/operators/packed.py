"""Several values packed in one field: split them to one row per value, position kept.

The field is split on its quote characters: odd pieces are literals and stay whole, even
pieces are split on delimiters. Arrays of pieces are then folded back into entries, so
that a delimiter inside quotes, brackets or a value never starts an entry. Everything is
built from SQL array functions; there is no Python and no shuffle, the work is linear in
the length of a field and a row is independent of every other row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions.text import BLANK_CLASS, trim_blanks

#: Opening and closing quote characters (fixed values).
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"))
#: Field names whose own spelling holds a delimiter, by the schema of the audit table.
COMPOUND_NAMES = ("电压/频率", "认证|备案号", "档位;模式")

_LIT = "\ue000"  # around a literal piece
_CUT = "\ue001"  # before an entry
_SEP = "\ue002"  # after a delimiter
_PAIR_DELIMS = r"\|\||[;；,，、|\t\n\r]|(?<![^ ])/(?![^ ])"
_LIST_DELIMS = r"[;；,，、|/\t\n\r]"
_PAIR_SEPS = r"::|[:：=]"


def _lit(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _mark_quotes(col: Column, before: str, after: str) -> Column:
    """Put marks round each quoted piece that stands where a whole value may stand.

    A quote inside a value, such as an inch mark, is no quote. The opening quote stays as
    the first character of the literal so that doubled quotes can be undone later.
    """
    for opening, closing in QUOTES:
        body = rf"[^{closing}]*+"
        if opening == closing:
            body += rf"(?:{closing}{closing}[^{closing}]*+)*+"
        pattern = rf"({before})([{BLANK_CLASS}]*){opening}({body}){closing}(?=[{BLANK_CLASS}]*(?:{after}))"
        col = F.regexp_replace(col, pattern, rf"$1$2{_LIT}{opening}$3{_LIT}")
    return col


def _unquote(piece: Column) -> Column:
    """The text of a literal piece: its first character is its quote; doubled quotes are undone."""
    quote, body = F.substring(piece, 1, 1), F.substring(piece, F.lit(2), F.length(piece))
    return F.when(quote.isin('"', "'"), F.replace(body, F.concat(quote, quote), quote)).otherwise(body)


def _unwrap(col: Column) -> Column:
    """A field that is quoted as a whole, as in a CSV file, loses that quoting."""
    text = trim_blanks(col)
    whole = text.rlike(rf'(?s)^"[^"]*?(?:{_PAIR_SEPS}).*"$') & ~text.rlike(r'^"(?:""|[^"])*"[^"]')
    inner = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
    return F.when(whole, inner).otherwise(text)


def _fold_pairs(text: Column, delims: str, seps: str, loose: bool) -> Column:
    """Split one field into ``array<struct<name, value>>`` of its complete entries.

    ``loose``: a piece without a separator belongs to the value before it, together with
    its delimiter. Otherwise it is an incomplete entry.
    """
    marked = _mark_quotes(text, rf"(?:{seps})", rf"$|{delims}")
    pieces = F.split(marked, _LIT)
    start = rf"^[{BLANK_CLASS}]*(?:(?:[^:：=]*?\p{{L}}[^:：=]*?)?)[{BLANK_CLASS}]*(?:{seps})"

    def even(piece: Column) -> Column:
        tokens = F.split(F.regexp_replace(piece, rf"({delims})", rf"{_CUT}$1{_SEP}"), _CUT)

        def fold(token: Column, at: Column) -> Column:
            delim = F.when(at == 0, F.lit("")).otherwise(F.substring_index(token, _SEP, 1))
            body = F.when(at == 0, token).otherwise(F.substring_index(token, _SEP, -1))
            if not loose:
                return F.when(at == 0, body).otherwise(F.concat(F.lit(_CUT), body))
            blank = F.regexp_replace(body, rf"[{BLANK_CLASS}]+", "") == ""
            return (
                F.when(at == 0, body)
                .when(body.rlike(start), F.concat(F.lit(_CUT), body))
                .when(blank, F.concat(F.lit(_CUT), body))
                .otherwise(F.concat(delim, body))
            )

        return F.array_join(F.transform(tokens, fold), "")

    joined = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(_LIT), p, F.lit(_LIT))).otherwise(even(p))), ""
    )

    def entry(token: Column) -> Column:
        name = trim_blanks(F.regexp_extract(token, rf"(?s)^(.*?)(?:{seps})", 1))
        value = trim_blanks(F.regexp_extract(token, rf"(?s)^.*?(?:{seps})(.*)$", 1))
        literal = value.startswith(_LIT)
        plain = F.when(literal, trim_blanks(_unquote(F.replace(value, F.lit(_LIT), F.lit(""))))).otherwise(value)
        return F.struct(name.alias("name"), plain.alias("value"))

    return F.filter(F.transform(F.split(joined, _CUT), entry), lambda e: (e["name"] != "") & (e["value"] != ""))


def packed_pairs(col: Column) -> Column:
    """Complete name/value entries of a packed attribute field, in the field's order.

    Null, blank and unparsable fields give an empty array. Two packings are told apart per
    field: the ``#;#`` / ``#:#`` one, whose values may hold any delimiter, and the free one.
    """
    text = _unwrap(col)
    tagged = _fold_pairs(text, "#;#", "#:#", loose=False)
    free = _fold_pairs(text, _PAIR_DELIMS, _PAIR_SEPS, loose=True)
    empty = F.array().cast("array<struct<name:string,value:string>>")
    return F.coalesce(F.when(text.contains("#:#"), tagged).otherwise(free), empty)


def packed_list(col: Column, compounds: Sequence[str] = COMPOUND_NAMES) -> Column:
    """Values of a packed list field, in the field's order.

    Quoted pieces, pieces with round brackets and the declared compound names stay whole.
    """
    text = trim_blanks(col)
    text = F.when(text.rlike(r"(?s)^\[.*\]$"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    text = _mark_quotes(text, rf"^|{_LIST_DELIMS}", rf"$|{_LIST_DELIMS}")
    outside = rf"(?=(?:[^{_LIT}]*{_LIT}[^{_LIT}]*{_LIT})*[^{_LIT}]*$)"
    name = r"[^;；,，、|/\t\n\r()（）" + _LIT + "]*"
    text = F.regexp_replace(text, rf"({name}[(（][^()（）{_LIT}]*[)）]{name}){outside}", rf"{_LIT}　$1{_LIT}")
    for compound in compounds:
        quoted = "".join(f"\\{c}" if c in "|/;()[].*+?^$\\" else c for c in compound)
        text = F.regexp_replace(text, rf"{quoted}{outside}", rf"{_LIT}　{_lit(compound)}{_LIT}")
    pieces = F.split(text, _LIT)
    values = F.flatten(
        F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, F.array(_unquote(p))).otherwise(F.split(p, _LIST_DELIMS)),
        )
    )
    kept = F.filter(F.transform(values, trim_blanks), lambda v: v != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def explode_packed(df: DataFrame, key: str, pairs: Column) -> DataFrame:
    """One row per entry: ``key, pos, item_name, item_value``; fields without entries give none."""
    return df.select(F.col(key), F.posexplode(pairs).alias("at", "e")).select(
        F.col(key),
        (F.col("at") + 1).cast("long").alias("pos"),
        F.col("e.name").alias("item_name"),
        F.col("e.value").alias("item_value"),
    )


def packed_items(pv_parser: DataFrame, rag: DataFrame) -> DataFrame:
    """The entries of both packed fields of the catalogue in one table.

    Every row is independent: repeated rows all count, nulls and blanks give no row, and
    other columns of the inputs are ignored whatever their names.
    """
    pairs = explode_packed(pv_parser.select("row_id", "attributes"), "row_id", packed_pairs(F.col("attributes")))
    names = F.transform(
        packed_list(F.col("blocked_fields")),
        lambda v: F.struct(F.lit("blocked_field").alias("name"), v.alias("value")),
    )
    fields = explode_packed(rag.select("row_id", "blocked_fields"), "row_id", names)
    out = ["record_source", "row_id", "pos", "item_name", "item_value"]
    return (
        pairs.withColumn("record_source", F.lit("pv_parser")).select(*out)
        .unionByName(fields.withColumn("record_source", F.lit("rag")).select(*out))
    )
