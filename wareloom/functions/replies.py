"""Reading model replies: JSON objects in prose, lists of points, figures with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLY_SCHEMA = "struct<generated_title:string,selling_points:array<string>,short_description:string>"
_FIGURE = r"[0-9]+(?:\.[0-9]+)?(?:mAh|ml|kW|W|kg|GB|TB|cm|mm|g|L|m|瓦|克|千克|斤|毫升|升|毫安时|毫安|厘米|米)"


def json_object(reply: Column) -> Column:
    """The text from the first opening to the last closing brace; code fences fall away."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def reply_status(reply: Column, points: int = 3) -> Column:
    """``ok`` or the first thing wrong: no object, not JSON, a missing field, the wrong number of points."""
    body = F.from_json(json_object(reply), REPLY_SCHEMA, {"mode": "PERMISSIVE"})
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    sound_points = F.filter(body["selling_points"], lambda p: ~blank(p))
    return (
        F.when(json_object(reply).isNull(), "no_object")
        .when(F.get_json_object(json_object(reply), "$").isNull(), "not_json")
        .when(blank(body["generated_title"]) | blank(body["short_description"]) | body["selling_points"].isNull(), "missing_field")
        .when((F.size(sound_points) != points) | (F.size(body["selling_points"]) != points), "wrong_points")
        .otherwise("ok")
    )


def listed_points(reply: Column) -> Column:
    """Points of a JSON array, or of bulleted or numbered lines."""
    text = F.trim(reply)
    parsed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*(?:[-*·•]|[0-9]+[.、)])[ \t]*", "")))
    return F.coalesce(parsed, F.filter(lines, lambda x: x != ""))


def figures(text: Column) -> Column:
    """Distinct figures with their units, lower case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_FIGURE), F.lit(0)), lambda x: F.lower(x)))


FIGURE_PATTERN = _FIGURE
