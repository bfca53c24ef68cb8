"""URL expressions; malformed and null URLs give null or false, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def canonical_url(url: Column) -> Column:
    """Always https, lower-case authority with its port, path and query kept, fragment dropped."""
    query = _part(url, "QUERY")
    return F.concat(
        F.lit("https://"), F.lower(_part(url, "AUTHORITY")), F.coalesce(_part(url, "PATH"), F.lit("")),
        F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""),
    )


def host_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """Scheme http or https and a host on the list."""
    scheme, host = F.lower(_part(url, "PROTOCOL")), F.lower(_part(url, "HOST"))
    return F.coalesce(scheme.isin("http", "https") & host.isin(*hosts), F.lit(False))


def id_from_path(path: Column) -> Column:
    """The digits a file is named by; null where the stem is not all digits."""
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    return F.when(stem.rlike("^[0-9]+$"), stem)
