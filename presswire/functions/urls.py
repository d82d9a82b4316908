"""URL parts by pattern; tolerant of the malformed links the feeds carry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def host(url: Column) -> Column:
    """Network location, empty when the URL has none."""
    return F.regexp_extract(_tidy(url), rf"^{_SCHEME}//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without query, fragment or the parameters of its last segment.

    An unbalanced bracket in the host makes the URL invalid: NULL.
    """
    whole = F.regexp_extract(_tidy(url), rf"^{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    bad_host = host(url).contains("[") != host(url).contains("]")
    return F.when(~bad_host, F.regexp_replace(whole, r";[^/]*$", ""))


def percent_decode(text: Column) -> Column:
    """Decode %XX as UTF-8; `+` and stray `%` stay as they are."""
    escaped = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(escaped)
