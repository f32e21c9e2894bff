"""Urls, ids and file names as column functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a link to follow must not contain.
SKIPPED_LINKS = ("#", ".pdf", ".zip", "mailto:", "javascript:")


def file_id(url: Column) -> Column:
    """The first eight hex digits of the MD5."""
    return F.substring(F.md5(url), 1, 8)


def section(url: Column) -> Column:
    """The first component of the path; empty for the root."""
    path = F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    return F.split_part(F.trim(path, F.lit("/")), F.lit("/"), F.lit(1))


def safe_file_name(name: Column, longest: int = 100) -> Column:
    """Letters, digits, spaces, underscores and hyphens of a name, trimmed and cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""), "^ +| +$", ""), 1, longest)


def numbered_file_name(number: Column, title: Column) -> Column:
    return F.format_string("%03d_%s.txt", number.cast("int"), safe_file_name(title))


def video_id(url: Column) -> Column:
    """The id in a watch, shorts or short-host url, or a bare id of eleven characters; else null."""
    u = F.regexp_replace(url, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    some = lambda c: F.when(c != "", c)
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    watched = F.try_url_decode(some(F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)))
    bare = F.when(u.rlike(r"^[A-Za-z0-9_-]{11}$"), u)
    long_host = F.when(path.contains("watch"), watched).when(path.contains("shorts"), F.regexp_extract(path, "([^/]*)$", 1)).otherwise(bare)
    return F.when(url.isNull() | (url == ""), None).when(rest.contains("youtube.com"), long_host).when(rest.contains("youtu.be"), F.regexp_replace(path, "^/+", "")).otherwise(bare)


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return None if b is None or h is None else urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def absolute_url(base: Column, href: Column) -> Column:
    """A reference against its page's url (RFC 3986). Absolute ones and plain absolute paths stay in the JVM."""
    whole = href.rlike(r"^https?://[^/?#]+(/(?!.*\.\.?(/|$))[^?#]*)?([?#].*)?$")
    rooted = href.rlike(r"^/(?!/)(?!.*(^|/)\.\.?(/|$|\?|#))")
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    easy = F.when(whole, href).when(rooted & (host != ""), F.concat(host, href))
    return F.coalesce(easy, _joined(base, F.when(easy.isNull(), href)))


def is_followed(url: Column, base: str) -> Column:
    """A link to crawl: holds base, and nothing that marks files, anchors or other schemes."""
    low = F.lower(url)
    skip = [low.contains(x) for x in SKIPPED_LINKS]
    out = url.contains(base)
    for s in skip:
        out = out & ~s
    return out
