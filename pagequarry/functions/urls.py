"""URL functions: normal form, hash, host, path, first directory, parameters, scope."""

from __future__ import annotations

import fnmatch
import re
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a path that stay as they are.
_SAFE = "/:@!$&'()*+,;=-._~"


def normalise(url: str | None, base: str | None = None) -> str | None:
    """The form under which URLs are compared: absolute, http(s), scheme and host in lower case, no escapes in the host, no fragment, canonical escapes.

    None for null, blank or other schemes.
    """
    if not url or not url.strip():
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not parts.netloc:
        return None
    return urlunsplit((parts.scheme.lower(), unquote(parts.netloc).lower(), quote(unquote(parts.path or "/"), safe=_SAFE), parts.query, ""))


@F.pandas_udf(T.StringType())
def normalise_url(urls: pd.Series) -> pd.Series:
    return urls.map(normalise, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def resolve_url(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([normalise(u, b) for u, b in zip(urls, bases, strict=True)], dtype=object)


def url_hash(url: Column) -> Column:
    """MD5 of the normal form, 16 bytes."""
    return F.unhex(F.md5(url))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segment(url: Column) -> Column:
    """The first directory of the path as '/name/', '/' where there is none."""
    first = F.regexp_extract(path(url), r"^/([^/]+)/", 1)
    return F.when(first != "", F.concat(F.lit("/"), first, F.lit("/"))).otherwise(F.lit("/"))


def in_scope(url: Column, base_host: str, cdn_hosts: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Same host, a subdomain or a CDN host; an exclude glob bars, include globs (any) are needed if given.

    Globs may start anywhere and must match to the end.
    """
    h = host(url)
    base = base_host.lower()
    inside = (h == base) | h.endswith("." + base) | h.isin([c.lower() for c in cdn_hosts])
    glob = lambda g: url.rlike(re.sub(r"\(\?s:(.*)\)\\[zZ]", r"(?s:\1)\\z", fnmatch.translate(g)))
    for g in exclude:
        inside = inside & ~glob(g)
    if include:
        wanted = F.lit(False)
        for g in include:
            wanted = wanted | glob(g)
        inside = inside & wanted
    return inside


def rewrite(url: Column, rules: list[tuple[str, str]] = (), strip: list[str] = ()) -> Column:
    """Removes query parameters by name, then applies (pattern, replacement) rules in order; an address without such a parameter keeps its spelling."""
    if strip:
        names = "|".join(re.escape(n) for n in strip)
        cut = F.regexp_replace(url, f"([?&])(?:{names})(?:=[^&#]*)?(?=[&#]|$)", "$1")
        url = F.when(cut == url, url).otherwise(F.regexp_replace(F.regexp_replace(cut, "([?&])&+", "$1"), "[?&]+(?=#|$)", ""))
    for pattern, replacement in rules:
        url = F.regexp_replace(url, pattern, replacement)
    return url
