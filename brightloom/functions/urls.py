"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visitors.
TRACKING = r"(?i)^(?:utm_[^=]*|ref|source|ocid|output)(?:=|$)"
# end of fixed values


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def article_key(url: Column) -> Column:
    """One form for the links of one article: no www, trailing slash, fragment or tracking parameters."""
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    short = F.regexp_replace(path(url), r"/+$", "")
    base = F.concat(scheme(url), F.lit("://"), F.regexp_replace(host(url), r"^www\.", ""), F.when(short == "", F.lit("/")).otherwise(short))
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def asset_key(url: Column) -> Column:
    """One form for the links of one asset: escaped slashes and missing schemes mended, no fragment; the query stays."""
    u = F.replace(url, F.lit("\\/"), F.lit("/"))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    q = query(u)
    base = F.concat(scheme(u), F.lit("://"), host(u), path(u))
    return F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q))


def host_allowed(url: Column, allowed: Column) -> Column:
    """Whether a URL's host is one of an array of hosts or below one of them."""
    h = host(url)
    return (h != "") & F.coalesce(F.exists(allowed, lambda a: (a != "") & ((h == a) | h.endswith(F.concat(F.lit("."), a)))), F.lit(False))
