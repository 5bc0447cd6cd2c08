"""Addresses as column expressions of Spark: resolution against a page and its base, without fragments and with dots taken out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_url(url: Column) -> Column:
    """(scheme, host, path, query) of an address without its fragment; what isn't there is empty."""
    plain = F.regexp_replace(url, "#.*$", "")
    part = lambda i: F.regexp_extract(plain, r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?]*))?([^?]*)(\?.*)?$", i)
    return F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"), part(4).alias("query"))


def without_dots(path: Column) -> Column:
    """A path with "." left out and ".." with what stands before it; it keeps a slash at its end."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    dot = F.element_at(parts, -1).isin(".", "..")
    joined = F.array_join(kept, "/")
    return F.when(dot & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(base: Column, href: Column) -> Column:
    """A link as an absolute address: as it is with a scheme, else by the scheme, host, folder or page of the base. Fragments go, "./" and "../" are followed, spaces are encoded."""
    href = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    b, h = split_url(base), split_url(href)
    folder = F.regexp_replace(b["path"], "[^/]*$", "")
    path = F.when(h["host"] != "", h["path"]).when(h["path"] == "", b["path"]).when(h["path"].startswith("/"), h["path"]).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h["path"]))
    query = F.when((h["host"] == "") & (h["path"] == "") & (h["query"] == ""), b["query"]).otherwise(h["query"])
    full = F.concat(b["scheme"], F.lit("://"), F.when(h["host"] != "", h["host"]).otherwise(b["host"]), without_dots(path), query)
    return F.replace(F.when(h["scheme"] != "", F.regexp_replace(href, "#.*$", "")).otherwise(full), F.lit(" "), F.lit("%20"))


def base_of(url: Column, html: Column) -> Column:
    """What links of a page are resolved against: its base element, itself resolved, or its address."""
    base = F.regexp_extract(html, r"(?is)<base\s[^>]*href=[\"']([^\"']+)[\"']", 1)
    return F.when(base != "", resolve(url, base)).otherwise(url)
