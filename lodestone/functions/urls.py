"""Column functions over URLs; malformed input gives empty parts, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user information and port."""
    authority = F.regexp_extract(F.trim(url), AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def bare_host(url: Column) -> Column:
    """The host without a leading ``www.``."""
    return F.regexp_replace(host_of(url), "^www[.]", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[^?#]*[?]([^#]*)", 1)


def resolve(link: Column, base: Column) -> Column:
    """The address that a link on the page ``base`` leads to: absolute links as
    they are, others by scheme, host, query or folder; dot segments go."""
    link, base = F.trim(link), F.trim(base)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    joined = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path_of(base), link))
        .otherwise(F.concat(origin, F.coalesce(F.nullif(F.regexp_replace(path_of(base), "[^/]*$", ""), F.lit("")), F.lit("/")), link))
    )
    part = lambda i: F.regexp_extract(joined, "(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", i)
    # A closing dot segment stands for its folder, so a slash stays behind it.
    segments = F.split(F.regexp_replace(part(2), "/([.]{1,2})$", "/$1/"), "/")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.array_append(kept, x))
    walked = F.array_join(F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step), "/")
    return F.when(part(2).rlike("/[.]{1,2}(/|$)"), F.concat(part(1), walked, part(3))).otherwise(joined)


def page_key(url: Column) -> Column:
    """One key for all spellings of a page: bare host, path without the closing
    slash, the query if any; lower case, no scheme, no fragment."""
    query = query_of(url)
    return F.lower(F.concat(
        bare_host(url), F.regexp_replace(path_of(url), "/+$", ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    ))


def fetch_url(url: Column) -> Column:
    """What a fetcher asks for: trimmed, without fragment, over https."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^http:", "https:")


def queue_key(url: Column, root: str) -> Column:
    """Queue identity: a bare root host gets ``www.``, closing slashes go."""
    return F.regexp_replace(F.regexp_replace(fetch_url(url), f"^https://{root.replace('.', '[.]')}", f"https://www.{root}"), "/+$", "")


def under(host: Column, root: str) -> Column:
    """Whether the host is the root or lies below it."""
    return (host == root) | host.endswith("." + root)


def source_kind(host: Column, root: str, news: str) -> Column:
    """official below the root, external for news hosts, affiliated otherwise."""
    return F.when(under(host, root), "official").when(host.rlike(news), "external").otherwise("affiliated")


def page_id(url: Column) -> Column:
    return F.sha1(url)
