"""Queries over pages and events as crawl and fetch log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import windows as W
from ..sources import files
from ..sources.shared import cut
from ..sources.tables import table

ROOT, NEWS = "example.com", "news|press"
HREF = r"""href=["']([^"'#]+)"""
ROBOTS = """User-agent: other
Disallow: /

User-agent: *
Disallow: /en/*5$  # comments go
Allow: /en/*05$
Disallow: /fr/
Allow: /fr/8
Disallow: /de/?
Crawl-delay: 5
"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.page_key(F.col("url")).alias("page_key"), U.fetch_url(F.col("url")).alias("fetch_url"),
                                           U.queue_key(F.col("url"), ROOT).alias("queue_key"), U.page_id(F.col("url")).alias("sha_id"))


def source_kinds(spark, d):
    host = U.bare_host(F.col("url"))
    return table(spark, d, "pages").groupBy(U.source_kind(host, ROOT, NEWS).alias("source_kind")).agg(
        F.count(F.lit(1)).alias("pages"), F.countDistinct(host).alias("hosts"))


def title_parse(spark, d):
    title = F.trim(F.regexp_extract("html", TITLE, 1))
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.length("html").cast("long").alias("n_html"))


def page_links(spark, d):
    """Links of every page, resolved against its address."""
    links = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    return links.select("page_id", "url", U.resolve(F.col("href"), F.col("url")).alias("link"))


def href_hosts(spark, d):
    links = page_links(spark, d)
    return links.withColumn("host", U.host_of(F.col("link"))).groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"))


def site_groups(spark, d):
    """Pages of one bare host: its spellings and the page with the most bytes."""
    pages = table(spark, d, "pages").withColumn("size", F.length("html"))
    return pages.groupBy(U.bare_host(F.col("url")).alias("site")).agg(
        F.max_by("page_id", F.struct("size", -F.col("page_id"))).alias("largest_page"),
        F.array_join(F.array_sort(F.collect_set(U.host_of(F.col("url")))), ",").alias("aliases"), F.count(F.lit(1)).alias("pages"))


def url_score(spark, d):
    """Weighted pattern counts less a penalty for depth, capped by host."""
    path = U.path_of(F.col("url"))
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    score = 3 * F.regexp_count("url", F.lit("about|research|course")) + F.regexp_count("url", F.lit("[0-9]")) - depth
    pages = table(spark, d, "pages").select("page_id", U.bare_host(F.col("url")).alias("host"), score.cast("long").alias("score"))
    return W.cap_per_key(pages, "host", [F.desc("score"), F.col("page_id")], 3).select("page_id", "host", "score", F.col("place").cast("long").alias("place"))


def robots_allowed(spark, d):
    """Every host has the same file; the longest matching rule of the group for
    all agents decides, an allow wins a tie, no rule allows."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("url"), U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"))
    rules = files.robots_rules(pages.select("host", F.lit(ROBOTS).alias("body")).distinct())
    return files.allowed(pages, rules).select(F.col("url").alias("page_id"), "allowed")


def active_minutes(spark, d):
    return W.active_minutes(table(spark, d, "events"), "user_id", "ts")


def fetch_status_rollup(spark, d):
    """Counts and medians by status with a grand total, and JSON credits."""
    log = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return log.rollup("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 6).alias("median_value"), F.sum("k").alias("sum_k"),
        F.countDistinct("user_id").alias("hosts")).withColumn("event_type", F.coalesce("event_type", F.lit("All")))


def peak_cost(spark, d):
    """Token cost at peak and off-peak rates: a join with the rate table."""
    rates = spark.createDataFrame([(True, 2.0), (False, 1.0)], "peak boolean, rate double")
    log = table(spark, d, "events").withColumn("peak", (F.dayofweek("ts").between(2, 6)) & (F.hour("ts").between(8, 17)))
    return log.join(F.broadcast(rates), "peak").groupBy("event_type", "peak").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value") * F.col("rate")) / 1e6, 9).alias("cost"))


def pacing(spark, d):
    out = W.pacing(table(spark, d, "events"), "user_id", [F.desc("value"), F.col("event_id")], 10)
    return out.select("event_id", "user_id", "start_s")


def session_gaps(spark, d):
    """Sessions of a user closed by ten idle minutes (an analogue on the log)."""
    log = table(spark, d, "events")
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(line)
    fresh = log.withColumn("fresh", F.coalesce((gap > 600_000_000).cast("int"), F.lit(1)))
    return fresh.withColumn("session", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def first_seen_urls(spark, d):
    """Pages and their links as one candidate pool, each address at its first source."""
    pages = table(spark, d, "pages")
    own = pages.select(U.page_key(F.col("url")).alias("key"), F.lit("page").alias("src"), "page_id")
    links = page_links(spark, d).select(U.page_key(F.col("link")).alias("key"), F.lit("link").alias("src"), "page_id")
    return own.unionByName(links).filter(F.col("key") != "").groupBy("key").agg(
        F.min("page_id").alias("first_page"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("srcs"), F.count(F.lit(1)).alias("n"))


def harvest_frontier(spark, d):
    """What up to three rounds of links reach beyond the pages known before, each
    address in the round that found it."""
    links = page_links(spark, d).select(U.page_key(F.col("url")).alias("parent"), U.page_key(F.col("link")).alias("child")).filter(F.col("child") != "")
    links = cut(links.distinct(), "links")  # every round joins them
    known = table(spark, d, "pages").select(U.page_key(F.col("url")).alias("url")).distinct()
    found = files.expand_sitemaps(links, known, 3)
    return found.filter(F.col("depth") > 0).select(F.col("node").alias("key"), F.col("depth").cast("long").alias("round"))


QUERIES = {f.__name__: f for f in (
    canonical_url, source_kinds, title_parse, href_hosts, site_groups, url_score, robots_allowed, active_minutes,
    fetch_status_rollup, peak_cost, pacing, session_gaps, first_seen_urls, harvest_frontier)}

_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_BARE = "regexp_replace(" + _HOST + ", '^www[.]', '')"
_PATH = "regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(trim({0}), '^[^?#]*[?]([^#]*)', 1)"
_KEY = "lower(" + _BARE + " || regexp_replace(" + _PATH + ", '/+$', '') || CASE WHEN " + _QUERY + " <> '' THEN '?' || " + _QUERY + " ELSE '' END)"
_FETCH = "regexp_replace(regexp_replace(trim({0}), '#.*$', ''), '^http:', 'https:')"
_HREFS = "SELECT page_id, url, trim(unnest(regexp_extract_all(html, 'href=[\"'']([^\"''#]+)', 1))) AS h FROM pages"
_ORIGIN = "regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_LINKS = f"""SELECT page_id, url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || h
  WHEN starts_with(h, '/') THEN {_ORIGIN} || h WHEN starts_with(h, '?') THEN {_ORIGIN} || {_PATH.format('url')} || h
  ELSE {_ORIGIN} || coalesce(nullif(regexp_replace({_PATH.format('url')}, '[^/]*$', ''), ''), '/') || h END AS link FROM ({_HREFS})"""

ORACLES = {
    "canonical_url": f"""SELECT page_id, {_KEY.format('url')} AS page_key, {_FETCH.format('url')} AS fetch_url,
  regexp_replace(regexp_replace({_FETCH.format('url')}, '^https://example[.]com', 'https://www.example.com'), '/+$', '') AS queue_key, sha1(url) AS sha_id FROM pages""",
    "source_kinds": f"""SELECT CASE WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'official' WHEN regexp_matches(h, 'news|press') THEN 'external' ELSE 'affiliated' END AS source_kind,
  count(*) AS pages, count(DISTINCT h) AS hosts FROM (SELECT {_BARE.format('url')} AS h FROM pages) GROUP BY 1""",
    "title_parse": r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(length(html) AS BIGINT) AS n_html FROM pages",
    "href_hosts": f"SELECT {_HOST.format('link')} AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM ({_LINKS}) GROUP BY 1",
    "site_groups": f"""SELECT {_BARE.format('url')} AS site, arg_max(page_id, length(html) * 1000000 - page_id) AS largest_page,
  array_to_string(list_sort(list(DISTINCT {_HOST.format('url')})), ',') AS aliases, count(*) AS pages FROM pages GROUP BY 1""",
    "url_score": f"""WITH s AS (SELECT page_id, {_BARE.format('url')} AS host, CAST(3 * len(regexp_extract_all(url, 'about|research|course')) + len(regexp_extract_all(url, '[0-9]'))
  - len(list_filter(string_split({_PATH.format('url')}, '/'), lambda x: x <> '')) AS BIGINT) AS score FROM pages)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS place FROM s) WHERE place <= 3""",
    "robots_allowed": f"""WITH rules(verdict, n, rx) AS (VALUES ('disallow', 7, '^/en/.*5$'), ('allow', 8, '^/en/.*05$'), ('disallow', 4, '^/fr/'), ('allow', 5, '^/fr/8'), ('disallow', 5, '^/de/[?]')),
m AS (SELECT page_id, verdict, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, verdict) AS rn
  FROM (SELECT page_id, {_PATH.format('url')} AS path FROM pages) JOIN rules ON regexp_matches(path, rx))
SELECT pages.page_id, coalesce(verdict = 'allow', true) AS allowed FROM pages LEFT JOIN m ON m.page_id = pages.page_id AND rn = 1""",
    "active_minutes": """SELECT user_id, round(coalesce(sum(least(g, 600000000)), 0) / 60e6, 6) AS minutes, count(*) AS n_events FROM
  (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS g FROM events) GROUP BY user_id""",
    "fetch_status_rollup": """SELECT coalesce(event_type, 'All') AS event_type, count(*) AS n, round(median(value), 6) AS median_value,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(DISTINCT user_id) AS hosts FROM events GROUP BY ROLLUP (event_type)""",
    "peak_cost": """SELECT event_type, peak, count(*) AS calls, round(sum(value * CASE WHEN peak THEN 2.0 ELSE 1.0 END) / 1e6, 9) AS cost FROM
  (SELECT *, dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) BETWEEN 8 AND 17 AS peak FROM events) GROUP BY ALL""",
    "pacing": "SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1) * 10 AS BIGINT) AS start_s FROM events",
    "session_gaps": """WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""",
    "first_seen_urls": f"""WITH pool AS (SELECT {_KEY.format('url')} AS key, 'page' AS src, page_id FROM pages UNION ALL SELECT {_KEY.format('link')}, 'link', page_id FROM ({_LINKS}))
SELECT key, min(page_id) AS first_page, array_to_string(list_sort(list(DISTINCT src)), ',') AS srcs, count(*) AS n FROM pool WHERE key <> '' GROUP BY key""",
    "harvest_frontier": f"""SELECT key, 1::BIGINT AS round FROM (SELECT DISTINCT {_KEY.format('link')} AS key FROM ({_LINKS})) WHERE key <> '' AND key NOT IN (SELECT {_KEY.format('url')} FROM pages)""",
}
