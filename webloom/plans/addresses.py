"""Queries on addresses: canonical forms, scope, kinds, rules, robots, dates, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, urls
from ..operators import admission, frontier, robots
from .registry import read, register

SITE = urls.UrlRules(scope=("example.com", "example.net", "example.org"), https=("example.com", "example.net", "example.org"), drop_params=("utm_*", "ref"))
#: The parts of a URL in DuckDB.
PARTS = """
parts AS (
    SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query
    FROM pages)"""
CANONICAL = f"""{PARTS},
cut AS (
    SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda t: t <> '' AND NOT (contains(t, '=') AND (starts_with(lower(t), 'utm_') OR lower(split_part(t, '=', 1)) = 'ref'))), '&') AS kept FROM parts),
canon AS (
    SELECT page_id, html, host, path, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url FROM cut)"""


@register(f"WITH {CANONICAL} SELECT page_id, url FROM canon")
def url_normalize(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.canonical_column(SITE, "url")["url"].alias("url"))


@register(f"WITH {CANONICAL} SELECT page_id, url FROM canon")
def url_normalize_builtin(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.canonical_plain(SITE, "url").alias("url"))


@register(f"""WITH {CANONICAL},
keyed AS (SELECT page_id, regexp_replace(regexp_replace('https://' || host || path, '\\.html$', ''), '/$', '') AS url, 10 + page_id % 7 AS priority, page_id % 3 AS depth FROM canon)
SELECT url, min(page_id) AS seq, min(priority) AS priority, arg_min(depth, page_id) AS depth FROM keyed GROUP BY url""")
def url_dedupe_first_wins(spark, folder):
    """Insert-or-ignore with priority merge, on a key coarse enough for duplicates."""
    pages = read(spark, folder, "pages").select("page_id", urls.canonical_plain(SITE, "url").alias("u"))
    key = F.regexp_replace(F.regexp_replace(F.regexp_extract("u", "^[^?]*", 0), r"\.html$", ""), "/$", "")
    new = pages.select(F.col("page_id").alias("seq"), key.alias("url"), F.lit(None).cast("string").alias("alt"), F.lit("page").alias("kind"), (10 + F.col("page_id") % 7).alias("priority"), (F.col("page_id") % 3).alias("depth"), F.lit(None).cast("long").alias("parent"))
    known = new.limit(0).select("url", F.lit(0).cast("long").alias("id"), "alt", "kind", "priority", "depth", "parent", F.lit("queued").alias("status"))
    return frontier.merged(known, new).select("url", F.col("seq").cast("long").alias("seq"), "priority", "depth")


@register(f"WITH {PARTS} SELECT page_id, (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org') AS inside FROM parts")
def host_in_scope(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.host_within(urls.host_of("url"), ("example.com", "example.org")).alias("inside"))


@register(f"""WITH {PARTS} SELECT page_id, CASE WHEN regexp_extract(lower(regexp_extract(path, '[^/]*$')), '\\.([^.]*)$', 1) IN ('html', 'htm', 'php') THEN 'page' END AS kind,
       regexp_extract(lower(regexp_extract(path, '[^/]*$')), '\\.([^.]*)$', 1) AS ext FROM parts""")
def kind_by_ext(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.kind_by_extension("url").alias("kind"), urls.extension("url").alias("ext"))


@register(f"WITH {PARTS} SELECT DISTINCT host FROM parts")
def distinct_hosts(spark, folder):
    from ..operators import reports

    return reports.distinct_hosts(read(spark, folder, "pages"))


@register(f"""WITH {PARTS} SELECT page_id, host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' OR ((host = 'example.net' OR host LIKE '%.example.net') AND starts_with(lower(path), '/en/7')) AS blocked FROM parts""")
def url_blocklist(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.blocked("url", ("spam-farm.example.org", "example.net/en/7")).alias("blocked"))


@register("""SELECT page_id, (regexp_matches(url, '/fr/') OR regexp_matches(url, 'page=')) AND NOT regexp_matches(url, '\\.html') AS excluded FROM pages""")
def excluded_urls(spark, folder):
    rules = admission.Rules(exclude=("/fr/", "page="), include=(r"\.html",))
    return read(spark, folder, "pages").withColumn("d", robots.decoded("url")).select("page_id", admission.excluded(rules, "url", "d").alias("excluded"))


@register("""SELECT page_id, CASE WHEN regexp_matches(url, '/en/[0-9]+/$') THEN 5 WHEN regexp_matches(url, '/en/') THEN 10 WHEN regexp_matches(url, '/de/') THEN 20 ELSE 50 END AS priority FROM pages""")
def priority_first_match(spark, folder):
    rules = ((r"/en/\d+/$", 5), ("/en/", 10), ("/de/", 20))
    return read(spark, folder, "pages").select("page_id", urls.first_value("url", rules, 50).alias("priority"))


@register("""SELECT page_id, CASE WHEN regexp_matches(url, '/en/[0-9]+\\.html') THEN regexp_replace(url, '/en/([0-9]+)\\.html', '/en/\\1')
       WHEN regexp_matches(url, '^http:') THEN regexp_replace(url, '^http:', 'https:') ELSE url END AS url FROM pages""")
def rewrite_first_match(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.rewrite_first("url", ((r"/en/(\d+)\.html", r"/en/\1"), ("^http:", "https:"))).alias("url"))


@register(f"""WITH {PARTS}, cut AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda t: lower(split_part(t, '=', 1)) NOT IN ('ref', 'utm_source')), '&') AS kept FROM parts)
SELECT page_id, CASE WHEN query = '' THEN url WHEN kept = '' THEN regexp_extract(url, '^[^?#]*') ELSE regexp_extract(url, '^[^?#]*') || '?' || kept END AS url FROM cut""")
def strip_params(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.without_params("url", ("ref", "utm_source")).alias("url"))


@register(f"WITH {PARTS} SELECT page_id, regexp_extract(path, '^/*([^/]*)', 1) AS section FROM parts")
def path_section(spark, folder):
    return read(spark, folder, "pages").select("page_id", urls.section("url").alias("section"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/*.html$\nDisallow: /*page=\nAllow: /fr/8\nDisallow: /fr/\nClean-param: ref&utm_source /en/\nCrawl-delay: 2\n"
#: The same rules as patterns that need no look-around.
RULES_SQL = "(VALUES ('/en/', '^/en/', false), ('/en/*.html$', '^/en/.*\\.html$', true), ('/*page=', '^/.*page=', false), ('/fr/8', '^/fr/8', true), ('/fr/', '^/fr/', false)) AS r(raw, pattern, allow)"


def robots_files(spark, pages):
    origins = pages.select(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0).alias("origin")).distinct()
    return origins.withColumn("text", F.lit(ROBOTS))


@register(f"""WITH {PARTS}, t AS (SELECT page_id, path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS target FROM parts),
hits AS (SELECT page_id, allow, length(raw) AS n FROM t JOIN {RULES_SQL} ON regexp_matches(target, pattern)),
best AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, allow DESC) AS k FROM hits)
SELECT t.page_id, coalesce(b.allow, true) AS allowed FROM t LEFT JOIN best b ON b.page_id = t.page_id AND b.k = 1""")
def robots_allowed(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", "url")
    return robots.allowed(pages, robots.rules_table(robots_files(spark, pages), "archiver"), "url").select("page_id", "allowed")


@register(f"""WITH {PARTS}, cut AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda t: lower(split_part(t, '=', 1)) NOT IN ('ref', 'utm_source')), '&') AS kept FROM parts)
SELECT page_id, CASE WHEN query = '' OR NOT starts_with(path, '/en/') THEN url WHEN kept = '' THEN regexp_extract(url, '^[^?#]*') ELSE regexp_extract(url, '^[^?#]*') || '?' || kept END AS url FROM cut""")
def robots_clean_params(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", "url")
    return robots.cleaned_params(pages, robots.params_table(robots_files(spark, pages), "archiver"), "url")


@register("""WITH made AS (SELECT o_orderkey, '/days/' || CAST(o_orderdate AS DATE) AS url, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, d < DATE '1994-01-01' OR d > DATE '1996-06-30' AS late FROM made""")
def date_filter(spark, folder):
    made = read(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("/days/"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("url"))
    return made.select("o_orderkey", dates.outside_dates("url", "1994-01-01", "1996-06-30", ("/days/",)).alias("late"))


@register("""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT d, (row_number() OVER (ORDER BY abs(d - DATE '2024-01-05'), CASE WHEN d < DATE '2024-01-05' THEN 1 ELSE 0 END) - 1)::INTEGER AS place FROM d""")
def dates_nearest_first(spark, folder):
    return dates.nearest_first(spark, "2023-12-20", "2024-02-10", "2024-01-05")


@register("""WITH t AS (SELECT * FROM (VALUES (0, 'https://example.com/days/', '', DATE '2024-01-01', DATE '2024-01-20', 7), (1, 'https://example.com/calendar?date=', '', DATE '2024-01-10', DATE '2024-01-15', NULL)) AS t(template, front, back, a, b, priority)),
d AS (SELECT *, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM t)
SELECT front || d || back AS url, priority::INTEGER AS priority, template::INTEGER AS template, (row_number() OVER (PARTITION BY template ORDER BY abs(d - greatest(least(DATE '2024-01-12', b), a)), CASE WHEN d < DATE '2024-01-12' THEN 1 ELSE 0 END) - 1)::INTEGER AS place FROM d""")
def seed_date_expand(spark, folder):
    templates = ({"template": "https://example.com/days/{date}", "priority": 7}, {"template": "https://example.com/calendar?date={date}", "from": "2024-01-10", "to": "2024-01-15"})
    return admission.date_seeds(spark, templates, "2024-01-01", "2024-01-20", "2024-01-12")


@register("""WITH v AS (SELECT unnest(['fr', 'de', 'es']) AS x)
SELECT page_id, regexp_extract(url, '^(.*)/en/([0-9]+)', 1) || '/' || x || '/' || regexp_extract(url, '^(.*)/en/([0-9]+)', 2) AS variant FROM pages, v WHERE regexp_matches(url, '^(.*)/en/([0-9]+)')""")
def variant_expand(spark, folder):
    return admission.expanded(read(spark, folder, "pages"), r"^(.*)/en/(\d+)", "{1}/{x}/{2}", ("fr", "de", "es")).select("page_id", "variant")


@register()
def file_places(spark, folder):
    """Places of files for all pages, told apart without regard to case."""
    pages = read(spark, folder, "pages").select("page_id", urls.canonical_column(SITE, "url")["url"].alias("url"))
    wanted = pages.select(F.col("page_id").alias("seq"), F.col("page_id").alias("id"), F.col("url").alias("salt"), urls.relative_path("url", F.lit(".html")).alias("path"))
    return frontier.reserved_paths(wanted).select("id", "path", "path_key")
