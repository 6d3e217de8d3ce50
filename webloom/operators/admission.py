"""Admission of links: an ordered chain of rules decides each link's fate and names the reason of a refusal.

A link passes through: canonical form, rewriting, video service mapping, clean parameters, scope, exclusion, dates, robots,
login, depth, priority, and last the cap on query variants of one page.  The chain is one CASE expression over columns, so a
batch of links is judged in one pass; only robots needs a join (on the origin) and the cap a window (on host and path).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, media, urls
from . import robots

# Forms of player addresses, and of players without a video.
PLAYER_PATH = r"(?i)/(embed|video_ext\.php|play/embed|videoembed|player|watch|shorts|w|v|video)(/|$|\?)"
EMPTY_PLAYER = r"(?i)/embed/?(\?|$)"
#: Refusals that are counted, in the order in which they are tested.
REASONS = ("peertube", "exclude", "date", "robots", "login", "depth", "query_cap")


@dataclass(frozen=True)
class Rules:
    """Admission settings; patterns are Java regular expressions."""

    site: urls.UrlRules = field(default_factory=urls.UrlRules)
    rewrites: tuple[tuple[str, str], ...] = ()
    video_hosts: tuple[str, ...] = ()
    embed_hosts: tuple[str, ...] = ()
    media_hosts: tuple[str, ...] = ()
    asset_blocklist: tuple[str, ...] = ()
    external_assets: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    no_follow: tuple[str, ...] = ()
    date_gates: tuple[str, ...] = ()
    dates: tuple[str, str] = ("1600-01-01", "2999-12-31")
    respect_robots: bool = True
    robots_for_all: bool = False
    robots_override: tuple[str, ...] = ()
    login: tuple[str, ...] = ()
    has_cookies: bool = False
    max_depth: int = 0
    priorities: tuple[tuple[str, int], ...] = ()
    default_priority: int = 50
    asset_priority: int = 90
    query_caps: tuple[tuple[str, int], ...] = ()
    default_query_cap: int = 50
    variants: tuple[tuple[str, str, tuple[str, ...], int | None], ...] = ()


def any_match(patterns, *columns: str) -> Column:
    """Whether a pattern matches one of the columns (null columns match nothing)."""
    return reduce(lambda a, pc: a | F.coalesce(F.col(pc[1]).rlike(pc[0]), F.lit(False)), [(p, c) for p in patterns for c in columns], F.lit(False))


def excluded(rules: Rules, *columns: str) -> Column:
    """Excluded unless included; both are tested on the raw and the decoded form."""
    return ~any_match(rules.include, *columns) & any_match(rules.exclude, *columns)


def follows(rules: Rules, *columns: str) -> Column:
    """Whether the links of a stored page are looked at."""
    return ~any_match(rules.no_follow, *columns)


def judged(links: DataFrame, rules: Rules, robots_rules: DataFrame | None = None, clean_params: DataFrame | None = None) -> DataFrame:
    """links with url, alt, kind, priority and fate: `accept`, `embed`, `drop` (silent), or the reason of a refusal.

    links: seq (order of arrival), raw, base, kind, depth, parent, parent_priority, external_parent; a priority column
    priority_override is honoured where it is not null.
    """
    df = links.withColumn("__c", urls.canonical_column(rules.site, "raw", "base"))
    df = df.withColumns({"url": F.col("__c.url"), "alt": F.col("__c.alt")}).drop("__c")
    if rules.rewrites:
        df = df.withColumn("__w", urls.rewrite_first("url", rules.rewrites)).withColumn("__n", urls.canonical_column(rules.site, "__w"))
        moved = F.col("__w") != F.col("url")
        df = df.withColumns({"alt": F.when(moved, F.lit(None)).otherwise(F.col("alt")), "url": F.when(moved, F.col("__n.url")).otherwise(F.col("url"))}).drop("__w", "__n")
    on_video = urls.host_within(urls.host_of("url"), rules.video_hosts)
    form = media.queue_form("url")
    df = df.withColumns({"__v": on_video, "__f": form})
    df = df.withColumns({"__lost": F.col("__v") & F.col("__f").isNull(), "kind": F.when(F.col("__v"), F.coalesce("__f.kind", "kind")).otherwise(F.col("kind")), "alt": F.when(F.col("__v"), None).otherwise(F.col("alt")), "url": F.when(F.col("__v"), F.coalesce("__f.url", "url")).otherwise(F.col("url"))})
    df = df.withColumn("in_scope", urls.host_within(urls.host_of("url"), rules.site.scope))
    if clean_params is not None and rules.respect_robots:
        df = robots.cleaned_params(df, clean_params, "url")
    if robots_rules is not None and rules.respect_robots:
        df = robots.allowed(df, robots_rules, "url", "__allowed")
    else:
        df = df.withColumn("__allowed", F.lit(True))
    df = df.withColumns({"__d": robots.decoded("url"), "__ad": robots.decoded("alt")})
    df = df.withColumn("__k", F.col("kind"))  # the kind as it came; the scope rules go by it, the later ones by the kind it becomes
    host, came, kind, inside = urls.host_of("url"), F.col("__k"), F.col("kind"), F.col("in_scope")
    free = rules.external_assets & ~urls.blocked("url", rules.asset_blocklist) if rules.external_assets else F.lit(False)
    from_media_host = urls.host_within(host, rules.media_hosts)
    player = urls.host_within(host, rules.embed_hosts)
    stays = from_media_host | ((came == "asset") & free) | ((came == "media") & free & ~F.col("external_parent"))
    outside = F.when(player & ((came == "embed") | urls.path_of("url").rlike(PLAYER_PATH)) & ~F.col("url").rlike(EMPTY_PLAYER), "embed").when(player | (came == "embed") | ~stays, "drop")
    df = df.withColumn("kind", F.when(~inside & from_media_host & ~player & (came != "embed"), F.coalesce(urls.kind_by_extension("url"), F.lit("media"))).when(inside & (came == "embed"), "page").otherwise(came))
    fate = (
        F.when(F.col("url").isNull(), "drop")
        .when(F.col("__lost"), "peertube")
        .when(~inside & outside.isNotNull(), outside)
        .when(inside & F.col("external_parent") & (came == "page"), "drop")
        .when(excluded(rules, "url", "__d") | (F.col("alt").isNotNull() & excluded(rules, "alt", "__ad")), "exclude")
        .when(kind.isin("page", "sitemap") & dates.outside_dates("url", *rules.dates, rules.date_gates), "date")
        .when(inside & F.lit(rules.respect_robots) & (F.lit(rules.robots_for_all) | kind.isin("page", "sitemap")) & ~any_match(rules.robots_override, "url") & ~F.col("__allowed"), "robots")
        .when(F.lit(not rules.has_cookies) & any_match(rules.login, "url", "__d"), "login")
        .when(F.lit(rules.max_depth > 0) & (F.col("depth") > rules.max_depth), "depth")
        .otherwise("accept")
    )
    listed = F.coalesce(urls.first_value("url", rules.priorities, None, "__d").cast("int"), F.lit(rules.default_priority))
    ranked = F.when(kind == "asset", F.coalesce("parent_priority", F.lit(rules.asset_priority))).when(~inside & F.col("parent_priority").isNotNull(), F.greatest(listed, "parent_priority")).otherwise(listed)
    given = F.col("priority_override") if "priority_override" in links.columns else F.lit(None).cast("int")
    df = df.withColumn("priority", F.coalesce(given, ranked).cast("int")).withColumn("fate", fate)
    return df.drop("__v", "__f", "__lost", "__allowed", "__d", "__ad", "__k")


def within_query_cap(judged_links: DataFrame, rules: Rules, known: DataFrame, counts: DataFrame) -> DataFrame:
    """Accepted links beyond the cap on query variants of one host and path turn to `query_cap`.

    Known URLs, and repeats of one in the batch, use up nothing; counts (host_path, n) is what earlier batches used.
    """
    asks = (F.col("fate") == "accept") & (urls.query_of("url") != "")
    df = judged_links.withColumn("host_path", F.concat(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), urls.path_of("url")))
    df = df.join(known.select("url").distinct().withColumn("__known", F.lit(True)), "url", "left")
    decoded = robots.decoded("url")
    df = df.withColumn("__cd", decoded).withColumn("__cap", F.coalesce(urls.first_value("url", rules.query_caps, None, "__cd").cast("int"), F.lit(rules.default_query_cap)))
    capped = asks & F.col("__known").isNull() & F.col("__cap").isNotNull()
    fresh = df.where(capped).groupBy("url", "host_path", "__cap").agg(F.min("seq").alias("first"))
    # No more than the largest cap of a host and path are ever taken; Spark cuts the groups to that before they are shuffled.
    most = max([c for c in (rules.default_query_cap, *(v for _, v in rules.query_caps)) if c is not None], default=0)
    early = fresh.withColumn("place", F.row_number().over(Window.partitionBy("host_path").orderBy("first", "url"))).where(F.col("place") <= most)
    taken = early.join(counts, "host_path", "left").where(F.col("place") + F.coalesce("n", F.lit(0)) <= F.col("__cap")).select("url", F.lit(True).alias("__taken"))
    late = capped & F.col("__taken").isNull()
    return df.join(taken, "url", "left").withColumn("fate", F.when(late, "query_cap").otherwise(F.col("fate"))).drop("__taken", "__known", "__cap", "__cd", "host_path")


def query_counts(judged_links: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """(host_path, n) after a batch: what was counted before and the new query variants that were accepted."""
    new = judged_links.where((F.col("fate") == "accept") & (urls.query_of("url") != "")).join(known.select("url").distinct(), "url", "left_anti").select("url").distinct()
    new = new.select(F.concat(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), urls.path_of("url")).alias("host_path"), F.lit(1).alias("n"))
    return counts.select("host_path", "n").unionByName(new).groupBy("host_path").agg(F.sum("n").alias("n"))


def skips(judged_links: DataFrame) -> DataFrame:
    """(reason, prefix, n, example) of refusals: counted by occurrence, the first one as the example."""
    prefix = F.when(urls.section("url") == "", urls.host_of("url")).otherwise(urls.section("url"))
    return judged_links.where(F.col("fate").isin(*REASONS)).groupBy(F.col("fate").alias("reason"), prefix.alias("prefix")).agg(F.count("*").alias("n"), F.min_by("url", "seq").alias("example"))


def added_skips(before: DataFrame, more: DataFrame) -> DataFrame:
    """Skip counters of two batches added up; the earlier example stays."""
    both = before.withColumn("__b", F.lit(0)).unionByName(more.withColumn("__b", F.lit(1)))
    return both.groupBy("reason", "prefix").agg(F.sum("n").alias("n"), F.min_by("example", "__b").alias("example"))


def expanded(df: DataFrame, pattern: str, template: str, values, url: str = "url") -> DataFrame:
    """Variants of the URLs that match: template with {0}, {1}.. for the groups and {x} for each value; not the URL itself."""
    import re

    pieces = re.split(r"(\{\d+\}|\{x\})", template)
    part = lambda p: F.col("x") if p == "{x}" else F.regexp_extract(url, pattern, int(p[1:-1])) if re.fullmatch(r"\{\d+\}", p) else F.lit(p)
    made = df.where(F.col(url).rlike(pattern)).withColumn("x", F.explode(F.array(*map(F.lit, values)))).withColumn("variant", F.concat(*map(part, pieces)))
    return made.where(F.col("variant") != F.col(url)).drop("x")


def date_seeds(spark, templates, first: str, last: str, centre: str) -> DataFrame:
    """(url, priority, template, place) of every date of each template ({date}), nearest dates first."""
    parts = []
    for k, t in enumerate(templates):
        low, high = dates.clamped(t.get("from"), t.get("to"), first, last)
        front, _, back = t["template"].partition("{date}")
        days = dates.nearest_first(spark, low, high, centre)
        parts.append(days.select(F.concat(F.lit(front), F.date_format("d", "yyyy-MM-dd"), F.lit(back)).alias("url"), F.lit(t.get("priority")).cast("int").alias("priority"), F.lit(k).alias("template"), "place"))
    return reduce(DataFrame.unionByName, parts)
