"""The crawl as a loop over snapshots: claim, fetch, classify, extract, admit, merge.

A table of fetch results (url, attempt, status, location, retry_after, content_type, body) stands for the network; an attempt
beyond the last one gets the last one's result, an unknown URL a 404.  Every round is a handful of DataFrame steps over all
rows that are due; its state is written before the next round reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import urls
from . import admission, frontier, links, robots

QUEUE = "id bigint, url string, alt string, kind string, priority int, depth int, parent bigint, status string, tries int, next_try_at double, http_status int, error string, location string, content_type string, size bigint, fetched_at double"


@dataclass
class State:
    queue: DataFrame
    skips: DataFrame
    embeds: DataFrame
    counts: DataFrame  # query variants used, by host and path


def _arrivals(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "raw", "base", "kind", "depth", "parent", "parent_priority", F.lit(False).alias("external_parent"))


def admitted(state: State, arriving: DataFrame, rules: admission.Rules, robots_rules: DataFrame | None, capped: bool = True) -> State:
    """The state after arriving links (seq, raw, base, kind, depth, parent, parent_priority) were judged and merged."""
    judged = admission.judged(_arrivals(arriving), rules, robots_rules)
    counts = state.counts
    if capped:  # seeds do not use up the cap
        judged = admission.within_query_cap(judged, rules, state.queue, state.counts)
        counts = admission.query_counts(judged, state.queue, state.counts)
    accepted = judged.where("fate = 'accept'").select("seq", "url", "alt", "kind", "priority", "depth", "parent")
    known = state.queue.select("url", "id", "alt", "kind", "priority", "depth", "parent", "status")
    merged = frontier.numbered(frontier.merged(known, accepted)).select("id", "url", "alt", "kind", F.col("priority").cast("int").alias("priority"), F.col("depth").cast("int").alias("depth"), "parent", "status")
    rest = state.queue.select("id", "tries", "next_try_at", "http_status", "error", "location", "content_type", "size", "fetched_at")
    queue = merged.join(rest, "id", "left").withColumns({"tries": F.coalesce("tries", F.lit(0)), "next_try_at": F.coalesce("next_try_at", F.lit(0.0))})
    players = judged.where("fate = 'embed'").select("url", F.col("base").alias("page_url"), "seq")
    return State(queue.select(*state.queue.columns), admission.added_skips(state.skips, admission.skips(judged)), frontier.added_embeds(state.embeds, players), counts)


def _fetched(due: DataFrame, results: DataFrame) -> DataFrame:
    """Claimed rows with the result of their attempt."""
    last = results.groupBy(F.col("url").alias("u")).agg(F.max("attempt").alias("last"))
    asked = due.join(last, due.url == last.u, "left").withColumn("attempt", F.least(F.col("tries"), F.coalesce("last", F.lit(0)))).drop("u", "last")
    got = results.select(F.col("url").alias("u"), F.col("attempt").alias("at"), F.col("status").alias("got"), F.col("location").alias("to"), "retry_after", F.col("content_type").alias("ctype"), "body")
    return asked.join(got, (F.col("url") == F.col("u")) & (F.col("attempt") == F.col("at")), "left").drop("u", "at")


def children(done: DataFrame, rules: admission.Rules) -> DataFrame:
    """Arriving links of stored documents (id, url, kind, depth, priority, content_type, body)."""
    found = links.by_content(done, "id", "url", "content_type", "body").join(done.select("id", F.col("url").alias("page"), F.col("kind").alias("of"), "priority", "depth"), "id")
    base = F.coalesce(urls.canonical_column(rules.site, "base", "page")["url"], F.col("page"))
    deeper = F.col("depth") + F.col("kind").isin("page", "embed").cast("int")
    return found.select(frontier.place("id", F.col("seq") + 1).alias("seq"), F.col("url").alias("raw"), base.alias("base"), "kind", deeper.alias("depth"), F.col("id").alias("parent"), F.when(F.col("of") != "sitemap", F.col("priority")).alias("parent_priority"))


def nothing(spark: SparkSession) -> State:
    """The state before anything was found."""
    empty = lambda schema: spark.createDataFrame([], schema)
    return State(empty(QUEUE), empty("reason string, prefix string, n bigint, example string"), empty(f"url string, page_url string, status string, seq {frontier.PLACE}"), empty("host_path string, n bigint"))


def step(state: State, results: DataFrame, rules: admission.Rules, robots_rules: DataFrame | None, now: float, limit: int, max_tries: int = 5, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> State:
    """One round: rows due are fetched and classified, and what their pages link to is admitted."""
    due = frontier.claimed(state.queue, ("sitemap", "page", "asset", "media"), now, limit)
    fetched = _fetched(due, results).withColumn("target", urls.canonical_column(rules.site, "to", "url")["url"])
    fetched = keep(fetched.select("id", "url", "kind", "priority", "depth", "tries", F.coalesce("got", F.lit(404)).alias("status"), "target", "retry_after", F.col("ctype").alias("content_type"), "body", (F.col("kind") == "media").alias("is_file"), F.lit(False).alias("complete")), "fetched")
    judged = keep(frontier.outcomes(fetched, max_tries), "outcomes")
    changes = judged.select("id", F.col("new_status").alias("status"), F.col("new_tries").alias("tries"), F.coalesce(F.col("delay") + now, F.lit(0.0)).alias("next_try_at"), F.col("status").alias("http_status"), "error", F.col("target").alias("location"), "content_type", F.octet_length("body").cast("long").alias("size"), F.lit(now).alias("fetched_at"))
    moved = State(frontier.updated(state.queue, changes), state.skips, state.embeds, state.counts)
    done = judged.where("new_status = 'done'").where(frontier.read_for_links("content_type", "url") & admission.follows(rules, "url"))
    kind = F.coalesce(urls.kind_by_extension("target"), F.when(F.col("kind") == "sitemap", "page").otherwise(F.col("kind")))
    targets = judged.where("new_status = 'redirect' AND target IS NOT NULL").select(frontier.place("id", F.lit(0)).alias("seq"), F.col("target").alias("raw"), F.lit(None).cast("string").alias("base"), kind.alias("kind"), "depth", F.col("id").alias("parent"), F.col("priority").alias("parent_priority"))
    return admitted(moved, children(done, rules).unionByName(targets), rules, robots_rules)


def crawl(spark: SparkSession, seeds: DataFrame, results: DataFrame, rules: admission.Rules, robots_files: DataFrame, agent: str, folder: str, rounds: int = 50, limit: int = 1_000_000, max_tries: int = 5, state: State | None = None, now: float = 0.0) -> State:
    """The state when nothing is queued any more, or after so many rounds, from nothing or from a state at a time `now`.

    seeds: url, kind; robots_files: origin, text.
    """
    state = state or nothing(spark)
    robots_rules = robots.rules_table(robots_files, agent)
    sitemaps = robots_files.select(F.explode(links.robots_sitemaps("text")).alias("url"), F.lit("sitemap").alias("kind"))
    first = seeds.select("url", "kind").unionByName(sitemaps).distinct()
    null = lambda kind: F.lit(None).cast(kind)
    order = F.row_number().over(Window.partitionBy("kind").orderBy("url"))
    arriving = first.select(order.cast(frontier.PLACE).alias("seq"), F.col("url").alias("raw"), null("string").alias("base"), "kind", F.lit(0).alias("depth"), null("bigint").alias("parent"), null("int").alias("parent_priority"))

    def keep(number: int, df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/round-{number}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def kept(number: int, s: State) -> State:
        return State(*[keep(number, getattr(s, name), name) for name in ("queue", "skips", "embeds", "counts")])

    state = kept(0, admitted(state, arriving, rules, robots_rules, capped=False))
    for number in range(1, rounds + 1):
        if not state.queue.where("status = 'queued'").limit(1).count():
            break
        state = kept(number, step(state, results, rules, robots_rules, now, limit, max_tries, lambda df, name, n=number: keep(n, df, name)))
        now += 3600.0  # longer than any delay
    return state
