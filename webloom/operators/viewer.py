"""Viewing an archive: which stored page an address stands for, where redirects end, links and playlists rewritten."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions import media, urls

#: Folder under which pages of outer hosts appear.
OUTER = "/__ext__/"
HOPS = 10
# Thumbnails in the address of a picture, players in markup, addresses in HLS tags.
THUMBNAIL = r"-\d{2,4}x\d{2,4}(\.(?:jpe?g|png|gif|webp))$"
FRAME = r"""(?i)(<(?:iframe|embed)\b[^>]*?\s(?:src|data-src|data-lazy-src)\s*=\s*["']?)(?:https?:)?//([a-z0-9][a-z0-9.-]*)"""
HLS_ADDRESS = re.compile(r'(URI=")([^"]+)(")', re.I)


def candidates(asked: DataFrame, site: urls.UrlRules, rewrites=(), url: str = "url") -> DataFrame:
    """asked with place and candidate: the addresses under which each may be stored, the likeliest first.

    Canonical, as given, with or without the last slash, http for https, rewritten, a thumbnail's original; then those
    with %27 and ' exchanged.
    """
    df = asked.withColumn("__n", urls.canonical_column(site, url)["url"])
    path, front = urls.path_of("__n"), F.regexp_extract("__n", "^[^?#]*", 0)
    tail = F.regexp_replace("__n", r"^[^?#]*", "")
    other = F.when(path.endswith("/") & (F.length(path) > 1), F.concat(F.regexp_replace(front, "/+$", ""), tail)).when(~path.endswith("/"), F.concat(front, F.lit("/"), tail))
    plain = F.when(F.col("__n").startswith("https:"), F.concat(F.lit("http"), F.substring("__n", 6, 1 << 20)))
    rewritten = urls.rewrite_first("__n", rewrites) if rewrites else F.lit(None).cast("string")
    original = F.regexp_replace("__n", "(?i)" + THUMBNAIL, "$1")
    first = F.array_distinct(F.array_compact(F.array(F.col("__n"), F.col(url), other, plain, rewritten, original)))
    quotes = F.transform(first, lambda c: F.when(c.contains("%27"), F.replace(c, F.lit("%27"), F.lit("'"))).when(c.contains("'"), F.replace(c, F.lit("'"), F.lit("%27"))))
    every = F.array_distinct(F.concat(first, F.array_compact(quotes)))
    return df.select(*asked.columns, F.posexplode(every).alias("place", "candidate"))


def looked_up(asked: DataFrame, queue: DataFrame, site: urls.UrlRules, rewrites=(), statuses=("done", "redirect"), url: str = "url") -> DataFrame:
    """The stored row for each asked URL: by status in the given order, then by candidate place."""
    found = candidates(asked, site, rewrites, url).join(queue.select(F.struct(*queue.columns).alias("row"), F.col("url").alias("candidate"), "status"), "candidate")
    order = F.array_position(F.array(*map(F.lit, statuses)), F.col("status"))
    best = found.where(F.col("status").isin(*statuses)).groupBy(*asked.columns).agg(F.min_by("row", F.struct(order, "place")).alias("row"))
    return best


def address_key(df: DataFrame, site: urls.UrlRules, url: str, out: str) -> DataFrame:
    """df with the address without scheme and last slash, for comparisons."""
    df = df.withColumn("__n", F.coalesce(urls.canonical_column(site, url)["url"], F.col(url)))
    path = F.regexp_replace(urls.path_of("__n"), "/+$", "")
    return df.withColumn(out, F.concat_ws("\u0001", urls.host_of("__n"), F.when(path == "", "/").otherwise(path), urls.query_of("__n"))).drop("__n")


def redirect_ends(queue: DataFrame, start: DataFrame, hops: int = HOPS) -> DataFrame:
    """(key, outcome, target) of redirect chains: `redirect` to the last target, `serve` a stored page, or `missing`.

    queue: key, status, location_key, location; start: key.  All chains advance together, one join a hop; a chain that meets a
    key again, or is not over after `hops`, is a loop: its stored page is served if there is one.
    """
    stored = queue.where("status = 'done'").select(F.col("key").alias("k"), F.lit(True).alias("has"))
    step = queue.where("status = 'redirect'").select(F.col("key").alias("k"), "location_key", "location")
    state = start.select("key", F.col("key").alias("at"), F.array("key").alias("seen"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("outcome"))
    for _ in range(hops):
        state = state.join(step, state.at == step.k, "left").drop("k")
        open_, there = F.col("outcome").isNull(), F.col("location_key").isNotNull()
        loop = open_ & there & F.array_contains("seen", F.col("location_key"))
        outcome = F.when(~open_, F.col("outcome")).when(~there, "redirect").when(loop, "loop")
        move = open_ & there & ~loop
        state = state.select("key", F.when(move | loop, F.col("location_key")).otherwise(F.col("at")).alias("at"), F.when(move, F.concat("seen", F.array("location_key"))).otherwise(F.col("seen")).alias("seen"), F.when(move, F.col("location")).otherwise(F.col("target")).alias("target"), outcome.alias("outcome"))
    ended = state.withColumn("outcome", F.coalesce("outcome", F.lit("long")))
    # A loop is served by a page stored under the asked key or the one it came back to.
    ended = ended.join(stored.withColumnsRenamed({"k": "key", "has": "own"}), "key", "left").join(stored.withColumnsRenamed({"k": "at", "has": "back"}), "at", "left")
    served = F.col("own") | F.col("back")
    outcome = F.when((F.col("outcome") == "loop") & F.coalesce(served, F.lit(False)), "serve").when(F.col("outcome").isin("loop", "long"), "missing").otherwise(F.col("outcome"))
    return ended.select("key", outcome.alias("outcome"), F.when(outcome == "redirect", F.col("target")).alias("target"))


def local_path(url: str, main_host: str, aliases: dict[str, str] | None = None) -> Column:
    """Path under which a page is seen in the viewer."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z]+://([^/?#]*)", 1)
    known = host
    for alias, name in (aliases or {}).items():
        known = F.when(host == alias, name).otherwise(known)
    query = urls.query_of(url)
    tail = F.concat(urls.path_of(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(known == main_host, tail).otherwise(F.concat(F.lit(OUTER), host, tail))


def web_address(path: str, main_host: str, scheme: str = "https") -> Column:
    """URL of a viewer path."""
    p = F.col(path)
    return F.when(p.startswith(OUTER), F.concat(F.lit("https://"), F.substring(p, len(OUTER) + 1, 1 << 20))).otherwise(F.concat(F.lit(f"{scheme}://{main_host}"), p))


def rewritten_links(markup: str, main_host: str, own_hosts, aliases: dict[str, str] | None = None, embed_hosts=()) -> Column:
    """Markup whose absolute links to archived hosts are local, also where a script writes the slashes as \\/.

    One pass of regular expressions for each host; players of embed hosts are handled last.
    """
    out = F.col(markup)
    for host in own_hosts:
        name = re.escape(host).replace("\\-", "-")
        end = r"(?![A-Za-z0-9.-])"
        main = (aliases or {}).get(host, host) == main_host
        local, script = ("", "") if main else (OUTER + host, (OUTER + host).replace("/", "\\/"))
        java = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, rf"(?i)(?:https?:)?\\/\\/{name}(?::\d+)?{end}(?=\\)", java(script))
        out = F.regexp_replace(out, rf"(?i)(?:https?:)?//{name}(?::\d+)?{end}(?=[/\\])", java(local))
        out = F.regexp_replace(out, rf"(?i)(?:https?:)?//{name}(?::\d+)?{end}", java(local + "/"))
    for host in embed_hosts:
        name = re.escape(host).replace("\\-", "-")
        frame = FRAME.replace("([a-z0-9][a-z0-9.-]*)", f"((?:[a-z0-9-]+\\.)*{name})(?![a-z0-9.-])")
        out = F.regexp_replace(out, frame, "$1" + OUTER + "$2")
    return out


def rewritten_playlist(site: urls.UrlRules, origin: str, main_host: str) -> object:
    """A function of columns (playlist, its URL, whether it is a PLS file): the playlist with addresses of this viewer."""

    def local(ref: str, base: str) -> str:
        ref = ref.strip()
        try:
            whole = urljoin(base, ref)
            parts = urlsplit(whole)
        except ValueError:
            return ref
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return ref
        parts = urlsplit((urls.canonical(whole, site) or (whole, None))[0])
        host = parts.netloc.lower()
        tail = parts.path + (f"?{parts.query}" if parts.query else "")
        return origin + (tail if site.aliases.get(host, host) == main_host else OUTER + host + tail)

    def line(raw: str, base: str, pls: bool) -> str:
        body = raw.rstrip("\r\n")
        end, mark = raw[len(body) :], "﻿" if body.strip().startswith("﻿") else ""
        core = body.strip().lstrip("﻿")
        if not core:
            return raw
        if core.startswith("#"):
            return HLS_ADDRESS.sub(lambda m: m[1] + local(m[2], base) + m[3], body) + end
        if not pls:
            return mark + local(core, base) + end
        name, equals, value = core.partition("=")
        return f"{mark}{name}={local(value, base)}{end}" if equals and re.fullmatch(r"(?i)file\d+", name.strip()) else raw

    @F.pandas_udf(StringType())
    def run(playlist: pd.Series, base: pd.Series, pls: pd.Series) -> pd.Series:
        return pd.Series(["".join(line(x, b, p) for x in t.splitlines(keepends=True)) if t is not None else None for t, b, p in zip(playlist, base, pls)], dtype=object)

    return run


def stored_video(asked: DataFrame, embeds: DataFrame, site: urls.UrlRules, url: str = "url") -> DataFrame:
    """asked with path of the stored video: by exact address, then the other scheme, then the comparison key (first wins)."""
    done = embeds.where("status = 'done' AND path IS NOT NULL").select("url", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.col("seq"))
    base = asked.withColumn("__n", F.coalesce(urls.canonical_column(site, url)["url"], F.col(url)))
    turned = lambda c: F.when(F.col(c).startswith("https:"), F.regexp_replace(c, "^https:", "http:")).otherwise(F.regexp_replace(c, "^http:", "https:"))
    tries = base.select(*asked.columns, F.posexplode(F.array(F.col(url), F.col("__n"), turned(url), turned("__n"))).alias("place", "u"))
    exact = tries.join(done.select(F.col("url").alias("u"), "path"), "u").groupBy(*asked.columns).agg(F.min_by("path", "place").alias("__exact"))
    keyed = media.comparison_key(done, "url").groupBy("video_key").agg(F.min_by("path", "seq").alias("__keyed"))
    joined = media.comparison_key(asked, url).join(exact, asked.columns, "left").join(keyed, "video_key", "left")
    return joined.select(*asked.columns, F.coalesce("__exact", "__keyed").alias("path"))


def page_media(queue: DataFrame) -> DataFrame:
    """(parent_id, path) of the first stored media file found on each page."""
    done = queue.where("status = 'done' AND kind = 'media' AND path IS NOT NULL AND parent_id IS NOT NULL")
    return done.groupBy("parent_id").agg(F.min_by("path", "id").alias("path"))


def byte_range(header: str, size: str) -> Column:
    """Struct (start, end) of a Range header within a file of the size; (-1, -1) if it cannot be met, null without one."""
    h = F.regexp_extract(header, r"(?i)^\s*bytes\s*=\s*(\d*)\s*-\s*(\d*)\s*$", 1)
    t = F.regexp_extract(header, r"(?i)^\s*bytes\s*=\s*(\d*)\s*-\s*(\d*)\s*$", 2)
    n = F.col(size)
    low = F.when(h != "", h.cast("long")).otherwise(F.greatest(n - t.cast("long"), F.lit(0)))
    high = F.when((h != "") & (t != ""), F.least(t.cast("long"), n - 1)).otherwise(n - 1)
    bad = (low >= n) | (low > high) | ((h == "") & (t.cast("long") == 0))
    pair = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    return F.when((h != "") | (t != ""), F.when(bad, pair(F.lit(-1), F.lit(-1))).otherwise(pair(low, high)))


def safe_inside(path: str) -> Column:
    """Whether a relative path stays in its folder."""
    p = F.col(path)
    return (p != "") & ~p.contains("\u0000") & ~p.contains("\\") & ~p.startswith("/") & ~p.rlike(r"^[A-Za-z]:") & ~F.array_contains(F.split(p, "/"), "..")
