"""Queries on the smaller pieces: links of single formats, names and places of files, bodies, headers, the viewer's paths.

Most build their input from the tables, so that SQL can say what has to come out.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType

from ..functions import media, text, urls
from ..operators import admission, frontier, links, reports, viewer
from ..sources import sinks, tables
from .addresses import CANONICAL, SITE
from .registry import read, register


def pages(spark, folder, *more):
    return read(spark, folder, "pages").select("page_id", *more)


def said(pattern: str, *columns: str) -> Column:
    """A text with the columns' values in place of each <>."""
    parts = pattern.split("<>")
    return F.concat(*[x for p, c in zip(parts, [*columns, None]) for x in ([F.lit(p)] if p else []) + ([F.col(c)] if c else [])])


def nth(values, of: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(of) % len(values) + 1).cast("int"))


@register("""SELECT page_id, 'img/' || page_id || '.png' AS url, 'asset' AS kind, 'css' AS source FROM pages UNION ALL SELECT page_id, '/v/' || page_id || '.mp4', 'media', 'css' FROM pages
UNION ALL SELECT page_id, 'p' || page_id || '.css', 'asset', 'css@import' FROM pages""")
def style_links(spark, folder):
    css = said("a{background:url( 'img/<>.png' )} b{c:url(data:x) d:url(#e)} @import \"p<>.css\"; f{g:URL(/v/<>.mp4)}", "page_id", "page_id", "page_id")
    return pages(spark, folder, css.alias("css")).select("page_id", F.explode(links.style_links("css")).alias("l")).select("page_id", "l.*")


@register("""SELECT page_id, 'https://e.com/p' || page_id AS url, 'page' AS kind, 'script' AS source FROM pages UNION ALL SELECT page_id, '//cdn.e.com/r' || page_id || '.js', 'asset', 'script' FROM pages
UNION ALL SELECT page_id, '/f/' || page_id || '.mp3', 'media', 'script:path' FROM pages""")
def script_links(spark, folder):
    """Escaped slashes, a full stop behind, a repeat, a path without an extension, and pieces of templates."""
    script = said(r"""a="https:\/\/e.com\/p<>.", b='https://e.com/p<>', c="/f/<>.mp3", d="/no/ext", e="/x/${y}.html", f="//cdn.e.com/r<>.js", g="/h/'+i+'.png";""", "page_id", "page_id", "page_id", "page_id")
    return pages(spark, folder, script.alias("s")).select("page_id", F.explode(links.script_links("s")).alias("l")).select("page_id", "l.*")


@register("SELECT page_id, 'https://e.com/s' || page_id || '.xml' AS url FROM pages UNION ALL SELECT page_id, 'https://e.com/t.xml' FROM pages")
def robots_sitemaps(spark, folder):
    robots = said("User-agent: *\r\nSitemap: https://e.com/s<>.xml\nDisallow: /sitemap:\n  SITEMAP :https://e.com/t.xml\nsitemap:\n", "page_id")
    return pages(spark, folder, robots.alias("r")).select("page_id", F.explode(links.robots_sitemaps("r")).alias("url"))


@register("SELECT page_id, 's' || page_id || '.png' AS url FROM pages UNION ALL SELECT page_id, '/b.png' FROM pages UNION ALL SELECT page_id, 'c.png' FROM pages")
def srcset_addresses(spark, folder):
    value = said(" s<>.png 1x ,\n/b.png\t2x, , c.png", "page_id")
    return pages(spark, folder, F.explode(links.srcset(value)).alias("url"))


_TYPES = ("Text/HTML; charset=utf-8", "image/x-icon", "audio/mp4", "application/epub+zip", "font/woff2", "application/x-of-no-kind", "", "image/vnd.djvu")
_EXTENSIONS = (".html", ".ico", ".m4a", ".epub", ".woff2", ".bin", ".bin", ".djvu")


@register(f"SELECT page_id, ({list(_EXTENSIONS)})[(page_id % 8 + 1)::INTEGER] AS ext FROM pages")
def content_extensions(spark, folder):
    return pages(spark, folder, nth(_TYPES, "page_id").alias("t")).select("page_id", urls.content_extension("t").alias("ext"))


@register("""SELECT page_id, coalesce(t IN ('text/html', 'application/json') OR page_id % 3 = 0, false) AS is_read
FROM (SELECT page_id, (['text/html', 'application/json', 'image/png', 'application/pdf', '', NULL, 'audio/mp4', 'video/mp4'])[(page_id % 8 + 1)::INTEGER] AS t FROM pages)""")
def read_for_links(spark, folder):
    """By type, or by the address (every third one is a playlist or sitemap)."""
    kind = nth(("text/html", "application/json", "image/png", "application/pdf", "", None, "audio/mp4", "video/mp4"), "page_id")
    address = F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 0, "https://e.com/l.M3U8?x").otherwise("https://e.com/s.xml.gz")).otherwise("https://e.com/a.png?b.xml")
    return pages(spark, folder, kind.alias("t"), address.alias("u")).select("page_id", F.coalesce(frontier.read_for_links("t", "u"), F.lit(False)).alias("is_read"))


@register("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '_.txt' WHEN 1 THEN '_con.' || p_partkey WHEN 2 THEN p_partkey || '_a_b' WHEN 3 THEN '_.' || p_partkey
    ELSE repeat('x', 91) || '~' || substr(sha1(repeat('x', 150) || p_partkey), 1, 8) END AS name FROM part""")
def file_names(spark, folder):
    """Refused characters, reserved names, percent codes, spaces and stops at the end, and names that are too long."""
    k = F.col("p_partkey")
    segment = F.when(k % 5 == 0, said("<>%3f.txt. ", "p_name")).when(k % 5 == 1, said("con.<>", "p_partkey")).when(k % 5 == 2, said("<>%2Fa|b", "p_partkey")).when(k % 5 == 3, said("%00.<>", "p_partkey"))
    return read(spark, folder, "part").select("p_partkey", urls.file_name(segment.otherwise(F.concat(F.lit("x" * 150), k))).alias("name"))


@register(f"""WITH {CANONICAL}, t AS (SELECT page_id, host, path, regexp_extract(url, '[?](.*)$', 1) AS q FROM canon)
SELECT page_id, host || CASE WHEN regexp_matches(path, '[.]html$') THEN regexp_replace(path, '[.]html$', '') ELSE rtrim(path, '/') || '/index' END || CASE WHEN q = '' THEN '' ELSE '@' || substr(sha1(q), 1, 8) END || '.html' AS path FROM t""")
def relative_paths(spark, folder):
    made = pages(spark, folder, urls.canonical_column(SITE, "url")["url"].alias("u"))
    return made.select("page_id", urls.relative_path("u", F.lit(".html")).alias("path"))


@register("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '<mark>x</mark>') AS form FROM documents""")
def escaped_with_marks(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.sha2(text.with_marks(F.concat("text", F.lit("<mark>x</mark>"))), 256).alias("form"))


@register(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*', chr(10), 'g'), ' ' || chr(10))) AS form FROM documents""")
def cleaned_text(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.sha2(text.cleaned(F.col("text")), 256).alias("form"))


@register("SELECT doc_id, left(text, 40) AS name FROM documents")
def mojibake_repair(spark, folder):
    """Names whose UTF-8 bytes were read as Latin-1 come back; plain ones stay."""
    broken = F.decode(F.encode(F.substring("text", 1, 40), "UTF-8"), "ISO-8859-1")
    return read(spark, folder, "documents").select("doc_id", broken.alias("b")).select("doc_id", text.repaired("b").alias("name"))


@register("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a ' || doc_id || '.pdf' WHEN 1 THEN 'é' || doc_id || '.txt' END AS name FROM documents")
def attachment_names(spark, folder):
    k = F.col("doc_id")
    header = F.when(k % 3 == 0, said('attachment; filename="a <>.pdf"', "doc_id")).when(k % 3 == 1, said("attachment; filename=\"____.txt\"; filename*=UTF-8''%C3%A9<>.txt", "doc_id")).otherwise(F.lit('attachment; filename="__-__.txt"'))
    return read(spark, folder, "documents").select("doc_id", tables.attachment_name(header).alias("name"))


@register("SELECT page_id, page_id || '%20a/%D0%B6%27%28%2A%29~' || page_id AS path FROM pages")
def encoded_paths(spark, folder):
    return pages(spark, folder, said("<> a\\ж'(*)~<>", "page_id", "page_id").alias("p")).select("page_id", urls.encoded_path("p").alias("path"))


@register("SELECT doc_id, sha256(text) AS form FROM documents WHERE text IS NOT NULL")
def decoded_bodies(spark, folder):
    """Bodies whose charset is named by the header, by a <meta>, or by nothing, read back without the <meta>."""
    meta = '<meta charset="utf-8">'
    rows = read(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text", (F.col("doc_id") % 3).alias("k"))
    body = F.when(F.col("k") == 0, F.encode("text", "UTF-16BE")).otherwise(F.encode(F.concat(F.when(F.col("k") == 1, meta).otherwise(""), "text"), "UTF-8"))
    made = rows.select("doc_id", "k", body.alias("body"), F.when(F.col("k") == 0, "text/html; charset=UTF-16BE").otherwise("text/html").alias("ct"))
    made = made.select("doc_id", "k", tables.decoded("body", "ct").alias("t"))
    return made.select("doc_id", F.sha2(F.when(F.col("k") == 1, F.substr("t", F.lit(len(meta) + 1))).otherwise(F.col("t")), 256).alias("form"))


@F.pandas_udf(BinaryType())
def _zipped(body: pd.Series) -> pd.Series:
    return body.map(lambda t: gzip.compress(t.encode(), 1), na_action="ignore")


@register("SELECT doc_id, sha256(text) AS form FROM documents WHERE text IS NOT NULL")
def unzipped_bodies(spark, folder):
    """Bodies packed under an address or a type that says so, and plain ones under an address that says so wrongly."""
    k = F.col("doc_id") % 3
    rows = read(spark, folder, "documents").where("text IS NOT NULL")
    rows = rows.select("doc_id", F.when(k == 2, F.encode("text", "UTF-8")).otherwise(_zipped("text")).alias("body"), F.when(k == 1, "a.xml").otherwise("a.xml.gz").alias("u"), F.when(k == 1, "application/gzip").otherwise("text/xml").alias("ct"))
    return rows.select("doc_id", F.sha2(tables.unzipped("body", "u", "ct"), 256).alias("form"))


@register("SELECT page_id, page_id % 5 < 3 AS is_binary, page_id % 4 = 1 AS login, page_id % 7 = 2 AS challenge FROM pages")
def body_marks(spark, folder):
    k, mark = F.col("page_id"), "<title>Just a moment...</title>"
    raw = F.when(k % 5 == 0, F.unhex(F.lit("0A20255044462D312E34"))).when(k % 5 == 1, F.unhex(F.lit("FFD8FFE000104A464946"))).when(k % 5 == 2, F.unhex(F.lit("000000186674797069736F6D"))).otherwise(F.encode(F.lit("<html>"), "UTF-8"))
    body = F.concat("html", F.when(k % 4 == 1, "<input type='password'>").otherwise(""))
    small = F.when(k % 7 == 2, mark).otherwise(F.concat(F.lit(mark), F.repeat(F.lit("x"), F.lit(60_000))))
    return pages(spark, folder, raw.alias("raw"), body.alias("body"), small.alias("small")).select("page_id", frontier.looks_binary("raw").alias("is_binary"), frontier.has_login_form("body").alias("login"), frontier.is_challenge("small").alias("challenge"))


@register("SELECT page_id, 'https://example.com/a/' || page_id || '/c' AS url FROM pages")
def dot_segments(spark, folder):
    return pages(spark, folder, said("https://example.com/./x/../a/<>/b/./../c", "page_id").alias("u")).select("page_id", urls.canonical_column(SITE, "u")["url"].alias("url"))


@register("""SELECT DISTINCT 'https://p.example.com/embed/' || page_id % 9 AS url, CASE WHEN page_id % 9 = 4 THEN 'done' ELSE 'new' END AS status FROM pages""")
def embeds_added(spark, folder):
    """Players of all pages are added once; the one known before keeps its state."""
    found = read(spark, folder, "pages").select(F.concat(F.lit("https://p.example.com/embed/"), F.col("page_id") % 9).alias("url"), F.col("url").alias("page_url"), F.col("page_id").cast(frontier.PLACE).alias("seq"))
    known = spark.range(1).select(F.lit("https://p.example.com/embed/4").alias("url"), F.lit("p").alias("page_url"), F.lit("done").alias("status"), F.col("id").cast(frontier.PLACE).alias("seq"))
    return frontier.added_embeds(known, found).select("url", "status")


@register("SELECT l_orderkey AS parent_id, min_by('m/' || l_partkey, l_linenumber * 10000000 + l_partkey) AS path FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey")
def page_media(spark, folder):
    """Order lines as files of a page (the order): the first stored media file of each."""
    rows = read(spark, folder, "lineitem").select((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("parent_id"), F.concat(F.lit("m/"), "l_partkey").alias("path"), F.lit("media").alias("kind"), F.when(F.col("l_returnflag") == "N", "queued").otherwise("done").alias("status"))
    return viewer.page_media(rows)


@register("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'v/' || page_id WHEN 1 THEN 'w/' || page_id WHEN 2 THEN 'x/' || page_id END AS path FROM pages")
def stored_videos_by_address(spark, folder):
    """By the exact address, by the other scheme, by the address in canonical form; every fourth is not stored."""
    k, plain = F.col("page_id") % 4, said("https://o.example.org/v/<>", "page_id")
    asked = pages(spark, folder, F.when(k == 2, said("https://example.com//v/<>?utm_source=x", "page_id")).otherwise(plain).alias("url"))
    address = F.when(k == 2, said("https://example.com/v/<>", "page_id")).when(k == 1, said("http://o.example.org/v/<>", "page_id")).otherwise(plain)
    path = F.when(k == 0, said("v\\<>", "page_id")).when(k == 1, said("w/<>", "page_id")).otherwise(said("x/<>", "page_id"))
    stored = read(spark, folder, "pages").where(k < 3).select(address.alias("url"), path.alias("path"), F.lit("done").alias("status"), F.col("page_id").alias("seq"))
    return viewer.stored_video(asked, stored, SITE).select("page_id", "path")


@register("""SELECT page_id, '#EXTM3U' || chr(10) || '#EXT-X-KEY:URI="http://l/d/k' || page_id || '.bin"' || chr(10) || 'http://l/d/' || page_id || '.mp3' || chr(10) || 'http://l/__ext__/o.org/b' || page_id AS made FROM pages""")
def playlist_addresses(spark, folder):
    playlist = said('#EXTM3U\n#EXT-X-KEY:URI="k<>.bin"\n<>.mp3\nhttps://o.org/b<>', "page_id", "page_id", "page_id")
    site = urls.UrlRules(scope=("e.com",), https=("e.com",))
    rows = pages(spark, folder, playlist.alias("t"), F.lit("https://e.com/d/l.m3u8").alias("b"), F.lit(False).alias("p"))
    return rows.select("page_id", viewer.rewritten_playlist(site, "http://l", "e.com")("t", "b", "p").alias("made"))


@register("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/a/' || page_id || '?b=1' ELSE '/__ext__/o.org/a/' || page_id END AS local,
    CASE WHEN page_id % 2 = 0 THEN 'https://e.com/a/' || page_id || '?b=1' ELSE 'https://o.org/a/' || page_id END AS back FROM pages""")
def viewer_paths(spark, folder):
    """Places in the viewer and back."""
    k = F.col("page_id") % 4
    u = F.when(k == 0, said("https://e.com/a/<>?b=1#c", "page_id")).when(k == 2, said("http://WWW.e.com/a/<>?b=1", "page_id")).otherwise(said("https://o.org/a/<>", "page_id"))
    rows = pages(spark, folder, u.alias("u")).select("page_id", viewer.local_path("u", "e.com", {"www.e.com": "e.com"}).alias("local"))
    return rows.select("page_id", "local", viewer.web_address("local", "e.com").alias("back"))


@register(r"SELECT page_id, (['a/1', '../1', '/1', 'C:1', 'a/../1', 'a..b/1', 'a\1', ''])[(page_id % 8 + 1)::INTEGER] AS path, page_id % 8 IN (0, 5) AS safe FROM pages")
def safe_paths(spark, folder):
    return pages(spark, folder, nth(("a/1", "../1", "/1", "C:1", "a/../1", "a..b/1", "a\\1", ""), "page_id").alias("path")).select("page_id", "path", viewer.safe_inside("path").alias("safe"))


RULES = admission.Rules(site=SITE, no_follow=("/es/",), include=("/de/1",), exclude=("/de/",))


@register("SELECT page_id, NOT contains(url, '/es/') AS follows, contains(url, '/de/') AND NOT contains(url, '/de/1') AS excluded FROM pages")
def follow_rules(spark, folder):
    return pages(spark, folder, "url").select("page_id", admission.follows(RULES, "url").alias("follows"), admission.excluded(RULES, "url").alias("excluded"))


@register("""WITH a AS (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages), k AS (SELECT count(*) AS n FROM a WHERE url <> '')
SELECT 'sources' AS part, 'a' AS value, n FROM k UNION ALL SELECT 'kinds', 'page', n FROM k UNION ALL SELECT 'outer_hosts', 'h' || page_id % 3 || '.test', count(*) FROM pages GROUP BY ALL
UNION ALL SELECT 'query_keys', 'p' || page_id % 2, count(*) FROM pages GROUP BY ALL UNION ALL SELECT 'sections', 's' || page_id % 4, count(*) FROM pages GROUP BY ALL""")
def probe_counters(spark, folder):
    """Counters of a page set: kinds and sources of its anchors; sections, query keys and outer hosts of addresses made of the ids."""
    found = links.from_html(read(spark, folder, "pages"), "page_id", "html").where("source = 'a'").withColumn("kind", F.lit("page"))
    k = F.col("page_id")
    own = F.concat(F.lit("https://example.com/s"), k % 4, F.lit("/x?p"), k % 2, F.lit("=1"))
    made = read(spark, folder, "pages").select(frontier.place("page_id", F.lit(0)).alias("seq"), F.explode(F.array(own, F.concat(F.lit("https://h"), k % 3, F.lit(".test/y")))).alias("url"), F.lit("page").alias("kind"), F.lit("a").alias("source"))
    anchors, addresses = reports.probe(found, SITE), reports.probe(made, SITE)
    parts = [of[p].select(F.lit(p).alias("part"), "value", "n") for of, names in ((anchors, ("sources", "kinds")), (addresses, ("outer_hosts", "query_keys", "sections"))) for p in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register(r"SELECT '| ' || r_regionkey || ' | ' || replace(r_name, 'A', 'A\|') || ' |' AS value FROM region")
def markdown_rows(spark, folder):
    rows = read(spark, folder, "region").withColumn("r_name", F.replace("r_name", F.lit("A"), F.lit("A|")))
    return sinks.markdown(rows, ("r_regionkey", "r_name"))


@register("SELECT page_id, 'https://v.example.com/api/v1/videos/' || page_id || 'abcdef' AS url FROM pages")
def video_addresses(spark, folder):
    """Addresses of a video in several forms have one API address."""
    form = F.when(F.col("page_id") % 2 == 0, said("https://v.example.com/videos/watch/<>abcdef?x=1", "page_id")).otherwise(said("https://v.example.com/w/<>abcdef", "page_id"))
    return pages(spark, folder, form.alias("u")).withColumn("f", media.queue_form("u")).select("page_id", "f.url")
