"""Operators on small tables: links, robots, admission, the queue, text, search, reports, viewer, sources and sinks."""

import gzip

from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import admission, frontier, links, main_text, reports, robots, search, viewer
from webloom.sources import sinks, tables

PAGE = """<html><head><base href="/b/"><title> A  page </title><link rel=stylesheet href=s.css><link rel="canonical" href="/c"><link rel=x href=/f.ico>
<meta property="og:image" content="/og.png"><meta http-equiv=refresh content="3; url='/next'"><style>@import "i.css"; a{background:url('/img/bg.png')}</style>
<script src=a.js>var u="https:\\/\\/example.com\\/p1", j='/x/'+a, q="/f/t.mp3";</script></head><body background=bg.gif><a href="/p"><a href="#x"><area href="/y.pdf">
<img src=i.png srcset="s1.png 1x, s2.png 2x" data-src=lazy.jpg><video src=v poster=p.jpg><source src=w></video><source src=z><iframe src=//yt.com/embed/1></iframe>
<div data-href="/d/1" data-x="no link" style="background:url(st.png)"></div><object data=o.swf></object><input type=image src=in.png>"""
WANTED = {
    ("s.css", "asset"), ("/c", "page"), ("/f.ico", "asset"), ("/og.png", "asset"), ("/next", "page"), ("i.css", "asset"), ("/img/bg.png", "asset"), ("a.js", "asset"), ("https://example.com/p1", "page"),
    ("/f/t.mp3", "media"), ("bg.gif", "asset"), ("/p", "page"), ("/y.pdf", "media"), ("i.png", "asset"), ("s1.png", "asset"), ("s2.png", "asset"), ("lazy.jpg", "asset"), ("v", "media"), ("p.jpg", "asset"),
    ("w", "media"), ("z", "asset"), ("//yt.com/embed/1", "embed"), ("/d/1", "page"), ("st.png", "asset"), ("o.swf", "embed"), ("in.png", "asset"),
}


def test_links_of_a_page(spark):
    found = links.from_html(spark.createDataFrame([(1, PAGE), (2, "<a href=/x <<<"), (3, None)], "id int, h string"), "id", "h").collect()
    rows = sorted((r for r in found if r["id"] == 1), key=lambda r: r["seq"])
    assert {(r["url"], r["kind"]) for r in rows} == WANTED and {r["base"] for r in rows} == {"/b/"}
    assert len({r["seq"] for r in rows}) == len(rows) and [r["url"] for r in rows[:3]] == ["s.css", "/c", "/f.ico"]
    sources = {r["url"]: r["source"] for r in rows}
    assert {u: sources[u] for u in ("/c", "s.css", "/f.ico", "i.css", "/next", "s1.png", "lazy.jpg", "st.png", "/d/1", "/f/t.mp3", "bg.gif", "p.jpg")} == {
        "/c": "link:canonical", "s.css": "link:stylesheet", "/f.ico": "link", "i.css": "style@import", "/next": "meta:refresh", "s1.png": "img:srcset", "lazy.jpg": "img:data-src", "st.png": "div:style", "/d/1": "div:data-href", "/f/t.mp3": "script:path",
        "bg.gif": "body:background", "p.jpg": "video:poster",
    }


def test_links_by_content_type(spark):
    rows = [
        (1, "https://e.com/", "text/html; charset=utf-8", "<a href=/p>"), (2, "https://e.com/s.css", "text/css", "a{b:url( 'x.png' )} @import 'y.css'; c{d:url(data:z)}"),
        (3, "https://e.com/sitemap.xml", "text/xml", "<urlset><loc> https://e.com/a?x=1&amp;y=2 </loc><image:loc><![CDATA[/i.jpg]]></image:loc><loc>/more.xml.gz</loc></urlset>"), (4, "https://e.com/l.m3u", "audio/mpegurl", "#EXTM3U\r\n a.mp3 \n\n#x\nb"),
        (5, "https://e.com/robots.txt", "text/plain", "User-agent: *\nSitemap: https://e.com/s.xml\n"), (6, "https://e.com/a.js", "application/javascript", r'x="https:\/\/e.com\/q.";y="/n/f.mp3";z="/no/ext";w="//cdn.e.com/r"'),
    ]
    df = spark.createDataFrame(rows, "id int, url string, ct string, body string")
    got = {(r["id"], r["url"], r["kind"]) for r in links.by_content(df, "id", "url", "ct", "body").collect()}
    assert got == {(1, "/p", "page"), (2, "x.png", "asset"), (2, "y.css", "asset"), (3, "https://e.com/a?x=1&y=2", "page"), (3, "/i.jpg", "asset"), (3, "/more.xml.gz", "sitemap"), (4, "a.mp3", "media"), (4, "b", "media"), (5, "https://e.com/s.xml", "sitemap"), (6, "https://e.com/q", "page"), (6, "/n/f.mp3", "media"), (6, "//cdn.e.com/r", "page")}


ROBOTS = "# c\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: x\nDisallow: /private/\nAllow: /private/open$\nDisallow: /*.zip$\nDisallow:\nCrawl-delay: 1,5\nClean-param: sid&ref /forum*\nDisallow: /тест\n"


def test_robots(spark):
    files = spark.createDataFrame([("https://e.com", ROBOTS)], "origin string, text string")
    asked = ["/private/a", "/private/open", "/private/open?x", "/a.zip", "/a.zip?x", "/ok", "/%D1%82%D0%B5%D1%81%D1%82/1", ""]
    df = spark.createDataFrame([(i, "https://e.com" + p) for i, p in enumerate(asked)] + [(99, "https://none.com/private/")], "id int, url string")
    got = {r["id"]: r["allowed"] for r in robots.allowed(df, robots.rules_table(files, "Archiver/1")).collect()}
    assert [got[i] for i in range(len(asked))] == [False, True, False, False, True, True, False, True] and got[99]
    assert robots.parse(ROBOTS, "the-other-bot")[0] == [(False, "/")] and robots.parse(ROBOTS, "y")[1] == 1.5
    cleaned = robots.cleaned_params(spark.createDataFrame([("https://e.com/forum/1?sid=1&a=2",), ("https://e.com/x?sid=1",)], "url string"), robots.params_table(files, "y"))
    assert {r["url"] for r in cleaned.collect()} == {"https://e.com/forum/1?a=2", "https://e.com/x?sid=1"}


RULES = admission.Rules(
    site=urls.UrlRules(scope=("e.com",), https=("e.com",)), rewrites=((r"/verse/(\d+)/\d+", r"/verse/\1"),), video_hosts=("v.e.com",), embed_hosts=("yt.com",), media_hosts=("files.org",), asset_blocklist=("ads.com", "cdn.com/track"),
    exclude=("/forum/",), include=("/forum/faq",), date_gates=("/days/",), dates=("2020-01-01", "2030-01-01"), login=("/my/",), max_depth=4, priorities=(("/important/", 1),), default_query_cap=2,
)


def arriving(spark, rows):
    return spark.createDataFrame([(i, r[0], "https://e.com/", r[1], r[2] if len(r) > 2 else 1, 7, r[3] if len(r) > 3 else 30, r[4] if len(r) > 4 else False) for i, r in enumerate(rows)], "seq long, raw string, base string, kind string, depth int, parent long, parent_priority int, external_parent boolean")


def test_admission_chain(spark):
    cases = [
        (("/a", "page"), "accept", "page", 50), (("/important/x", "page"), "accept", "page", 1), (("/i.png", "asset"), "accept", "asset", 30), (("/i.png", "asset", 1, None), "accept", "asset", 90), (("mailto:x", "page"), "drop", None, None),
        (("/forum/1", "page"), "exclude", None, None), (("/forum/faq", "page"), "accept", "page", 50), (("/days/1990-01-01", "page"), "date", None, None), (("/days/2024-01-01", "page"), "accept", "page", 50), (("/private/x", "page"), "robots", None, None),
        (("/private/i.png", "asset"), "accept", "asset", 30), (("/my/x", "page"), "login", None, None), (("/deep", "page", 5), "depth", None, None), (("https://other.com/x", "page"), "drop", None, None), (("https://other.com/i.png", "asset"), "accept", "asset", 30),
        (("https://ads.com/i.png", "asset"), "drop", None, None), (("https://cdn.com/track/i.png", "asset"), "drop", None, None), (("https://other.com/f.pdf", "media"), "accept", "media", 50), (("https://other.com/f.pdf", "media", 1, 30, True), "drop", None, None),
        (("https://files.org/f", "page"), "accept", "media", 50), (("https://yt.com/embed/abc", "embed"), "embed", None, None), (("https://yt.com/share", "page"), "drop", None, None), (("https://yt.com/embed/", "embed"), "drop", None, None), (("/frame", "embed"), "accept", "page", 50),
        (("/p", "page", 1, 30, True), "drop", None, None), (("/pf", "embed", 1, 30, True), "accept", "page", 50), (("/verse/3/16", "page"), "accept", "page", 50), (("https://v.e.com/w/abcdefg", "page"), "accept", "page", 50), (("https://v.e.com/about", "page"), "peertube", None, None),
    ]
    rules = robots.rules_table(spark.createDataFrame([("https://e.com", "User-agent: *\nDisallow: /private/")], "origin string, text string"), "a")
    judged = admission.judged(arriving(spark, [c[0] for c in cases]), RULES, rules).cache()
    got = {r["seq"]: r for r in judged.collect()}
    for i, (row, fate, kind, priority) in enumerate(cases):
        assert got[i]["fate"] == fate, (row, got[i])
        if fate == "accept":
            assert (got[i]["kind"], got[i]["priority"]) == (kind, priority), (row, got[i])
    assert got[26]["url"] == "https://e.com/verse/3" and got[27]["url"] == "https://v.e.com/api/v1/videos/abcdefg"
    skipped = {(r["reason"], r["prefix"]): (r["n"], r["example"]) for r in admission.skips(judged).collect()}
    assert skipped[("exclude", "forum")] == (1, "https://e.com/forum/1") and len(skipped) == 6
    twice = {(r["reason"], r["prefix"]): r["n"] for r in admission.added_skips(admission.skips(judged), admission.skips(judged)).collect()}
    assert twice[("exclude", "forum")] == 2


def test_query_cap_counts_new_variants_once(spark):
    rows = arriving(spark, [(f"/q?x={x}", "page") for x in (1, 2, 1, 3, 4)] + [("/q", "page"), ("/r?x=1", "page")])
    judged = admission.judged(rows, RULES)
    none = spark.createDataFrame([], "host_path string, n long")
    known = spark.createDataFrame([("https://e.com/q?x=3",)], "url string")
    fates = [r["fate"] for r in admission.within_query_cap(judged, RULES, known, none).orderBy("seq").collect()]
    assert fates == ["accept", "accept", "accept", "accept", "query_cap", "accept", "accept"]
    used = spark.createDataFrame([("e.com/q", 2)], "host_path string, n long")
    assert [r["fate"] for r in admission.within_query_cap(judged, RULES, known, used).orderBy("seq").collect()][:2] == ["query_cap", "query_cap"]


def test_merge_and_claims(spark):
    known = spark.createDataFrame([(1, "a", None, "page", 50, 1, None, "queued"), (2, "b", None, "page", 50, 1, None, "done")], "id long, url string, alt string, kind string, priority int, depth int, parent long, status string")
    new = spark.createDataFrame([(5, "c", None, "asset", 9, 2, 1), (3, "a", None, "asset", 10, 9, 1), (4, "b", None, "page", 1, 1, 1), (2, "c", "alt", "page", 20, 3, 2)], "seq long, url string, alt string, kind string, priority int, depth int, parent long")
    merged = frontier.numbered(frontier.merged(known, new))
    got = {r["url"]: r for r in merged.collect()}
    assert (got["a"]["priority"], got["a"]["kind"]) == (10, "page") and got["b"]["priority"] == 50
    assert (got["c"]["priority"], got["c"]["kind"], got["c"]["alt"], got["c"]["status"]) == (9, "page", "alt", "queued") and got["c"]["id"] > 2
    queue = merged.withColumn("next_try_at", F.lit(0.0))
    assert [r["url"] for r in frontier.claimed(queue, ("page", "asset"), 1.0, 5).collect()] == ["c", "a"]
    assert frontier.reset_active(queue.withColumn("status", F.lit("active"))).where("status = 'queued'").count() == 3


def test_places_without_regard_to_case(spark):
    rows = [(1, 1, "h/Dir/a.txt", "u1"), (2, 2, "h/dir/A.txt", "u2"), (3, 3, "h/DIR/b.txt", "u3"), (4, 4, "top.txt", "u4")]
    got = {r["id"]: r["path"] for r in frontier.reserved_paths(spark.createDataFrame(rows, "seq long, id long, path string, salt string")).collect()}
    assert got[1] == "h/Dir/a.txt" and got[3] == "h/Dir/b.txt" and got[4] == "top.txt"
    assert got[2].startswith("h/Dir/A~") and len({p.casefold() for p in got.values()}) == 4


def test_body_tests(spark):
    df = spark.createDataFrame([(b"  %PDF-1.4",), (b"\xff\xd8\xff\xe0",), (b"\0\0\0\x18ftypmp42",), (b"<html>",)], "b binary")
    assert [r[0] for r in df.select(frontier.looks_binary("b")).collect()] == [True, True, True, False]


BOILER = '<html class="sidebar-toggle"><body class="sidebar-hide"><header><h1>Site</h1></header><div class="main-menu">Menu</div><div class="sidebar">S</div><article><header class="entry-header"><h1>Head</h1></header><p>One<p>Two<br>Three<!--noindex--> no <!--/noindex--></article><div id=comments>C</div><footer>F</footer></body></html>'


def test_main_text():
    assert main_text.title_and_text(BOILER) == ("Head", "Head\nOne\nTwo\nThree")
    assert main_text.title_and_text("<title>T</title><div class=menu><ul><li>x<main><p>in</main></div>")[1].endswith("in")
    assert main_text.title_and_text('<div class="menu">' + "long text " * 400 + "</div>")[1].startswith("long text")
    assert main_text.title_and_text("<nav>unclosed<p>x</body><p>after") == ("", "after")
    assert main_text.title_and_text("<ul><li class=menu-item>Home<li>Kept</ul><p>Text") == ("", "Kept\nText")
    assert main_text.title_and_text("<p>" + "a" * 30 + "<p>b", limit=20)[1] == "a" * 30 and main_text.title_and_text("<b>" * 1200 + "x<p>y", limit=None, depth=None)[1] == "x\ny"
    assert [main_text.boiler_word(w) for w in ("menu", "menu-toggle", "has-sidebar", "post-header", "site-header", "comment-list", "ad", "nav_", "-nav", "x-ads", "show-ads", "single-x-header", "nav-x-on", "nav-on-x")] == [True, False, False, False, True, True, False, False, False, True, False, False, False, True]


def fts(spark):
    rows = [(1, "Отче наш", "Иже еси на небесех"), (2, "Наш дом", "отче и наш сын, наша земля"), (3, "Other", "the cat_sat on the mat"), (4, "X", "бой боя"), (5, "Y", "бои")]
    docs = search.documents(spark.createDataFrame(rows, "id int, t string, b string"), "id", "t", "b")
    return search.postings(docs), docs.select("doc_id", (F.size("title_words") + F.size("body_words")).alias("length"))


def test_search(spark, tmp_path):
    index, lengths = fts(spark)
    ids = lambda q: {r["doc_id"] for r in search.matches(index, search.parse(q)).collect()}
    assert ids("отче наш") == {1, 2} and ids('"отче наш"') == {1} and ids("cat sat") == {3} and ids("бой") == {4} and ids("нет") == set()
    order = [r["doc_id"] for r in search.page_of(search.ranked(index, lengths, search.parse("отче наш"))).collect()]
    assert order == [1, 2]
    assert search.capped_count(index, search.parse("наш"), cap=0).first()[0] == 1
    shown = spark.createDataFrame([("a b c отче <наш> d",)], "b string").select(search.snippet("b", search.parse("отче"))).first()[0]
    assert "<mark>отче</mark>" in shown and "&lt;наш&gt;" in shown
    search.write_index(search.documents(spark.createDataFrame([(1, "a", "b c")], "id int, t string, b string"), "id", "t", "b"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/postings").where("term = 'b'").count() == 1


def test_incremental_index(spark):
    pages = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "url string, sha1 string")
    indexed = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], "url string, sha1 string")
    assert {r["url"] for r in search.changed(pages, indexed).collect()} == {"b", "c"}
    queue = spark.createDataFrame([("a", "done", "text/html", "p"), ("b", "auth", None, None)], "url string, status string, content_type string, path string")
    assert {r["url"] for r in search.stale(indexed, queue).collect()} == {"b", "z"}


def test_viewer(spark):
    site = urls.UrlRules(scope=("e.com",), https=("e.com",))
    asked = spark.createDataFrame([("http://e.com/x/",)], "url string")
    got = [r["candidate"] for r in viewer.candidates(asked, site).orderBy("place").collect()]
    assert got == ["https://e.com/x/", "http://e.com/x/", "https://e.com/x"]
    pic = spark.createDataFrame([("https://e.com/it's-300x200.jpg",)], "url string")
    assert {"https://e.com/it's.jpg", "https://e.com/it%27s.jpg"} <= {r["candidate"] for r in viewer.candidates(pic, site).collect()}
    queue = spark.createDataFrame([("k1", "redirect", "k2", "u2"), ("k2", "done", None, None), ("l1", "redirect", "l2", "m2"), ("l2", "redirect", "l1", "m1"), ("self", "redirect", "self", "s"), ("out", "redirect", "gone", "g")], "key string, status string, location_key string, location string")
    ends = {r["key"]: (r["outcome"], r["target"]) for r in viewer.redirect_ends(queue, queue.select("key")).collect()}
    assert ends["k1"] == ("redirect", "u2") and ends["l1"] == ("missing", None) and ends["self"][0] == "missing" and ends["out"] == ("redirect", "g")
    html = spark.createDataFrame([('<a href="https://e.com/a"><a href="//o.org"> "https:\\/\\/e.com\\/b" <iframe src="//www.yt.com/embed/1"> https://e.community/',)], "h string")
    out = html.select(viewer.rewritten_links("h", "e.com", ("e.com", "o.org"), embed_hosts=("yt.com",))).first()[0]
    assert '<a href="/a">' in out and '"/__ext__/o.org/"' in out and '"\\/b"' in out and '"/__ext__/www.yt.com/embed/1"' in out and "https://e.community/" in out
    playlist = spark.createDataFrame([('#EXTM3U\r\n#EXT-X-KEY:URI="k.bin"\r\na.mp3\nhttps://o.org/b\n', "https://e.com/d/l.m3u8", False), ("[playlist]\nFile1=a.mp3\nTitle1=x\n", "https://e.com/d/l.pls", True)], "t string, b string, p boolean")
    made = [r[0] for r in playlist.select(viewer.rewritten_playlist(site, "http://l", "e.com")("t", "b", "p")).collect()]
    assert made == ['#EXTM3U\r\n#EXT-X-KEY:URI="http://l/d/k.bin"\r\nhttp://l/d/a.mp3\nhttp://l/__ext__/o.org/b\n', "[playlist]\nFile1=http://l/d/a.mp3\nTitle1=x\n"]


def test_catalogue_pages_and_sinks(spark, tmp_path):
    rows = [(i, "books", f"Book {i // 7}" if i % 5 else None, f"u{i}", f"p/{i}.pdf", i) for i in range(60)] + [(99, "audio", "A", "u", "p/x.mp3", 0)]
    files = spark.createDataFrame(rows, "id long, category string, parent_title string, url string, path string, size long")
    placed = reports.catalogue_pages(files, 20).cache()
    got = sorted((r for r in placed.collect() if r["category"] == "books"), key=lambda r: r["place"])
    want = sorted((r for r in rows if r[1] == "books"), key=lambda r: ((r[2] or "~").lower(), r[4].lower()))
    assert [r["id"] for r in got] == [r[0] for r in want] and [r["place"] for r in got] == list(range(1, 61))
    assert [r["page"] for r in got] == [1 + k // 20 for k in range(60)]
    for k, r in enumerate(got):
        assert r["header"] == (k % 20 == 0 or (got[k - 1]["parent_title"] or "") != (r["parent_title"] or ""))
    pages = sinks.html_pages(placed).collect()
    assert len(pages) == 4 and all(p["html"].count("<tr><td>") <= 20 for p in pages)
    sinks.write_csv(files, str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert part.startswith("\ufeffid;category".encode())
    sinks.write_snapshot(files, str(tmp_path / "state"))
    sinks.write_snapshot(files.limit(3), str(tmp_path / "state"))
    assert sinks.read_snapshot(spark, str(tmp_path / "state")).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "Dir").mkdir()
    (tmp_path / "Dir/A.html").write_bytes("<meta charset=windows-1251>Привет".encode("cp1251"))
    stored = tables.files(spark, str(tmp_path))
    wanted = spark.createDataFrame([("Dir/A.html", None), ("dir/a.HTML", "text/html; charset=windows-1251"), ("none", None)], "path string, ct string")
    got = tables.bodies(wanted, stored).select("path", tables.decoded("content", "ct").alias("t")).collect()
    assert len(got) == 2 and all(r["t"].endswith("Привет") for r in got)
    df = spark.createDataFrame([(gzip.compress(b"x"), "a.xml.gz", None), (b"\x1f\x8bbad", "a.gz", None), (gzip.compress(b"x"), "a", None)], "b binary, u string, c string")
    assert [bytes(r[0])[:1] for r in df.select(tables.unzipped("b", "u", "c")).collect()] == [b"x", b"\x1f", b"\x1f"]
    assert tables.decode("é".encode("latin-1"), "text/html; charset=latin-1") == "é" and tables.decode(b"\xd0", "x; charset=nonsense") == "�"
    assert tables.settings("a = 1\n[t]\nx = [1]\n", "[t]\nadd_x = [2]\ny = 3\n") == {"a": 1, "t": {"x": [1, 2], "y": 3}}
    names = {None: None, "attachment; filename=\"____.pdf\"; filename*=UTF-8''%D0%B0.pdf": "а.pdf", 'attachment; filename="b c.pdf"': "b c.pdf", 'attachment; filename="____.pdf"': None, "inline": None}
    df = spark.createDataFrame([(k,) for k in names], "h string")
    assert {r["h"]: r["n"] for r in df.select("h", tables.attachment_name(F.col("h")).alias("n")).collect()} == names
    assert tables.signature({"b": 1, "a": 2}) == tables.signature({"a": 2, "b": 1})
