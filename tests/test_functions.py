"""Scalar functions on literal inputs and expected outputs."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from webloom.functions import dates, media, text, urls
from webloom.operators import search

SITE = urls.UrlRules(scope=("example.ru",), https=("example.ru",), aliases={"example.org": "example.ru"}, drop_params=("utm_*", "sid", "fbclid"))


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("HTTP://Example.RU/a/../b//c?utm_source=x&v&sid=3&q=1#top", None, "https://example.ru/b/c?v&q=1"),
        ("/x y", "https://example.ru/d/", "https://example.ru/x%20y"), ("?p=2", "https://example.ru/d/e?p=1", "https://example.ru/d/e?p=2"),
        ("//other.com/%7Ea/%d0%bf", "https://example.ru/", "https://other.com/~a/%D0%BF"), ("http://other.com/?utm_source=x", None, "http://other.com/?utm_source=x"),
        ("https://example.ru/путь", None, "https://example.ru/%D0%BF%D1%83%D1%82%D1%8C"), ("https://example.ru/100%", None, "https://example.ru/100%25"),
        ("http://other.com:80/", None, "http://other.com/"), ("http://other.com:8080", None, "http://other.com:8080/"), ("https://example.ru?", None, "https://example.ru/"),
        ("http://пример.рф/", None, "http://xn--e1afmkfd.xn--p1ai/"), ("mailto:a@b", None, None), ("javascript:x", "https://example.ru/", None), ("#a", "https://example.ru/", None),
        ("", None, None), (None, None, None), ("ftp://a/b", None, None), ("http://[bad", None, None), (" https://exa\nmple.ru/\t ", None, "https://example.ru/"), ("https://example.ru./", None, "https://example.ru/"),
    ],
)
def test_canonical(url, base, want):
    made = urls.canonical(url, SITE, base)
    assert (made[0] if made else None) == want


def test_alias_gives_both_addresses():
    assert urls.canonical("http://example.org:8080/a?b", SITE) == ("https://example.ru/a?b", "http://example.org:8080/a?b")


def test_canonical_columns_agree(spark):
    rows = ["http://example.ru//a//b?utm_x=1&c&d=2", "http://other.com/a//b?utm_x=1", "https://EXAMPLE.ru", "https://example.ru/?sid=1", "nothing"]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    got = df.select(urls.canonical_column(SITE, "url")["url"].alias("a"), urls.canonical_plain(SITE, "url").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


HASH = hashlib.sha1(b"d=1").hexdigest()[:8]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("https://h.ru/a/b.html",), "h.ru/a/b.html"), (("https://h.ru/",), "h.ru/index.html"), (("https://h.ru/a",), "h.ru/a/index.html"), (("https://h.ru/a.php", ".html"), "h.ru/a.php.html"),
        (("https://h.ru:81/a/x.pdf?d=1",), f"h.ru_81/a/x@{HASH}.pdf"), (("https://h.ru/d/1", ".epub", "Имя.epub"), "h.ru/d/1/Имя.epub"), (("https://h.ru/con/a:b.txt",), "h.ru/_con/a_b.txt"),
        (("https://h.ru",), "h.ru/index.html"), (("https://h.ru/a/?d=1", ".xml"), f"h.ru/a/index@{HASH}.xml"), (("https://h.ru/%D0%B6+x/%2Fa.HTM", ".html"), "h.ru/ж+x/_a.HTM"), (("https://h.ru/../%zz/. ./x.y.tar.gz",), "h.ru/_/%zz/_/x.y.tar.gz"),
        (("https://U@H.ru//Aux.txt",), "h.ru/_/_Aux.txt"),
    ],
)
def test_relative_path(spark, args, want):
    row = spark.createDataFrame([(*args, None, None)[:3]], "u string, e string, g string")
    assert row.select(urls.relative_path("u", F.col("e"), F.col("g"))).first()[0] == want


def test_long_names_are_cut(spark):
    names = ["x" * 300 + ".html", "y" * 300, "z" * 95 + ".unlikely-long"]
    made = [r[0] for r in spark.createDataFrame([(n,) for n in names], "v string").select(urls.file_name("v")).collect()]
    assert all(len(m) <= urls.LONGEST_NAME for m in made) and made[0].endswith(".html") and "~" in made[1]
    assert made[1] == "y" * 91 + "~" + hashlib.sha1(b"y" * 300).hexdigest()[:8]
    deep = "https://h.ru/" + "/".join(["segment" * 5] * 20) + "/a.html"
    path = column(spark, deep, "string", urls.relative_path("v"))[0]
    assert len(path) <= urls.LONGEST_PATH and path.startswith("h.ru/segment") and f"/_long/{hashlib.sha1(deep.encode()).hexdigest()[:12]}/a.html" in path


def column(spark, value, kind, *columns):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_url_columns(spark):
    assert list(column(spark, "https://U@h.Example.com:81/a/b.FB2.zip?x=1#y", "string", urls.host_of("v"), urls.path_of("v"), urls.query_of("v"), urls.extension("v"), urls.kind_by_extension("v"), urls.section("v"))) == ["h.example.com", "/a/b.FB2.zip", "x=1", "fb2.zip", "media", "a"]
    assert column(spark, "Text/HTML; charset=x", "string", urls.base_content_type("v"), urls.content_extension("v")) == ("text/html", ".html")
    assert column(spark, "a/b.tar.gz", "string", urls.told_apart("v", "v"), F.lit(urls.digest("a/b.tar.gz", 6))) == ("a/b.tar~1ca88b.gz", "1ca88b")
    assert column(spark, "д#/a b'~", "string", urls.encoded_path("v"))[0] == "%D0%B4%23/a%20b%27~"
    assert column(spark, "x12y34", "string", urls.rewrite_first("v", [(r"(\d)(\d)", r"\2\1")]))[0] == "x21y34"


def test_content_extensions(spark):
    kinds = {**urls.CONTENT_EXT, "Image/X-Icon; q=1": ".ico", "audio/mp4": ".m4a", "application/epub+zip": ".epub", "font/woff2": ".woff2", "application/x-tar": ".tar", "x/y": ".bin", "": ".bin", None: ".bin"}
    rows = spark.createDataFrame([(k,) for k in kinds], "v string")
    assert {r[0]: r[1] for r in rows.select("v", urls.content_extension("v")).collect()} == kinds


def test_search_form():
    assert text.search_form("Ёлка и̇ Сергий а́ бо́й ў") == "Елка и Сергий а бой ў"
    assert text.search_form("Crème Ångström") == "Creme Angstrom" and text.search_form("ß") == "ß"


def test_query_forms():
    assert search.match_expression("Отче наш") == '"отче"* AND "наш"*'
    assert search.match_expression("«Отче наш»") == '"отче наш"' and search.match_expression("я к он") == '"он"' and search.match_expression("!") is None


@pytest.mark.parametrize(("tries", "want"), [(0, 30), (1, 30), (2, 60), (5, 480), (20, 3600)])
def test_backoff(spark, tries, want):
    assert column(spark, tries, "int", dates.backoff("v", 30))[0] == want


@pytest.mark.parametrize(("header", "want"), [("120", 120), ("99999", 900), ("Mon, 15 Jan 2024 00:01:00 GMT", 60), ("Mon, 15 Jan 2020 00:01:00 GMT", 0), ("soon", None), (None, None)])
def test_retry_after(spark, header, want):
    df = spark.createDataFrame([(header, "2024-01-15 00:00:00")], "v string, now string")
    assert df.select(dates.retry_after("v", "now")).first()[0] == want


@pytest.mark.parametrize(("url", "late"), [("/days/2024-01-05", False), ("/days/2020-01-05", True), ("/days/2020-02-31", False), ("/x?date=2030-1-1", True), ("/calendar/1999/", True), ("/icons/1851/", False), ("/calendar/2024", False)])
def test_dates_outside(spark, url, late):
    assert column(spark, url, "string", dates.outside_dates("v", "2023-01-01", "2025-12-31", ("/days/", "/calendar/", "date=")))[0] is late


def test_nearest_dates(spark):
    got = [r["d"] for r in dates.nearest_first(spark, "2024-01-01", "2024-01-06", "2024-01-02").orderBy("place").collect()]
    assert got == [datetime.date(2024, 1, k) for k in (2, 3, 1, 4, 5, 6)]
    assert dates.nearest_first(spark, "2024-01-02", "2024-01-01", "2024-01-02").count() == 0


def test_video_files(spark):
    body = '{"name": "n", "thumbnailPath": "/static/t.jpg", "files": [{"resolution": {"id": 1080}, "fileDownloadUrl": "a"}, {"resolution": {"id": 480}, "fileUrl": "b"}], "streamingPlaylists": [{"files": [{"resolution": {"id": 720}, "fileDownloadUrl": "c"}, {"resolution": {"id": 0}, "fileDownloadUrl": "d"}]}]}'
    listing = '{"total": 120, "data": [{"uuid": "u1"}, {"shortUUID": "s2"}, {}]}'
    df = spark.createDataFrame([("https://v.ru/api/v1/videos/abcdefg", body), ("https://v.ru/api/v1/videos?start=50&count=50", listing), ("https://v.ru/x", "no json")], "url string, body string")
    got = {(r["parent"], r["url"], r["kind"]) for r in media.from_api(df, 720).collect()}
    assert {u for p, u, k in got if k == "media"} == {"c"} and ("https://v.ru/api/v1/videos/abcdefg", "https://v.ru/static/t.jpg", "asset") in got
    assert {u for p, u, k in got if "start=" in p} == {"https://v.ru/api/v1/videos/u1", "https://v.ru/api/v1/videos/s2", "https://v.ru/api/v1/videos?start=100&count=50&sort=publishedAt&isLocal=true"}
    assert {u for p, u, k in media.from_api(df, 100).collect() if k == "media"} == {"b"}


def test_text_columns(spark):
    assert column(spark, 'a & <mark>b</mark> "c"', "string", text.with_marks(F.col("v")))[0] == "a &amp; <mark>b</mark> &quot;c&quot;"
    assert column(spark, " a \t b\n \n c ", "string", text.cleaned(F.col("v")))[0] == "a b\nc"
    assert column(spark, "ÐºÐ½Ð¸Ð³Ð°", "string", text.repaired("v"))[0] == "книга" and column(spark, "é", "string", text.repaired("v"))[0] == "é"
    assert column(spark, 1536, "bigint", text.human_bytes("v"))[0] == "1.5 KB" and column(spark, 12, "bigint", text.human_bytes("v"))[0] == "12 B"
    assert column(spark, "Straße", "string", text.case_folded(F.col("v")))[0] == "strasse"
