"""Queries that SQL cannot express, against plain versions."""

import html
import re
from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest

from webloom.functions import urls
from webloom.plans import registry
from webloom.plans.addresses import SITE


@pytest.fixture(scope="module")
def pages(data):
    return pq.read_table(f"{data}/pages.parquet").to_pylist()


def test_main_text_rows_against_plain_pages(spark, data, pages):
    """The pages' blocks are menus, an advert whose class is no word of the list, headings and paragraphs, and a footer."""
    got = {r["page_id"]: r["text"] for r in registry.QUERIES["main_text_rows"](spark, data).collect()}
    for page in pages:
        body = re.sub(r"(?s).*<body>|<nav>.*?</nav>|<footer>.*|<!--.*?-->", "", page["html"])
        lines = re.split(r"<(?:br|/?(?:p|h1|div|article)(?:\s[^>]*)?)>", re.sub(r"</?b>", "", body))
        want = "\n".join(t for x in lines for t in re.split(r"\n\s*", re.sub("[ \t\r\f\v\xa0]+", " ", html.unescape(x))) if t.strip())
        assert re.sub(r" *\n *", "\n", got[page["page_id"]]).strip() == re.sub(r" *\n *", "\n", want).strip()


def test_link_rows_against_a_plain_queue(spark, data, pages):
    """Anchors in order, canonical, judged by the query's rules, first come first served."""
    queue = {}
    for page in pages:
        for href in re.findall(r'<a href="([^"]+)"', page["html"]):
            made = urls.canonical(html.unescape(href), SITE, page["url"])
            if made and SITE.owns(urlsplit(made[0]).hostname) and "/fr/" not in made[0] and "/es/9" not in made[0]:
                queue.setdefault(made[0], 10 if "/en/" in made[0] else 20 if "/de/" in made[0] else 50)
    got = {r["url"]: r["priority"] for r in registry.QUERIES["link_rows"](spark, data).collect()}
    assert set(got) <= set(queue) and all(got[u] == queue[u] for u in got)
    # What is missing was refused by the pages' robots files.
    assert len(got) >= 0.5 * len(queue) and len(got) > 50


def test_file_places_against_plain_order(spark, data, pages):
    """Places are told apart without regard to case, the first page keeps the plain one."""
    got = {r["id"]: r["path"] for r in registry.QUERIES["file_places"](spark, data).collect()}
    assert len({p.casefold() for p in got.values()}) == len(got) == len(pages)
    taken = set()
    for page in pages:
        parts = urlsplit(urls.canonical(page["url"], SITE)[0])
        name = parts.path.removesuffix(".html") if parts.path.endswith(".html") else parts.path.rstrip("/") + "/index"
        place = parts.hostname + name + (f"@{urls.digest(parts.query)}" if parts.query else "") + ".html"
        if place.casefold() not in taken:
            assert got[page["page_id"]].casefold() == place.casefold()
        else:
            assert "~" in got[page["page_id"]]
        taken.add(place.casefold())
