"""Queries with SQL on tables that hold what the small test tables do not."""

import duckdb
import pytest

from webloom.plans import registry


@pytest.fixture
def both(spark, tmp_path):
    """A function: rows of a query and of its SQL, over one table made by SQL."""

    def run(query, table, sql):
        path = f"{tmp_path}/{table}.parquet"
        con = duckdb.connect()
        con.sql(f"COPY ({sql}) TO '{path}' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
        got = registry.QUERIES[query](spark, str(tmp_path))
        key = lambda row: tuple((v is not None, v) for v in row)
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[query]})").fetchall()
        return sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key)

    return run


def test_sizes_beyond_a_terabyte(both):
    got, want = both("human_sizes", "orders", "SELECT unnest([0, 15, 16, 511, 524287, 524288, 524289, 700000, 9000000])::BIGINT AS o_orderkey")
    assert got == want and (524288, "1024.0 GB") in got


def test_partial_files_of_pages_that_share_a_url(both):
    """Pages 0 to 3 have one URL; the partial files of even pages are left over, each by itself."""
    got, want = both("set_difference_partials", "pages", "SELECT page_id, CASE WHEN page_id < 4 THEN 'https://e.test/a' WHEN page_id < 8 THEN 'https://e.test/' || page_id END AS url FROM range(12) r(page_id)")
    assert got == want and len(got) == 6


def test_titles_that_end_within_a_reference(both):
    """Headings cut within &amp; or &quot;, and entities that are none of the four."""
    ends = ["&amp", "&am", "&a", "&", "&quot", "&quo", "&quot;", "&amp;amp;", "&amp;lt;", "&nbsp;x", "&eacute;", "&#65;", "&lt;b&gt;", "&LT"]
    values = ", ".join(f"({k}, '<html><title>t</title><body><h1>Head &amp; {e}</h1><p>x</p></body></html>')" for k, e in enumerate(ends))
    got, want = both("title_h1", "pages", f"SELECT page_id::BIGINT AS page_id, html FROM (VALUES {values}) v(page_id, html)")
    assert got == want and (0, "Head & &amp") in got
