"""What the words of an index cost, and that they are right where ids or words repeat."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.operators import links, main_text, search
from webloom.plans import registry

BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@pytest.fixture
def made(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["a", "b", "of", "the", "éa", "ü"]) for _ in range(rng.randrange(n)))
    rows = [(k, words(3), words(40)) for k in range(60)] + [(7, "the of", "of the of the")]
    return rows, search.documents(spark.createDataFrame(rows, "id long, t string, b string").repartition(3), "id", "t", "b")


def plain(rows):
    out = defaultdict(list)
    for k, *texts in rows:
        for col, t in zip(("title", "body"), texts):
            for p, w in enumerate(t.replace("é", "e").replace("ü", "u").split()):
                out[w, k, col].append(p)
    return {k: sorted(v) for k, v in out.items()}


def test_written_index_of_repeated_ids(spark, made, tmp_path):
    """Documents that share an id have their postings together and a length each; the texts are grouped without a shuffle."""
    rows, docs = made
    assert "Exchange" not in search.listed(docs.select("*").coalesce(1))._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    search.write_index(docs, str(tmp_path))
    postings, lengths = search.read_index(spark, str(tmp_path))
    got = {(r["term"], r["doc_id"], r["col"]): (r["tf"], r["positions"]) for r in postings.collect()}
    assert got == {k: (len(v), v) for k, v in plain(rows).items()} and postings.count() == len(got)
    assert sorted(tuple(r) for r in lengths.collect()) == sorted((k, len(t.split()) + len(b.split())) for k, t, b in rows)
    assert {(r["term"], r["doc_id"], r["col"]): (r["tf"], r["positions"]) for r in search.postings(docs).collect()} == got


def test_phrases_without_a_row_for_each_place(made):
    """Phrases with repeated words against plain texts; positions are compared as lists."""
    rows, docs = made
    rows, docs = rows[:-1], docs.where("doc_id <> 7").unionByName(docs.where("doc_id = 7").limit(0))
    index = search.postings(docs)
    for words in (("of", "the"), ("a", "a", "b"), ("ea",), ("the", "of", "the")):
        found = search.term_weights(index, search.Query(words, True))
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = {}
        for k, *texts in rows:
            lists = [t.replace("é", "e").replace("ü", "u").split() for t in texts]
            hits = [sum(tuple(x[p : p + len(words)]) == words for p in range(len(x))) for x in lists]
            if any(hits) and k != 7:
                want[k] = 8.0 * hits[0] + hits[1]
        assert {r["doc_id"]: r["t0"] for r in found.collect()} == want


@pytest.mark.parametrize("build", [
    lambda s, d: registry.QUERIES["norm_text_equality"](s, d), lambda s, d: registry.QUERIES["unzipped_bodies"](s, d),
    lambda s, d: main_text.main_text(s.read.parquet(f"{d}/pages.parquet"), "html", "page_id"), lambda s, d: links.from_html(s.read.parquet(f"{d}/pages.parquet"), "page_id", "html"),
    lambda s, d: search.documents(s.range(1).select("id", F.lit("é").alias("t")), "id", "t", "t"),
])
def test_batches_are_bounded(spark, data, build):
    """Workers get batches of few bytes, whatever the session has been set to."""
    before = {k: spark.conf.get(k) for k in BOUNDS}
    for k in BOUNDS:
        spark.conf.unset(k)
    build(spark, data)
    assert {k: spark.conf.get(k) for k in BOUNDS} == BOUNDS
    for k, v in before.items():
        spark.conf.set(k, v)
