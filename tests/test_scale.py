"""What skew, very large ids and stopped writers must not break."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import admission, frontier, reports, robots
from webloom.sources import sinks, steps
from webloom.streaming import bursts


def test_order_of_arrival_for_very_large_ids(spark):
    asked = [(1 << 62, 1 << 40), (1 << 62, 3), ((1 << 62) + 1, 0), (5, (1 << 61)), (6, 0), (0, 0)]
    rows = spark.createDataFrame([(i, n) for i, n in asked], "id long, n long").select("id", "n", frontier.place("id", F.col("n")).alias("seq")).collect()
    assert [(r["id"], r["n"]) for r in sorted(rows, key=lambda r: r["seq"])] == sorted(asked) and all(r["seq"] is not None for r in rows)


def test_catalogue_of_files_without_titles(spark):
    """All files of a category lack a title: none of them is a group for one task, and the places are right."""
    rng = random.Random(1)
    rows = [(i, "audio", None if i % 50 else "", f"u{i}", f"d/{rng.randrange(10**6)}.mp3", 1) for i in range(3000)]
    files = spark.createDataFrame(rows, "id long, category string, parent_title string, url string, path string, size long").repartition(7)
    got = sorted(reports.catalogue_pages(files, 100).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 3001)) and [r["id"] for r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[4], r[0]))]
    assert [r["place"] for r in got if r["header"]] == list(range(1, 3001, 100))


def test_distinct_counts_of_a_burst(spark):
    """Thousands of events in a few seconds, few values, ties in time and nulls, against every window by itself."""
    rng = random.Random(2)
    rows = [(i, rng.randrange(40) + (0 if i % 3 else 1000), rng.choice(["a", "b", "c", "d", None]), i % 2) for i in range(1500)]
    events = spark.createDataFrame(rows, "i long, t long, url string, site int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["i"]: r["recent"] for r in bursts.recent_counts(events, 7, ("site",), distinct="url").collect()}
    assert got == {i: len({u for _, s, u, w in rows if w == site and t - 7 <= s <= t and u}) for i, t, _, site in rows}


def test_a_snapshot_stays_whole_when_a_writer_stops(spark, tmp_path):
    folder = str(tmp_path)
    for n in range(1, 13):
        sinks.write_snapshot(spark.range(n), folder)
    (tmp_path / "draft-snapshot-x").write_text("stopped before its rename")
    spark.range(99).write.parquet(f"{folder}/snapshot-never-pointed-to")
    assert sinks.read_snapshot(spark, folder).count() == 12 and len(list(tmp_path.glob("CURRENT-*"))) == 2


def test_a_cluster_has_to_name_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, other=None: other, set=lambda *a: None)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        steps.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert steps.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:///")


def test_robots_rules_without_expressions_equal_their_patterns(spark):
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice("ab/*$.%") for _ in range(rng.randrange(1, 6)))
    rules = sorted({"/" + piece() for _ in range(60)})
    paths = ["/" + "".join(rng.choice("ab/.") for _ in range(rng.randrange(7))) for _ in range(80)]
    table = robots.rules_table(spark.createDataFrame([(f"https://h{k}.test", f"User-agent: *\nDisallow: {r}\n") for k, r in enumerate(rules)], "origin string, text string"), "x")
    asked = spark.createDataFrame([(k, n, f"https://h{k}.test{p}") for k in range(len(rules)) for n, p in enumerate(paths)], "k int, n int, url string")
    got = {(r["k"], r["n"]): r["allowed"] for r in robots.allowed(asked, table).collect()}
    assert got == {(k, n): not re.search(robots.pattern_of(r), p) for k, r in enumerate(rules) for n, p in enumerate(paths)}


def test_variants_of_one_hot_path(spark):
    """Thousands of variants of one path: the cap takes the first, and the groups are cut before the shuffle."""
    rules = admission.Rules(site=urls.UrlRules(scope=("e.test",)), default_query_cap=3)
    judged = spark.range(4000).select(F.col("id").cast(frontier.PLACE).alias("seq"), F.concat(F.lit("https://e.test/q?x="), F.col("id") % 2000).alias("url"), F.lit("accept").alias("fate"))
    none = spark.createDataFrame([], "url string, host_path string, n long")
    out = admission.within_query_cap(judged, rules, none.select("url"), none.select("host_path", "n"))
    assert sorted(int(r["seq"]) for r in out.where("fate = 'accept'").collect()) == [0, 1, 2, 2000, 2001, 2002]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
