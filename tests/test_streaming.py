"""Streaming forms against plain loops."""

import datetime

from webloom.streaming import bursts

START = datetime.datetime(2024, 1, 1)


def events(seconds):
    return [(START + datetime.timedelta(seconds=s), f"u{k % 7}", "a") for k, s in enumerate(seconds)]


def test_window_empties_when_it_fires():
    held, at = bursts.fired([(float(t), "u") for t in range(25)], [], **bursts.FORBIDDEN)
    assert at == [9.0, 19.0] and len(held) == 5
    assert bursts.fired([(float(t), "same") for t in range(50)], [], **bursts.SERVER)[1] == []
    assert bursts.fired([(float(t), f"u{t}") for t in (0, 1, 2, 3, 70)], [], **bursts.SERVER)[1] == []


def stream(spark, folder, rows):
    spark.createDataFrame(rows, "ts timestamp, url string, site string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("ts timestamp, url string, site string").parquet(folder)


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_pauses_of_a_stream(spark, tmp_path):
    rows = events(range(25))
    run(bursts.pauses(stream(spark, str(tmp_path / "in"), rows), bursts.FORBIDDEN), "pauses")
    got = sorted((r["at"] - START).total_seconds() for r in spark.table("pauses").collect())
    assert got == [9, 19]


def test_first_arrivals_of_a_stream(spark, tmp_path):
    run(bursts.first_arrivals(stream(spark, str(tmp_path / "in"), events(range(25)))), "arrivals")
    assert spark.table("arrivals").count() == 7


def test_throughput_of_a_stream(spark, tmp_path):
    df = stream(spark, str(tmp_path / "in"), events(range(0, 60, 2))).withWatermark("ts", "1 minute")
    run(bursts.throughput(df, 15), "rates", "complete")
    assert [r["n"] for r in spark.table("rates").orderBy("start").collect()] == [8, 7, 8, 7]


def test_recent_counts_equal_a_loop(spark):
    seconds = [0, 1, 1, 5, 59, 60, 61, 119, 120, 121, 300, 301]
    df = spark.createDataFrame([(k, START + datetime.timedelta(seconds=s), s % 2) for k, s in enumerate(seconds)], "id int, ts timestamp, v int")
    got = {r["id"]: (r["recent"], r["d"]) for r in bursts.recent_counts(bursts.recent_counts(df, 60), 60, distinct="v", out="d").collect()}
    for k, s in enumerate(seconds):
        near = [x for x in seconds if 0 <= s - x <= 60]
        assert got[k] == (len(near), len({x % 2 for x in near}))
