"""Streams of responses: error bursts that pause a site, throughput, duplicate addresses.

The batch forms are windows over event time.  The streaming forms keep state per site: a burst empties its window when it
fires, as a pause does, which a window function cannot say.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FORBIDDEN = {"least": 10, "seconds": 120, "pause": 600, "distinct": False}
SERVER = {"least": 5, "seconds": 60, "pause": 120, "distinct": True}


def as_events(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """rows with a timestamp that watermarks accept (UTC session)."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def recent_counts(events: DataFrame, seconds: int, by: tuple[str, ...] = (), ts: str = "ts", distinct: str | None = None, out: str = "recent") -> DataFrame:
    """events with the number of events (or distinct values) of the last `seconds`, the event itself included.

    Time is cut into stretches of `seconds`; a copy of each event stands in the next stretch too, so that all that an event
    looks back on is in its stretch, and no window spans the whole table even where there is nothing to group by.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    stretch = F.floor(micros / (seconds * 1_000_000))
    both = events.withColumns({"__t": micros, "__own": F.explode(F.array(F.lit(True), F.lit(False)))}).withColumn("__s", stretch + F.when(F.col("__own"), 0).otherwise(1))
    here = Window.partitionBy(*by, "__s").orderBy("__t")
    if distinct is None:
        counted = both.withColumn(out, F.count("*").over(here.rangeBetween(-seconds * 1_000_000, 0)).cast("long"))
        return counted.where("__own").drop("__t", "__own", "__s")
    # A value counts from each of its events to its next one, or until the event is too old: a running sum of comings and goings.
    following = F.lead("__t").over(Window.partitionBy(*by, "__s", distinct).orderBy("__t"))
    gone = F.least(F.coalesce(following, F.lit(1 << 62)), F.col("__t") + seconds * 1_000_000 + 1)
    step = F.when(F.col(distinct).isNull(), 0).otherwise(1)
    changes = F.array(F.struct(F.col("__t").alias("t"), step.alias("d"), F.lit(True).alias("come")), F.struct(F.col("__g").alias("t"), (-step).alias("d"), F.lit(False).alias("come")))
    moved = both.withColumn("__g", gone).withColumn("__x", F.explode(changes)).withColumn("__t", F.col("__x.t")).drop("__g")
    total = F.sum("__x.d").over(here.rangeBetween(Window.unboundedPreceding, 0))
    return moved.withColumn(out, total.cast("long")).where("__own AND __x.come").drop("__t", "__own", "__s", "__x")


def throughput(events: DataFrame, seconds: int = 15, ts: str = "ts", size: str | None = None) -> DataFrame:
    """(start, n, bytes) of tumbling windows; works on streams (with a watermark) and tables."""
    more = [F.sum(size).alias("bytes")] if size else []
    return events.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), *more).select(F.col("w.start").alias("start"), "n", *(["bytes"] if size else []))


def fired(times: Iterable[tuple[float, str]], held: list[tuple[float, str]], least: int, seconds: int, distinct: bool, **_) -> tuple[list[tuple[float, str]], list[float]]:
    """(window left over, times at which a burst fired): the window is emptied whenever it fires."""
    out = []
    for t, url in times:
        held = [x for x in [*held, (t, url)] if t - x[0] < seconds]
        if len({u for _, u in held} if distinct else held) >= least:
            out.append(t)
            held = []
    return held, out


def pauses(events: DataFrame, kind: dict, site: str = "site", ts: str = "ts", url: str = "url", watermark: str = "10 minutes") -> DataFrame:
    """(site, at, until) of pauses that bursts call for in a stream of failing responses.

    A site's window is forgotten when the watermark has passed all of it, so state does not outlive what it is for.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists and state.get[0] else []
        rows = pd.concat(list(frames)).sort_values(ts)
        held, at = fired(zip(rows[ts].astype("datetime64[us]").astype("int64") / 1e6, rows[url]), held, **kind)
        if held:
            state.update(([t for t, _ in held], [u for _, u in held]))
            state.setTimeoutTimestamp(max(int((held[-1][0] + kind["seconds"]) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if at:
            stamps = pd.to_datetime(pd.Series(at), unit="s")
            yield pd.DataFrame({"site": key[0], "at": stamps, "until": stamps + pd.Timedelta(seconds=kind["pause"])})

    rows = events.select(F.col(site).alias("site"), F.col(ts).alias(ts), F.col(url).alias(url)).withWatermark(ts, watermark)
    return rows.groupBy("site").applyInPandasWithState(step, "site string, at timestamp, until timestamp", "times array<double>, urls array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def first_arrivals(events: DataFrame, url: str = "url", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """A stream of addresses without those seen within the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([url])
