"""Dates in addresses, seed dates, retry delays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A date in a path segment or a date= parameter, year 1600 on; and a calendar year.
DATE = r"(?:(?<=/)|(?<=[?&]date=))((?:1[6-9]|2\d)\d\d-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01]))(?!\d)"
CALENDAR_YEAR = r"/calendar/((?:1[6-9]|2\d)\d\d)(?=/|$|\?)"
LONGEST_WAIT, LONGEST_RETRY = 3600, 900


def outside_dates(url: str, first: str, last: str, gates) -> Column:
    """Whether a URL that a gate pattern lets through names a valid date, or a calendar year, outside [first, last]."""
    gated = reduce(lambda a, p: a | F.col(url).rlike(p), gates, F.lit(False))
    out = lambda d: F.coalesce((d < F.lit(first).cast("date")) | (d > F.lit(last).cast("date")), F.lit(False))
    days = F.transform(F.regexp_extract_all(F.col(url), F.lit(DATE), F.lit(1)), lambda t: F.try_to_date(t, "y-M-d"))
    years = F.regexp_extract_all(F.col(url), F.lit(CALENDAR_YEAR), F.lit(1))
    late = F.exists(years, lambda y: (y.cast("int") < F.year(F.lit(first).cast("date"))) | (y.cast("int") > F.year(F.lit(last).cast("date"))))
    return gated & (F.exists(days, out) | late)


def nearest_first(spark: SparkSession, first: str, last: str, centre: str) -> DataFrame:
    """(d, place): the dates of [first, last] from the one nearest to centre outwards, the later of two equals first."""
    middle = F.greatest(F.least(F.lit(centre).cast("date"), F.lit(last).cast("date")), F.lit(first).cast("date"))
    days = spark.range(1).select(F.explode(F.expr(f"IF(date'{first}' <= date'{last}', sequence(date'{first}', date'{last}'), array())")).alias("d"), middle.alias("m"))
    gap = F.datediff("d", "m")
    # Counted out from the middle, a date's place needs no sort: both sides alternate until the shorter one ends.
    ahead, behind = F.datediff(F.lit(last).cast("date"), F.col("m")), F.datediff(F.col("m"), F.lit(first).cast("date"))
    place = F.when(gap == 0, 0).when(gap > 0, gap + F.least(gap - 1, behind)).otherwise(-gap + F.least(-gap, ahead))
    return days.select("d", place.cast("int").alias("place"))


def clamped(spec_from, spec_to, first: str, last: str) -> tuple[str, str]:
    """A seed template's own dates inside the configured ones (ISO strings)."""
    return max(first, str(spec_from)) if spec_from else first, min(last, str(spec_to)) if spec_to else last


def backoff(tries: str, base: float) -> Column:
    """Seconds before the next try: doubled each time, an hour at most."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(F.col(tries) - 1, F.lit(0))), F.lit(float(LONGEST_WAIT)))


def retry_after(header: str, now: str) -> Column:
    """Seconds that a Retry-After header (a number, or an HTTP date against `now`) asks for, within limits; else null."""
    text = F.trim(F.col(header))
    date = F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.unix_timestamp(date).cast("double") - F.unix_timestamp(F.col(now).cast("timestamp")).cast("double")
    return F.when(text.rlike(r"^\d+$"), F.least(text.cast("double"), F.lit(float(LONGEST_RETRY)))).otherwise(F.greatest(F.lit(0.0), F.least(wait, F.lit(float(LONGEST_RETRY)))) * F.when(wait.isNotNull(), 1.0))
