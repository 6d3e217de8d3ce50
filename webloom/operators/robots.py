"""robots.txt: from files to a rules table, and the verdict on each URL by a join on the origin."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions import urls

RULES = "origin string, allow boolean, raw string, pattern string, delay double"
PARAMS = "origin string, params array<string>, prefix string, pattern string"


def pattern_of(rule: str) -> str:
    """A path rule with * and a closing $ as a regular expression."""
    end = rule.endswith("$")
    body = rule[:-1] if end else rule
    return "^" + ".*".join(re.sub(r"([^A-Za-z0-9/_\-%~])", r"\\\1", part) for part in body.split("*")) + ("$" if end else "")


def parse(text: str, agent: str) -> tuple[list[tuple[bool, str]], float | None, list[tuple[list[str], str]]]:
    """(rules for the agent, crawl delay, clean-param entries) of one file.

    The agent's group is the first that names a part of the agent's whole name, else the first for *; empty rules say nothing.
    """
    groups: list[dict] = []
    clean, fresh = [], False
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not fresh:
                groups.append({"names": [], "rules": [], "delay": None})
            groups[-1]["names"].append(value.lower())
        elif key == "clean-param":
            names, _, prefix = value.partition(" ")
            clean.append(([n for n in names.split("&") if n], prefix.strip() or "/"))
        elif groups and key in ("allow", "disallow") and value:
            groups[-1]["rules"].append((key == "allow", value))
        elif groups and key == "crawl-delay" and re.fullmatch(r"[+-]?(\d+([.,]\d*)?|[.,]\d+)", value):
            groups[-1]["delay"] = float(value.replace(",", "."))
        fresh = key == "user-agent"
    named = [g for g in groups if any(n != "*" and n in agent.lower() for n in g["names"])]
    chosen = (named or [g for g in groups if "*" in g["names"]] or [{"rules": [], "delay": None}])[0]
    return chosen["rules"], chosen["delay"], clean


def rules_table(files: DataFrame, agent: str, origin: str = "origin", text: str = "text") -> DataFrame:
    """One row for each rule of each origin's file (origin, allow, raw, pattern, delay)."""

    def run(batches):
        for frame in batches:
            out = [(o, a, r, pattern_of(r), delay) for o, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for rules, delay, _ in [parse(t or "", agent)] for a, r in rules]
            yield pd.DataFrame(out, columns=["origin", "allow", "raw", "pattern", "delay"])

    return files.select(origin, text).mapInPandas(run, RULES)


def params_table(files: DataFrame, agent: str, origin: str = "origin", text: str = "text") -> DataFrame:
    """One row for each clean-param entry (origin, params, prefix, pattern)."""

    def run(batches):
        for frame in batches:
            yield pd.DataFrame([(o, p, x, pattern_of(x)) for o, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for p, x in parse(t or "", agent)[2]], columns=["origin", "params", "prefix", "pattern"])

    return files.select(origin, text).mapInPandas(run, PARAMS)


@F.pandas_udf(StringType())
def percent_decoded(text: pd.Series) -> pd.Series:
    from urllib.parse import unquote

    return text.map(lambda t: unquote(t, errors="replace"), na_action="ignore")


def decoded(url: str | Column) -> Column:
    """Percent-decoded text; what has no percent sign stays in the JVM."""
    c = F.col(url) if isinstance(url, str) else url
    return F.when(c.contains("%"), percent_decoded(c)).otherwise(c)


def target_of(url: str) -> Column:
    path, query = urls.path_of(url), urls.query_of(url)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def allowed(df: DataFrame, rules: DataFrame, url: str = "url", out: str = "allowed") -> DataFrame:
    """df with the verdict on each URL: the longest matching rule of its origin, allow among equals; allowed without any.

    Rules are gathered to one array per origin first, so that the join adds no rows: a URL is judged where it stands.  A
    rule list is as long as one file, which bounds the array.
    """
    origin = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    body = F.regexp_replace("raw", r"\*+$", "")
    whole = body.endswith("$")
    body = F.when(whole, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    rule = F.struct(F.length("raw").alias("n"), F.col("allow"), F.col("pattern"), body.alias("body"), whole.alias("whole"), body.contains("*").alias("wild"))
    lists = rules.groupBy(F.col("origin").alias("__o")).agg(F.collect_set(rule).alias("__r"))
    joined = df.withColumn("__o", origin).withColumn("__t", target_of(url)).withColumn("__d", decoded("__t")).join(lists, "__o", "left")
    # Only a rule with a * inside is a regular expression; the others are compared as they stand.
    fits = lambda t, r: F.when(r["wild"], F.rlike(t, r["pattern"])).when(r["whole"], t == r["body"]).otherwise(F.startswith(t, r["body"]))
    hit = F.array_max(F.transform(F.filter("__r", lambda r: fits(F.col("__t"), r) | (F.col("__d") != F.col("__t")) & fits(F.col("__d"), r)), lambda r: F.struct(r["n"], r["allow"])))
    return joined.withColumn(out, F.coalesce(hit["allow"], F.lit(True))).drop("__o", "__t", "__d", "__r")


def cleaned_params(df: DataFrame, params: DataFrame, url: str = "url") -> DataFrame:
    """df with the query parameters cut that the origin's file names as without meaning for the path."""
    origin = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    lists = params.groupBy(F.col("origin").alias("__o")).agg(F.collect_list(F.struct("params", "prefix", "pattern")).alias("__p"))
    path = urls.path_of(url)
    fits = F.filter("__p", lambda p: path.startswith(p["prefix"]) | F.rlike(path, p["pattern"]))
    joined = df.withColumn("__o", origin).join(lists, "__o", "left").withColumn("__n", F.transform(F.flatten(F.transform(fits, lambda p: p["params"])), F.lower))
    tokens = F.filter(F.split(urls.query_of(url), "&"), lambda t: ~F.array_contains(F.col("__n"), F.lower(F.regexp_extract(t, "^[^=]*", 0))))
    kept, front = F.array_join(tokens, "&"), F.regexp_extract(url, "^[^?#]*", 0)
    short = F.when(kept == "", front).otherwise(F.concat(front, F.lit("?"), kept))
    return joined.withColumn(url, F.when((urls.query_of(url) != "") & (F.size("__n") > 0), short).otherwise(F.col(url))).drop("__o", "__p", "__n")
