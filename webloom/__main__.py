"""Commands on an archive: python -m webloom COMMAND --data FOLDER [--config FILE.toml] [--results TABLE] [--robots TABLE] ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .archive import Archive
from .functions import urls
from .operators import admission
from .sources import tables

#: command -> (help, options beside --data and --config).
COMMANDS = {
    "crawl": ("fetch what is due until nothing is", ("results", "robots", "seeds", "rounds")),
    "relink": ("read stored pages for links again under changed rules", ("results", "robots", "match")),
    "status": ("counts by status and group, refusals, errors", ("by", "top")),
    "retry": ("queue failed rows again", ("status", "match")),
    "refresh": ("queue done rows again", ("match", "older_days")),
    "probe": ("counters of the stored pages' links", ("results", "out", "limit")),
    "serve": ("the stored rows for addresses", ("url",)),
    "index": ("bring the full-text index up to date", ("results", "rebuild")),
    "search": ("the best pages for a line", ("line",)),
    "catalog": ("HTML catalogue of files", ("out",)),
    "video": ("players whose videos are not stored", ()),
    "verify": ("compare rows with stored files", ("files", "fix")),
}
OPTIONS = {
    "results": {"help": "table of fetch results"}, "robots": {"help": "table of robots files (origin, text)"}, "seeds": {"nargs": "*", "default": []}, "rounds": {"type": int, "default": 50}, "match": {"default": ""}, "by": {"default": "section", "choices": ["section", "kind", "status", "ctype"]},
    "top": {"type": int, "default": 40}, "status": {"nargs": "+", "default": ["error", "auth"]}, "older_days": {"type": float, "default": 0}, "out": {"default": "out"}, "limit": {"type": int, "default": 3}, "url": {"nargs": "+", "default": []}, "rebuild": {"action": "store_true"},
    "line": {"default": ""}, "files": {"help": "folder of the stored files"}, "fix": {"action": "store_true"},
}


def rules_of(settings: dict) -> admission.Rules:
    """Admission rules of a settings file: tables [site] and [rules] with the names of the rules' fields."""
    as_tuple = lambda v: tuple(map(as_tuple, v)) if isinstance(v, list) else v
    site = {k: as_tuple(v) for k, v in settings.get("site", {}).items()}
    return admission.Rules(site=urls.UrlRules(**site), **{k: as_tuple(v) for k, v in settings.get("rules", {}).items()})


def shown(out) -> None:
    for name, rows in (out if isinstance(out, dict) else {"": out}).items():
        if isinstance(rows, DataFrame):
            print(name)
            rows.show(100, truncate=False)
        else:
            print(rows)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m webloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (told, options) in COMMANDS.items():
        sub = commands.add_parser(name, help=told)
        sub.add_argument("--data", required=True)
        sub.add_argument("--config", nargs="*", default=[])
        for o in options:
            sub.add_argument(f"--{o.replace('_', '-')}", **OPTIONS[o])
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("webloom").getOrCreate()
    config = tables.settings(*("\n".join(r["value"] for r in spark.read.text(f, wholetext=True).collect()) for f in given.config))
    archive = Archive(spark, given.data, rules_of(config), config.get("agent", "archiver"))
    read = lambda path: spark.read.parquet(path)
    run = {
        "crawl": lambda: archive.crawl(spark.createDataFrame([(u, "page") for u in given.seeds], "url string, kind string"), read(given.results), read(given.robots), time.time(), given.rounds),
        "relink": lambda: archive.relink(read(given.results), read(given.robots), given.match),
        "status": lambda: archive.status(given.by, given.top, next(iter(archive.rules.site.scope), "")),
        "retry": lambda: archive.retry(tuple(given.status), given.match),
        "refresh": lambda: archive.refresh(time.time(), given.match, given.older_days),
        "probe": lambda: archive.probe(read(given.results), given.out, given.limit),
        "serve": lambda: archive.serve(spark.createDataFrame([(u,) for u in given.url], "url string")).select("url", "row.*"),
        "index": lambda: archive.index(read(given.results), given.rebuild),
        "search": lambda: archive.search(given.line),
        "catalog": lambda: archive.catalog(given.out),
        "video": archive.video,
        "verify": lambda: archive.verify(tables.files(spark, given.files).select("path", F.col("length")), given.fix),
    }
    shown(run[given.command]())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
