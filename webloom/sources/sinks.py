"""Writing results: snapshots with a pointer, spreadsheets, HTML pages, JSON and text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text, urls


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, path) of the pointers of a folder, the latest last."""
    path, fs = _path(spark, f"{folder}/CURRENT-*")
    found = [f.getPath().toString() for f in fs.globStatus(path) or ()]
    return sorted((int(f.rpartition("-")[2]), f) for f in found if f.rpartition("-")[2].isdigit())


def write_snapshot(df: DataFrame, folder: str, keep: int = 2) -> str:
    """Write a new snapshot of a state table, then a pointer to it with the next number; the last `keep` pointers stay.

    A pointer appears under its number by a rename, so a reader, or a writer that stops anywhere, finds the old state or the
    new one, whole.  Two writers at once cannot take one number.
    """
    spark, name = df.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    before = _pointers(spark, folder)
    draft, fs = _path(spark, f"{folder}/draft-{name}")
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    final, _ = _path(spark, f"{folder}/CURRENT-{(before[-1][0] if before else 0) + 1:012d}")
    if fs.exists(final) or not fs.rename(draft, final):
        raise OSError(f"cannot point {folder} to {name}")
    for _, old in before[: len(before) - keep + 1]:
        fs.delete(_path(spark, old)[0], False)
    return name


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    name = spark.read.text(_pointers(spark, folder)[-1][1]).first()[0]
    return spark.read.parquet(f"{folder}/{name}")


def has_snapshot(spark: SparkSession, folder: str) -> bool:
    return bool(_pointers(spark, folder))


def write_csv(files: DataFrame, folder: str, order: tuple[str, ...] = ("category", "id")) -> None:
    """Semicolon-separated files in order, each part with a header line that begins with a byte order mark, for spreadsheets."""
    first = files.columns[0]
    marked = files.orderBy(*order).withColumnRenamed(first, "﻿" + first)
    marked.write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(folder)


def html_pages(placed: DataFrame) -> DataFrame:
    """(category, page, html) of the rows of catalogue_pages(): a table for each page, a heading where the title changes."""
    title = F.when(F.coalesce("parent_title", F.lit("")) == "", "Without a page").otherwise(F.col("parent_title"))
    heading = F.when(F.col("header"), F.concat(F.lit("<tr><th colspan=2>"), text.escaped_html(title), F.lit("</th></tr>"))).otherwise("")
    name = F.regexp_extract("path", "[^/]*$", 0)
    size = F.when(F.coalesce("size", F.lit(0)) > 0, text.human_bytes("size")).otherwise("")
    row = F.concat(heading, F.lit("<tr><td><a href='../mirror/"), urls.encoded_path("path"), F.lit("'>"), text.escaped_html(name), F.lit("</a></td><td class=s>"), size, F.lit("</td></tr>"))
    lines = placed.select("category", "page", "place", row.alias("row")).groupBy("category", "page").agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))
    body = F.array_join(F.col("rows.row"), "\n")
    return lines.select("category", "page", F.concat(F.lit("<!DOCTYPE html><meta charset=utf-8><h1>"), F.col("category"), F.lit("</h1><table>\n"), body, F.lit("\n</table>")).alias("html"))


def write_html(pages: DataFrame, folder: str) -> None:
    pages.write.mode("overwrite").partitionBy("category", "page").text(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def markdown(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One text column with each row as a line of a Markdown table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("value"))
