"""Rows that every operator has to take: nulls, empty, blank and very long texts, ties, repeated rows, clashing columns."""

import pytest

LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "plain words of one small text here"), (5, "plain words of one small text here"), (6, "plain words of one small text here"), (None, "no id at all for these words"), (7, "é́ 漢字 😀 \u2028 ﻿ x"), (5, "another text under the same id")]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    # Columns whose names clash with those the operators use inside.
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"), F.lit(0).alias("id"), F.lit(0).alias("bucket"), F.lit("x").alias("edges"), F.lit(1).alias("component"), F.lit("k").alias("n_tokens"), *[F.lit(0).alias(n) for n in ("key", "tie", "cuts", "lines_deleted", "score", "lang_pred", "phrase_rate", "part", "guest", "a", "b", "ids")])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
