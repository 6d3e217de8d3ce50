"""Corpus preparation: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written
as Parquet and read again for the next one.  All but the last return the columns of `documents`.

Defined results, besides those of the operators: a null id is never matched by another row, so such rows pass the
near-duplicate and benchmark stages by themselves; rows that repeat an id and text are one row after near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, session

#: Some stage is beyond SQL, so the rows of run() are tested against brute-force versions of the stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no learned language, go."""
    lang, score, rate = (session.free(n, *docs.columns) for n in ("lang_pred", "score", "phrase_rate"))
    model = language_id.train(docs)
    judged = language_id.predict(docs, model, passing=True, names=(lang, score, rate))
    letters = F.greatest(F.length(F.regexp_replace("text", r"\P{L}+", "")), F.lit(1))
    known = (F.col(rate) <= model.foreign) | (F.col(rate) <= model.foreign + language_id.SLACK / letters)
    return judged.where((F.col(lang) != "und") & known).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go from the texts; a document of which nothing is left goes."""
    n = session.free("lines_deleted", *docs.columns)
    cut = line_dedup.dedup_lines(docs, count_col=n).where((F.col(n) == 0) | F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the text decoded from them."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=True).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("bpe_encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
