"""Session helpers: Arrow batch sizes, tables written between steps, joins that stay splittable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.steps import arrow, as_one, cleanup, forget, written

__all__ = ["arrow", "as_one", "cleanup", "documents", "forget", "free", "joined_back", "partitions", "written"]


def joined_back(rows: DataFrame, grouped: DataFrame, *keys: str) -> DataFrame:
    """rows joined to a table that was grouped by the keys.

    A join by the keys alone would reuse the grouping's partitions, and then a hot key's rows all meet in one task.  A hash
    beside the keys makes it a join of two plain shuffles, whose large partitions AQE splits.
    """
    beside = F.hash(*keys)
    return rows.withColumn("beside_", beside).join(grouped.withColumn("beside_", beside), [*keys, "beside_"]).drop("beside_")


def free(name: str, *taken: str) -> str:
    """name, with underscores behind it until it is none of the taken column names (in any case)."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
