"""Tables written between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in a file of a table whose number of rows is known beforehand.
FILE_ROWS = 2_000_000


def arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='webloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/webloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, and survives lost executors.

    rows: a bound of its rows, where the caller knows one; a small table is then one file, not one for each partition.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> list[str]:
    return sorted({f.rpartition("/")[0] for f in df.inputFiles() if "/webloom/" in f})


def as_one(tables: list[DataFrame]) -> DataFrame:
    """Tables made by written(), of one schema, as one scan: a union would put each of them into every plan that reads it."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[f for df in tables for f in _folders(df)])


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that written() made for this application; for callers that have stored their results."""
    _delete(spark, own_folder(spark))


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that no later plan reads."""
    for df in tables:
        for folder in _folders(df):
            _delete(df.sparkSession, folder)
