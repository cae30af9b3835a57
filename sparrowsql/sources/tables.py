"""SQL in the dialect over a folder of Parquet tables; scans keep pushdown and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowsql.functions.dialect import Rewriter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """The time and size of a table's file or folder: one call, however many files it has.

    Spark's writers put new files beside old ones or in their place, either of
    which changes a folder's time.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    return status.getModificationTime(), status.getLen()


def view(spark: SparkSession, path: str) -> str:
    """The name of a temporary view over a Parquet table; its schema and file list are read again only when the table changes."""
    known = spark.__dict__.setdefault("_sparrow_views", {})
    state = _state(spark, path)
    name, seen = known.get(path, (f"sparrow_files_{len(known)}", None))
    if seen != state:
        spark.read.parquet(path).createOrReplaceTempView(name)
        known[path] = (name, state)
    return name


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.table(view(spark, f"{folder}/{name}.parquet"))


def over_folder(spark: SparkSession, folder: str, tables: list[str] = TABLES, **options) -> Rewriter:
    """A rewriter that reads the named tables from folder/<name>.parquet."""
    known = {t.lower() for t in tables}
    return Rewriter(table=lambda name: view(spark, f"{folder}/{name.lower()}.parquet") if name.lower() in known else name, **options)


def query(spark: SparkSession, folder: str, sql: str, **options) -> DataFrame:
    return spark.sql(over_folder(spark, folder, **options).text(sql))
