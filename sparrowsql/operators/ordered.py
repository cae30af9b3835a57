"""Row numbers over a whole table in one order, without sorting it in one task.

The range of the first order column is cut at its approximate quantiles; each
range is numbered by itself and gets the number of rows in the ranges before it,
a frame of as many rows as ranges. A value that many rows share stays in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], column: str = "row_number", ranges: int | None = None) -> DataFrame:
    """df with each row's number in ascending order (nulls last); the first order column is a number, a date or a timestamp."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[order[0]].dataType.typeName()
    first = F.col(order[0]) if kind not in ("date", "timestamp", "timestamp_ntz") else F.unix_micros(F.col(order[0]).cast("timestamp"))
    first = first.cast("double")
    cuts = sorted(set(df.agg(F.percentile_approx(first, [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []))
    place = F.lit(0)
    if cuts:
        place = F.when(first.isNull(), len(cuts) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < first)))
    marked = df.withColumn("__range", place)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("__range").agg(F.count("*").alias("n"))  # a row for each range
    counts = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    joined = marked.withColumn("__own", F.row_number().over(own)).join(F.broadcast(counts), F.col("__range") == F.col("__r"))
    return joined.withColumn(column, F.col("__before") + F.col("__own")).drop("__range", "__r", "__own", "__before")


def _tile(number: Column, total: int, tiles: int) -> Column:
    size, more = divmod(total, tiles)  # the first `more` tiles hold one row more
    late = F.lit(more) + F.ceil((number - more * (size + 1)) / max(size, 1))
    return F.when(number <= more * (size + 1), F.ceil(number / (size + 1))).otherwise(late).cast("int")


def ntile(df: DataFrame, order: list[str], tiles: int, column: str = "bucket", ranges: int | None = None) -> DataFrame:
    """NTILE(tiles) OVER (ORDER BY order) of the whole table."""
    return numbered(df, order, "__number", ranges).withColumn(column, _tile(F.col("__number"), df.count(), tiles)).drop("__number")
