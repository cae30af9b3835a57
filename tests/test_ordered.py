import pytest
from pyspark.sql import functions as F

from sparrowsql.operators import ordered


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_numbers_are_those_of_one_window(spark, ranges):
    values = [None, 5.0, 1.0, 1.0, 1.0, -3.5, 9.0, None, 2.0, 1.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    got = {r.id: r.row_number for r in ordered.numbered(frame, ["v", "id"], ranges=ranges).collect()}
    want = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] or 0.0, i))
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(1, 11))
    assert ordered.numbered(frame.limit(0), ["v", "id"]).count() == 0


@pytest.mark.parametrize(("rows", "tiles"), [(10, 3), (3, 7), (14, 7), (100, 9), (1, 1)])
def test_tiles(spark, rows, tiles):
    frame = spark.range(rows).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")))
    got = [r.bucket for r in ordered.ntile(frame, ["d"], tiles, ranges=4).orderBy("id").collect()]
    size, more = divmod(rows, tiles)
    assert got == [t for t in range(1, tiles + 1) for _ in range(size + (t <= more))]
