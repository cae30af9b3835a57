from sparrowsql.sources.tables import frame, query


def test_views_follow_the_files(spark, tmp_path):
    folder, path = f"{tmp_path}", f"{tmp_path}/region.parquet"
    spark.range(3).selectExpr("id AS r_regionkey", "'a' AS r_name").write.parquet(path)
    assert query(spark, folder, "SELECT COUNT(*) AS n FROM region").first()[0] == 3
    first = spark._sparrow_views[path]
    assert query(spark, folder, "SELECT COUNT(*) AS n FROM region").first()[0] == 3 and spark._sparrow_views[path] == first
    spark.range(5).selectExpr("id AS r_regionkey", "'a' AS r_name", "1.5 AS more").write.mode("overwrite").parquet(path)
    assert query(spark, folder, "SELECT COUNT(*) AS n, SUM(more) AS s FROM region").first() == (5, 7.5)
    spark.range(2).selectExpr("id AS r_regionkey", "'b' AS r_name", "1.5 AS more").write.mode("append").parquet(path)
    assert frame(spark, folder, "region").count() == 7
