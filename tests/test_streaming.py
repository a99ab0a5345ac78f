from pyspark.sql import functions as F

from lumbung.streaming.incremental import clean_increments, new_files, read_reviews, windowed_sentiment


def test_increments_and_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00", 0.2, 0.8), ("a", "2024-01-01 23:00:00", 0.4, 0.6), ("b", "2024-01-02 01:00:00", 0.9, 0.1)], "product_id string, t string, p_negatif double, p_positif double")
    df = df.withColumn("timestamp", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = read_reviews(spark, str(tmp_path / "in"), df.schema)
    clean_increments(stream, lambda b: b.where("p_negatif < 0.5"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = windowed_sentiment(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["product_id"], r["n"], round(r["p_negatif"], 3)) for r in spark.table("windows").collect()}
    assert got == {("a", 2, 0.3), ("b", 1, 0.9)}
    files = spark.createDataFrame([("x",), ("y",)], "file string")
    assert [r[0] for r in new_files(files, files.where("file = 'x'")).collect()] == ["y"]
