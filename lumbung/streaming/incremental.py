"""Streams of reviews: new files by micro-batches, and event-time counts. An extension; the engine's rules are the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_reviews(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_sentiment(reviews: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Reviews and mean probabilities of each product and event-time window; later rows than ``late`` are dropped.

    The state holds one row for each open window and product, never the reviews.
    """
    by = reviews.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "product_id")
    return by.agg(F.count("*").alias("n"), F.avg("p_negatif").alias("p_negatif"), F.avg("p_positif").alias("p_positif")).select("product_id", F.col("window.start").alias("start"), "n", "p_negatif", "p_positif")


def clean_increments(reviews: DataFrame, clean: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Cleans each batch and writes it under its number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reviews.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no earlier run has seen."""
    return files.join(manifest.select("file"), "file", "left_anti")
