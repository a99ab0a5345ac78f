"""How much Spark hands to a Python worker at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows in a batch. A worker holds them several times over outside the heap, and does not give that memory back.
ARROW_BYTES = 2 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Bounds the batches between executors and Python workers by bytes, unless the session has a bound of its own."""
    spark = spark or SparkSession.active()
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(ARROW_BYTES))
