"""Splits of products by hashed rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.ranks import numbered


def _shuffled(ids: DataFrame, seed: int) -> DataFrame:
    """product_id, its place k in the random order, and their number n."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("product_id").cast("string")))
    ranked = numbered(ids, order, "product_id", name="k")
    return ranked.withColumn("n", F.lit(ranked.count()))


def product_split(products: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """(product_id, split) with floor sizes for train and validation and the rest for test.

    The random order is that of a hash of seed and id.
    """
    if min(train, validation, test) < 0 or abs(train + validation + test - 1) > 1e-9:
        raise ValueError("the three shares must add up to 1")
    ids = products.select("product_id").where("product_id IS NOT NULL").distinct()
    ranked = _shuffled(ids, seed)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * validation)
    return ranked.select("product_id", F.when(F.col("k") <= a, "train").when(F.col("k") <= a + b, "validation").otherwise("test").alias("split"))


def temporary_split(products: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Train and test with max(1, round(n * test)) test products."""
    ids = products.select("product_id").where("product_id IS NOT NULL").distinct()
    ranked = _shuffled(ids, seed)
    return ranked.select("product_id", F.when(F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("n") * test)), "test").otherwise("train").alias("split"))


def split_summary(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows, products and their shares of each split."""
    by = rows.join(split, "product_id").groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("product_id").alias("n_products"))
    total = by.agg(F.sum("n_rows").alias("r"), F.sum("n_products").alias("p"))
    return by.join(F.broadcast(total)).select("split", "n_rows", "n_products", (F.col("n_rows") / F.col("r")).alias("row_share"), (F.col("n_products") / F.col("p")).alias("product_share"))
