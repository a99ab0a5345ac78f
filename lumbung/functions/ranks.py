"""Numbers in the order of a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` with its rows' numbers from 1 in a total order.

    Rows are sorted in ranges; a row's number is its place in its range and the sizes of the ranges before, of which there is
    one count each. The sorted table is kept, so that ranges are the same for both looks at it.
    """
    kept = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("__at", 33)
    sizes = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts += [F.lit(p).cast("bigint"), F.lit(before).cast("bigint")]
        before += n
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return kept.withColumn(name, start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at")
