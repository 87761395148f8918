"""Consecutive numbers for the rows of a table in a given order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import written


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0 for the first row by ``order``, and so on; equal rows by chance.

    Rows are sorted by ranges and stored. Their number is the place in the range behind the
    sizes of the ranges before it, of which there are as many as the shuffle has parts.
    """
    stored = written(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    # that id has the range in its upper bits and the row's place in the lower 33
    part, row = F.shiftrightunsigned(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    # a row for each part of the shuffle: the rows themselves need not move for it
    return stored.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_first") + row).drop("_part", "_first")
