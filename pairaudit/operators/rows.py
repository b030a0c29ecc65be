"""Row numbers and dense ids over a total order, without one global sort task.

A global ``row_number()`` sends every row to one task.  Here the rows are cut
into ranges of all order columns, so many values of one leading column make no
large range, and the number of ranges follows the number of rows.  Each range
is sorted by itself and written with its places; the ranges before it shift
them.  Rows that are equal in every order column are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairaudit.session import Materialized

#: Rows of a range, and ranges at most (their counts are ranked in one task).
ROWS_A_RANGE, MOST_RANGES = 500_000, 100_000


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_index", rows: int | None = None, store: Materialized | None = None) -> DataFrame:
    """``df`` with a bigint ``name`` from 0, dense and complete.

    Nulls come first.  ``rows`` is the number of rows if it is known.
    """
    n = min(MOST_RANGES, max(1, -(-(df.count() if rows is None else rows) // ROWS_A_RANGE)))
    by = [F.col(c).asc_nulls_first() for c in order]
    # the id is the range and, below it, the place; the ranges are drawn by
    # sampling, so they are written before they are counted
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    held = (store or Materialized(df.sparkSession, "numbered")).write(placed)
    ranges = held.groupBy(F.shiftright("__id", 33).cast("int").alias("__range")).agg(F.count("*").alias("__in"))  # ``n`` rows at most
    before = ranges.select("__range", (F.sum("__in").over(W.orderBy("__range")) - F.col("__in")).alias("__base"))
    return (
        held.withColumn("__range", F.shiftright("__id", 33).cast("int"))
        .join(F.broadcast(before), "__range")
        .withColumn(name, F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__range", "__id", "__base")
    )


def dense_ids(df: DataFrame, key: str, row_index: str = "row_index", name: str = "dense_id") -> DataFrame:
    """``(key, first_row, name)``: ids from 0 in the order in which the keys
    first appear."""
    first = df.groupBy(key).agg(F.min(row_index).alias("first_row"))
    return number_rows(first, ["first_row"], name)
