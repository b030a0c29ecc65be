"""Which of many ranges a value falls in, in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_bucket(df: DataFrame, x: Column, edges: Column, name: str, depth: int) -> DataFrame:
    """``df`` with ``name``: how many of the sorted ``edges`` are below ``x``.

    A binary search of fixed depth over up to ``2 ** depth - 1`` edges, one
    projection per step; null falls in range 0.
    """
    df = df.withColumn(name, F.lit(0))
    for i in reversed(range(depth)):
        edge = F.get(edges, F.col(name) + F.lit((1 << i) - 1))
        df = df.withColumn(name, F.when(edge < x, F.col(name) + F.lit(1 << i)).otherwise(F.col(name)))
    return df
