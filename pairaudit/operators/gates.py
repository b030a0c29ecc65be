"""Gates: what must hold before outcomes may be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairaudit.operators.verify import fingerprint, require_empty
from pairaudit.session import Materialized


class GateError(RuntimeError):
    """A frozen table is not what it was."""


def gated(mask: DataFrame, baseline: Callable[[], DataFrame], outcome: Callable[[DataFrame], DataFrame], store: Materialized) -> DataFrame:
    """The outcome on a mask that was frozen before any outcome was read.

    1. The mask is written and its fingerprint taken.
    2. ``baseline()`` lists faults of the unmasked baseline; any stops the run.
    3. The mask is read again and must have its fingerprint still.
    4. Only then ``outcome(mask)`` is called.
    """
    frozen = store.write(mask)
    before = fingerprint(frozen)
    require_empty(baseline(), "baseline")
    if fingerprint(frozen) != before:
        raise GateError("the mask changed after it was frozen")
    return outcome(frozen)


def fold_spread(rows: DataFrame, fold: str, value: str, tolerance: float) -> DataFrame:
    """``(fold, n, mean, within)``: whether each fold's mean lies within
    ``tolerance`` deviations of the mean of all rows."""
    whole = rows.agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd")).withColumn("__one", F.lit(1))
    each = rows.groupBy(fold).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).withColumn("__one", F.lit(1))
    return each.join(whole, "__one").select(fold, "n", "mean", (F.abs(F.col("mean") - F.col("__mean")) <= tolerance * F.col("__sd")).alias("within"))
