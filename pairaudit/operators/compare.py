"""Models against the strongest of a set of null baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two published orders in which ties between nulls resolve.
NULL_ORDER_SIMILARITY_FIRST = ("sim_knn_k5", "additive", "host_only_RF", "guest_only_RF", "cond_only_RF", "source_only_RF")
NULL_ORDER_ADDITIVE_FIRST = ("additive", "host_only_RF", "guest_only_RF", "cond_only_RF", "source_only_RF", "sim_knn_k5")


def _place(model: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), model)


def strongest_null(scores: DataFrame, unit: Sequence[str], order: Sequence[str], value: str = "r2") -> DataFrame:
    """``(*unit, best_null, best_value, n_defined)``: the greatest defined
    score among the models of ``order``; ties go to the earlier one.  A unit
    without a defined null keeps its row, with nulls."""
    ours = scores.filter(F.col("model").isin(*order))
    key = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-_place(F.col("model"), order)).alias("t"), "model"))
    return (
        ours.groupBy(*unit)
        .agg(F.max(key).alias("__best"), F.count(value).alias("n_defined"))
        .select(*unit, F.col("__best.model").alias("best_null"), F.col("__best.v").alias("best_value"), "n_defined")
    )


def margins(scores: DataFrame, best: DataFrame, unit: Sequence[str], value: str = "r2") -> DataFrame:
    """``(*unit, model, value, best_null, margin)``; null if either is."""
    models = scores.select(*unit, "model", value)
    return models.join(best, list(unit)).select(
        *unit, "model", F.col(value), "best_null", (F.col(value) - F.col("best_value")).alias("margin")
    )


def equal_block(deltas: DataFrame, roster: DataFrame, by: Sequence[str], block: str = "block_id", value: str = "margin") -> DataFrame:
    """All-or-nothing mean over the roster's blocks: ``(*by, n_blocks,
    n_defined, n_positive, mean, sd, positive_share)``; one undefined or absent
    block makes the mean undefined, none is dropped."""
    full = roster.select(*by, block).distinct().join(deltas.select(*by, block, value), [*by, block], "left")
    whole = F.count(value) == F.count("*")
    return full.groupBy(*by).agg(
        F.count("*").alias("n_blocks"),
        F.count(value).alias("n_defined"),
        F.count_if(F.col(value) > 0).alias("n_positive"),
        F.when(whole, F.avg(value)).alias("mean"),
        F.when(whole, F.stddev_pop(value)).alias("sd"),
        F.avg(value).alias("mean_of_defined"),
    )


def weighted_block(deltas: DataFrame, by: Sequence[str], weight: str = "n", value: str = "margin") -> DataFrame:
    """Mean weighted by appearances, null if any member is undefined."""
    total = F.sum(weight)
    whole = (F.count(value) == F.count("*")) & (total > 0)
    return deltas.groupBy(*by).agg(
        total.alias("weight"), F.when(whole, F.sum(F.col(weight) * F.col(value)) / F.when(total > 0, total)).alias("mean")
    )


def changed_winners(before: DataFrame, after: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Units whose strongest null differs between two scenarios."""
    a = before.select(*unit, F.col("best_null").alias("before"))
    b = after.select(*unit, F.col("best_null").alias("after"))
    return a.join(b, list(unit), "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def wide_by_model(scores: DataFrame, unit: Sequence[str], models: Sequence[str], value: str = "r2") -> DataFrame:
    """One column per model, and the greatest of them (nulls skipped)."""
    wide = scores.groupBy(*unit).pivot("model", list(models)).agg(F.first(value, ignorenulls=True))
    return wide.withColumn("greatest", F.greatest(*models) if len(models) > 1 else F.col(models[0]))
