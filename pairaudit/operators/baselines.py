"""Null baselines: what marginal means of the train rows already predict.

``members(unit..., role, row_index, y, <features>)`` is one long membership.
Means are partial aggregates over train rows per unit; test rows look them up.
A key that no train row has falls back to the unit's mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairaudit.operators.trees import target_encoded

SHRINK = 5.0


def _side(train: DataFrame, by: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    return train.groupBy(*by, *keys).agg(F.avg("y").alias(f"__m_{name}"), F.count("y").alias(f"__n_{name}"))


def null_panel(
    members: DataFrame,
    by: Sequence[str],
    sides: dict[str, Sequence[str]],
    host: str = "host",
    guest: str = "guest",
    shrink: float = SHRINK,
) -> DataFrame:
    """Long panel ``(*by, row_index, model, y_true, y_pred)`` of the test rows
    under each null: ``global_mean``, one per entry of ``sides`` (name to key
    columns), ``additive`` (shrunken effects of host and guest) and
    ``additive_sum`` (host mean + guest mean - global mean)."""
    train, test = members.filter("role = 'train'"), members.filter("role = 'test'")
    needed = {**sides, "__host": [host], "__guest": [guest]}
    overall = train.groupBy(*by).agg(F.avg("y").alias("__mu"))
    rows = test.join(overall, list(by), "left")
    for name, keys in needed.items():
        rows = rows.join(_side(train, by, keys, name), [*by, *keys], "left")
    mu = F.col("__mu")

    def effect(name: str):
        n = F.col(f"__n_{name}")
        return F.coalesce((F.col(f"__m_{name}") - mu) * n / (n + F.lit(shrink)), F.lit(0.0))

    def mean(name: str):
        return F.coalesce(F.col(f"__m_{name}"), mu)

    predictions = {
        "global_mean": mu,
        **{name: mean(name) for name in sides},
        "additive": mu + effect("__host") + effect("__guest"),
        "additive_sum": mean("__host") + mean("__guest") - mu,
    }
    models = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("y_pred")) for k, v in predictions.items()]))
    return rows.select(*by, "row_index", F.col("y").alias("y_true"), models.alias("__x")).select(
        *by, "row_index", "__x.model", "y_true", "__x.y_pred"
    )


def oof_encoded_ridge(
    members: DataFrame, by: Sequence[str], host: str = "host", guest: str = "guest", folds: int = 5, shrink: float = 5.0, alpha: float = 1.0
) -> DataFrame:
    """``(*by, row_index, y_true, y_pred)``: ridge on two target encodings.

    Train rows are encoded by the smoothed means of the other folds, whose own
    overall mean is the prior, test rows by those of all train rows.  Two
    features and an intercept need the 2 x 2 normal equations only, which are
    sums.
    """
    train, test = target_encoded(members, by, {host: "x1", guest: "x2"}, folds, shrink)
    overall = members.filter("role = 'train'").groupBy(*by).agg(F.avg("y").alias("__mean"))
    fit = train.join(overall, list(by)).withColumn("__r", F.col("y") - F.col("__mean"))
    moments = fit.groupBy(*by).agg(
        *[(F.covar_pop(a, b) * F.count("*")).alias(n) for a, b, n in (("x1", "x2", "c12"), ("x1", "__r", "c1"), ("x2", "__r", "c2"))],
        (F.var_pop("x1") * F.count("*") + F.lit(alpha)).alias("c11"),
        (F.var_pop("x2") * F.count("*") + F.lit(alpha)).alias("c22"),
        *[F.avg(c).alias(f"m_{c}") for c in ("x1", "x2", "__r")],
    )
    det = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12")
    solved = moments.select(
        *by,
        ((F.col("c1") * F.col("c22") - F.col("c2") * F.col("c12")) / det).alias("b1"),
        ((F.col("c2") * F.col("c11") - F.col("c1") * F.col("c12")) / det).alias("b2"),
        "m_x1",
        "m_x2",
        "m___r",
    )
    prediction = (
        F.col("__mean")
        + F.col("m___r")
        + F.col("b1") * (F.col("x1") - F.col("m_x1"))
        + F.col("b2") * (F.col("x2") - F.col("m_x2"))
    )
    return test.join(overall, list(by)).join(solved, list(by)).select(*by, "row_index", F.col("y").alias("y_true"), prediction.alias("y_pred"))
