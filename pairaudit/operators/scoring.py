"""Guarded scores of prediction panels.

A panel is long: one row per unit (split, block, model ...) and test row, with
target and prediction.  Scores come with a status; an undefined score is null,
never NaN, so it can't win a maximum or leak into a mean.

Everything but the rank correlation is one partial aggregate: sums of squares
come from ``var_pop`` (a merged, stable moment), so a unit of any size is
reduced in the tasks first and several grouping levels can share one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairaudit.functions.buckets import with_bucket
from pairaudit.functions.numeric import as_float32, finite
from pairaudit.session import Materialized

DEFINED = "DEFINED"
EMPTY = "UNDEFINED_EMPTY"
TOO_FEW = "UNDEFINED_TOO_FEW_ROWS"
NONFINITE = "UNDEFINED_NONFINITE_INPUT"
CONSTANT_TARGET = "UNDEFINED_CONSTANT_TARGET"
NEAR_CONSTANT = "UNDEFINED_NEAR_CONSTANT_PREDICTION"
NONFINITE_SCORE = "UNDEFINED_NONFINITE_SCORE"


@dataclass(frozen=True)
class Contract:
    """What a score asks of its rows.

    ``guard_prediction``: near-constant predictions are undefined; limited to
    ``guarded_models`` when that is given (by the ``model`` column).
    ``strict``: the guard is ``sd < limit`` instead of ``sd <= limit``.
    ``check_finite``: a non-finite value makes the unit undefined; else rows
    with one are left out.
    """

    min_rows: int = 2
    guard_prediction: bool = True
    guarded_models: tuple[str, ...] | None = None
    limit: float = 1e-9
    strict: bool = False
    check_finite: bool = True
    float32_target: bool = False
    float32_prediction: bool = False


#: The published variants of the score by the guard they apply.
CONTRACTS = {
    "full": Contract(),
    "job": Contract(min_rows=1, float32_target=True, float32_prediction=True),
    "tree": Contract(min_rows=1, float32_target=True),
    "standard": Contract(min_rows=1, guard_prediction=False, float32_target=True),
    "source_only": Contract(guarded_models=("source_only_RF",)),
    "comparator": Contract(guard_prediction=False),
    "diagnostic": Contract(min_rows=1, strict=True),
}


def _inputs(panel: DataFrame, y: str, p: str, contract: Contract) -> tuple[DataFrame, Column, Column]:
    target, prediction = F.col(y).cast("double"), F.col(p).cast("double")
    if contract.float32_target:
        target = as_float32(target)
    if contract.float32_prediction:
        prediction = as_float32(prediction)
    rows = panel.withColumns({"__y": target, "__p": prediction})
    rows = rows.withColumn("__ok", finite(F.col("__y")) & finite(F.col("__p")))
    if not contract.check_finite:
        rows = rows.filter("__ok")
    # sums over finite rows only, so that one NaN can't reach a moment
    return rows, F.when(F.col("__ok"), F.col("__y")), F.when(F.col("__ok"), F.col("__p"))


def _moments(y: Column, p: Column) -> list[Column]:
    d = y - p
    return [
        F.count("*").alias("n"),
        F.count_if(~F.col("__ok")).alias("__bad"),
        F.min(y).alias("__ymin"),
        F.max(y).alias("__ymax"),
        F.stddev_pop(p).alias("__sdp"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.sum(d * d).alias("sse"),
        F.avg(F.abs(d)).alias("mae"),
        (F.avg(y) - F.avg(p)).alias("offset"),
        F.covar_pop(y, p).alias("__cov"),
        F.var_pop(p).alias("__varp"),
        F.var_pop(y).alias("__vary"),
    ]


def _status(contract: Contract, has_model: bool) -> Column:
    flat = F.col("__sdp") < contract.limit if contract.strict else F.col("__sdp") <= contract.limit
    if not contract.guard_prediction:
        flat = F.lit(False)
    elif contract.guarded_models is not None:
        flat = flat & F.col("model").isin(*contract.guarded_models) if has_model else F.lit(False)
    return (
        F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, EMPTY)
        .when(F.col("n") < contract.min_rows, TOO_FEW)
        .when(F.col("__bad") > 0, NONFINITE)
        .when(F.col("__ymin") == F.col("__ymax"), CONSTANT_TARGET)
        .when(flat, NEAR_CONSTANT)
        .when(~finite(1 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst"))), NONFINITE_SCORE)
        .otherwise(DEFINED)
    )


def _finish(moments: DataFrame, by: Sequence[str], contract: Contract) -> DataFrame:
    ok = F.col("status") == DEFINED
    usable = (F.col("__bad") == 0) & (F.col("n") > 0)
    spread = F.col("__varp") > 0
    return (
        moments.withColumn("status", _status(contract, "model" in by))
        .withColumn("r2", F.when(ok, 1 - F.col("sse") / F.col("sst")))
        .select(
            *by,
            F.coalesce("n", F.lit(0)).alias("n"),
            "r2",
            "status",
            F.when(usable, F.col("mae")).alias("mae"),
            F.when(usable, F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"),
            F.when(usable, F.col("sst")).alias("sst"),
            F.when(usable, F.col("sse")).alias("sse"),
            F.when(usable, F.col("offset")).alias("offset"),
            F.when(usable & spread, F.col("__cov") / F.when(spread, F.col("__varp"))).alias("slope"),
            F.when(
                usable & spread & (F.col("__vary") > 0),
                F.col("__cov") / F.sqrt(F.when(F.col("__varp") * F.col("__vary") > 0, F.col("__varp") * F.col("__vary"))),
            ).alias("pearson"),
            F.when(usable, F.col("__sdp")).alias("prediction_sd"),
        )
    )


def guarded_scores(
    panel: DataFrame,
    by: Sequence[str],
    y: str = "y_true",
    p: str = "y_pred",
    contract: Contract = CONTRACTS["full"],
    roster: DataFrame | None = None,
) -> DataFrame:
    """One row per unit: n, r2, status, mae, rmse, sst, sse, offset, slope,
    pearson, prediction_sd.  Units of ``roster`` without rows are
    ``UNDEFINED_EMPTY`` rather than absent."""
    rows, target, prediction = _inputs(panel, y, p, contract)
    moments = rows.groupBy(*by).agg(*_moments(target, prediction))
    if roster is not None:
        moments = roster.select(*by).distinct().join(moments, list(by), "left")
    return _finish(moments, by, contract)


def contract_scores(panel: DataFrame, by: Sequence[str], contracts: Mapping[str, Contract], store: Materialized, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``guarded_scores`` under several contracts, with their name in
    ``contract``; all must check for finite values.

    The panel is read once: contracts differ in precision and in guards, so
    moments are taken for each precision and the guards applied to them."""
    kinds = sorted({(c.float32_target, c.float32_prediction) for c in contracts.values()})
    single = lambda name, i: F.when(F.array(*[F.lit(k[i]) for k in kinds])[F.col("__kind")], as_float32(F.col(name).cast("double"))).otherwise(F.col(name).cast("double"))
    rows = panel.withColumn("__kind", F.explode(F.array(*map(F.lit, range(len(kinds))))))
    rows = rows.withColumns({"__y": single(y, 0), "__p": single(p, 1)})
    rows = rows.withColumn("__ok", finite(F.col("__y")) & finite(F.col("__p")))
    kept = F.when(F.col("__ok"), F.col("__y")), F.when(F.col("__ok"), F.col("__p"))
    moments = store.write(rows.groupBy(*by, "__kind").agg(*_moments(*kept)))
    out = None
    for name, contract in contracts.items():
        own = moments.filter(F.col("__kind") == kinds.index((contract.float32_target, contract.float32_prediction)))
        part = _finish(own, by, contract).withColumn("contract", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def block_and_pooled_scores(
    panel: DataFrame,
    pooled_by: Sequence[str],
    block: str = "block_id",
    y: str = "y_true",
    p: str = "y_pred",
    contract: Contract = CONTRACTS["full"],
) -> DataFrame:
    """Block scores and the score over all blocks in one pass; ``scope`` tells
    them apart and the block of a pooled row is null."""
    rows, target, prediction = _inputs(panel, y, p, contract)
    keys = [*pooled_by, block]
    moments = rows.groupingSets([keys, list(pooled_by)], *keys).agg(
        F.grouping(block).alias("__pooled"), *_moments(target, prediction)
    )
    scored = _finish(moments.withColumn("scope", F.when(F.col("__pooled") == 1, "pooled").otherwise("block")), [*keys, "scope"], contract)
    return scored


def average_ranks(df: DataFrame, unit: Sequence[str], x: str, n: str = "n", depth: int = 6) -> DataFrame:
    """``(*unit, x, rank)`` for distinct values with multiplicity ``n``.

    A unit's values are spread over buckets by its quantiles; ranks are
    counted within a bucket and shifted by the buckets before, so no unit is
    ranked in one task.  Ties share their average rank.
    """
    values = df.groupBy(*unit, x).agg(F.sum(n).alias("__n"))
    cuts = F.array(*[F.lit(i / (1 << depth)) for i in range(1, 1 << depth)])
    edges = values.groupBy(*unit).agg(F.array_sort(F.percentile_approx(x, cuts, F.lit(2000))).alias("__edges"))
    joined = values.join(edges, list(unit))
    placed = with_bucket(joined, F.col(x), F.col("__edges"), "__bucket", depth).drop("__edges")
    before = placed.groupBy(*unit, "__bucket").agg(F.sum("__n").alias("__in"))
    before = before.withColumn("__base", F.sum("__in").over(W.partitionBy(*unit).orderBy("__bucket")) - F.col("__in"))
    upto = F.sum("__n").over(W.partitionBy(*unit, "__bucket").orderBy(x))
    ranked = placed.withColumn("__upto", upto).join(before.drop("__in"), [*unit, "__bucket"])
    rank = F.col("__base") + F.col("__upto") - (F.col("__n") - 1) / 2
    return ranked.select(*unit, x, rank.alias("rank"))


def spearman(panel: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred", guard: str = "values") -> DataFrame:
    """``(*by, n, spearman, status)`` over finite rows, ties averaged.

    Three guards: ``values`` leaves a constant side undefined; ``spread`` also
    predictions whose deviation is at most 1e-9; ``zero`` gives 0.0 wherever
    ``spread`` (with less than 1e-9) or the ranks leave it undefined."""
    if guard != "values":
        plain = spearman(panel, by, y, p)
        known = panel.filter(finite(F.col(y)) & finite(F.col(p)))
        spread = known.groupBy(*by).agg(F.stddev_pop(p).alias("__sd"))
        flat = F.col("__sd") <= 1e-9 if guard == "spread" else F.col("__sd") < 1e-9
        value = F.when(~flat, F.col("spearman"))
        return plain.join(spread, list(by)).select(
            *by, "n", (F.coalesce(value, F.lit(0.0)) if guard == "zero" else value).alias("spearman"),
            F.when((F.col("status") == DEFINED) & flat, NEAR_CONSTANT).otherwise(F.col("status")).alias("status"),
        )
    rows = panel.filter(finite(F.col(y)) & finite(F.col(p))).groupBy(*by, F.col(y).alias("__y"), F.col(p).alias("__p"))
    cells = rows.agg(F.count("*").alias("n"))
    ry = average_ranks(cells, by, "__y").withColumnRenamed("rank", "ry")
    rp = average_ranks(cells, by, "__p").withColumnRenamed("rank", "rp")
    w = F.col("n")
    sums = (
        cells.join(ry, [*by, "__y"])
        .join(rp, [*by, "__p"])
        .groupBy(*by)
        .agg(
            F.sum(w).alias("n"),
            F.sum(w * F.col("ry")).alias("a"),
            F.sum(w * F.col("rp")).alias("b"),
            F.sum(w * F.col("ry") * F.col("rp")).alias("ab"),
            F.sum(w * F.col("ry") * F.col("ry")).alias("aa"),
            F.sum(w * F.col("rp") * F.col("rp")).alias("bb"),
        )
    )
    va, vb = F.col("n") * F.col("aa") - F.col("a") * F.col("a"), F.col("n") * F.col("bb") - F.col("b") * F.col("b")
    product = va * vb
    value = (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(F.when(product > 0, product))
    status = F.when(va <= 0, CONSTANT_TARGET).when(vb <= 0, NEAR_CONSTANT).otherwise(DEFINED)
    return sums.select(*by, "n", F.when(product > 0, value).alias("spearman"), status.alias("status"))


def across_seeds(scores: DataFrame, by: Sequence[str], seed: str, value: str, n_seeds: int) -> DataFrame:
    """Mean, sample deviation, least and greatest over the seeds, null unless
    all ``n_seeds`` are there and defined."""
    whole = (F.countDistinct(seed) == n_seeds) & (F.count(value) == F.count("*"))
    return scores.groupBy(*by).agg(
        F.countDistinct(seed).alias("n_seeds"),
        F.when(whole, F.avg(value)).alias("mean"),
        F.when(whole, F.stddev_samp(value)).alias("sd"),
        F.when(whole, F.min(value)).alias("least"),
        F.when(whole, F.max(value)).alias("greatest"),
    )
