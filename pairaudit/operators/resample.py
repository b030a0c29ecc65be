"""Exact small-sample tests and resampling summaries."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Deltas up to which a signed-rank test counts all sign patterns.
MAX_EXACT = 50


def exact_wilcoxon(deltas: DataFrame, by: Sequence[str], value: str = "margin") -> DataFrame:
    """``(*by, n, w, p_value)``: signed-rank test by all sign patterns, for
    units of over ``MAX_EXACT`` deltas by the normal approximation.

    Zeros are dropped and tied magnitudes share their average rank.  Patterns
    are counted by their rank sum, one delta after the other, so a unit costs
    the square of its deltas.  Only small units are ranked in one place.
    """
    by = list(by)
    unit = by or ["__unit"]
    used = deltas.filter(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("__unit", F.lit(0))
    counted = used.groupBy(*unit).agg(F.count("*").alias("n"))
    small = counted.filter(F.col("n") <= MAX_EXACT)
    keep = [*unit, F.abs(F.col(value)).alias("__a"), (F.col(value) > 0).alias("__up")]
    whole, tie = W.partitionBy(*unit), W.partitionBy(*unit, "__a")
    ranked = used.select(*keep).join(small, unit, "left_semi")
    ranked = ranked.withColumn("__r", 2 * F.rank().over(whole.orderBy("__a")) + F.count("*").over(tie) - 1)
    folded = ranked.groupBy(*unit).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("__up"), F.col("__r")).otherwise(0)).alias("__plus"), F.collect_list("__r").alias("__ranks")
    )

    @F.pandas_udf("double")
    def p_value(ranks: pd.Series, plus: pd.Series) -> pd.Series:
        def one(doubled: np.ndarray, up: int) -> float:
            total = int(doubled.sum())
            patterns = np.zeros(total + 1)
            patterns[0] = 1.0
            for r in sorted(doubled):
                patterns[r:] += patterns[: total + 1 - r].copy()
            sums = np.arange(total + 1)
            w = min(up, total - up)
            return float(patterns[np.minimum(sums, total - sums) <= w].sum() / patterns.sum())

        return pd.Series([one(np.asarray(r, dtype=np.int64), int(u)) for r, u in zip(ranks, plus, strict=True)], dtype="float64")

    total = F.aggregate("__ranks", F.lit(0).cast("bigint"), lambda a, r: a + r)
    exact = folded.select(*by, "n", (F.least(F.col("__plus"), total - F.col("__plus")) / 2).alias("w"), p_value("__ranks", "__plus").alias("p_value"))
    large = used.join(counted.filter(F.col("n") > MAX_EXACT), unit, "left_semi")
    return exact.unionByName(normal_wilcoxon(large, unit, value).select(*by, "n", "w", "p_value"))


def exact_sign_test(deltas: DataFrame, by: Sequence[str], value: str = "margin") -> DataFrame:
    """``(*by, n, n_positive, p_value)``: two-sided binomial test at 1/2.

    The tail is summed from its greatest term down until nothing is added, so
    units of any size are exact to rounding.
    """
    counted = deltas.filter(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("n_positive")
    )

    @F.pandas_udf("double")
    def p_value(n: pd.Series, positive: pd.Series) -> pd.Series:
        def one(n: int, k: int) -> float:
            k = min(k, n - k)
            ratio, tail, i = 1.0, 0.0, k
            while i >= 0 and ratio > tail * 1e-17:
                tail += ratio
                ratio *= i / (n - i + 1)
                i -= 1
            return min(1.0, 2 * tail * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)))

        return pd.Series([one(int(a), int(b)) for a, b in zip(n, positive, strict=True)], dtype="float64")

    return counted.withColumn("p_value", p_value("n", "n_positive"))


def leave_two_out(deltas: DataFrame, key: str = "block_id", value: str = "margin", most: int = 1000) -> DataFrame:
    """``(a, b, mean)`` of the other blocks for each pair of blocks, null if
    a delta is; more than ``most`` blocks are refused."""
    blocks = deltas.select(key, value).limit(most + 1).collect()
    if len(blocks) > most:
        raise ValueError(f"over {most} blocks: too many to pair")
    known = deltas.select(F.col(key).alias("a"), F.col(value).alias("__va"))
    others = F.array(*[F.struct(F.lit(r[0]).alias("b"), F.lit(r[1]).cast("double").alias("v")) for r in blocks])
    pairs = known.withColumn("__o", F.explode(others)).filter(F.col("a") < F.col("__o.b"))
    whole = all(r[1] is not None for r in blocks)
    total, rest = F.lit(sum(r[1] for r in blocks) if whole else None).cast("double"), max(len(blocks) - 2, 0)
    mean = (total - F.col("__va") - F.col("__o.v")) / F.lit(rest or None).cast("double")
    return pairs.select("a", F.col("__o.b").alias("b"), mean.alias("mean"))


def block_bootstrap(deltas: DataFrame, by: Sequence[str], value: str = "margin", draws: int = 3000, seed: int = 0) -> DataFrame:
    """``(*by, n, mean, low, high)``: percentile interval of the mean over
    resampled blocks; a unit's blocks are few by design."""
    schema = ", ".join([*[f"`{c}` {deltas.schema[c].dataType.simpleString()}" for c in by], "n bigint, mean double, low double, high double"])

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy(dtype=float))
        picks = np.random.RandomState(seed).randint(0, len(x), size=(draws, len(x)))
        low, high = np.percentile(x[picks].mean(axis=1), [2.5, 97.5])
        return pd.DataFrame([[*key, len(x), x.mean(), low, high]])

    return deltas.filter(F.col(value).isNotNull()).groupBy(*by).applyInPandas(resample, schema)


def cluster_bootstrap(panel: DataFrame, by: Sequence[str], cluster: str, y: str, p: str, draws: int = 200) -> DataFrame:
    """``(*by, n_clusters, r2, low, high)``: interval of R2 over resampled
    clusters.

    Rows are reduced to sufficient sums per cluster, centred on the unit's
    mean; a draw gives each cluster a Poisson(1) count from its hash, so the
    draws of all clusters are sums too and nothing is duplicated or collected.
    """
    mean = panel.groupBy(*by).agg(F.avg(y).alias("__mu"))
    d, c = F.col(y) - F.col(p), F.col(y) - F.col("__mu")
    sums = panel.join(mean, list(by)).groupBy(*by, cluster).agg(
        F.count("*").alias("__n"), F.sum(c).alias("__s"), F.sum(c * c).alias("__ss"), F.sum(d * d).alias("__e")
    )
    cdf, term, bounds = 0.0, float(np.exp(-1)), []
    for i in range(8):
        cdf += term
        bounds.append(cdf)
        term /= i + 1
    drawn = sums.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    u = F.shiftrightunsigned(F.xxhash64(F.col(cluster), "__draw"), 11) / F.lit(float(1 << 53))
    times = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        times = F.when(u < bounds[i], i).otherwise(times)
    times = F.when(F.col("__draw") == 0, 1).otherwise(times)  # draw 0 is the sample itself
    w = drawn.withColumn("__w", times)
    total = w.groupBy(*by, "__draw").agg(
        *[F.sum(F.col("__w") * F.col(x)).alias(x) for x in ("__n", "__s", "__ss", "__e")], F.count("*").alias("__k")
    )
    n = F.when(F.col("__n") > 0, F.col("__n"))
    sst = F.col("__ss") - F.col("__s") * F.col("__s") / n
    scored = total.withColumn("__r2", F.when(sst > 0, 1 - F.col("__e") / F.when(sst > 0, sst)))
    resampled = F.when(F.col("__draw") > 0, F.col("__r2"))
    return scored.groupBy(*by).agg(
        F.max("__k").alias("n_clusters"),
        F.max(F.when(F.col("__draw") == 0, F.col("__r2"))).alias("r2"),
        F.percentile(resampled, F.lit(0.025)).alias("low"),
        F.percentile(resampled, F.lit(0.975)).alias("high"),
    )


def normal_wilcoxon(deltas: DataFrame, by: Sequence[str], value: str = "margin") -> DataFrame:
    """``(*by, n, w, z, p_value)``: signed-rank test by the normal
    approximation with the tie correction, for units too large to enumerate.

    Ranks come from distinct magnitudes (``average_ranks``), so no unit is
    ranked in one task.
    """
    from pairaudit.operators.scoring import average_ranks

    used = deltas.filter(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("__a", F.abs(F.col(value)))
    cells = used.groupBy(*by, "__a").agg(F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("__up"))
    ranked = cells.join(average_ranks(cells, by, "__a"), [*by, "__a"])
    n = F.sum("n")
    plus, total = F.sum(F.col("__up") * F.col("rank")), F.sum(F.col("n") * F.col("rank"))
    ties = F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n"))
    summed = ranked.groupBy(*by).agg(n.alias("n"), plus.alias("p"), total.alias("t"), ties.alias("ties"))
    mean = F.col("n") * (F.col("n") + 1) / 4
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    w = F.least("p", F.col("t") - F.col("p"))
    z = (w - mean) / F.sqrt(F.when(var > 0, var))

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return z.map(lambda v: None if v is None or v != v else min(1.0, erfc(abs(v) / sqrt(2))))

    return summed.select(*by, "n", w.alias("w"), z.alias("z")).withColumn("p_value", two_sided("z"))
