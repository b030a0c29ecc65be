from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairaudit.functions import numeric
from pairaudit.operators import compare, resample, scoring

UNITS = {
    "perfect": ([0, 1, 2], [0, 1, 2], scoring.DEFINED, 1.0),
    "flat_prediction": ([0, 1, 2], [1, 1, 1], scoring.NEAR_CONSTANT, None),
    "flat_target": ([1, 1, 1], [0, 1, 2], scoring.CONSTANT_TARGET, None),
    "one_row": ([1], [2], scoring.TOO_FEW, None),
    "nan": ([0, 1], [0, math.nan], scoring.NONFINITE, None),
    "null": ([0, 1], [0, None], scoring.NONFINITE, None),
    "infinite": ([0, 1], [0, math.inf], scoring.NONFINITE, None),
}


@pytest.fixture(scope="module")
def truth(spark):
    data = [(u, "m", float(y), None if p is None else float(p)) for u, (ys, ps, _, _) in UNITS.items() for y, p in zip(ys, ps, strict=True)]
    return spark.createDataFrame(data, "unit string, model string, y_true double, y_pred double")


def test_truth_table(spark, truth):
    roster = spark.createDataFrame([(u,) for u in [*UNITS, "empty"]], "unit string")
    got = {r.unit: r for r in scoring.guarded_scores(truth, ["unit"], roster=roster).collect()}
    for u, (_, _, status, r2) in UNITS.items():
        assert (got[u].status, got[u].r2) == (status, r2), u
    assert (got["empty"].n, got["empty"].status, got["empty"].r2) == (0, scoring.EMPTY, None)


def test_contracts(truth):
    def status(name, unit, by=("unit", "model")):
        rows = scoring.guarded_scores(truth, list(by), contract=scoring.CONTRACTS[name]).collect()
        return next(r for r in rows if r.unit == unit)

    assert status("standard", "flat_prediction").r2 == 0.0
    assert status("source_only", "flat_prediction").r2 == 0.0
    assert status("source_only", "flat_prediction").status == scoring.DEFINED
    assert status("full", "flat_prediction").r2 is None


def test_pooled_is_not_the_mean_of_blocks(spark):
    data = [("0", "m", 0.0, 0.0), ("0", "m", 1.0, 2.0), ("1", "m", 10.0, 10.0), ("1", "m", 11.0, 12.0)]
    df = spark.createDataFrame(data, "block_id string, model string, y_true double, y_pred double")
    rows = scoring.block_and_pooled_scores(df, ["model"]).collect()
    blocks = [r.r2 for r in rows if r.scope == "block"]
    pooled = next(r.r2 for r in rows if r.scope == "pooled")
    assert blocks == [-1.0, -1.0]
    assert pooled == pytest.approx(1 - 2 / 101)


def _spearman(y, p):
    def ranks(x):
        order = sorted(x)
        return [order.index(v) + (order.count(v) + 1) / 2 for v in x]

    return float(np.corrcoef(ranks(y), ranks(p))[0, 1])


def test_spearman_against_brute_force(spark):
    rng = random.Random(1)
    data = [(u, float(rng.randint(0, 12)), rng.choice([None, rng.gauss(0, 1), float(rng.randint(0, 5))])) for u in "abc" for _ in range(150)]
    data += [("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(data, "u string, y_true double, y_pred double")
    got = {r.u: r for r in scoring.spearman(df, ["u"]).collect()}
    for u in "abc":
        pairs = [(y, p) for v, y, p in data if v == u and p is not None]
        assert got[u].spearman == pytest.approx(_spearman(*zip(*pairs, strict=True)), abs=1e-12)
        assert got[u].n == len(pairs)
    assert (got["flat"].spearman, got["flat"].status) == (None, scoring.CONSTANT_TARGET)


def test_winner_ties_follow_the_order(spark):
    nulls = compare.NULL_ORDER_ADDITIVE_FIRST
    rows = [("a", m, 0.1) for m in nulls] + [("b", m, 0.4 if m == "host_only_RF" else 0.1) for m in nulls] + [("c", m, None) for m in nulls]
    df = spark.createDataFrame(rows, "block_id string, model string, r2 double")
    best = {r.block_id: r for r in compare.strongest_null(df, ["block_id"], nulls).collect()}
    assert best["a"].best_null == "additive"
    assert best["b"].best_null == "host_only_RF"
    assert (best["c"].best_null, best["c"].best_value) == (None, None)
    first = compare.strongest_null(df, ["block_id"], compare.NULL_ORDER_SIMILARITY_FIRST).filter("block_id = 'a'").first()
    assert first.best_null == "sim_knn_k5"


def test_undefined_block_keeps_its_place(spark):
    deltas = spark.createDataFrame([("m", "0", 0.4), ("m", "1", None)], "model string, block_id string, margin double")
    got = compare.equal_block(deltas, deltas, ["model"]).first()
    assert (got.n_blocks, got.n_defined, got.mean) == (2, 1, None)
    weighted = compare.weighted_block(deltas.withColumn("n", F.lit(3)), ["model"]).first()
    assert weighted["mean"] is None


#: Published margins of one model over twelve blocks have 11 positive signs;
#: any twelve with one small negative give the same exact tests.
MARGINS = [0.10, 0.21, -0.03, 0.08, 0.15, 0.02, 0.19, 0.05, 0.07, 0.25, 0.11, 0.04]


def test_exact_tests(spark):
    df = spark.createDataFrame([("m", str(i), v) for i, v in enumerate(MARGINS)], "model string, block_id string, margin double")
    w = resample.exact_wilcoxon(df, ["model"]).first()
    assert (w.n, w.w) == (12, 2.0)
    assert w.p_value == pytest.approx(6 / 4096)
    s = resample.exact_sign_test(df, ["model"]).first()
    assert (s.n_positive, s.p_value) == (11, pytest.approx(26 / 4096))
    pairs = resample.leave_two_out(df)
    assert pairs.count() == 66
    least = pairs.agg(F.min("mean")).first()[0]
    want = min(statistics.mean(v for k, v in enumerate(MARGINS) if k not in (i, j)) for i in range(12) for j in range(i + 1, 12))
    assert least == pytest.approx(want)


def test_bootstraps(spark):
    df = spark.createDataFrame([("m", str(i), v) for i, v in enumerate(MARGINS)], "model string, block_id string, margin double")
    got = resample.block_bootstrap(df, ["model"]).first()
    assert got.low < got["mean"] < got.high
    rng = random.Random(5)
    panel = spark.createDataFrame([("m", i % 20, y := rng.gauss(0, 1), y + rng.gauss(0, 0.3)) for i in range(400)], "model string, host bigint, y double, p double")
    cluster = resample.cluster_bootstrap(panel, ["model"], "host", "y", "p").first()
    assert cluster.n_clusters == 20
    assert cluster.low < cluster.r2 < cluster.high


def test_ulps(spark):
    values = [1.0, 1.5, 2.0, 4.0, 1e-300, 5e-324, 0.1, 1e300, 2.0**52, math.nextafter(2.0, 0), math.nextafter(4.0, 8), 3.7, 1e-308]
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double")
    for r in df.select("a", numeric.ulp(F.col("a")).alias("u"), numeric.ulp(F.col("b")).alias("v")).collect():
        assert r.u == math.ulp(r.a) == r.v

    def step(x, n):
        for _ in range(n):
            x = math.nextafter(x, 9)
        return x

    pairs = spark.createDataFrame([(step(1.0, 8), 1.0), (step(1.0, 9), 1.0), (None, None), (1.0, None)], "a double, b double")
    assert [r[0] for r in pairs.select(numeric.within_ulps(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
