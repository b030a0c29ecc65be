"""Queries on scores: contracts, nulls, margins, aggregation, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.operators import baselines, compare, curation, resample, scoring, verify
from pairaudit.plans.common import FINITE_SQL, MEMBERS_SQL, NULLS, PANEL_SQL, finite_panel, members, panel, r6
from pairaudit.session import Materialized
from pairaudit.sources.catalog import table

UNIT = ["split", "block_id", "model"]
SCORE_COLUMNS = ["r2", "mae", "rmse", "sst", "sse", "offset", "slope", "pearson"]


def _rounded(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.select(*keys, "n", "status", *[r6(c).alias(c) for c in SCORE_COLUMNS])


def guarded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its status; a single non-finite row makes it undefined."""
    return _rounded(scoring.guarded_scores(panel(spark, sf_dir), UNIT), UNIT)


def finite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the rows that can be scored."""
    return _rounded(scoring.guarded_scores(finite_panel(spark, sf_dir), UNIT), UNIT)


def score_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit set under each published contract."""
    out = scoring.contract_scores(finite_panel(spark, sf_dir), UNIT, scoring.CONTRACTS, Materialized(spark, "contracts"))
    return out.select(*UNIT, "contract", "n", r6("r2").alias("r2"), "status")


def block_and_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.block_and_pooled_scores(finite_panel(spark, sf_dir), ["split", "model"])
    return scored.select("split", "model", "block_id", "scope", "n", r6("r2").alias("r2"), "status")


def spearman_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.spearman(panel(spark, sf_dir), UNIT)
    return scored.select(*UNIT, "n", r6("spearman").alias("spearman"), "status")


def spearman_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation under the three guards, on predictions that are flat
    for one model, nearly flat for another."""
    flat = F.when(F.col("model") == "GINE", F.lit(1.0)).when(F.col("model") == "PAIR_RF", 1 + F.col("y_pred") * 1e-12).otherwise(F.col("y_pred"))
    rows, out = panel(spark, sf_dir).filter("split = 'host_cold'").withColumn("y_pred", flat), None
    for guard in ("values", "spread", "zero"):
        part = scoring.spearman(rows, ["model"], guard=guard).select(F.lit(guard).alias("guard"), "model", "n", r6("spearman").alias("spearman"), "status")
        out = part if out is None else out.unionByName(part)
    return out


def repeat_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two runs per block, and over all blocks of a split."""
    limits = {"mae": 0.02, "r2": 0.03, "spearman": 0.03}

    def scores(name: str) -> DataFrame:
        rows, out = panel(spark, sf_dir, name), None
        for unit, block in ((UNIT, F.col("block_id")), (["split", "model"], F.lit("ALL"))):
            one = scoring.guarded_scores(rows, unit).join(scoring.spearman(rows, unit).select(*unit, "spearman"), unit, "left")
            part = one.select("split", block.alias("block_id"), "model", *[F.round(c, 9).alias(c) for c in limits])
            out = part if out is None else out.unionByName(part)
        return out

    out = verify.metric_deltas(scores("predictions"), scores("predictions_repeat"), UNIT, limits)
    return out.select(*UNIT, "metric", r6("delta").alias("delta"), "threshold", "status")


def spearman_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation on the largest table, few units of many rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    scored = scoring.spearman(rows, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return scored.select("l_returnflag", "n", r6("spearman").alias("spearman"), "status")


SIDES = {"host_mean": ["host"], "guest_mean": ["guest"], "condition_mean": ["solvent", "ph"], "source_mean": ["source"]}


def null_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.null_panel(members(spark, sf_dir), ["block_id"], SIDES)


def null_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.guarded_scores(null_panel(spark, sf_dir), ["block_id", "model"])
    return scored.select("block_id", "model", "n", r6("r2").alias("r2"), "status", r6("mae").alias("mae"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.guarded_scores(null_panel(spark, sf_dir), ["block_id", "model"])
    # compared at nine digits, so that engines that add in another order agree on ties
    return compare.strongest_null(scored.withColumn("r2", F.round("r2", 9)), ["block_id"], NULLS)


def strongest_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("block_id", "best_null", r6("best_value").alias("best_value"), "n_defined")


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finite_panel(spark, sf_dir).filter("split = 'host_cold'")
    scored = scoring.guarded_scores(rows, ["block_id", "model"])
    with_n = compare.margins(scored, _best(spark, sf_dir), ["block_id"])
    return with_n.join(scored.select("block_id", "model", "n"), ["block_id", "model"])


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _margins(spark, sf_dir).select("block_id", "model", "n", "best_null", r6("r2").alias("r2"), r6("margin").alias("margin"))


def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "predictions").filter("split = 'host_cold'").select("model", "block_id").distinct()
    return found


def equal_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per model, the margin over the strongest null, equal blocks."""
    out = compare.equal_block(_margins(spark, sf_dir), _roster(spark, sf_dir), ["model"])
    return out.select("model", "n_blocks", "n_defined", "n_positive", *[r6(c).alias(c) for c in ("mean", "sd", "mean_of_defined")])


def weighted_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.weighted_block(_margins(spark, sf_dir), ["model"]).select("model", "weight", r6("mean").alias("mean"))


def across_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of double_cold stand for seeds."""
    scored = scoring.guarded_scores(finite_panel(spark, sf_dir), UNIT)
    out = scoring.across_seeds(scored, ["split", "model"], "block_id", "r2", 12)
    return out.select("split", "model", "n_seeds", *[r6(c).alias(c) for c in ("mean", "sd", "least", "greatest")])


def wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ["additive", "additive_sum", "guest_mean", "host_mean", "source_mean"]
    scored = scoring.guarded_scores(null_panel(spark, sf_dir), ["block_id", "model"])
    wide = compare.wide_by_model(scored, ["block_id"], models)
    return wide.select("block_id", *[r6(c).alias(c) for c in [*models, "greatest"]])


def exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _margins(spark, sf_dir)
    w = resample.exact_wilcoxon(rows, ["model"]).select("model", "n", "w", F.col("p_value").alias("wilcoxon_p"))
    s = resample.exact_sign_test(rows, ["model"]).select("model", "n_positive", F.col("p_value").alias("sign_p"))
    return w.join(s, "model").select("model", "n", r6("w").alias("w"), r6("wilcoxon_p").alias("wilcoxon_p"), "n_positive", r6("sign_p").alias("sign_p"))


def _double_cold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.guarded_scores(finite_panel(spark, sf_dir).filter("split = 'double_cold'"), ["block_id", "model"])
    a = scored.filter("model = 'PAIR_RF'").select("block_id", F.col("r2").alias("a"))
    b = scored.filter("model = 'GINE'").select("block_id", F.col("r2").alias("b"))
    return a.join(b, "block_id").select("block_id", (F.col("a") - F.col("b")).alias("margin"))


def leave_two_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.leave_two_out(_double_cold_deltas(spark, sf_dir))
    return out.select("a", "b", r6("mean").alias("mean"))


def leave_two_out_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.leave_two_out(_double_cold_deltas(spark, sf_dir))
    return out.agg(F.min(F.struct(F.round("mean", 6).alias("mean"), "a", "b")).alias("x")).select("x.*")


def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.block_bootstrap(_margins(spark, sf_dir), ["model"])


def host_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.cluster_bootstrap(finite_panel(spark, sf_dir), ["split", "model"], "host_id", "y_true", "y_pred")


def oof_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baselines.oof_encoded_ridge(members(spark, sf_dir), ["block_id"])
    return scoring.guarded_scores(rows, ["block_id"]).select("block_id", "n", r6("r2").alias("r2"), "status")


def winner_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose strongest null is another one without the additive null."""
    scored = scoring.guarded_scores(null_panel(spark, sf_dir).filter("model <> 'additive'"), ["block_id", "model"])
    fewer = compare.strongest_null(scored.withColumn("r2", F.round("r2", 9)), ["block_id"], [m for m in NULLS if m != "additive"])
    return compare.changed_winners(_best(spark, sf_dir), fewer, ["block_id"])


def bias_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curation.bias_share(finite_panel(spark, sf_dir), ["split", "model"], "y_true", "y_pred")
    return out.select("split", "model", "n", *[r6(c).alias(c) for c in ("mse", "bias", "bias_share")])


def sse_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each host in a model's squared error, with group means."""
    d = F.col("y_true") - F.col("y_pred")
    hosts = finite_panel(spark, sf_dir).groupBy("model", "host_id").agg(
        F.count("*").alias("n"), F.sum(d * d).alias("sse"), F.avg("y_true").alias("mean_y"), F.avg("y_pred").alias("mean_p")
    )
    total = hosts.groupBy("model").agg(F.sum("sse").alias("total"))
    share = F.col("sse") / F.when(F.col("total") > 0, F.col("total"))
    return hosts.join(total, "model").select("model", "host_id", "n", r6(share).alias("share"), r6("mean_y").alias("mean_y"), r6("mean_p").alias("mean_p"))


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest squared errors."""
    d = F.col("y_true") - F.col("y_pred")
    rows = finite_panel(spark, sf_dir).select(*UNIT, "row_index", F.round(d * d, 6).alias("squared_error"))
    return rows.orderBy(F.desc("squared_error"), *UNIT, "row_index").limit(10)


def target_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose single-precision target is not one over all models."""
    from pairaudit.operators.verify import disagreeing

    return disagreeing(panel(spark, sf_dir), ["row_index"], F.col("y_true").cast("float"))


def mask_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without the rows whose guest also stands in a train row of the
    block, next to the scores of all rows and of the removed rows."""
    rows = finite_panel(spark, sf_dir).filter("split = 'host_cold'")
    known = members(spark, sf_dir).filter("role = 'train' AND guest IS NOT NULL").select("block_id", F.col("guest").alias("guest_id")).distinct()
    keys = rows.join(known, ["block_id", "guest_id"], "left_semi").select("block_id", "row_index").distinct()
    # each row counts in two scenarios, so the panel is read once
    flagged = rows.join(keys.withColumn("seen", F.lit(True)), ["block_id", "row_index"], "left")
    own = F.when(F.col("seen"), "removed").otherwise("retained")
    scenarios = flagged.withColumn("scenario", F.explode(F.array(F.lit("all"), own)))
    return scoring.guarded_scores(scenarios, ["block_id", "model", "scenario"]).select("block_id", "model", "scenario", "n", r6("r2").alias("r2"), "status")


QUERIES = {
    f.__name__: f
    for f in (
        guarded_scores, finite_scores, score_contracts, block_and_pooled, spearman_scores, spearman_large, spearman_guards, repeat_deltas, null_scores,
        strongest_null, margins, equal_block, weighted_block, across_seeds, wide_scores, exact_tests, leave_two_out,
        leave_two_out_least, block_bootstrap, host_bootstrap, oof_ridge, winner_changes, bias_share, sse_share, top_errors,
        target_agreement, mask_sensitivity,
    )
}


_SINGLE_Y, _SINGLE_P = ("CAST(CAST({0} AS FLOAT) AS DOUBLE)".format(c) for c in ("y_true", "y_pred"))
#: The published contracts written out apart from the operator's: least rows,
#: when predictions are too flat, target and prediction as they are scored.
_CONTRACT_SQL = {
    "full": (2, "sdp <= 1e-9", "y_true", "y_pred"),
    "job": (1, "sdp <= 1e-9", _SINGLE_Y, _SINGLE_P),
    "tree": (1, "sdp <= 1e-9", _SINGLE_Y, "y_pred"),
    "standard": (1, "false", _SINGLE_Y, "y_pred"),
    "source_only": (2, "sdp <= 1e-9 AND model = 'source_only_RF'", "y_true", "y_pred"),
    "comparator": (2, "false", "y_true", "y_pred"),
    "diagnostic": (1, "sdp < 1e-9", "y_true", "y_pred"),
}


def _score_sql(source: str, keys: str, where: str = "true", contract: str = "full") -> str:
    min_rows, flat, y, p = _CONTRACT_SQL[contract]
    return f"""
SELECT {keys}, n, status, CASE WHEN status = 'DEFINED' THEN 1 - sse / sst END AS raw,
  CASE WHEN bad = 0 THEN mae END AS mae, CASE WHEN bad = 0 THEN sqrt(sse / n) END AS rmse,
  CASE WHEN bad = 0 THEN sst END AS sst, CASE WHEN bad = 0 THEN sse END AS sse,
  CASE WHEN bad = 0 THEN my - mp END AS offset_, CASE WHEN bad = 0 AND vp > 0 THEN cov / vp END AS slope,
  CASE WHEN bad = 0 AND vp * vy > 0 THEN cov / sqrt(vp * vy) END AS pearson
FROM (SELECT *, CASE WHEN n < {min_rows} THEN 'UNDEFINED_TOO_FEW_ROWS' WHEN bad > 0 THEN 'UNDEFINED_NONFINITE_INPUT'
        WHEN lo = hi THEN 'UNDEFINED_CONSTANT_TARGET' WHEN {flat} THEN 'UNDEFINED_NEAR_CONSTANT_PREDICTION'
        WHEN NOT coalesce(isfinite(1 - sse / CASE WHEN sst > 0 THEN sst END), false) THEN 'UNDEFINED_NONFINITE_SCORE'
        ELSE 'DEFINED' END AS status
  FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad, min(y) AS lo, max(y) AS hi,
          stddev_pop(p) AS sdp, var_pop(y) * count(y) AS sst, sum((y - p) * (y - p)) AS sse, avg(abs(y - p)) AS mae,
          avg(y) AS my, avg(p) AS mp, covar_pop(y, p) AS cov, var_pop(p) AS vp, var_pop(y) AS vy
        FROM (SELECT *, CASE WHEN ok THEN yy END AS y, CASE WHEN ok THEN pp END AS p
              FROM (SELECT *, {y} AS yy, {p} AS pp,
                      coalesce(isfinite(y_true) AND isfinite(y_pred), false) AS ok FROM {source} WHERE {where}))
        GROUP BY {keys}))"""


def _wide_score(source: str) -> str:
    return f"""SELECT split, block_id, model, n, status, round(raw, 6) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse,
  round(sst, 6) AS sst, round(sse, 6) AS sse, round(offset_, 6) AS "offset", round(slope, 6) AS slope,
  round(pearson, 6) AS pearson FROM ({_score_sql(source, "split, block_id, model")})"""


_RANKS = """SELECT {keys}, count(*) AS n,
  CASE WHEN min(y) < max(y) AND min(p) < max(p) THEN round(corr(ry, rp), 6) END AS spearman,
  CASE WHEN min(y) = max(y) THEN 'UNDEFINED_CONSTANT_TARGET' WHEN min(p) = max(p)
       THEN 'UNDEFINED_NEAR_CONSTANT_PREDICTION' ELSE 'DEFINED' END AS status
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry,
             rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0 AS rp
      FROM {source}) GROUP BY {keys}"""
_FINE_RANKS = _RANKS.replace("corr(ry, rp), 6", "corr(ry, rp), 9")

_NULLS = (
    MEMBERS_SQL
    + """, train AS (SELECT * FROM members WHERE role = 'train'), test AS (SELECT * FROM members WHERE role = 'test'),
mu AS (SELECT block_id, avg(y) AS mu FROM train GROUP BY 1),
h AS (SELECT block_id, host, avg(y) AS m, count(*) AS n FROM train GROUP BY 1, 2),
g AS (SELECT block_id, guest, avg(y) AS m, count(*) AS n FROM train GROUP BY 1, 2),
c AS (SELECT block_id, solvent, ph, avg(y) AS m FROM train GROUP BY 1, 2, 3),
s AS (SELECT block_id, source, avg(y) AS m FROM train GROUP BY 1, 2),
w AS (SELECT t.block_id, t.row_index, t.y AS y_true, mu.mu, h.m AS hm, h.n AS hn, g.m AS gm, g.n AS gn, c.m AS cm, s.m AS sm
      FROM test t LEFT JOIN mu USING (block_id) LEFT JOIN h USING (block_id, host)
      LEFT JOIN g ON g.block_id = t.block_id AND g.guest = t.guest LEFT JOIN c USING (block_id, solvent, ph)
      LEFT JOIN s USING (block_id, source)),
nulls AS (
  SELECT block_id, row_index, y_true, 'global_mean' AS model, mu AS y_pred FROM w
  UNION ALL SELECT block_id, row_index, y_true, 'host_mean', coalesce(hm, mu) FROM w
  UNION ALL SELECT block_id, row_index, y_true, 'guest_mean', coalesce(gm, mu) FROM w
  UNION ALL SELECT block_id, row_index, y_true, 'condition_mean', coalesce(cm, mu) FROM w
  UNION ALL SELECT block_id, row_index, y_true, 'source_mean', coalesce(sm, mu) FROM w
  UNION ALL SELECT block_id, row_index, y_true, 'additive',
    mu + coalesce((hm - mu) * hn / (hn + 5.0), 0) + coalesce((gm - mu) * gn / (gn + 5.0), 0) FROM w
  UNION ALL SELECT block_id, row_index, y_true, 'additive_sum', coalesce(hm, mu) + coalesce(gm, mu) - mu FROM w)"""
)
_NULL_SCORES = _NULLS + ", null_scores AS (" + _score_sql("nulls", "block_id, model") + ")"
_ORDER = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(NULLS))
_BEST = (
    _NULL_SCORES
    + f""", best AS (
  SELECT block_id, model AS best_null, r AS best_value, n_defined FROM (
    SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY r DESC NULLS LAST, k) AS rn,
           count(r) OVER (PARTITION BY block_id) AS n_defined
    FROM (SELECT *, round(raw, 9) AS r, CASE model {_ORDER} END AS k FROM null_scores) WHERE k IS NOT NULL) WHERE rn = 1)"""
)
_MARGINS = (
    _BEST
    + ", "
    + FINITE_SQL
    + ", scores AS ("
    + _score_sql("finite_panel", "block_id, model", "split = 'host_cold'")
    + """), margins AS (SELECT block_id, model, n, raw AS r2, best_null, raw - best_value AS margin
  FROM scores JOIN best USING (block_id)), roster AS (SELECT DISTINCT model, block_id FROM predictions WHERE split = 'host_cold')"""
)
_DELTAS = (
    "WITH "
    + FINITE_SQL
    + ", scores AS ("
    + _score_sql("finite_panel", "block_id, model", "split = 'double_cold'")
    + """), d AS (SELECT block_id, a.raw - b.raw AS m FROM scores a JOIN scores b USING (block_id)
  WHERE a.model = 'PAIR_RF' AND b.model = 'GINE'), two AS (
  SELECT a.block_id AS a, b.block_id AS b, round(((SELECT sum(m) FROM d) - a.m - b.m) / ((SELECT count(*) FROM d) - 2), 6) AS mean
  FROM d a JOIN d b ON a.block_id < b.block_id)"""
)
_MASK = (
    "WITH "
    + MEMBERS_SQL
    + ", "
    + FINITE_SQL
    + """, hc AS (SELECT * FROM finite_panel WHERE split = 'host_cold'),
known AS (SELECT DISTINCT block_id, guest AS guest_id FROM members WHERE role = 'train' AND guest IS NOT NULL),
keys AS (SELECT DISTINCT block_id, row_index FROM hc SEMI JOIN known USING (block_id, guest_id)),
scen AS (SELECT *, 'all' AS scenario FROM hc
         UNION ALL SELECT *, 'removed' FROM hc SEMI JOIN keys USING (block_id, row_index)
         UNION ALL SELECT *, 'retained' FROM hc ANTI JOIN keys USING (block_id, row_index))
SELECT block_id, model, scenario, n, round(raw, 6) AS r2, status FROM ("""
    + _score_sql("scen", "block_id, model, scenario")
    + ")"
)

ORACLE = {
    "guarded_scores": "WITH " + PANEL_SQL + " " + _wide_score("panel"),
    "finite_scores": "WITH " + FINITE_SQL + " " + _wide_score("finite_panel"),
    "score_contracts": "WITH "
    + FINITE_SQL
    + " UNION ALL ".join(
        f" SELECT split, block_id, model, '{c}' AS contract, n, round(raw, 6) AS r2, status FROM ({_score_sql('finite_panel', 'split, block_id, model', contract=c)})"
        for c in _CONTRACT_SQL
    ),
    "block_and_pooled": "WITH "
    + FINITE_SQL
    + f""" SELECT split, model, block_id, 'block' AS scope, n, round(raw, 6) AS r2, status
    FROM ({_score_sql("finite_panel", "split, block_id, model")})
    UNION ALL SELECT split, model, NULL, 'pooled', n, round(raw, 6), status FROM ({_score_sql("finite_panel", "split, model")})""",
    "spearman_scores": "WITH "
    + FINITE_SQL
    + ", x AS (SELECT *, y_true AS y, y_pred AS p FROM finite_panel) "
    + _RANKS.format(keys="split, block_id, model", source="x"),
    "spearman_guards": "WITH "
    + FINITE_SQL
    + """, x AS (SELECT model, y_true AS y, CASE model WHEN 'GINE' THEN 1.0 WHEN 'PAIR_RF' THEN 1 + y_pred * 1e-12 ELSE y_pred END AS p FROM finite_panel WHERE split = 'host_cold'),
    x2 AS (SELECT model, y_true AS y, 1.0 AS p FROM panel WHERE model = 'GINE' AND split = 'host_cold' AND isfinite(y_true)),
    v AS (SELECT * FROM x WHERE model <> 'GINE' UNION ALL SELECT * FROM x2),
    r AS ("""
    + _RANKS.format(keys="model", source="v")
    + """), d AS (SELECT model, stddev_pop(p) AS sd FROM v GROUP BY 1)
    SELECT 'values' AS "guard", model, n, spearman, status FROM r
    UNION ALL SELECT 'spread', model, n, CASE WHEN sd > 1e-9 THEN spearman END,
      CASE WHEN status = 'DEFINED' AND sd <= 1e-9 THEN 'UNDEFINED_NEAR_CONSTANT_PREDICTION' ELSE status END FROM r JOIN d USING (model)
    UNION ALL SELECT 'zero', model, n, coalesce(CASE WHEN sd >= 1e-9 THEN spearman END, 0.0),
      CASE WHEN status = 'DEFINED' AND sd < 1e-9 THEN 'UNDEFINED_NEAR_CONSTANT_PREDICTION' ELSE status END FROM r JOIN d USING (model)""",
    "repeat_deltas": "WITH "
    + PANEL_SQL
    + ", "
    + PANEL_SQL.replace("panel AS", "repeat_panel AS").replace("FROM predictions", "FROM predictions_repeat")
    + ", "
    + ", ".join(
        f"{run}s AS (SELECT split, block_id, model, raw, mae FROM ({_score_sql(source, 'split, block_id, model')}) UNION ALL SELECT split, 'ALL', model, raw, mae FROM ({_score_sql(source, 'split, model')})), "
        f"{run}f AS (SELECT split, block_id, model, y_true AS y, y_pred AS p FROM {source} WHERE isfinite(y_true) AND isfinite(y_pred)), "
        f"{run}r AS ({_FINE_RANKS.format(keys='split, block_id, model', source=run + 'f')} UNION ALL SELECT split, 'ALL', model, n, spearman, status FROM ({_FINE_RANKS.format(keys='split, model', source=run + 'f')})), "
        f"{run} AS (SELECT split, block_id, model, unnest(['mae', 'r2', 'spearman']) AS metric, unnest([mae, raw, spearman]) AS value FROM {run}s LEFT JOIN {run}r USING (split, block_id, model))"
        for run, source in (("ra", "panel"), ("rb", "repeat_panel"))
    )
    + """, d AS (SELECT split, block_id, model, metric, ra.value AS a, rb.value AS b, CASE metric WHEN 'mae' THEN 0.02 ELSE 0.03 END AS threshold
        FROM ra FULL JOIN rb USING (split, block_id, model, metric))
    SELECT split, block_id, model, metric, round(abs(a - b), 6) AS delta, CAST(threshold AS DOUBLE) AS threshold,
      CASE WHEN a IS NULL AND b IS NULL THEN 'UNKNOWN_SYMMETRIC' WHEN a IS NULL OR b IS NULL THEN 'FAIL_ASYMMETRIC_DEFINEDNESS'
           WHEN abs(a - b) <= threshold THEN 'PASS' ELSE 'FAIL_THRESHOLD' END AS status FROM d""",
    "spearman_large": "WITH x AS (SELECT l_returnflag, l_quantity AS y, l_extendedprice AS p FROM lineitem) "
    + _RANKS.format(keys="l_returnflag", source="x"),
    "null_scores": "WITH "
    + _NULL_SCORES
    + " SELECT block_id, model, n, round(raw, 6) AS r2, status, round(mae, 6) AS mae FROM null_scores",
    "strongest_null": "WITH " + _BEST + " SELECT block_id, best_null, round(best_value, 6) AS best_value, n_defined FROM best",
    "margins": "WITH "
    + _MARGINS
    + " SELECT block_id, model, n, best_null, round(r2, 6) AS r2, round(margin, 6) AS margin FROM margins",
    "equal_block": "WITH "
    + _MARGINS
    + """ SELECT model, count(*) AS n_blocks, count(margin) AS n_defined, count(*) FILTER (WHERE margin > 0) AS n_positive,
    CASE WHEN count(margin) = count(*) THEN round(avg(margin), 6) END AS mean,
    CASE WHEN count(margin) = count(*) THEN round(stddev_pop(margin), 6) END AS sd, round(avg(margin), 6) AS mean_of_defined
    FROM roster LEFT JOIN margins USING (model, block_id) GROUP BY model""",
    "weighted_block": "WITH "
    + _MARGINS
    + """ SELECT model, CAST(sum(n) AS BIGINT) AS weight,
    CASE WHEN count(margin) = count(*) THEN round(sum(n * margin) / sum(n), 6) END AS mean FROM margins GROUP BY model""",
    "across_seeds": "WITH "
    + FINITE_SQL
    + f""" SELECT split, model, count(DISTINCT block_id) AS n_seeds, CASE WHEN ok THEN round(avg(raw), 6) END AS mean,
    CASE WHEN ok THEN round(stddev_samp(raw), 6) END AS sd, CASE WHEN ok THEN round(min(raw), 6) END AS least,
    CASE WHEN ok THEN round(max(raw), 6) END AS greatest
    FROM (SELECT *, count(raw) OVER w = count(*) OVER w AND count(*) OVER w = 12 AS ok
          FROM ({_score_sql("finite_panel", "split, block_id, model")}) WINDOW w AS (PARTITION BY split, model))
    GROUP BY split, model, ok""",
    "wide_scores": "WITH "
    + _NULL_SCORES
    + """ SELECT block_id, """
    + ", ".join(
        f"round(max(raw) FILTER (WHERE model = '{m}'), 6) AS {m}"
        for m in ("additive", "additive_sum", "guest_mean", "host_mean", "source_mean")
    )
    + """, round(max(raw) FILTER (WHERE model IN ('additive', 'additive_sum', 'guest_mean', 'host_mean', 'source_mean')), 6) AS greatest
    FROM null_scores GROUP BY block_id""",
    "oof_ridge": "WITH "
    + MEMBERS_SQL
    + """, k AS (SELECT *, row_index * 48271 % 65537 % 5 AS f FROM members WHERE role = 'train'),
    o AS (SELECT block_id, sum(y) AS s, count(*) AS n, avg(y) AS mean FROM k GROUP BY 1),
    mu AS (SELECT i.block_id, f, (o.s - i.s) / (o.n - i.n) AS mu FROM (SELECT block_id, f, sum(y) AS s, count(*) AS n FROM k GROUP BY 1, 2) i JOIN o USING (block_id)),
    h AS (SELECT block_id, host, sum(y) AS s, count(*) AS n FROM k GROUP BY 1, 2),
    hf AS (SELECT block_id, host, f, sum(y) AS s, count(*) AS n FROM k GROUP BY 1, 2, 3),
    g AS (SELECT block_id, coalesce(guest, -1) AS guest, sum(y) AS s, count(*) AS n FROM k GROUP BY 1, 2),
    gf AS (SELECT block_id, coalesce(guest, -1) AS guest, f, sum(y) AS s, count(*) AS n FROM k GROUP BY 1, 2, 3),
    t AS (SELECT k.block_id, k.y - o.mean AS r, (h.s - hf.s + 5 * mu) / (h.n - hf.n + 5) AS x1, (g.s - gf.s + 5 * mu) / (g.n - gf.n + 5) AS x2
          FROM k JOIN o USING (block_id) JOIN mu USING (block_id, f) JOIN h USING (block_id, host) JOIN hf USING (block_id, host, f)
          JOIN g ON g.block_id = k.block_id AND g.guest = coalesce(k.guest, -1)
          JOIN gf ON gf.block_id = k.block_id AND gf.guest = coalesce(k.guest, -1) AND gf.f = k.f),
    m AS (SELECT block_id, avg(x1) AS m1, avg(x2) AS m2, avg(r) AS mr, var_pop(x1) * count(*) + 1 AS c11, var_pop(x2) * count(*) + 1 AS c22,
            covar_pop(x1, x2) * count(*) AS c12, covar_pop(x1, r) * count(*) AS c1, covar_pop(x2, r) * count(*) AS c2 FROM t GROUP BY 1),
    b AS (SELECT *, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) AS b1, (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM m),
    q AS (SELECT x.block_id, x.y AS y_true, o.mean + mr + b1 * ((coalesce(h.s, 0) + 5 * o.mean) / (coalesce(h.n, 0) + 5) - m1)
            + b2 * ((coalesce(g.s, 0) + 5 * o.mean) / (coalesce(g.n, 0) + 5) - m2) AS y_pred
          FROM members x JOIN o USING (block_id) JOIN b USING (block_id) LEFT JOIN h USING (block_id, host)
          LEFT JOIN g ON g.block_id = x.block_id AND g.guest = coalesce(x.guest, -1) WHERE x.role = 'test')
    """
    + f"SELECT block_id, n, round(raw, 6) AS r2, status FROM ({_score_sql('q', 'block_id')})",
    "winner_changes": "WITH "
    + _BEST
    + f""", fewer AS (SELECT block_id, CASE WHEN r IS NOT NULL THEN model END AS best_null FROM (
      SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY r DESC NULLS LAST, k) AS rn
      FROM (SELECT *, round(raw, 9) AS r, CASE model {_ORDER} END AS k FROM null_scores WHERE model <> 'additive') WHERE k IS NOT NULL) WHERE rn = 1)"""
    + """ SELECT block_id, best.best_null AS before, fewer.best_null AS after FROM best FULL JOIN fewer USING (block_id)
    WHERE best.best_null IS DISTINCT FROM fewer.best_null""",
    "exact_tests": "WITH "
    + _MARGINS
    + """, m AS (SELECT model, margin, rank() OVER (PARTITION BY model ORDER BY abs(margin))
             + (count(*) OVER (PARTITION BY model, abs(margin)) - 1) / 2.0 AS r FROM margins WHERE margin <> 0),
    o AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE margin > 0) AS n_positive, list(r) AS ranks, sum(r) AS total,
                 least(coalesce(sum(r) FILTER (WHERE margin > 0), 0), coalesce(sum(r) FILTER (WHERE margin < 0), 0)) AS w
          FROM m GROUP BY model),
    e AS (SELECT model, avg(CAST(least(pl, total - pl) <= w + 1e-12 AS INTEGER)) AS wp FROM (
            SELECT o.*, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (s >> (i - 1)) & 1 = 1 THEN ranks[i] ELSE 0 END)) AS pl
            FROM o, range(1024) t(s) WHERE s < (1 << n)) GROUP BY model)
    SELECT model, n, round(CAST(w AS DOUBLE), 6) AS w, round(wp, 6) AS wilcoxon_p, n_positive,
      round(least(1.0, 2 * (SELECT sum(factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER))))
        FROM range(1000) t(i) WHERE i <= least(n_positive, n - n_positive)) / pow(2, n)), 6) AS sign_p
    FROM o JOIN e USING (model)""",
    "leave_two_out": _DELTAS + " SELECT a, b, mean FROM two",
    "leave_two_out_least": _DELTAS + " SELECT mean, a, b FROM two ORDER BY mean, a, b LIMIT 1",
    "bias_share": "WITH "
    + FINITE_SQL
    + """ SELECT split, model, count(*) AS n, round(avg(r * r), 6) AS mse, round(avg(r), 6) AS bias,
    round(avg(r) * avg(r) / avg(r * r), 6) AS bias_share FROM (SELECT *, y_true - y_pred AS r FROM finite_panel) GROUP BY 1, 2""",
    "sse_share": "WITH "
    + FINITE_SQL
    + """ SELECT model, host_id, count(*) AS n, round(sum(d * d) / sum(sum(d * d)) OVER (PARTITION BY model), 6) AS share,
    round(avg(y_true), 6) AS mean_y, round(avg(y_pred), 6) AS mean_p
    FROM (SELECT *, y_true - y_pred AS d FROM finite_panel) GROUP BY model, host_id""",
    "top_errors": "WITH "
    + FINITE_SQL
    + """ SELECT split, block_id, model, row_index, round((y_true - y_pred) * (y_true - y_pred), 6) AS squared_error
    FROM finite_panel ORDER BY squared_error DESC, split, block_id, model, row_index LIMIT 10""",
    "target_agreement": "WITH "
    + PANEL_SQL
    + " SELECT row_index, count(DISTINCT CAST(y_true AS FLOAT)) AS n_values FROM panel GROUP BY 1 HAVING n_values > 1",
    "mask_sensitivity": _MASK,
}
