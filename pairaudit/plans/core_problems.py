"""Queries of the general data problems 2, 4 and 5, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.operators.copy_diff import Field, diff_copies
from pairaudit.operators.orphans import Parent, count_orphans, find_orphans
from pairaudit.operators.packed_values import unpack_values
from pairaudit.sources.catalog import table

PANEL_KEY = ["split", "block_id", "model", "row_index"]
PANEL_FIELDS = [
    Field("fold_index"),
    Field("seed"),
    Field("host_id"),
    Field("guest_id"),
    Field("canonical_host_sha256", hexadecimal=True),
    Field("canonical_guest_sha256", hexadecimal=True),
    Field("y_true"),
    Field("y_pred", ulps=8, undefined_nan=True),
]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_copies(
        table(spark, sf_dir, "predictions"),
        table(spark, sf_dir, "predictions_repeat"),
        PANEL_KEY,
        PANEL_FIELDS,
        order_by="loaded_at",
        names=("predictions", "repeat"),
    )


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing keys per split, model and kind of difference."""
    return p2_found(spark, sf_dir).groupBy("split", "model", "difference").agg(F.count("*").alias("n_keys"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unpack_values(table(spark, sf_dir, "host_id_map"), "host_id", "host_names", order_by="loaded_at")
    return rows.select("host_id", "pos", F.col("value").alias("host_name"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(
        table(spark, sf_dir, "predictions"),
        PANEL_KEY,
        [
            Parent("row_index", table(spark, sf_dir, "clean_condition"), "row_index"),
            Parent("host_id", table(spark, sf_dir, "host_id_map"), "host_id"),
            Parent("guest_id", table(spark, sf_dir, "guest_id_map"), "guest_id"),
        ],
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_orphans(_orphans(spark, sf_dir))


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_report": p5_report,
}

_COPIES = """
WITH a AS (SELECT DISTINCT ON (split, block_id, model, row_index) * FROM predictions
           ORDER BY split, block_id, model, row_index, loaded_at DESC),
     b AS (SELECT DISTINCT ON (split, block_id, model, row_index) * FROM predictions_repeat
           ORDER BY split, block_id, model, row_index, loaded_at DESC),
     j AS (SELECT split, block_id, model, row_index, a.* EXCLUDE (split, block_id, model, row_index),
                  b.fold_index AS b_fold_index, b.seed AS b_seed, b.host_id AS b_host_id, b.guest_id AS b_guest_id,
                  b.canonical_host_sha256 AS b_host, b.canonical_guest_sha256 AS b_guest,
                  b.y_true AS b_y_true, b.y_pred AS b_y_pred
           FROM a JOIN b USING (split, block_id, model, row_index)),
     n AS (SELECT *, CASE WHEN isnan(y_pred) THEN NULL ELSE y_pred END AS p,
                  CASE WHEN isnan(b_y_pred) THEN NULL ELSE b_y_pred END AS q FROM j),
     d AS (
  SELECT split, block_id, model, row_index, 'missing_in_repeat' AS difference
  FROM a ANTI JOIN b USING (split, block_id, model, row_index)
  UNION ALL SELECT split, block_id, model, row_index, 'missing_in_predictions'
  FROM b ANTI JOIN a USING (split, block_id, model, row_index)
  UNION ALL SELECT split, block_id, model, row_index, 'fold_index' FROM j WHERE fold_index IS DISTINCT FROM b_fold_index
  UNION ALL SELECT split, block_id, model, row_index, 'seed' FROM j WHERE seed IS DISTINCT FROM b_seed
  UNION ALL SELECT split, block_id, model, row_index, 'host_id' FROM j WHERE host_id IS DISTINCT FROM b_host_id
  UNION ALL SELECT split, block_id, model, row_index, 'guest_id' FROM j WHERE guest_id IS DISTINCT FROM b_guest_id
  UNION ALL SELECT split, block_id, model, row_index, 'canonical_host_sha256' FROM j
  WHERE lower(canonical_host_sha256) IS DISTINCT FROM lower(b_host)
  UNION ALL SELECT split, block_id, model, row_index, 'canonical_guest_sha256' FROM j
  WHERE lower(canonical_guest_sha256) IS DISTINCT FROM lower(b_guest)
  UNION ALL SELECT split, block_id, model, row_index, 'y_true' FROM j WHERE y_true IS DISTINCT FROM b_y_true
  UNION ALL SELECT split, block_id, model, row_index, 'y_pred' FROM n
  WHERE (p IS NULL) <> (q IS NULL)
     OR (p <> q AND abs(p - q) > 8 * pow(2, floor(log2(greatest(abs(p), abs(q), 1e-300))) - 52)))
"""

_ORPHANS = """
WITH r AS (SELECT split, block_id, model, row_index, loaded_at AS seen, produced_at AS produced,
                  'row_index' AS ref_field, row_index AS k FROM predictions
           UNION ALL SELECT split, block_id, model, row_index, loaded_at, produced_at, 'host_id', host_id FROM predictions
           UNION ALL SELECT split, block_id, model, row_index, loaded_at, produced_at, 'guest_id', guest_id
           FROM predictions),
     t AS (SELECT 'row_index' AS ref_field, row_index AS k, loaded_at, deleted_at FROM clean_condition
           UNION ALL SELECT 'host_id', host_id, loaded_at, deleted_at FROM host_id_map
           UNION ALL SELECT 'guest_id', guest_id, loaded_at, deleted_at FROM guest_id_map),
     u AS (SELECT ref_field, k, true AS there, min(loaded_at) AS came, min(deleted_at) AS gone FROM t
           GROUP BY ref_field, k),
     f AS (SELECT split, block_id, model, row_index, ref_field, seen, strftime(produced, '%Y-%m') AS period,
                  CASE WHEN there IS NULL THEN 'missing' WHEN gone <= seen THEN 'deleted'
                       WHEN came > seen THEN 'late' END AS reason
           FROM r LEFT JOIN u USING (ref_field, k) WHERE k >= 0),
     o AS (SELECT DISTINCT ON (split, block_id, model, row_index, ref_field)
                  split, block_id, model, row_index, ref_field, reason, period
           FROM f WHERE reason IS NOT NULL ORDER BY split, block_id, model, row_index, ref_field, seen)
"""

ORACLE = {
    "p2_found": _COPIES + "SELECT * FROM d",
    "p2_report": _COPIES + "SELECT split, model, difference, count(*) AS n_keys FROM d GROUP BY split, model, difference",
    "p5_found": _ORPHANS + "SELECT * FROM o",
    "p5_report": _ORPHANS
    + "SELECT ref_field, reason, period, count(*) AS n_references FROM o GROUP BY 1, 2, 3",
}
