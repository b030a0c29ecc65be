"""Inputs that several queries share, as DataFrames and as SQL.

The tables are dirty by design: rows come twice, roles vary in case, ids are
null, blank or negative.  These views settle that once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.operators.splits import with_blocks
from pairaudit.sources.catalog import table

PANEL_KEY = ["split", "block_id", "model", "row_index"]
NULLS = ("additive", "host_mean", "guest_mean", "condition_mean", "source_mean", "global_mean")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def latest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the one loaded last."""
    best = df.groupBy(*keys).agg(F.max(F.struct("loaded_at", *columns)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])


def panel(spark: SparkSession, sf_dir: str, name: str = "predictions") -> DataFrame:
    return latest(table(spark, sf_dir, name), PANEL_KEY, ["host_id", "guest_id", "y_true", "y_pred"])


def finite_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).filter("NOT isnan(y_pred) AND y_pred IS NOT NULL AND y_true IS NOT NULL")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["host_smiles", "guest_smiles", "host_name", "source", "y", "family", "solvent_bucket", "temp_bucket", "ph_bucket"]
    return latest(table(spark, sf_dir, "clean_condition"), ["row_index"], columns)


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (fold, role, row_index, host, guest), unknown guests null."""
    guest = F.col("guest_id").try_cast("bigint")
    return (
        table(spark, sf_dir, "folds_host_canonical")
        .select(
            F.trim("split").alias("split"),
            F.col("fold_index").cast("bigint").alias("fold"),
            F.lower(F.trim("role")).alias("role"),
            F.col("row_index").cast("bigint").alias("row_index"),
            F.col("host_id").cast("bigint").alias("host"),
            F.when(guest >= 0, guest).alias("guest"),
        )
        .distinct()
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold members with target and conditions; records without one left out."""
    kept = records(spark, sf_dir).filter("y IS NOT NULL").select(
        "row_index",
        "y",
        "family",
        F.coalesce("source", F.lit("?")).alias("source"),
        F.coalesce(F.lower("solvent_bucket"), F.lit("?")).alias("solvent"),
        F.coalesce("ph_bucket", F.lit("?")).alias("ph"),
    )
    return folds(spark, sf_dir).withColumn("block_id", F.concat(F.lit("host_cold_"), "fold")).join(kept, "row_index")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large pair table: host, guest, conditions and target."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("host"),
        F.col("l_partkey").alias("guest"),
        F.col("l_returnflag").alias("source"),
        F.col("l_linestatus").alias("cond1"),
        F.col("l_linenumber").alias("cond2"),
        (F.col("l_extendedprice") / 1000).alias("y"),
    )


def pair_blocks(spark: SparkSession, sf_dir: str, n_blocks: int = 12) -> DataFrame:
    """Pairs under double-cold roles by arithmetic held sets."""
    from pairaudit.operators.splits import double_cold_role, held

    rows = with_blocks(pairs(spark, sf_dir), n_blocks)
    host = held(F.col("host"), F.col("block"), 4, 7919)
    guest = held(F.col("guest"), F.col("block"), 4, 31337)
    return rows.withColumn("role", double_cold_role(host, guest))


PANEL_SQL = """panel AS (
  SELECT split, block_id, model, row_index, host_id, guest_id, y_true, y_pred FROM (
    SELECT *, row_number() OVER (PARTITION BY split, block_id, model, row_index ORDER BY loaded_at DESC) AS rn
    FROM predictions) WHERE rn = 1)"""
REPEAT_SQL = PANEL_SQL.replace("panel AS", "repeat_panel AS").replace("FROM predictions", "FROM predictions_repeat")
FINITE_SQL = PANEL_SQL + """, finite_panel AS (SELECT * FROM panel WHERE NOT isnan(y_pred) AND y_pred IS NOT NULL AND y_true IS NOT NULL)"""
RECORDS_SQL = """records AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY loaded_at DESC) AS rn
                              FROM clean_condition) WHERE rn = 1)"""
FOLDS_SQL = """folds AS (
  SELECT DISTINCT trim(split) AS split, CAST(fold_index AS BIGINT) AS fold, lower(trim(role)) AS role,
         CAST(row_index AS BIGINT) AS row_index, CAST(host_id AS BIGINT) AS host,
         CASE WHEN TRY_CAST(guest_id AS BIGINT) >= 0 THEN CAST(guest_id AS BIGINT) END AS guest
  FROM folds_host_canonical)"""
MEMBERS_SQL = (
    RECORDS_SQL
    + ", "
    + FOLDS_SQL
    + """, members AS (
  SELECT f.*, 'host_cold_' || fold AS block_id, y, family, coalesce(source, '?') AS source,
         coalesce(lower(solvent_bucket), '?') AS solvent, coalesce(ph_bucket, '?') AS ph
  FROM folds f JOIN records USING (row_index) WHERE y IS NOT NULL)"""
)
PAIRS_SQL = """pairs AS (
  SELECT l_suppkey AS host, l_partkey AS guest, l_returnflag AS source, l_linestatus AS cond1, l_linenumber AS cond2,
         l_extendedprice / 1000 AS y FROM lineitem)"""
BLOCKS_SQL = (
    PAIRS_SQL
    + """, pair_blocks AS (
  SELECT *, CASE WHEN hh AND gh THEN 'test' WHEN NOT hh AND NOT gh THEN 'train' ELSE 'neither' END AS role FROM (
    SELECT p.*, CAST(b.block AS INTEGER) AS block, (host * 7919 + b.block * 104729) % 65537 % 4 = 0 AS hh,
           (guest * 31337 + b.block * 104729) % 65537 % 4 = 0 AS gh
    FROM pairs p CROSS JOIN range(12) b(block)))"""
)
