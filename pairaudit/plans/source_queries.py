"""Queries on sources, sinks, saved jobs and gates.

Each writes a table of the test data in some form to the shared folder, reads
it back through the source under test, and returns what was read, so that SQL
on the original table can be compared with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.operators import gates, scoring, verify
from pairaudit.plans.common import FINITE_SQL, FOLDS_SQL, finite_panel, folds, r6
from pairaudit.plans.scoring_queries import _score_sql
from pairaudit.session import Materialized
from pairaudit.sources import files, jobs, sinks
from pairaudit.sources.catalog import table

SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def _folder(spark: SparkSession, label: str) -> str:
    return Materialized(spark, label).root


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers through a CSV file in a fixed order; doubles come back."""
    path, df = f"{_folder(spark, 'csv')}/supplier", table(spark, sf_dir, "supplier").select(*SUPPLIER)
    sinks.sorted_delimited(df, path, SUPPLIER, ["s_suppkey"])
    return files.delimited(spark, path, df.schema)


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions through a TSV with UNDEFINED, every cell as text."""
    path = f"{_folder(spark, 'tsv')}/panel"
    panel = table(spark, sf_dir, "predictions").select("model", "block_id", "row_index", F.nanvl("y_pred", F.lit(None)).alias("y_pred"), "seed")
    sinks.table_with_undefined(panel, path)
    read = files.all_text(spark, path, panel.columns, sep="\t")
    undefined = lambda c: F.count_if(F.col(c) == sinks.UNDEFINED)
    return read.groupBy("model", "block_id").agg(
        F.count("*").alias("n"), undefined("y_pred").alias("undefined_y"), undefined("seed").alias("undefined_seed"),
        F.sum(F.col("row_index").cast("bigint")).alias("checksum"), r6(F.sum(F.col("y_pred").try_cast("double"))).alias("sum_y"),
    )


def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells stay as they are: blank stays blank and NA stays NA."""
    path = f"{_folder(spark, 'cells')}/folds"
    df = table(spark, sf_dir, "folds_host_canonical").select("role", "guest_id", F.lit("NA").alias("na"), F.coalesce("seed", F.lit("")).alias("seed"))
    sinks.sorted_delimited(df, path, df.columns, ["role"], single=False)
    return files.strict_rows(spark, path, df.columns).groupBy("role", "na", "seed").agg(F.count("*").alias("n"), F.count_if(F.col("guest_id") == "").alias("n_blank"))


def projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed columns under equality and IN filters."""
    spec = files.Projection(
        {"row": "row_index", "block": "block_id", "value": "y_true"}, equals={"split": "host_cold"}, within={"model": ("PAIR_RF", "GINE")}, forbidden=("outcome",)
    )
    return files.projected(table(spark, sf_dir, "predictions"), spec).groupBy("block").agg(F.count("*").alias("n"), F.sum("row").alias("checksum"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one JSON object per file."""
    path, df = f"{_folder(spark, 'json')}/nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    df.write.option("maxRecordsPerFile", 1).json(path)
    return files.json_documents(spark, path, df.schema).drop("path")


def file_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against expected sizes and hashes, of which one is wrong."""
    path, df = f"{_folder(spark, 'receipts')}/region", table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    df.repartition(1).sortWithinPartitions("r_regionkey").write.partitionBy("r_regionkey").csv(path)
    seen = files.content_hashes(spark, f"{path}/*").withColumn("name", F.element_at(F.split("path", "/"), -2))
    wrong = F.when(F.col("name") == "r_regionkey=3", F.lit("00")).otherwise(F.col("sha256"))
    expected = seen.select("name", "bytes", wrong.alias("sha256")).unionByName(spark.createDataFrame([("r_regionkey=9", 1, "00")], "name string, bytes bigint, sha256 string"))
    faults = files.file_faults(seen, expected)
    text = spark.read.text(f"{path}/*").count()
    return faults.withColumn("n_rows", F.lit(text))


def digits_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles that read back as they were from 17 digits."""
    p = table(spark, sf_dir, "predictions").select("model", F.nanvl("y_pred", F.lit(None)).alias("y_pred"))
    same = sinks.seventeen_digits("y_pred").cast("double").eqNullSafe(F.col("y_pred"))
    return p.groupBy("model").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


def _jobs(spark: SparkSession, sf_dir: str) -> str:
    """A directory of saved jobs, one per model and host-cold block."""
    rows = finite_panel(spark, sf_dir).filter("split = 'host_cold'").select("model", "block_id", "row_index", "y_true", "y_pred")
    scores = scoring.guarded_scores(rows, ["model", "block_id"]).select("model", "block_id", "n", "r2", "mae")
    root = _folder(spark, "jobs")
    jobs.save_jobs(rows, scores, ["model", "block_id"], root)
    return root


SCORES = "n bigint, r2 double, mae double"


def job_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores recomputed from the predictions that saved jobs hold."""
    saved = jobs.read_jobs(spark, _jobs(spark, sf_dir), SCORES)
    again = scoring.guarded_scores(saved.predictions, ["job_id"])
    stored = saved.results.select("job_id", F.col("r2").alias("stored"))
    close = F.abs(F.col("r2") - F.col("stored")) <= 1e-9
    return again.join(stored, "job_id").select(
        F.split("job_id", "--")[0].alias("model"), F.split("job_id", "--")[1].alias("block_id"), "n", r6("r2").alias("r2"), F.coalesce(close, F.col("stored").isNull()).alias("as_stored")
    )


def job_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved jobs whose parts do not belong together: none."""
    faults = jobs.job_faults(jobs.read_jobs(spark, _jobs(spark, sf_dir), SCORES))
    return faults.groupBy("fault").agg(F.count("*").alias("n")).unionByName(spark.createDataFrame([("all", 0)], "fault string, n bigint"))


def gated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of host-cold blocks on rows whose guest train does not have.

    The mask is frozen first, then the unmasked scores must repeat those of
    the stored copy of the panel, and only then outcomes are read.
    """
    f = folds(spark, sf_dir)
    seen = f.filter("role = 'train' AND guest IS NOT NULL").select(F.concat(F.lit("host_cold_"), "fold").alias("block_id"), F.col("guest").alias("guest_id")).distinct()
    tests = f.filter("role = 'test' AND guest IS NOT NULL").select(F.concat(F.lit("host_cold_"), "fold").alias("block_id"), "row_index", F.col("guest").alias("guest_id"))
    mask = tests.join(seen, ["block_id", "guest_id"], "left_anti").select("block_id", "row_index").distinct()
    rows = finite_panel(spark, sf_dir).filter("split = 'host_cold'")
    unit = ["block_id", "model"]

    def baseline() -> DataFrame:
        stored = scoring.guarded_scores(rows, unit).select(*unit, F.round("r2", 9).alias("r2"))
        again = scoring.guarded_scores(rows.repartition("row_index"), unit).select(*unit, F.round("r2", 9).alias("r2"))
        return verify.metric_faults(stored, again, unit, "r2", rel_tol=1e-6)

    def outcome(frozen: DataFrame) -> DataFrame:
        return scoring.guarded_scores(rows.join(frozen, ["block_id", "row_index"], "left_semi"), unit).select(*unit, "n", r6("r2").alias("r2"), "status")

    return gates.gated(mask, baseline, outcome, Materialized(spark, "gate"))


def fold_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target means of the folds against the mean of all rows."""
    panel = finite_panel(spark, sf_dir).filter("split = 'host_cold' AND model = 'PAIR_RF'")
    out = gates.fold_spread(panel.select("block_id", "y_true"), "block_id", "y_true", tolerance=0.5)
    return out.select("block_id", "n", r6("mean").alias("mean"), "within")


def branch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One branch that works and one that fails; the first is kept."""

    def run(branch: str) -> DataFrame:
        entries = table(spark, sf_dir, "identity_entry").filter(F.col("branch") == branch)
        verify.require_empty(entries.limit(1), "entries") if branch == "released" else None
        return entries

    done, failed, verdict = verify.by_branch(["canonical", "released"], run)
    rows = [(b, "PASS" if b in done else "FAIL", verdict) for b in sorted([*done, *failed])]
    return spark.createDataFrame(rows, "branch string, status string, verdict string")


def mapping_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of guests against a ledger and decisions on undone groups."""
    e = table(spark, sf_dir, "identity_entry").filter("branch = 'canonical' AND layer = 'v1_strict_exact' AND axis = 'guest' AND trim(parent_key) <> '' AND NOT missing")
    ledger = e.groupBy("identity_key").agg(F.min(F.trim("parent_key")).alias("parent"))
    decisions = ledger.select("parent", (F.length("parent") % 5 == 0).alias("reverted")).distinct()
    mapping = ledger.filter("identity_key <> '7'").withColumn("parent", F.when(F.length("parent") % 4 == 0, F.col("identity_key")).otherwise(F.col("parent")))
    return verify.mapping_faults(mapping, decisions, ledger, "identity_key", "parent").groupBy("fault").agg(F.count("*").alias("n"))


def rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key that are less urgent than the next one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), "o_orderpriority")
    urgency = F.substring("o_orderpriority", 1, 1).cast("int")
    return verify.out_of_order(o, [urgency], "at")


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, tsv_round_trip, text_cells, projected_scan, json_round_trip, file_receipts, digits_17, job_replay,
        job_bindings, gated_mask, fold_consistency, branch_verdicts, mapping_check, rank_order,
    )
}

_COLD = "split = 'host_cold'"

ORACLE = {
    "csv_round_trip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "tsv_round_trip": """SELECT model, block_id, count(*) AS n, count(*) FILTER (WHERE y_pred IS NULL OR isnan(y_pred)) AS undefined_y,
      count(*) FILTER (WHERE seed IS NULL) AS undefined_seed, CAST(sum(row_index) AS BIGINT) AS checksum,
      round(sum(y_pred) FILTER (WHERE NOT isnan(y_pred)), 6) AS sum_y FROM predictions GROUP BY 1, 2""",
    "text_cells": """SELECT coalesce(role, '') AS role, 'NA' AS na, coalesce(seed, '') AS seed, count(*) AS n, count(*) FILTER (WHERE coalesce(guest_id, '') = '') AS n_blank
      FROM folds_host_canonical GROUP BY 1, 2, 3""",
    "projected_scan": """SELECT block_id AS block, count(*) AS n, CAST(sum(row_index) AS BIGINT) AS checksum FROM predictions
      WHERE split = 'host_cold' AND model IN ('PAIR_RF', 'GINE') GROUP BY 1""",
    "json_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "file_receipts": "SELECT * FROM (VALUES ('r_regionkey=3', 'content'), ('r_regionkey=9', 'missing')) t(name, fault), (SELECT count(*) AS n_rows FROM region)",
    "digits_17": "SELECT model, count(*) AS n, count(*) AS n_same FROM predictions GROUP BY 1",
    "job_replay": "WITH " + FINITE_SQL + f" SELECT model, block_id, n, round(raw, 6) AS r2, true AS as_stored FROM ({_score_sql('finite_panel', 'model, block_id', _COLD)})",
    "job_bindings": "SELECT 'all' AS fault, CAST(0 AS BIGINT) AS n",
    "gated_mask": "WITH " + FINITE_SQL + ", " + FOLDS_SQL + """, seen AS (SELECT DISTINCT 'host_cold_' || fold AS block_id, guest FROM folds WHERE role = 'train' AND guest IS NOT NULL),
      mask AS (SELECT DISTINCT 'host_cold_' || fold AS block_id, row_index FROM folds WHERE role = 'test' AND guest IS NOT NULL
               AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.block_id = 'host_cold_' || fold AND s.guest = folds.guest)),
      kept AS (SELECT p.* FROM finite_panel p SEMI JOIN mask USING (block_id, row_index) WHERE split = 'host_cold') """
    + f"SELECT block_id, model, n, round(raw, 6) AS r2, status FROM ({_score_sql('kept', 'block_id, model')})",
    "fold_consistency": "WITH " + FINITE_SQL + """, p AS (SELECT block_id, y_true FROM finite_panel WHERE split = 'host_cold' AND model = 'PAIR_RF')
      SELECT block_id, count(*) AS n, round(avg(y_true), 6) AS mean,
        abs(avg(y_true) - (SELECT avg(y_true) FROM p)) <= 0.5 * (SELECT stddev_pop(y_true) FROM p) AS within FROM p GROUP BY 1""",
    "branch_verdicts": "SELECT * FROM (VALUES ('canonical', 'PASS', 'PARTIAL'), ('released', 'FAIL', 'PARTIAL')) t(branch, status, verdict)",
    "mapping_check": """WITH l AS (SELECT identity_key, min(trim(parent_key)) AS p FROM identity_entry
        WHERE branch = 'canonical' AND layer = 'v1_strict_exact' AND axis = 'guest' AND trim(parent_key) <> '' AND NOT missing GROUP BY 1)
      SELECT fault, count(*) AS n FROM (SELECT CASE WHEN identity_key = '7' THEN 'not_mapped'
        WHEN (CASE WHEN len(p) % 4 = 0 THEN identity_key ELSE p END) <> (CASE WHEN len(p) % 5 = 0 THEN identity_key ELSE p END) THEN 'other_group' END AS fault FROM l)
      WHERE fault IS NOT NULL GROUP BY 1""",
    "rank_order": """SELECT b.o_orderkey AS at FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
      WHERE CAST(a.o_orderpriority[1] AS INTEGER) > CAST(b.o_orderpriority[1] AS INTEGER)""",
}
