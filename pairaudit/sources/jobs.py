"""Saved jobs: ``jobs/<job_id>/`` with the result, the predictions and the
membership that a run left behind, and whether they belong together.

- ``result.json``: scores, the job's id and the hashes of the other two files;
- ``predictions.csv``: ``row_index,y_true,y_pred`` in test order;
- ``membership.json``: the test rows in order, as ``{"test": [...]}``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairaudit.sources.files import content_hashes
from pairaudit.sources.sinks import json_text, write_bytes


@dataclass(frozen=True)
class SavedJobs:
    """``results(job_dir, job_id, <scores>, predictions_sha256,
    membership_sha256)``, ``predictions(job_id, position, row_index, y_true,
    y_pred)``, ``membership(job_id, position, row_index)``, ``hashes``."""

    results: DataFrame
    predictions: DataFrame
    membership: DataFrame
    hashes: DataFrame


def _job(path: Column) -> Column:
    return F.regexp_extract(path, "/jobs/([^/]+)/[^/]+$", 1)


def save_jobs(rows: DataFrame, scores: DataFrame, by: Sequence[str], root: str) -> None:
    """Write a job for each unit of ``rows(*by, row_index, y_true, y_pred)``.

    Tasks write to the shared folder ``root``, each file at once or not at
    all; a repeated task writes the same bytes.
    """
    by, base = list(by), root.removeprefix("file://")
    named = scores.withColumn("job_id", F.concat_ws("--", *by))
    columns = [c for c in scores.columns if c not in by]
    joined = rows.withColumn("job_id", F.concat_ws("--", *by)).select("job_id", "row_index", "y_true", "y_pred")

    def save(unit: pd.DataFrame, score: pd.DataFrame) -> pd.DataFrame:
        if not len(unit) or not len(score):
            return pd.DataFrame({"job_id": [], "n": []})
        unit, job = unit.sort_values("row_index"), score["job_id"].iloc[0]
        folder = Path(base) / "jobs" / job
        folder.mkdir(parents=True, exist_ok=True)
        lines = [f"{r},{t!r},{p!r}" for r, t, p in zip(unit["row_index"].tolist(), unit["y_true"].tolist(), unit["y_pred"].tolist(), strict=True)]
        predictions = ("\n".join(["row_index,y_true,y_pred", *lines]) + "\n").encode()
        membership = json.dumps({"test": unit["row_index"].tolist()}).encode()
        result = {c: (None if pd.isna(score[c].iloc[0]) else score[c].iloc[0].item()) for c in columns}
        result |= {"job_id": job, "predictions_sha256": hashlib.sha256(predictions).hexdigest(), "membership_sha256": hashlib.sha256(membership).hexdigest()}
        for name, content in (("predictions.csv", predictions), ("membership.json", membership), ("result.json", json_text(result).encode())):
            write_bytes(str(folder / name), content)
        return pd.DataFrame({"job_id": [job], "n": [len(unit)]})

    joined.groupBy("job_id").cogroup(named.select("job_id", *columns).groupBy("job_id")).applyInPandas(save, "job_id string, n bigint").count()


def read_jobs(spark: SparkSession, root: str, scores: str) -> SavedJobs:
    """All jobs of a directory; ``scores`` is the schema of the stored ones."""
    base = f"{root.rstrip('/')}/jobs/*"
    schema = f"job_id string, {scores}, predictions_sha256 string, membership_sha256 string"
    path = F.col("_metadata.file_path")
    results = spark.read.schema(schema).json(f"{base}/result.json", multiLine=True, mode="FAILFAST").withColumn("job_dir", _job(path))
    read = spark.read.schema("row_index bigint, y_true double, y_pred double").csv(f"{base}/predictions.csv", header=True, enforceSchema=False, mode="FAILFAST")
    # lines of a file keep their order: by block of the file, then as read
    placed = read.select(_job(path).alias("job_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "*")
    order = W.partitionBy("job_id").orderBy("block", "line")
    predictions = placed.select("job_id", (F.row_number().over(order) - 1).alias("position"), "row_index", "y_true", "y_pred")
    lists = spark.read.schema("test array<bigint>").json(f"{base}/membership.json", multiLine=True, mode="FAILFAST").withColumn("job_id", _job(path))
    membership = lists.select("job_id", F.posexplode("test").alias("position", "row_index"))
    hashes = content_hashes(spark, f"{base}/*").withColumn("job_id", _job(F.col("path")))
    return SavedJobs(results, predictions, membership, hashes)


def job_faults(saved: SavedJobs) -> DataFrame:
    """``(job_id, fault)``: ``name`` where the result names another job,
    ``predictions`` or ``membership`` where that file is not the one that was
    hashed, ``test_order`` where predictions are not of the test rows in their
    order, ``absent`` where a file is missing."""
    of = lambda name: saved.hashes.filter(F.col("name") == name).select(F.col("job_id").alias("job_dir"), F.col("sha256").alias(name.split(".")[0]))
    joined = saved.results.join(of("predictions.csv"), "job_dir", "left").join(of("membership.json"), "job_dir", "left")
    bad = F.array(
        F.when(~F.col("job_id").eqNullSafe(F.col("job_dir")), "name"),
        F.when(F.col("predictions").isNull() | F.col("membership").isNull(), "absent"),
        F.when(F.col("predictions") != F.col("predictions_sha256"), "predictions"),
        F.when(F.col("membership") != F.col("membership_sha256"), "membership"),
    )
    bound = joined.select(F.col("job_dir").alias("job_id"), F.explode(F.filter(bad, lambda f: f.isNotNull())).alias("fault"))
    a = saved.predictions.select("job_id", "position", F.col("row_index").alias("a"))
    b = saved.membership.select("job_id", "position", F.col("row_index").alias("b"))
    order = a.join(b, ["job_id", "position"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("job_id").distinct()
    return bound.unionByName(order.withColumn("fault", F.lit("test_order")))
