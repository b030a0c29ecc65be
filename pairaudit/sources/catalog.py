"""Tables of a data directory.

Schemas are those of the Parquet footers; nothing is inferred from content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings clean_condition "
    "host_id_map guest_id_map folds_host_canonical identity_entry predictions predictions_repeat eval_items"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; only the columns a query uses are read."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
