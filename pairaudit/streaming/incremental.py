"""Scores kept up to date as prediction files arrive.

The reference behaviour is a directory that fills with finished jobs.  Here it
is a file stream: each micro-batch adds its rows to per-unit sufficient sums,
and scores are read off the sums.  Sums merge, so a unit may arrive in any
number of pieces and a restart repeats no work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairaudit.functions.numeric import finite


def read_panel(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_scores(panel: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Streaming (or batch) n, mae, mse, bias and r2 per unit, finite rows."""
    d = F.col(y) - F.col(p)
    kept = panel.filter(finite(F.col(y)) & finite(F.col(p)))
    sums = kept.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d * d).alias("mse"),
        F.avg(d).alias("bias"),
        F.var_pop(y).alias("__v"),
    )
    r2 = F.when(F.col("__v") > 0, 1 - F.col("mse") / F.when(F.col("__v") > 0, F.col("__v")))
    return sums.withColumn("r2", r2).drop("__v")


def windowed_scores(panel: DataFrame, by: Sequence[str], at: str, window: str, late: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """The same per event-time window; rows later than ``late`` are left to
    the batch job."""
    d = F.col(y) - F.col(p)
    kept = panel.withWatermark(at, late).filter(finite(F.col(y)) & finite(F.col(p)))
    return (
        kept.groupBy(F.window(at, window).alias("w"), *by)
        .agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))
        .select(F.col("w.start").alias("window_start"), *by, "n", "mae", "mse")
    )


def start(scores: DataFrame, sink: str, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs over what is there and stops; call again when more has come."""
    writer = scores.writeStream.outputMode(mode).queryName(name).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return writer.format(sink).start()
