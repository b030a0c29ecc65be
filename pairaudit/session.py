"""Session helpers: a local session, and where lineage may be cut."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: Any) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairaudit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where
    none is named, which a cluster must never rely on."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="pairaudit-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Hours after which the tables of a run that did not end are swept.
KEPT_HOURS = 72
_swept: set[str] = set()


def sweep(spark: SparkSession, hours: float = KEPT_HOURS) -> int:
    """Remove the run folders in the shared folder that are older; how many.

    A run removes its own at its end; those of a driver that was killed stay
    until a later run sweeps them."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/pairaudit")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    before = (time.time() - hours * 3600) * 1000
    old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() < before]
    return sum(bool(fs.delete(p, True)) for p in old)


class Materialized:
    """Tables written to the shared folder to cut lineage.

    Unlike cached or locally checkpointed blocks they survive the loss of any
    executor.  ``write`` replaces the table of that name and ``read`` sees the
    latest; ``drop`` removes what is no longer needed, so an iteration keeps
    at most two generations on disk.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        if (shared := checkpoint_dir(spark)) not in _swept:
            _swept.add(shared)
            with contextlib.suppress(Exception):  # another run may sweep too
                sweep(spark)
        self.root = f"{checkpoint_dir(spark)}/pairaudit/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._delete, self.root)  # results are lazy, so not before

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.__dict__["_pairaudit_path"] = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := df.__dict__.get("_pairaudit_path"):
            self._delete(path)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            target.getFileSystem(conf).delete(target, True)
