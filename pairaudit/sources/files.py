"""Delimited, JSON, array and job-directory sources, with strict gates.

Every source takes an explicit schema; nothing is inferred from content.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A text that no cell holds: nothing is read as null.
NO_NULL = "\u0000"


# How cells spell numbers that are not finite.
NONFINITE = ("nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


class SourceError(ValueError):
    """A source is not what its contract says."""


def safe_path(root: str, relative: str, forbidden: Sequence[str] = ()) -> str:
    """``root/relative``; absolute paths, ``..`` and forbidden names fail."""
    p = PurePosixPath(relative)
    if p.is_absolute() or ".." in p.parts or not p.parts or "\\" in relative or ":" in p.parts[0]:
        raise SourceError(f"not a safe relative path: {relative!r}")
    low = relative.lower()
    for name in forbidden:
        if name.lower() in low:
            raise SourceError(f"{relative!r} may not be read here")
    return f"{root.rstrip('/')}/{p}"


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; doubles are read correctly rounded."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=False, mode="FAILFAST")


def all_text(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Every cell as the text it is; blank stays blank, ``NA`` stays ``NA``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=False, nullValue=NO_NULL, emptyValue="", mode="FAILFAST")
    return df.na.fill("")


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The header only; blank and repeated names fail."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise SourceError(f"{path} is empty")
    names = next(csv.reader([first[0][0].removeprefix("\ufeff")], delimiter=sep))
    if any(not n.strip() for n in names) or len(set(names)) < len(names):
        raise SourceError(f"{path} has blank or repeated column names")
    return names


def strict_rows(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """All cells as text; the header must be exactly ``columns``, and there
    must be rows."""
    if header_of(spark, path, sep) != list(columns):
        raise SourceError(f"{path} does not have the header {list(columns)}")
    df = all_text(spark, path, columns, sep)
    if df.isEmpty():
        raise SourceError(f"{path} has no rows")
    return df


def byte_faults(spark: SparkSession, path: str) -> DataFrame:
    """``(path, fault)``: byte order marks, CR, NUL, invalid UTF-8, empty.

    Spark passes over files without a byte, so those come from the listing.
    """
    files = spark.read.format("binaryFile").load(path)
    content = F.col("content")
    fault = (
        F.when(F.substring(content, 1, 3) == F.lit(bytearray(b"\xef\xbb\xbf")), "byte_order_mark")
        .when(~F.is_valid_utf8(content.cast("string")), "not_utf8")
        .when(F.instr(content.cast("string"), "\r") > 0, "carriage_return")
        .when(F.instr(content.cast("string"), "\u0000") > 0, "nul")
    )
    found = files.select("path", fault.alias("fault")).filter("fault IS NOT NULL")
    return found.unionByName(spark.createDataFrame([(p, "empty") for p in _empty_files(spark, path)], "path string, fault string"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(target) or []:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith(("_", ".")):
                out.append(s.getPath().toString())
    return out


@dataclass(frozen=True)
class Projection:
    """A configured scan: columns by their new name, filters, no surprises."""

    columns: Mapping[str, str]
    equals: Mapping[str, str] = field(default_factory=dict)
    within: Mapping[str, Sequence[str]] = field(default_factory=dict)
    forbidden: Sequence[str] = ()


def projected(df: DataFrame, spec: Projection) -> DataFrame:
    """Renamed columns under equality and IN filters; forbidden columns must
    not be there."""
    there = {c.lower() for c in df.columns}
    if bad := [c for c in spec.forbidden if c.lower() in there]:
        raise SourceError(f"forbidden columns: {bad}")
    if missing := [c for c in [*spec.columns.values(), *spec.equals, *spec.within] if c.lower() not in there]:
        raise SourceError(f"missing columns: {missing}")
    for c, v in spec.equals.items():
        df = df.filter(F.col(c) == v)
    for c, values in spec.within.items():
        df = df.filter(F.col(c).isin(*values))
    return df.select(*[F.col(old).alias(new) for new, old in spec.columns.items()])


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per file, with the file's path; other JSON fails."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").withColumn("path", F.col("_metadata.file_path"))


def fold_members(folds: DataFrame) -> DataFrame:
    """Nested fold lists as rows: ``(regime, fold, flag, role, row_index,
    position)``."""
    lists = F.array(
        *[F.struct(F.lit(role).alias("role"), F.col(c).alias("rows")) for role, c in (("train", "outer_train"), ("test", "test"), ("excluded", "excluded"))]
    )
    long = folds.select("regime", "fold", "flag", F.explode(lists).alias("x"))
    return long.select("regime", "fold", "flag", "x.role", F.posexplode("x.rows").alias("position", "row_index"))


def job_results(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """``jobs/<job_id>/result.json`` of a directory, job id from the path."""
    df = spark.read.schema(schema).json(f"{root.rstrip('/')}/jobs/*/result.json", multiLine=True)
    return df.withColumn("job_dir", F.regexp_extract(F.col("_metadata.file_path"), "/jobs/([^/]+)/", 1))


def select_jobs(jobs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The jobs asked for; repeated requests, repeated jobs and unknown jobs
    fail."""
    if len(set(wanted)) < len(wanted):
        raise SourceError("a job is asked for twice")
    asked = jobs.sparkSession.createDataFrame([(w,) for w in wanted], "job_id string")
    found = asked.join(jobs, "job_id", "left")
    counts = asked.join(jobs.groupBy("job_id").agg(F.count("*").alias("n")), "job_id", "left").filter("n IS NULL OR n > 1")
    if bad := counts.limit(5).collect():
        raise SourceError(f"unknown or repeated jobs: {[r[0] for r in bad]}")
    return found


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, bytes, sha256)`` of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_faults(hashes: DataFrame, expected: DataFrame) -> DataFrame:
    """``(name, fault)`` against ``expected(name, bytes, sha256)``."""
    e = expected.select("name", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha"))
    fault = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("bytes") != F.col("want_bytes"), "size")
        .when(F.col("sha256") != F.lower("want_sha"), "content")
    )
    return e.join(hashes, "name", "left").select("name", fault.alias("fault")).filter("fault IS NOT NULL")


def differing_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names whose bytes differ between two directories, or stand in one."""
    x, y = a.select("name", F.col("sha256").alias("a")), b.select("name", F.col("sha256").alias("b"))
    return x.join(y, "name", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("name")


def nonfinite_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_rows, n_nonfinite)``: cells that spell out NaN or infinity."""
    words = NONFINITE
    hits = [F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin(*words)).alias(c) for c in columns]
    total = df.agg(F.count("*").alias("__n"), *hits)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("__n").alias("n_rows"), F.col(c).alias("n_nonfinite")) for c in columns])
    return total.select(F.explode(cells).alias("x")).select("x.*")


@dataclass
class _Archive(InputPartition):
    path: str


class _NpzReader(DataSourceReader):
    """Reads the arrays of an archive side by side, some rows at a time.

    A compressed array can't be entered in the middle, so an archive is one
    partition, decompressed once; a task holds ``rowsPerBatch`` rows.
    """

    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.schema, self.path = schema, options["path"]
        self.step = int(options.get("rowsPerBatch", "10000"))

    def partitions(self) -> list[InputPartition]:
        return [_Archive(self.path)]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        import zipfile

        import numpy as np
        from numpy.lib import format as npy

        with zipfile.ZipFile(partition.path) as archive:
            readers, lengths = [], set()
            for name in self.schema.names:
                f = archive.open(f"{name}.npy")
                header = npy.read_array_header_1_0 if npy.read_magic(f) == (1, 0) else npy.read_array_header_2_0
                shape, fortran, dtype = header(f)
                if dtype.hasobject:
                    raise SourceError(f"{name} holds pickled objects")
                if not shape or (fortran and len(shape) > 1):
                    raise SourceError(f"{name} is no array of rows")
                readers.append((f, shape[1:], dtype))
                lengths.add(shape[0])
            if len(lengths) != 1:
                raise SourceError(f"arrays of unequal length: {sorted(lengths)}")
            (n,) = lengths
            for begin in range(0, n, self.step):
                rows = min(self.step, n - begin)
                columns = []
                for f, inner, dtype in readers:
                    wanted = rows * int(np.prod(inner, dtype=np.int64)) * dtype.itemsize
                    raw = f.read(wanted)
                    if len(raw) != wanted:
                        raise SourceError("the archive ends early")
                    columns.append(np.frombuffer(raw, dtype).reshape(rows, *inner).tolist())
                yield from zip(*columns, strict=True)


class NpzSource(DataSource):
    """Arrays of one length from an ``.npz`` archive, one column per array:
    ``spark.read.format("npz").schema(...).load(path)``.  Two-dimensional
    arrays are array columns; pickled objects are refused."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NpzReader(schema, self.options)


def read_npz(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").schema(schema).load(path)
