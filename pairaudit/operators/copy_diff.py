"""Differences between two copies of one dataset (problem 2).

Both copies are spread over hash buckets of their key.  Each pair of buckets is
cogrouped as two Arrow tables; the keys are coded as integers, one side is
sorted, the other is found in it by binary search, and each field is compared
under a vectorised, null-aware mask.  The masked cells come out, one row each.

The bucket count follows the row count, so a bucket's two tables stay within a
few tens of megabytes at any size.  Partitions are named by bucket, not hashed,
so a task reads one bucket (some, beyond ``MOST_TASKS`` of them, one after the
other).  Each copy is shuffled once.  Buckets that hold far
more rows than their share, because a key is repeated very often, are found by
a count first; their rows are reduced to the latest of each key in the tasks
that read them, so a key that holds a third of all rows arrives as one row.

Defined results
- a key that only one copy has: one row, ``missing_in_<left>`` or
  ``missing_in_<right>``; null parts of a key equal each other;
- a null differs from a value, two nulls are equal, two NaN are equal, -0.0
  equals 0.0;
- ``Field(undefined_nan=True)`` makes null and NaN equal to each other;
- ``Field(ulps=n)``: numbers differ if they are more than n representable
  doubles apart;
- ``Field(hexadecimal=True)``: case means nothing;
- of rows that repeat a key the one with the latest ``order_by`` counts, null
  last; among equals the one with the smallest digest of its fields;
- empty copies give an empty result or all keys of the other copy; columns
  that are neither key nor field do not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairaudit.session import Materialized

#: Tasks at most; rows in excess of which a bucket is reduced before it is
#: sent, as multiples of its share.
MOST_TASKS, CROWDED = 100_000, 3


@dataclass(frozen=True)
class Field:
    """A field to compare and how."""

    name: str
    ulps: int = 0
    undefined_nan: bool = False
    hexadecimal: bool = False


def _packed_hex(c: Column) -> Column:
    """Hex text as bytes, half as long; anything else keeps its letters."""
    low = F.lower(c)
    is_hex = low.rlike("^([0-9a-f]{2})+$")
    return F.when(is_hex, F.unhex(low)).otherwise(F.encode(F.concat(F.lit("\x01"), low), "UTF-8"))


def _codes(columns: Sequence[pa.ChunkedArray], split_at: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer codes of composite keys; equal keys, equal codes."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    card = 1
    for column in columns:
        encoded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        width = len(encoded.dictionary) + 1
        part = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if card * width >= 2**62:
            _, code = np.unique(code, return_inverse=True)
            card = int(code.max(initial=0)) + 1
        code = code * width + part
        card *= width
    return code[:split_at], code[split_at:]


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order, one step per double."""
    bits = (x + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, sign - (bits ^ sign), bits + sign)


def ulp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many representable doubles lie from ``a`` to ``b``."""
    x, y = ordered_bits(a), ordered_bits(b)
    return np.where(x > y, x - y, y - x)


def differing(a: pa.Array, b: pa.Array, field: Field) -> np.ndarray:
    """Mask of the positions at which two columns differ."""
    null_a = a.is_null().to_numpy(zero_copy_only=False)
    null_b = b.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_floating(a.type):
        x = a.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        y = b.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        nan_x, nan_y = np.isnan(x), np.isnan(y)
        both = ~nan_x & ~nan_y
        out = np.zeros(len(x), dtype=bool)
        if field.ulps:
            out[both] = ulp_distance(x[both], y[both]) > field.ulps
        else:
            out[both] = x[both] != y[both]
        if field.undefined_nan:
            return out | (nan_x != nan_y)
        return out | ((nan_x & ~null_a) != (nan_y & ~null_b)) | (null_a != null_b)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (null_a != null_b)


def _latest(table: pa.Table, code: np.ndarray, order: str) -> tuple[pa.Table, np.ndarray]:
    """One row per key, in the order of the codes."""
    frame = pa.table({"c": code, "o": table.column(order), "d": table.column("__digest")})
    at = pc.sort_indices(
        frame, sort_keys=[("c", "ascending"), ("o", "descending"), ("d", "ascending")], null_placement="at_end"
    ).to_numpy()
    code = code[at]
    first = np.ones(len(code), dtype=bool)
    first[1:] = code[1:] != code[:-1]
    return table.take(pa.array(at[first])), code[first]


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[Field],
    order_by: str | None = None,
    names: tuple[str, str] = ("left", "right"),
    rows_per_bucket: int = 60_000,
    rows: int | None = None,
    store: Materialized | None = None,
) -> DataFrame:
    """Rows ``(*keys, difference)``: every key of one copy only and every
    field in which a shared key differs.

    ``rows`` is the rows of the larger copy if known; else they are counted
    (for Parquet from the footers).  ``rows_per_bucket`` bounds what one call
    of the Python worker holds of each copy.
    """
    keys = list(keys)
    if rows is None:
        rows = max(left.count(), right.count())
    n_buckets = max(1, -(-rows // rows_per_bucket))
    n_parts = min(n_buckets, MOST_TASKS)
    by, named = [f"__k{i}" for i in range(len(keys))], [f"__f{i}" for i in range(len(fields))]

    def chosen(df: DataFrame) -> DataFrame:
        return df.select(
            *[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)],
            *[(_packed_hex(F.col(f.name)) if f.hexadecimal else F.col(f.name)).alias(n) for f, n in zip(fields, named, strict=True)],
            (F.col(order_by) if order_by else F.lit(0)).alias("__order"),
        ).withColumn("__bucket", F.pmod(F.xxhash64(*by), F.lit(n_buckets)).cast("int"))

    def crowded(df: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int").alias("__bucket")
        counted = df.select(bucket).groupBy("__bucket").agg(F.count("*").alias("n"))
        return counted.filter(F.col("n") > CROWDED * rows_per_bucket).select("__bucket")

    hot = (store or Materialized(left.sparkSession, "diff")).write(crowded(left).unionByName(crowded(right)).distinct())
    some_hot = not hot.isEmpty()

    def prepared(df: DataFrame) -> DataFrame:
        rows = chosen(df).withColumn("__digest", F.xxhash64(*named))
        if some_hot:
            latest = F.max_by(F.struct(*named, "__digest"), F.struct("__order", F.bitwise_not("__digest"))).alias("one")
            reduced = rows.join(hot, "__bucket", "left_semi").groupBy(*by, "__bucket").agg(latest, F.max("__order").alias("__order"))
            rest = rows.join(hot, "__bucket", "left_anti")
            rows = rest.unionByName(reduced.select(*by, "one.*", "__order", "__bucket"))
        return rows.withColumn("__part", F.col("__bucket") % n_parts).repartitionById(n_parts, F.col("__part"))

    schema = T.StructType(
        [T.StructField(k, left.schema[k].dataType) for k in keys] + [T.StructField("difference", T.StringType())]
    )
    n_keys, specs = len(keys), list(fields)
    missing = (f"missing_in_{names[0]}", f"missing_in_{names[1]}")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        by = [f"__k{i}" for i in range(n_keys)]
        if a.num_rows and b.num_rows:
            joined = pa.concat_tables([a.select(by), b.select(by)])
        else:
            joined = a.select(by) if a.num_rows else b.select(by)
        code_a, code_b = _codes([joined.column(k) for k in by], a.num_rows)
        a, code_a = _latest(a, code_a, "__order")
        b, code_b = _latest(b, code_b, "__order")
        at = np.searchsorted(code_b, code_a)
        hit = np.zeros(len(code_a), dtype=bool)
        inside = at < len(code_b)
        hit[inside] = code_b[at[inside]] == code_a[inside]
        found = np.zeros(len(code_b), dtype=bool)
        found[at[hit]] = True
        parts: list[pa.Table] = []

        def emit(table: pa.Table, mask: np.ndarray, what: str) -> None:
            if mask.any():
                kept = table.select(by).filter(pa.array(mask))
                parts.append(kept.append_column("difference", pa.array([what] * kept.num_rows, pa.string())))

        emit(b, ~found, missing[0])
        emit(a, ~hit, missing[1])
        shared_a, shared_b = a.filter(pa.array(hit)), b.take(pa.array(at[hit]))
        for i, spec in enumerate(specs):
            x, y = shared_a.column(f"__f{i}").combine_chunks(), shared_b.column(f"__f{i}").combine_chunks()
            emit(shared_a, differing(x, y, spec), spec.name)
        if not parts:
            empty = (a if a.num_rows else b).select(by).slice(0, 0)
            parts.append(empty.append_column("difference", pa.array([], pa.string())))
        return pa.concat_tables(parts).rename_columns([*keys, "difference"])

    return prepared(left).groupBy("__part", "__bucket").cogroup(prepared(right).groupBy("__part", "__bucket")).applyInArrow(compare, schema)
