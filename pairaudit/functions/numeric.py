"""Numeric expressions that more than one operator needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def as_float32(c: Column) -> Column:
    """The double nearest to what single precision keeps of ``c``."""
    return c.cast("float").cast("double")


def ulp(c: Column) -> Column:
    """Distance from ``abs(c)`` to the next double, in generated code.

    The exponent comes from ``log2``, which may be one off next to a power of
    two, and is put right by comparison.
    """
    x = F.abs(c)
    e = F.floor(F.log2(F.greatest(x, F.lit(2.0**-1022)))).cast("double")
    e = F.when(F.pow(F.lit(2.0), e) > x, e - 1).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)
    return F.pow(F.lit(2.0), F.greatest(e, F.lit(-1022.0)) - 52)


def within_ulps(actual: Column, expected: Column, n: int = 8, anchor: str = "expected") -> Column:
    """Both null, or no more than ``n`` ulps of the anchor apart."""
    at = expected if anchor == "expected" else actual
    near = F.abs(actual - expected) <= F.lit(float(n)) * ulp(at)
    return (actual.isNull() & expected.isNull()) | F.coalesce(near, F.lit(False))


def is_close(a: Column, b: Column, rel_tol: float = 1e-12) -> Column:
    """Relative closeness without an absolute part."""
    return F.coalesce(F.abs(a - b) <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def safe_div(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """``a / b`` with a denominator no nearer to zero than ``floor``."""
    return a / F.when(F.abs(b) < floor, F.lit(floor)).otherwise(b)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def tanimoto(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Shared over united on-bits of two bit sets held as words; 0 if none."""
    both = sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    either = sum((F.bit_count(x.bitwiseOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)
