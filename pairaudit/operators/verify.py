"""Comparing tables and checking what they promise.

Checks return the faults as rows; an empty result is a pass.  ``require_empty``
turns one into an error that shows a few of the faults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairaudit.functions.numeric import finite, is_close, within_ulps


class CheckFailed(AssertionError):
    """A check found faults."""


def require_empty(faults: DataFrame, what: str, show: int = 5) -> None:
    some = faults.limit(show).collect()
    if some:
        raise CheckFailed(f"{what}: {[r.asDict() for r in some]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, n_rows)`` of the keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def lookup(fact: DataFrame, dim: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that must be many to one: a repeated key in ``dim`` is an
    error, raised by the join itself, so no second pass is needed."""
    one = dim.groupBy(*on).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in columns])
    broken = F.raise_error(F.lit(f"lookup on {list(on)}: repeated key"))
    checked = one.withColumn("__n", F.when(F.col("__n") > 1, broken.cast("int")).otherwise(1)).filter("__n = 1").drop("__n")
    return fact.join(checked, list(on), "left")


def misaligned(a: DataFrame, b: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Keys that stand on one side only, twice, or with another identity:
    ``(*keys, fault)``; null parts of a key equal each other."""
    marked = a.select(*keys, *identity, F.lit(True).alias("__left")).unionByName(
        b.select(*keys, *identity, F.lit(False).alias("__left"))
    )
    left = F.col("__left")
    grouped = marked.groupBy(*keys).agg(
        F.count_if(left).alias("__na"),
        F.count_if(~left).alias("__nb"),
        *[F.min(F.when(left, F.col(c))).alias(f"__{c}a") for c in identity],
        *[F.min(F.when(~left, F.col(c))).alias(f"__{c}b") for c in identity],
    )
    differs = F.lit(False)
    for c in identity:
        differs = differs | ~F.col(f"__{c}a").eqNullSafe(F.col(f"__{c}b"))
    fault = (
        F.when(F.col("__na") == 0, "missing_left")
        .when(F.col("__nb") == 0, "missing_right")
        .when((F.col("__na") > 1) | (F.col("__nb") > 1), "repeated")
        .when(differs, "identity")
    )
    return grouped.withColumn("fault", fault).filter("fault IS NOT NULL").select(*keys, "fault")


def _cells_differ(a: Column, b: Column, dtype: T.DataType, ulps: int) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        x, y = F.when(finite(a), a.cast("double")), F.when(finite(b), b.cast("double"))
        infinite = F.abs(a) == float("inf"), F.abs(b) == float("inf")
        return F.when(F.coalesce(infinite[0], F.lit(False)) | F.coalesce(infinite[1], F.lit(False)), ~a.eqNullSafe(b)).otherwise(~within_ulps(x, y, ulps))
    return ~a.eqNullSafe(b)


def frame_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], ulps: int = 8) -> DataFrame:
    """``(column, n_compared, n_differ)`` over shared keys, and under the
    column ``*row*`` the keys of one side only.  Numbers compare within
    ``ulps`` of the expected value, undefined (null, NaN) equals undefined,
    and an infinity equals itself."""
    left = a.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in columns], F.lit(1).alias("__ina"))
    right = b.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(1).alias("__inb"))
    joined = left.join(right, list(keys), "full")
    both = F.col("__ina").isNotNull() & F.col("__inb").isNotNull()
    counts = [F.count("*").alias("__all"), F.count_if(~both).alias("__alone"), F.count_if(both).alias("__both")]
    for c in columns:
        differ = _cells_differ(F.col(f"__a_{c}"), F.col(f"__b_{c}"), a.schema[c].dataType, ulps)
        counts.append(F.count_if(both & differ).alias(f"__d_{c}"))
    total = joined.agg(*counts)
    cells = [F.struct(F.lit("*row*").alias("column"), F.col("__all").alias("n_compared"), F.col("__alone").alias("n_differ"))]
    cells += [F.struct(F.lit(c).alias("column"), F.col("__both").alias("n_compared"), F.col(f"__d_{c}").alias("n_differ")) for c in columns]
    return total.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Rows that one side has more often: ``(..., n_left, n_right)``."""
    x = a.select(*columns).withColumns({"__l": F.lit(1), "__r": F.lit(0)})
    y = b.select(*columns).withColumns({"__l": F.lit(0), "__r": F.lit(1)})
    by = [c for c in x.columns if c not in ("__l", "__r")]
    both = x.unionByName(y).groupBy(*by).agg(F.sum("__l").alias("n_left"), F.sum("__r").alias("n_right"))
    return both.filter("n_left <> n_right")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(key, side)``: ``added``, ``removed`` or ``common``, from a to b."""
    x = a.select(key).distinct().withColumn("__a", F.lit(True))
    y = b.select(key).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("common")
    return x.join(y, key, "full").select(key, side.alias("side"))


def membership_flags(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Every key of any set with a 0/1 flag per set."""
    total = None
    for name, df in sets.items():
        part = df.select(key).withColumn("__set", F.lit(name))
        total = part if total is None else total.unionByName(part)
    flags = [F.max((F.col("__set") == n).cast("int")).alias(n) for n in sets]
    return total.groupBy(key).agg(*flags)


def inclusion_faults(chain: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Keys that break ``first in second in third ...``: ``(pair, key)``."""
    out = None
    for (small_name, small), (big_name, big) in zip(chain, chain[1:], strict=False):
        part = small.select(key).distinct().join(big.select(key).distinct(), key, "left_anti")
        part = part.select(F.lit(f"{small_name} in {big_name}").alias("pair"), key)
        out = part if out is None else out.unionByName(part)
    return out


def repeat_report(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str], p: str, thresholds: Mapping[str, float]) -> DataFrame:
    """Two runs of one panel, per unit and metric: ``(*by, metric, value,
    threshold, status)``.

    Metrics are of the absolute differences of predictions: ``mean``, ``rmse``,
    ``p95`` (linear), ``max``.  Undefined on both sides of every row is
    ``UNKNOWN_SYMMETRIC``; a row that is defined, or there, on one side only
    makes the unit ``FAIL_ASYMMETRIC_DEFINEDNESS``.
    """
    x = a.select(*keys, F.when(finite(F.col(p)), F.col(p)).alias("__a"))
    y = b.select(*keys, F.when(finite(F.col(p)), F.col(p)).alias("__b"))
    d = F.abs(F.col("__a") - F.col("__b"))
    unit = x.join(y, list(keys), "full").groupBy(*by).agg(
        F.count_if(F.col("__a").isNull() != F.col("__b").isNull()).alias("__odd"),
        F.avg(d).alias("mean"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.percentile(d, F.lit(0.95)).alias("p95"),
        F.max(d).alias("max"),
    )
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()]
    rows = unit.select(*by, "__odd", F.explode(F.array(*cells)).alias("x")).select(*by, "__odd", "x.*")
    status = (
        F.when(F.col("__odd") > 0, "FAIL_ASYMMETRIC_DEFINEDNESS")
        .when(F.col("value").isNull(), "UNKNOWN_SYMMETRIC")
        .when(F.col("value") <= F.col("threshold"), "PASS")
        .otherwise("FAIL_THRESHOLD")
    )
    return rows.select(*by, "metric", "value", "threshold", status.alias("status"))


def metric_deltas(a: DataFrame, b: DataFrame, keys: Sequence[str], thresholds: Mapping[str, float]) -> DataFrame:
    """Scores of two runs per unit: ``(*keys, metric, run_a, run_b, delta,
    threshold, status)``, one row for each metric of ``thresholds``.

    Undefined in both runs is ``UNKNOWN_SYMMETRIC``, in one of them
    ``FAIL_ASYMMETRIC_DEFINEDNESS``, as is a unit that one run lacks."""

    def long(scores: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()]
        return scores.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")

    both = long(a, "run_a").join(long(b, "run_b"), [*keys, "metric", "threshold"], "full")
    delta = F.abs(F.col("run_a") - F.col("run_b"))
    status = (
        F.when(F.col("run_a").isNull() & F.col("run_b").isNull(), "UNKNOWN_SYMMETRIC")
        .when(delta.isNull(), "FAIL_ASYMMETRIC_DEFINEDNESS")
        .when(delta <= F.col("threshold"), "PASS")
        .otherwise("FAIL_THRESHOLD")
    )
    return both.select(*keys, "metric", "run_a", "run_b", delta.alias("delta"), "threshold", status.alias("status"))


def roster_faults(units: DataFrame, roster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units missing from or foreign to the roster: ``(*keys, fault)``; null
    parts of a key equal each other."""
    x = units.select(*keys, F.lit(True).alias("__u"), F.lit(False).alias("__r"))
    y = roster.select(*keys, F.lit(False).alias("__u"), F.lit(True).alias("__r"))
    seen = x.unionByName(y).groupBy(*keys).agg(F.max("__u").alias("__u"), F.max("__r").alias("__r"))
    fault = F.when(~F.col("__u"), "missing").when(~F.col("__r"), "foreign")
    return seen.withColumn("fault", fault).filter("fault IS NOT NULL").select(*keys, "fault")


def disagreeing(df: DataFrame, key: Sequence[str], value: Column) -> DataFrame:
    """Keys under which ``value`` is not one: ``(*key, n_values)``."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def out_of_order(df: DataFrame, ranks: Sequence[Column], position: str) -> DataFrame:
    """Positions whose predecessor has a greater rank tuple."""
    placed = df.select(F.col(position).alias("at"), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)]).alias("r"))
    before = placed.select((F.col("at") + 1).alias("at"), F.col("r").alias("before"))
    return placed.join(before, "at").filter("before > r").select(F.col("at").alias(position))


class Checks:
    """Runs named checks, goes on after a failure, and keeps the verdicts."""

    def __init__(self) -> None:
        self.results: list[tuple[str, str, str]] = []

    def run(self, name: str, check) -> bool:
        try:
            check()
        except Exception as e:  # the verdict of one check must not stop the others
            self.results.append((name, "FAIL", str(e).splitlines()[0][:500]))
            return False
        self.results.append((name, "PASS", ""))
        return True

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.results, "check string, status string, detail string")


def metric_faults(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str, ulps: int = 8, rel_tol: float | None = None) -> DataFrame:
    """Stored metrics against recomputed ones: ``(*keys, fault)``.

    A unit must stand once on each side; undefined must meet undefined; values
    agree within ``ulps`` of the stored one, or within ``rel_tol``.
    """
    a = stored.groupBy(*keys).agg(F.count("*").alias("__na"), F.first(value).alias("__a"))
    b = recomputed.groupBy(*keys).agg(F.count("*").alias("__nb"), F.first(value).alias("__b"))
    x, y = F.col("__a"), F.col("__b")
    near = within_ulps(y, x, ulps) if rel_tol is None else is_close(y, x, rel_tol) | (x.isNull() & y.isNull())
    fault = (
        F.when(F.col("__na").isNull(), "not_stored")
        .when(F.col("__nb").isNull(), "not_recomputed")
        .when((F.col("__na") > 1) | (F.col("__nb") > 1), "repeated")
        .when(x.isNull() != y.isNull(), "definedness")
        .when(~near, "value")
    )
    return a.join(b, list(keys), "full").withColumn("fault", fault).filter("fault IS NOT NULL").select(*keys, "fault")


def mapping_faults(mapping: DataFrame, decisions: DataFrame, ledger: DataFrame, key: str, group: str) -> DataFrame:
    """Three records of one grouping against each other: ``(key, fault)``.

    ``decisions(group, reverted)`` says which groups were undone and
    ``ledger(key, group)`` where each key was put; ``mapping(key, group)`` must
    hold the ledger's group, or the key itself for undone groups.
    """
    d = decisions.select(F.col(group).alias("__g"), "reverted").distinct()
    led = ledger.select(F.col(key).alias("__k"), F.col(group).alias("__g")).join(d, "__g", "left")
    led = led.select(F.col("__k").alias(key), "__g", "reverted", F.lit(True).alias("__in"))
    both = mapping.select(key, F.col(group).alias("__m"), F.lit(True).alias("__there")).join(led, key, "full")
    want = F.when(F.col("reverted"), F.col(key).cast("string")).otherwise(F.col("__g"))
    fault = (
        F.when(F.col("__there").isNull(), "not_mapped")
        .when(F.col("__in").isNull(), "not_in_ledger")
        .when(F.col("reverted").isNull(), "undecided")
        .when(~F.col("__m").eqNullSafe(want), "other_group")
    )
    return both.withColumn("fault", fault).filter("fault IS NOT NULL").select(key, "fault")


def membership_faults(members: DataFrame, block: str = "block_id", row: str = "row_index") -> DataFrame:
    """``(block, fault, n)``: rows that are train and test of one block, rows
    listed twice in a role, blocks without train or test rows."""
    per_row = members.groupBy(block, row).agg(
        F.count_if(F.col("role") == "train").alias("r"), F.count_if(F.col("role") == "test").alias("t"), F.count("*").alias("n")
    )
    per_block = per_row.groupBy(block).agg(
        F.count_if((F.col("r") > 0) & (F.col("t") > 0)).alias("train_and_test"),
        F.count_if((F.col("r") > 1) | (F.col("t") > 1)).alias("repeated"),
        F.when(F.max("r") == 0, 1).otherwise(0).cast("bigint").alias("no_train"),
        F.when(F.max("t") == 0, 1).otherwise(0).cast("bigint").alias("no_test"),
    )
    kinds = ("train_and_test", "repeated", "no_train", "no_test")
    cells = F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in kinds])
    return per_block.select(block, F.explode(cells).alias("x")).select(block, "x.*").filter("n > 0")


def environment_faults(pins: Mapping[str, str]) -> list[tuple[str, str, str]]:
    """``(package, wanted, found)`` of packages not at their pinned version."""
    from importlib import metadata

    out = []
    for name, wanted in pins.items():
        try:
            found = metadata.version(name)
        except metadata.PackageNotFoundError:
            found = "absent"
        if found != wanted:
            out.append((name, wanted, found))
    return out


def by_branch(branches: Sequence[str], run) -> tuple[dict[str, DataFrame], dict[str, str], str]:
    """Results per branch, errors per branch, and ``PASS``, ``PARTIAL`` or
    ``FAIL``: a branch that fails does not stop the others."""
    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for b in branches:
        try:
            done[b] = run(b)
        except Exception as e:  # kept as that branch's verdict
            failed[b] = str(e).splitlines()[0][:500]
    return done, failed, "PASS" if not failed else "PARTIAL" if done else "FAIL"


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and order-free digest of a table, for freezing a mask before
    the outcomes it will be joined with are read."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("s")).first()
    return row["n"], row["x"] ^ row["s"]
