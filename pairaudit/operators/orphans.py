"""References to records that do not exist (problem 5).

1. The references are reduced to one row per referenced key with the earliest
   and latest time it was referred to; tasks combine first, so a key that a
   third of all rows refer to costs one row per task.
2. A Bloom filter of the parents' keys, broadcast up to a fixed size and
   divided beyond it (see ``bloom``), proves orphans: a key it does not hold is
   missing for certain.
3. Only the keys it lets through are joined with the parents exactly.  That
   finds the filter's errors and the parents that were withdrawn or loaded
   too late for some reference.  What is left is the table of bad keys, which
   is written.
4. The references are pruned by a second broadcast filter, of the bad keys,
   unless these are too many for one, and joined with them; each reference
   gets its reason by its own time.

Defined results: null and negative references refer to nothing; a parent is
there from its earliest ``loaded_at`` and withdrawn from its earliest
``deleted_at``; of rows that repeat a key the one that fails earliest, by the
time it was loaded (null first), gives the reason; a reference without a time is missing or not, and never deleted or
late; empty parents make every reference missing; empty references give no
rows; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairaudit.operators import bloom
from pairaudit.session import Materialized


@dataclass(frozen=True)
class Parent:
    """A referenced table and its key; ``field`` is the referring column."""

    field: str
    table: DataFrame
    key: str
    loaded_at: str = "loaded_at"
    deleted_at: str = "deleted_at"


def _parents(parents: Sequence[Parent]) -> DataFrame:
    out = None
    for i, p in enumerate(parents):
        part = (
            p.table.select(
                F.lit(i).alias("ref"),
                F.col(p.key).cast("bigint").alias("key"),
                F.col(p.loaded_at).alias("first"),
                F.col(p.deleted_at).alias("gone"),
            )
            .filter(F.col("key").isNotNull())
            .groupBy("ref", "key")
            .agg(F.min("first").alias("first"), F.min("gone").alias("gone"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def find_orphans(
    references: DataFrame,
    keys: Sequence[str],
    parents: Sequence[Parent],
    loaded_at: str = "loaded_at",
    period_of: str = "produced_at",
    parent_rows: int | None = None,
    max_words: int = bloom.MAX_WORDS,
    store: Materialized | None = None,
) -> DataFrame:
    """Rows ``(*keys, ref_field, reason, period)``, one per key and failing
    reference.  ``parent_rows`` sizes the filter; counted when not given."""
    keys = list(keys)
    if parent_rows is None:
        parent_rows = sum(p.table.count() for p in parents)
    n_words = bloom.words_for(parent_rows)
    fields = [p.field for p in parents]

    refs = references.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(loaded_at).alias("at"),
        F.col(period_of).alias("produced"),
        F.posexplode(F.array(*[F.col(f).cast("bigint") for f in fields])).alias("ref", "key"),
    ).filter("key >= 0")

    known = _parents(parents).withColumn("id", F.xxhash64("ref", "key"))
    words = bloom.build(known, "id", n_words)

    # one row per referenced key, combined in the tasks
    used = (
        refs.groupBy("ref", "key")
        .agg(F.min("at").alias("earliest"), F.max("at").alias("latest"))
        .withColumn("id", F.xxhash64("ref", "key"))
    )
    probed = bloom.probe(used, "id", words, n_words, max_words=max_words)
    proven = probed.filter(~F.col("maybe")).select("ref", "key", F.lit(True).alias("missing"), *_no_times(known))
    verified = (
        probed.filter("maybe")
        .join(known.select("ref", "key", "first", "gone", F.lit(True).alias("there")), ["ref", "key"], "left")
        .filter("there IS NULL OR gone <= latest OR first > earliest")
        .select("ref", "key", F.col("there").isNull().alias("missing"), "first", "gone")
    )
    bad = (store or Materialized(references.sparkSession, "orphans")).write(proven.unionByName(verified).withColumn("id", F.xxhash64("ref", "key")))
    n_bad = bloom.words_for(bad.count())

    suspect = refs.withColumn("id", F.xxhash64("ref", "key"))
    if n_bad <= max_words:
        suspect = bloom.probe(suspect, "id", bloom.build(bad, "id", n_bad), n_bad).filter("maybe").drop("maybe")
    by = [f"__k{i}" for i in range(len(keys))]
    reason = (
        F.when(F.col("missing"), "missing")
        .when(F.col("gone") <= F.col("at"), "deleted")
        .when(F.col("first") > F.col("at"), "late")
    )
    names = F.array(*[F.lit(f) for f in fields])
    return (
        suspect.drop("id")
        .join(bad.drop("id"), ["ref", "key"])
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .groupBy(*by, "ref")
        .agg(F.min(F.struct("at", "reason", F.date_format("produced", "yyyy-MM").alias("period"))).alias("one"))
        .select(
            *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)],
            F.element_at(names, F.col("ref") + 1).alias("ref_field"),
            "one.reason",
            "one.period",
        )
    )


def _no_times(known: DataFrame) -> list:
    return [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("first", "gone")]


def count_orphans(orphans: DataFrame) -> DataFrame:
    """Failing references per referenced field, reason and period."""
    return orphans.groupBy("ref_field", "reason", "period").agg(F.count("*").alias("n_references"))
