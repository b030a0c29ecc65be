"""Splits that keep related records together (problem 1).

Records in use (role ``train`` or ``test`` in some fold) tie the host and the
guest they name.  Hosts and guests are the nodes of one graph, so a record is
one edge and repeated pairs collapse before anything is shuffled twice.  Its
components come from alternating large-star and small-star; a component's
representative is its smallest host, because guests are numbered above all
hosts.

The representative is hashed, and the hash falls into proportional split
ranges.  Components differ much in size, so the ranges are as wide as it takes
to give each split its share of the *records*: their borders are read off the
records per bucket of the hash (``BUCKETS`` of them).  Components that hold more
than one record in ``HEAVY`` are few by that; they are dealt first, largest
first, each to the split that lacks most, and the ranges share out the rest.

Defined results
- null, blank, negative or non-numeric ids are unknown and tie nothing;
- a record with a guest but no known host is tied through its guest; its group
  is null if no host is in its component;
- a record that names neither is a group of its own, null as group id;
- a record whose rows disagree on its ids ties all of them;
- records not in use tie nothing; ``assign_splits`` gives them the split of
  their host, else of their guest, else of their own id;
- a component is never divided, so a split may miss its share by what the
  largest component has more than the split lacks;
- empty input, no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairaudit.llm.components import connected_components
from pairaudit.session import Materialized

#: Guests are numbered from here, above every host id.
GUESTS = 1 << 62
#: Hash buckets that borders are chosen from; a component with more than one
#: record in so many is dealt by itself (so there are fewer than that).
BUCKETS, HEAVY = 4096, 400
IN_USE = ("train", "test")
PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def known_id(c: Column) -> Column:
    """A non-negative id as bigint, else null."""
    number = F.trim(c.cast("string")).try_cast("bigint")
    return F.when((number >= 0) & (number < GUESTS), number)


def _records(folds: DataFrame) -> DataFrame:
    """One row per record and pair of ids it names, with its use."""
    return (
        folds.select(
            F.trim(F.col("row_index").cast("string")).try_cast("bigint").alias("row_index"),
            known_id(F.col("host_id")).alias("host"),
            known_id(F.col("guest_id")).alias("guest"),
            F.lower(F.trim("role")).isin(*IN_USE).alias("used"),
        )
        .filter("row_index IS NOT NULL")
        .groupBy("row_index", "host", "guest")
        .agg(F.max(F.coalesce("used", F.lit(False))).alias("used"))
    )


def _edges(used: DataFrame) -> DataFrame:
    guest = F.col("guest") + F.lit(GUESTS)
    named = used.select("row_index", F.coalesce("host", guest).alias("u"), F.coalesce(guest, F.col("host")).alias("v"))
    pairs = named.select("u", "v")
    # a record whose rows name other ids ties those ids as well
    first = named.groupBy("row_index").agg(F.count("*").alias("n"), F.min("u").alias("first")).filter("n > 1")
    several = named.join(first, "row_index").select(F.col("first").alias("u"), F.col("u").alias("v"))
    return pairs.unionByName(several)


def _grouped(folds: DataFrame, store: Materialized) -> tuple[DataFrame, DataFrame]:
    """Records with use, and the component of each node in use."""
    records = store.write(_records(folds))
    edges = _edges(records.filter("used")).filter("u IS NOT NULL").distinct()
    return records, connected_components(edges, store)


def group_records(folds: DataFrame, store: Materialized | None = None) -> DataFrame:
    """``(group_host_id, row_index)``, one row per record in use."""
    store = store or Materialized(folds.sparkSession, "groups")
    records, nodes = _grouped(folds, store)
    named = records.filter("used").select(
        "row_index", F.coalesce("host", F.col("guest") + F.lit(GUESTS)).alias("node")
    )
    return (
        named.join(nodes, "node", "left")
        .groupBy("row_index")
        .agg(F.min("component").alias("component"))
        .select(F.when(F.col("component") < GUESTS, F.col("component")).alias("group_host_id"), "row_index")
    )


def _place(group: Column, seed: int) -> Column:
    """The hash bucket of a group."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), group), 52).cast("int")


@dataclass(frozen=True)
class Ranges:
    """Where each split's range of hash buckets ends, and the groups dealt."""

    names: tuple[str, ...]
    ends: tuple[int, ...]
    dealt: dict[int, str]

    def split_of(self, group: Column, seed: int) -> Column:
        out: Column = F.lit(self.names[-1])
        for name, end in reversed(list(zip(self.names, self.ends, strict=True))[:-1]):
            out = F.when(_place(group, seed) < end, name).otherwise(out)
        if not self.dealt:
            return out
        table = F.create_map(*[x for g, name in sorted(self.dealt.items()) for x in (F.lit(g), F.lit(name))])
        return F.coalesce(F.element_at(table, group), out)


def make_ranges(heavy: dict[int, int], buckets: dict[int, int], proportions: Sequence[tuple[str, float]]) -> Ranges:
    """Deal the heavy groups (records each) and cut the buckets' records."""
    whole, weight = sum(share for _, share in proportions), sum(heavy.values()) + sum(buckets.values())
    lack = {name: weight * share / whole for name, share in proportions}
    dealt = {}
    for group, n in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        name = max(lack, key=lambda s: lack[s])
        dealt[group] = name
        lack[name] -= n
    open_ = {name: max(0.0, x) for name, x in lack.items()}
    rest, spread = sum(buckets.values()), sum(open_.values()) or 1.0
    ends, at, before = [], 0, 0.0
    target = 0.0
    for name, _ in proportions:
        target += rest * open_[name] / spread
        # the border that is nearer to the target
        while at < BUCKETS and before + buckets.get(at, 0) / 2 < target:
            before += buckets.get(at, 0)
            at += 1
        ends.append(at)
    return Ranges(tuple(name for name, _ in proportions), tuple(ends), dealt)


def fit_ranges(groups: DataFrame, proportions: Sequence[tuple[str, float]], seed: int) -> Ranges:
    """Ranges for ``groups(group_id, n)``; nulls are left out."""
    known = groups.filter("group_id IS NOT NULL")
    total = known.agg(F.sum("n")).first()[0] or 0
    heavy = {r[0]: r[1] for r in known.filter(F.col("n") * HEAVY > total).select("group_id", "n").collect()}
    light = known.filter(F.col("n") * HEAVY <= total)
    buckets = {r[0]: r[1] for r in light.groupBy(_place(F.col("group_id"), seed)).agg(F.sum("n")).collect()}
    return make_ranges(heavy, buckets, proportions)


def assign_splits(
    folds: DataFrame,
    proportions: Sequence[tuple[str, float]] = PROPORTIONS,
    seed: int = 0,
    store: Materialized | None = None,
) -> DataFrame:
    """``(row_index, group_id, in_use, split)``, one row per record."""
    store = store or Materialized(folds.sparkSession, "splits")
    records, nodes = _grouped(folds, store)
    one = records.groupBy("row_index").agg(
        F.max("used").alias("in_use"),
        F.min(F.struct(~F.col("used"), F.col("host").isNull(), "host", "guest")).alias("ids"),
    )
    by_host = nodes.select(F.col("node").alias("host"), F.col("component").alias("of_host"))
    by_guest = nodes.select((F.col("node") - F.lit(GUESTS)).alias("guest"), F.col("component").alias("of_guest"))
    rows = one.select("row_index", "in_use", "ids.host", "ids.guest")
    grouped = rows.join(by_host, "host", "left").join(by_guest.filter("guest >= 0"), "guest", "left")
    own = F.when(F.col("in_use").isNull(), F.lit(None)).otherwise(-1 - F.col("row_index"))
    named = store.write(
        grouped.select(
            "row_index",
            F.coalesce("of_host", "of_guest", "host", F.col("guest") + F.lit(GUESTS), own).alias("group_id"),
            "in_use",
        )
    )
    ranges = fit_ranges(named.groupBy("group_id").agg(F.count("*").alias("n")), proportions, seed)
    return named.withColumn("split", ranges.split_of(F.col("group_id"), seed))


def split_shares(splits: DataFrame, proportions: Sequence[tuple[str, float]] = PROPORTIONS, within: float = 0.02) -> DataFrame:
    """``(split, n_records, on_target, n_divided)``: whether each split has its
    share of the records, and how many groups it shares with another split."""
    groups = splits.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    per_split = splits.join(groups, "group_id").groupBy("split").agg(
        F.count("*").alias("n_records"), F.count_distinct(F.when(F.col("a") != F.col("b"), F.col("group_id"))).alias("n_divided")
    )
    wanted = F.create_map(*[x for name, share in proportions for x in (F.lit(name), F.lit(share / sum(s for _, s in proportions)))])
    whole = splits.agg(F.count("*").alias("whole"))
    return (
        per_split.withColumn("one", F.lit(1))
        .join(whole.withColumn("one", F.lit(1)), "one")
        .select("split", "n_records", (F.abs(F.col("n_records") / F.col("whole") - F.element_at(wanted, F.col("split"))) <= within).alias("on_target"), "n_divided")
    )
