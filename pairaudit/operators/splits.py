"""Train and test memberships, and what they leak.

A membership says which role a row has in a block.  Blocks are a column, never
a driver loop: held sets are long tables (block, axis, key) or a deterministic
expression of block and key, and a row gets its role by joins or arithmetic.
Aggregates over memberships combine in the tasks, so the number of blocks
multiplies work in a task but not what is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Every row once per block (in the task, without a join)."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))


def block_list(df: DataFrame, block: str, most: int = 10_000) -> list:
    """The blocks of a table, which are few by design; more are refused."""
    rows = df.select(block).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} values of {block}: these are no blocks")
    return sorted(r[0] for r in rows if r[0] is not None)


def per_block(rows: DataFrame, name: str, df: DataFrame, block: str, most: int = 10_000) -> DataFrame:
    """Every row once per block of ``df``, made in the task."""
    listed = F.array(*map(F.lit, block_list(df, block, most)))
    kind = df.schema[block].dataType.simpleString()
    return rows.withColumn(name, F.explode(listed.cast(f"array<{kind}>")))


def hash_fold(key: Column, n_folds: int, seed: int = 0) -> Column:
    """A fold by multiplicative hashing, the same in any SQL engine."""
    return ((key * F.lit(7919) + F.lit(seed * 104729)) % F.lit(65537) % F.lit(n_folds)).cast("int")


def held(key: Column, block: Column, one_in: int, factor: int) -> Column:
    """Whether ``key`` is held out in ``block``: about one key in ``one_in``."""
    return (key * F.lit(factor) + block * F.lit(104729)) % F.lit(65537) % F.lit(one_in) == 0


def double_cold_role(host_held: Column, guest_held: Column) -> Column:
    """Test if both are held, train if neither, else left out."""
    return F.when(host_held & guest_held, "test").when(~host_held & ~guest_held, "train").otherwise("neither")


def roles_from_held(rows: DataFrame, blocks: DataFrame, held_sets: DataFrame) -> DataFrame:
    """Double-cold roles from a long table of held keys.

    ``held_sets(block, axis, key)``, axis ``host`` or ``guest``;
    ``blocks(block)``; ``rows(row_index, host, guest, ...)``.
    """
    hosts = held_sets.filter("axis = 'host'").select("block", F.col("key").alias("host"), F.lit(True).alias("__h")).distinct()
    guests = held_sets.filter("axis = 'guest'").select("block", F.col("key").alias("guest"), F.lit(True).alias("__g")).distinct()
    every = per_block(rows, "block", blocks, "block")
    roles = every.join(hosts, ["block", "host"], "left").join(guests, ["block", "guest"], "left")
    role = double_cold_role(F.coalesce("__h", F.lit(False)), F.coalesce("__g", F.lit(False)))
    return roles.withColumn("role", role).drop("__h", "__g")


def admissible(roles: DataFrame, y: str = "y", min_test: int = 25, min_train: int = 50) -> DataFrame:
    """``(block, n_test, n_train, n_targets, admissible)``."""
    test, train = F.col("role") == "test", F.col("role") == "train"
    counted = roles.groupBy("block").agg(
        F.count_if(test).alias("n_test"),
        F.count_if(train).alias("n_train"),
        F.countDistinct(F.when(test, F.col(y))).alias("n_targets"),
    )
    ok = (F.col("n_test") >= min_test) & (F.col("n_targets") >= 2) & (F.col("n_train") >= min_train)
    return counted.withColumn("admissible", ok)


def complement(test: DataFrame, universe: DataFrame, block: str = "block", row: str = "row_index") -> DataFrame:
    """Train rows of each block: the universe without the block's test rows."""
    everything = per_block(universe.select(row).distinct(), block, test, block)
    return everything.join(test.select(block, row).distinct(), [block, row], "left_anti")


def partition_faults(test: DataFrame, universe: DataFrame, row: str = "row_index") -> DataFrame:
    """Rows that are not in exactly one test block: ``(row, n_blocks)``."""
    seen = test.groupBy(row).agg(F.count("*").alias("n_blocks"))
    return (
        universe.select(row)
        .distinct()
        .join(seen, row, "full")
        .select(row, F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
        .filter("n_blocks <> 1")
    )


def leakage(members: DataFrame, by: Sequence[str], entities: Sequence[str]) -> DataFrame:
    """Share of test rows whose entity also stands in a train row of the unit.

    ``members(*by, role, *entities)``.  One row per unit and entity tuple is
    left before anything is joined.
    """
    parts = None
    for entity in entities:
        seen = members.filter(F.col(entity).isNotNull()).groupBy(*by, entity).agg(
            F.count_if(F.col("role") == "test").alias("t"), F.max(F.col("role") == "train").alias("s")
        )
        one = seen.groupBy(*by).agg(
            F.lit(entity).alias("entity"),
            F.sum("t").alias("n_test"),
            F.sum(F.when(F.col("s"), F.col("t")).otherwise(0)).alias("n_seen"),
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("share", F.col("n_seen") / F.when(F.col("n_test") > 0, F.col("n_test")))


def group_folds(df: DataFrame, group: str, n_folds: int = 5, groups_at_once: int = 100_000) -> DataFrame:
    """``(group, n, fold)``: groups dealt to folds, largest first, each to the
    fold with fewest rows.

    The rule is sequential.  The ``groups_at_once`` largest groups are dealt
    one by one; the rest, each no larger than the smallest of those, on the
    histogram of their sizes, a run of equally large groups at once.  Among
    those of one size the order is by group, in the rest by hash and group,
    so that no task ranks all of them; the loads are the same.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), F.asc(group)).limit(groups_at_once).collect()
    load = [(0, f) for f in range(n_folds)]
    placed = []
    for g, n in largest:
        held_rows, f = heapq.heappop(load)
        placed.append((g, n, f))
        heapq.heappush(load, (held_rows + n, f))
    schema = f"`{group}` {sizes.schema[group].dataType.simpleString()}, n bigint, fold int"
    head = df.sparkSession.createDataFrame(placed, schema)
    if len(largest) < groups_at_once:
        return head
    last, least = largest[-1]
    key = F.col(group)
    after = key.isNotNull() if last is None else key > F.lit(last).cast(sizes.schema[group].dataType)
    rest = sizes.filter((F.col("n") < least) | ((F.col("n") == least) & after))
    rest = rest.withColumn("__shard", F.pmod(F.xxhash64(group), F.lit(256)))
    counts = rest.groupBy("n", "__shard").agg(F.count("*").alias("__c"))
    unit = W.partitionBy("n")
    counts = counts.select("n", "__shard", (F.sum("__c").over(unit.orderBy("__shard")) - F.col("__c")).alias("__base"), F.sum("__c").over(unit).alias("__all"))
    runs = sorted(((r["n"], r["__all"]) for r in counts.select("n", "__all").distinct().collect()), reverse=True)
    loads = {f: held_rows for held_rows, f in load}
    dealt = [(n, _deal(loads, n, count)) for n, count in runs]
    deals = df.sparkSession.createDataFrame(dealt, "n bigint, __deals array<struct<start: bigint, folds: array<int>>>")
    rank = F.col("__base") + F.row_number().over(W.partitionBy("n", "__shard").orderBy(group)) - 1
    ranked = rest.join(counts, ["n", "__shard"]).withColumn("__rank", rank).join(deals, "n")
    ranked = ranked.withColumn("__d", F.element_at(F.filter("__deals", lambda d: d["start"] <= F.col("__rank")), -1))
    place = F.pmod(F.col("__rank") - F.col("__d.start"), F.size("__d.folds").cast("bigint")).cast("int")
    return head.unionByName(ranked.select(group, "n", F.get("__d.folds", place).alias("fold")))


def _deal(loads: dict[int, int], n: int, count: int) -> list[tuple[int, list[int]]]:
    """Deals ``count`` groups of ``n`` rows greedily and adds them to ``loads``:
    ``(start, folds)``, from rank ``start`` on the folds take turns."""
    deals, at = [], 0
    while at < count:
        order = sorted((held_rows, f) for f, held_rows in loads.items())
        # those that come before any other is reached
        turn = [x for x in order if (x[0] - n, x[1]) < order[0]]
        others = order[len(turn) :]
        picks = count - at
        if others:
            rows, g = others[0]
            picks = min(picks, sum(-((held_rows - rows) // n) + ((rows - held_rows) % n == 0 and f < g) for held_rows, f in turn))
        deals.append((at, [f for _, f in turn]))
        for k, (_, f) in enumerate(turn):
            loads[f] += n * (picks // len(turn) + (k < picks % len(turn)))
        at += picks
    return deals


def inner_validation(train: DataFrame, by: Sequence[str], row: str, share: float = 0.15, least: int = 20) -> DataFrame:
    """Marks ``greatest(least, floor(share * n))`` train rows of each unit as
    ``validation``, by a hash order.

    The cut is found on a histogram of the hash, so only the rows of the one
    bucket that the cut falls in are ranked.
    """
    bucket = (F.col("__h") / F.lit(1 << 10)).cast("int")
    hashed = train.withColumn("__h", (F.col(row) * F.lit(48271) % F.lit(2147483647) % F.lit(1 << 20)).cast("bigint"))
    hashed = hashed.withColumn("__b", bucket)
    counts = hashed.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    unit = W.partitionBy(*by)
    counts = counts.withColumn("__want", F.greatest(F.lit(least), F.floor(F.lit(share) * F.sum("__n").over(unit))))
    counts = counts.withColumn("__before", F.sum("__n").over(unit.orderBy("__b")) - F.col("__n"))
    placed = hashed.join(counts, [*by, "__b"])
    rank = F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h", row))
    chosen = F.when(F.col("__before") + F.col("__n") <= F.col("__want"), True).when(F.col("__before") >= F.col("__want"), False)
    inside = chosen.otherwise(F.col("__before") + rank <= F.col("__want"))
    return placed.withColumn("validation", inside).drop("__h", "__b", "__n", "__want", "__before")
