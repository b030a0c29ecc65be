"""Filling fixed-capacity containers with items (problem 6).

Hierarchical multi-length packing.  Each item is routed to a context-size tier,
the shortest whose windows hold it.  From the longest tier down, an item opens
a window of its tier, further items of the tier join it where they fit, and the
gap that is left is filled from the shorter tiers, longest fitting item first.
Windows of the longest tier are containers; the windows of each shorter tier
are units, which are packed whole, longest fitting unit first, into containers
of their own.  So an item competes for the gaps of windows of its size before
those of longer ones, and other tiers make another plan.

Lengths are integers up to the capacity, so packing needs the *histogram* of
lengths only: one row per length, whatever the number of items.  The plan made
from it is a list of patterns (windows with so many items of these lengths)
with the number of containers filled alike.  Each item then finds its place
from its rank among the items of its length.  Ranks are counted per shard of a
hash of the item and shifted by the shards before, so no length, however
common, is ranked in one task.

Containers are numbered by falling cost (sum of squared lengths, what attention
costs) and dealt to step groups in a snake, so that every group of containers
costs about the same.

Defined results: items longer than the capacity are cut into full containers
and one rest, no other item is cut; items of no length take no space and are
dealt to the containers after their other items; with no other items they
share container 0; negative and null lengths count as none; each row of the
input is one item (repeated rows are repeated items of that id).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pairaudit.session import Materialized

TIERS = (2048, 1024, 512, 256)
#: The token pattern of the data model; ``\\w`` and ``\\s`` are ASCII classes.
TOKEN_PATTERN = r"\w+|[^\w\s]+"


def token_count(text: Column, counted: Column | None = None) -> Column:
    """Tokens of ``text``; the stored count where there is one."""
    worked_out = F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("bigint")
    stored = F.when(counted >= 0, counted) if counted is not None else F.lit(None)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.coalesce(stored, worked_out)).cast("bigint")


@dataclass(frozen=True)
class Window:
    """A window of a tier, with ``items`` as (length, how many)."""

    tier: int
    items: tuple[tuple[int, int], ...]

    @property
    def length(self) -> int:
        return sum(s * k for s, k in self.items)


@dataclass(frozen=True)
class Pattern:
    """``n`` containers of the same windows, each (window, how many)."""

    windows: tuple[tuple[Window, int], ...]
    n: int

    @property
    def lengths(self) -> list[tuple[int, int]]:
        return [(s, k * m) for w, m in self.windows for s, k in w.items]

    @property
    def cost(self) -> int:
        return sum(k * s * s for s, k in self.lengths)


class _Stock:
    """Things of some lengths, taken longest fitting first."""

    def __init__(self, things: dict[tuple, int]):
        """``things``: how many there are of each (length, what)."""
        self.left = dict(things)
        self.order = sorted(things)

    def fitting(self, gap: int, spent: dict[tuple, int] | None = None) -> tuple | None:
        """The longest of at most ``gap`` that is not all spent."""
        i = bisect_right(self.order, (gap, _LAST)) - 1
        while i >= 0 and spent and spent.get(self.order[i], 0) >= self.left[self.order[i]]:
            i -= 1
        return self.order[i] if i >= 0 else None

    def fill(self, gap: int, first: tuple | None = None) -> dict[tuple, int]:
        """What one container of ``gap`` takes, ``first`` at any rate."""
        chosen: dict[tuple, int] = {}
        if first:
            chosen[first] = 1
            gap -= first[0]
        while gap and (thing := self.fitting(gap, chosen)):
            k = min(gap // thing[0], self.left[thing] - chosen.get(thing, 0))
            chosen[thing] = chosen.get(thing, 0) + k
            gap -= k * thing[0]
        return chosen

    def take(self, chosen: dict[tuple, int]) -> int:
        """As many alike as there can be; how many that is."""
        n = min(self.left[x] // k for x, k in chosen.items())
        for x, k in chosen.items():
            self.left[x] -= n * k
            if not self.left[x]:
                del self.left[x]
                self.order.remove(x)
        return n


_LAST = (1 << 62,)


def make_plan(histogram: dict[int, int], capacity: int, tiers: Sequence[int] = TIERS) -> list[Pattern]:
    """Patterns that use every item of the histogram exactly once."""
    items = _Stock({(s, ()): n for s, n in histogram.items() if 0 < s <= capacity and n > 0})
    plan: list[Pattern] = []
    units: dict[tuple, int] = {}
    bounds = sorted({min(t, capacity) for t in tiers} | {capacity}, reverse=True)
    for upper, lower in zip(bounds, [*bounds[1:], 0], strict=True):
        while (first := items.fitting(upper)) and first[0] > lower:
            chosen = items.fill(upper, first)
            window = Window(upper, tuple(sorted(((x[0], k) for x, k in chosen.items()), reverse=True)))
            n = items.take(chosen)
            if upper == capacity:
                plan.append(Pattern(((window, 1),), n))
            else:
                key = (window.length, (upper, window.items))
                units[key] = units.get(key, 0) + n
    stock = _Stock(units)
    while first := stock.fitting(capacity):
        chosen = stock.fill(capacity, first)
        n = stock.take(chosen)
        plan.append(Pattern(tuple((Window(*what), k) for (_, what), k in sorted(chosen.items(), reverse=True)), n))
    return sorted(plan, key=lambda p: (-p.cost, p.lengths))


@dataclass(frozen=True)
class _Lookup:
    """The plan as arrays, sorted by (length, first rank)."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    container: np.ndarray
    position: np.ndarray
    offset: np.ndarray
    window: np.ndarray
    tier: np.ndarray
    pattern_start: np.ndarray
    pattern_items: np.ndarray
    n_containers: int


def _lookup(plan: Sequence[Pattern]) -> _Lookup:
    rows: list[tuple[int, ...]] = []
    taken: dict[int, int] = {}
    starts, items, at = [0], [0], 0
    for p in plan:
        position = offset = 0
        for i, w in enumerate(w for w, m in p.windows for _ in range(m)):
            for s, k in w.items:
                rows.append((s, taken.get(s, 0), k, at, position, offset, i, w.tier))
                taken[s] = taken.get(s, 0) + k * p.n
                position += k
                offset += k * s
        starts.append(at)
        items.append(position)
        at += p.n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 8)
    return _Lookup(*a.T, np.array(starts), np.array(items), at)


def step_group(container: Column, n_containers: int, per_group: int) -> Column:
    """Deal containers, numbered by falling cost, in a snake."""
    groups = max(1, -(-n_containers // per_group))
    turn, place = F.floor(container / F.lit(groups)), container % F.lit(groups)
    return F.when(turn % 2 == 0, place).otherwise(F.lit(groups - 1) - place).cast("bigint")


def pack(
    items: DataFrame,
    key: str,
    size: Column,
    capacity: int = 2048,
    tiers: Sequence[int] = TIERS,
    per_group: int = 8,
    rows_per_shard: int = 50_000,
    store: Materialized | None = None,
) -> DataFrame:
    """``(key, piece, container_id, position, token_start, token_end,
    container_offset, window, tier, step_group)``, one row per item and piece.

    ``token_start`` and ``token_end`` are the item's own tokens, the end
    excluded; ``position`` counts from 1 within the container and
    ``container_offset`` is where the piece begins in it; ``window`` counts
    the windows of the container from 0 and ``tier`` is this one's size.
    """
    # written once, so that the texts are read once
    store = store or Materialized(items.sparkSession, "packing")
    sized = store.write(items.select(F.col(key).alias("id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("n")))
    pieces = sized.select("id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select(
        "id",
        F.col("piece").cast("bigint").alias("piece"),
        (F.col("piece") * capacity).cast("bigint").alias("start"),
        F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("length"),
    )
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # capacity + 1 rows at most
    plan = make_plan(histogram, capacity, tiers)
    found = _lookup(plan)
    n_shards = max(1, -(-sum(histogram.values()) // rows_per_shard))

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(n_shards)).cast("int"))
    before = (
        sharded.groupBy("length", "shard")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("shard")) - F.col("n"))
        .drop("n")
    )
    local = F.row_number().over(W.partitionBy("length", "shard").orderBy("id", "piece")) - 1
    ranked = (
        sharded.withColumn("local", local)
        .join(before, ["length", "shard"])
        .select("id", "piece", "start", "length", (F.col("base") + F.col("local")).alias("rank"))
    )
    schema = T.StructType(
        [T.StructField("id", items.schema[key].dataType)]
        + [
            T.StructField(c, T.LongType())
            for c in ("piece", "container_id", "position", "token_start", "token_end", "container_offset", "window", "tier")
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = int(found.first.max(initial=0)) + 1
        order = found.length * stride + found.first
        for batch in batches:
            start, length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "rank"))
            container, position, offset, window, tier = (np.zeros(len(rank), dtype=np.int64) for _ in range(5))
            full = length > 0
            at = np.searchsorted(order, length[full] * stride + np.minimum(rank[full], stride - 1), side="right") - 1
            nth = rank[full] - found.first[at]
            container[full] = found.container[at] + nth // found.per[at]
            position[full] = found.position[at] + nth % found.per[at]
            offset[full] = found.offset[at] + nth % found.per[at] * length[full]
            window[full], tier[full] = found.window[at], found.tier[at]
            n = max(1, found.n_containers)
            container[~full] = rank[~full] % n
            pattern = np.searchsorted(found.pattern_start, container[~full], side="right") - 1
            position[~full] = found.pattern_items[pattern] + rank[~full] // n
            columns = [container, position + 1, start, start + length, offset, window, tier]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("piece"), *(pa.array(c.astype(np.int64)) for c in columns)],
                names=schema.names,
            )

    return ranked.mapInArrow(place, schema).select(
        F.col("id").alias(key),
        *schema.names[1:],
        step_group(F.col("container_id"), found.n_containers, per_group).alias("step_group"),
    )


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Space used per step group: containers, pieces, tokens, waste, cost."""
    length = F.col("token_end") - F.col("token_start")
    per_container = packed.groupBy("step_group", "container_id").agg(
        F.count("*").alias("n"), F.sum(length).alias("tokens"), F.sum(length * length).alias("cost")
    )
    return per_container.groupBy("step_group").agg(
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_pieces"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.lit(capacity) - F.col("tokens")).alias("unused"),
        F.sum("cost").alias("cost"),
    )


def tier_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Space used per tier: windows, pieces, tokens, unused space.

    A window of the longest tier is unused where its container is; the windows
    of other tiers lie close together, so what they leave unused is the rest of
    their container, counted for the tier of its longest window."""
    length = F.col("token_end") - F.col("token_start")
    windows = packed.filter("tier > 0").groupBy("container_id", "window").agg(
        F.max("tier").alias("tier"), F.count("*").alias("n"), F.sum(length).alias("tokens")
    )
    containers = windows.groupBy("container_id").agg(F.max("tier").alias("tier"), F.sum("tokens").alias("tokens"))
    per_tier = windows.groupBy("tier").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_pieces"), F.sum("tokens").alias("n_tokens"))
    rests = containers.groupBy("tier").agg(F.count("*").alias("n_containers"), F.sum(F.lit(capacity) - F.col("tokens")).alias("unused"))
    return per_tier.join(rests, "tier", "left").na.fill(0)


def packing_faults(packed: DataFrame, key: str, capacity: int = 2048) -> DataFrame:
    """One row: what was packed, and how often a rule was broken.

    ``(n_items, n_pieces, n_tokens, overfull, needlessly_cut, gaps,
    misplaced)``: containers above the capacity, cut items that would have fit,
    items whose pieces do not cover their tokens once, pieces that do not begin
    where the piece before them in the container ends."""
    length = F.col("token_end") - F.col("token_start")
    per_item = packed.groupBy(key).agg(
        F.count("*").alias("pieces"), F.sum(length).alias("tokens"), F.min("token_start").alias("low"), F.max("token_end").alias("high")
    )
    items = per_item.agg(
        F.count("*").alias("n_items"),
        F.sum("pieces").cast("bigint").alias("n_pieces"),
        F.sum("tokens").cast("bigint").alias("n_tokens"),
        F.sum(((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).cast("bigint")).alias("needlessly_cut"),
        F.sum(((F.col("low") != 0) | (F.col("high") != F.col("tokens"))).cast("bigint")).alias("gaps"),
    )
    before = F.coalesce(F.sum(length).over(W.partitionBy("container_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    containers = (
        packed.withColumn("before", before)
        .groupBy("container_id")
        .agg(F.sum(length).alias("tokens"), F.sum(((length > 0) & (F.col("before") != F.col("container_offset"))).cast("bigint")).alias("wrong"))
        .agg(F.sum((F.col("tokens") > capacity).cast("bigint")).alias("overfull"), F.sum("wrong").alias("misplaced"))
    )
    return items.withColumn("one", F.lit(1)).join(containers.withColumn("one", F.lit(1)), "one").drop("one")
