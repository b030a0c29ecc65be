"""Identity layers: what a test row shares with its train rows.

A layer maps raw host and guest ids to parent keys.  Layers are rows, not
loops: the layer is a join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairaudit.operators.splits import per_block

# The published classes of what a test row shares with train.
CLASSES = ("same_pair_seen", "both_seen_pair_unseen", "host_only_seen", "guest_only_seen", "neither_seen")


def annotate(members: DataFrame, layer_map: DataFrame) -> DataFrame:
    """Members with both parent keys per layer.

    ``members(unit..., host, guest)``, ``layer_map(layer, axis, id, parent,
    uncertain)`` with one row per layer, axis and id.  Null keys mark what the
    layer does not know; ``blockers`` lists it.
    """
    hosts = layer_map.filter("axis = 'host'").select(
        "layer", F.col("id").alias("host"), F.col("parent").alias("parent_host"), F.col("uncertain").alias("host_uncertain")
    )
    guests = layer_map.filter("axis = 'guest'").select(
        "layer", F.col("id").alias("guest"), F.col("parent").alias("parent_guest"), F.col("uncertain").alias("guest_uncertain")
    )
    every = per_block(members, "layer", layer_map, "layer", 1000)
    return every.join(hosts, ["layer", "host"], "left").join(guests, ["layer", "guest"], "left")


def blockers(annotated: DataFrame, by: Sequence[str]) -> DataFrame:
    """References a layer can't resolve: ``(*by, layer, axis, n_rows, n_keys)``."""
    axis = F.explode(
        F.array(
            F.struct(F.lit("host").alias("axis"), F.col("host").alias("key"), F.col("parent_host").isNull().alias("gap")),
            F.struct(F.lit("guest").alias("axis"), F.col("guest").alias("key"), F.col("parent_guest").isNull().alias("gap")),
        )
    )
    gaps = annotated.select(*by, "layer", axis.alias("x")).filter("x.gap")
    return gaps.groupBy(*by, "layer", F.col("x.axis").alias("axis")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("x.key").alias("n_keys")
    )


def classify(host_seen: Column, guest_seen: Column, pair_seen: Column) -> Column:
    """The class of a test row; a seen pair with an unseen side raises."""
    broken = pair_seen & ~(host_seen & guest_seen)
    return (
        F.when(broken, F.raise_error(F.lit("a seen pair needs a seen host and guest")).cast("string"))
        .when(pair_seen, CLASSES[0])
        .when(host_seen & guest_seen, CLASSES[1])
        .when(host_seen, CLASSES[2])
        .when(guest_seen, CLASSES[3])
        .otherwise(CLASSES[4])
    )


def retained(split: Column, host_seen: Column, guest_seen: Column) -> Column:
    """Whether a test row keeps what its split protects; any other split is an
    error."""
    return (
        F.when(split == "host_cold", ~host_seen)
        .when(split == "guest_cold", ~guest_seen)
        .when(split == "double_cold", ~host_seen & ~guest_seen)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported split: "), F.coalesce(split, F.lit("null")))).cast("boolean"))
    )


def seen_flags(annotated: DataFrame, by: Sequence[str], split: str = "split") -> DataFrame:
    """Test rows with ``host_seen``, ``guest_seen``, ``pair_seen``, ``class``
    and ``retained``, per layer.  Unresolved keys were never seen.

    The train side is reduced to its distinct keys before it is joined.
    """
    keys = [*by, "layer"]
    train = annotated.filter("role = 'train'")
    test = annotated.filter("role = 'test'")
    hosts = train.filter("parent_host IS NOT NULL").select(*keys, "parent_host", F.lit(True).alias("__h")).distinct()
    guests = train.filter("parent_guest IS NOT NULL").select(*keys, "parent_guest", F.lit(True).alias("__g")).distinct()
    pairs = (
        train.filter("parent_host IS NOT NULL AND parent_guest IS NOT NULL")
        .select(*keys, "parent_host", "parent_guest", F.lit(True).alias("__p"))
        .distinct()
    )
    flagged = (
        test.join(hosts, [*keys, "parent_host"], "left")
        .join(guests, [*keys, "parent_guest"], "left")
        .join(pairs, [*keys, "parent_host", "parent_guest"], "left")
        .withColumns({n: F.coalesce(c, F.lit(False)) for n, c in (("host_seen", "__h"), ("guest_seen", "__g"), ("pair_seen", "__p"))})
        .drop("__h", "__g", "__p")
    )
    h, g, p = F.col("host_seen"), F.col("guest_seen"), F.col("pair_seen")
    return flagged.withColumn("class", classify(h, g, p)).withColumn("retained", retained(F.col(split), h, g))


def coverage(flags: DataFrame, by: Sequence[str], row: str = "row_index") -> DataFrame:
    """Appearances and unique rows, all, retained and uncertain."""
    kept, unsure = F.col("retained"), F.coalesce("host_uncertain", F.lit(False)) | F.coalesce("guest_uncertain", F.lit(False))
    return flags.groupBy(*by).agg(
        F.count("*").alias("appearances"),
        F.countDistinct(row).alias("unique_rows"),
        F.count_if(kept).alias("retained_appearances"),
        F.countDistinct(F.when(kept, F.col(row))).alias("retained_unique_rows"),
        F.count_if(unsure).alias("uncertain_appearances"),
    )


def crosstab(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class by uncertainty, with a row for each empty cell."""
    unsure = F.coalesce("host_uncertain", F.lit(False)) | F.coalesce("guest_uncertain", F.lit(False))
    counted = flags.groupBy(*by, "class", unsure.alias("uncertain")).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(u).alias("uncertain")) for c in CLASSES for u in (False, True)]))
    grid = flags.select(*by).distinct().select(*by, cells.alias("c")).select(*by, "c.*")
    return grid.join(counted, [*by, "class", "uncertain"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
