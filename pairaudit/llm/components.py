"""Connected components by alternating large-star and small-star operations.

Each round reads an edge table and writes the next one to the shared folder,
so lineage stays short and a lost executor costs a task, not the run.  Nodes
are bigint; the representative of a component is its smallest node.

*Large-star* links every neighbour of ``u`` that is greater than ``u`` to the
smallest node of ``u``'s neighbourhood; *small-star* does the same for the
neighbours that are not greater.  Both keep the components, and the rounds end
when the edge set stops changing: then every edge leads to a representative.

A hub of any degree is safe: its minimum is a partial aggregate and the join
that hands it out has one row per node on the other side, which adaptive
execution may split.  Nothing but the fingerprint of the edge set (a count and
two 64-bit values) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairaudit.session import Materialized

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # repeats are left to the small-star after it, whose result has none
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges  # large-star leaves the greater node first
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, store: Materialized) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``.

    Loops give their node a component of its own; null ends are left out;
    repeated edges count once; no edges, no rows.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        watched = df.observe(
            seen,
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("u", "v")).alias("x"),
            F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"),
        )
        table = store.write(watched)
        return table, tuple(seen.get.values())

    known = edges.filter("u IS NOT NULL AND v IS NOT NULL")
    current, mark = written(known.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        following, then = written(_small_star(_large_star(current)))
        store.drop(current)
        current = following
        if then == mark:
            break
        mark = then
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    loops = known.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return members.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
