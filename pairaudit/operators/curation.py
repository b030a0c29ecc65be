"""Record curation: validity codes, reasons, ladders, replicate spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairaudit.functions.text import first_match

# The published ladders of host classes and of host families, as
# (label, pattern of the name in lower case); the first that matches counts.
HOST_CLASSES = (
    ("protein (HSA)", r"serum albumin|^\s*hsa\s*$"),
    ("inorganic zeolite", r"zeolite"),
    ("mechanically interlocked (rotaxane)", r"rotaxane"),
    ("pillararene (SMILES not shipped)", r"pillar"),
    ("calixarene (SMILES not shipped)", r"calix"),
    ("functionalized cucurbituril (SMILES not shipped)", r"cucurbit|cb\[|cb6|cb8"),
    ("cyclodextrin (SMILES not shipped)", r"cyclodext"),
)
OTHER_CLASS = "other (SMILES not shipped)"
FAMILIES = (
    ("cucurbituril", r"cucurbit|\bcb\s*\[?\d"),
    ("cyclodextrin", r"cyclodext|\b[abgαβγ]-?cd\b"),
    ("calixarene", r"calix"),
    ("pillararene", r"pillar"),
    ("cavitand", r"cavitand"),
    ("cyclophane", r"cyclophane"),
    ("crown_ether", r"crown"),
)
# Names of families that the gate for calixarenes blocks.
BLOCKED_FAMILY_WORDS = (
    "pillar", "cucurbit", "cyclodextrin", "bambus", "tweezer", "cyclophane", "naphthotube", "glycoluril", "crown", "cryptand",
    "cryptophane", "corral", "oxatub", "zorb", "exbox", "sugammadex", "viologen", "paraquat", "positand",
)


def size_code(text: Column) -> Column:
    """Signed code of a structure text: -1 null, 0 empty, -2 not readable,
    else its size (letters that stand for heavy atoms)."""
    t = F.trim(text)
    atoms = F.regexp_count(t, F.lit("Cl|Br|[BCNOPSFI]|[cnops]"))
    return (
        F.when(text.isNull(), -1)
        .when(t == "", 0)
        .when(~t.rlike(r"^[A-Za-z0-9@+\-\[\]()=#/\\.%]+$"), -2)
        .otherwise(atoms)
        .cast("int")
    )


def exclusion_reason(host_code: Column, guest_code: Column) -> Column:
    """First reason that holds, host before guest; null if none."""
    rules = []
    for side, code in (("host", host_code), ("guest", guest_code)):
        rules += [(code == 0, f"{side}_empty"), (code == -1, f"{side}_missing"), (code == -2, f"{side}_unreadable")]
    return first_match(rules)


def curate(records: DataFrame, host: str, guest: str) -> DataFrame:
    """Adds ``host_code``, ``guest_code``, ``valid`` and ``reason``."""
    coded = records.withColumns({"host_code": size_code(F.col(host)), "guest_code": size_code(F.col(guest))})
    valid = (F.col("host_code") >= 1) & (F.col("guest_code") >= 1)
    return coded.withColumn("valid", valid).withColumn("reason", F.when(~valid, exclusion_reason(F.col("host_code"), F.col("guest_code"))))


def replicate_spread(records: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """``(n_groups, n_rows, median_range, mean_sd)`` over repeated groups."""
    groups = records.groupBy(*by).agg(
        F.count(y).alias("n"), (F.max(y) - F.min(y)).alias("range"), F.stddev_samp(y).alias("sd")
    )
    return groups.filter("n > 1").agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.percentile("range", F.lit(0.5)).alias("median_range"),
        F.avg("sd").alias("mean_sd"),
    )


def sigma_decomposition(records: DataFrame, pair: Sequence[str], conditions: Sequence[str], y: str) -> DataFrame:
    """``(kind, n_groups, mean_sd)``: spread within a pair, within a pair under
    one condition, and within pairs seen under several conditions."""
    kept = records.filter(F.col(y).isNotNull())
    same = kept.groupBy(*pair).agg(
        F.count("*").alias("n"),
        F.stddev_samp(y).alias("sd"),
        F.countDistinct(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in conditions])).alias("k"),
    )
    true = kept.groupBy(*pair, *conditions).agg(F.count("*").alias("n"), F.stddev_samp(y).alias("sd"))

    def row(kind: str, groups: DataFrame) -> DataFrame:
        return groups.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_groups"), F.avg("sd").alias("mean_sd"))

    return (
        row("same_pair", same.filter("n > 1"))
        .unionByName(row("true_replicate", true.filter("n > 1")))
        .unionByName(row("cross_condition", same.filter("n > 1 AND k > 1")))
    )


def describe(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """count, mean, std, min, quartiles (linear), max."""
    v = F.col(y)
    quartiles = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"),
        quartiles.alias("__q"), F.max(v).alias("greatest"),
    )
    return out.select(
        *by, "n", "mean", "sd", "least",
        *[F.col("__q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
        "greatest",
    )


def pair_features(host: Sequence[Column], guest: Sequence[Column], floor: float = 1e-6) -> dict[str, Column]:
    """Algebraic pair columns: sums, products, differences, safe ratios."""
    out: dict[str, Column] = {}
    for i, (h, g) in enumerate(zip(host, guest, strict=True)):
        out[f"sum_{i}"], out[f"product_{i}"], out[f"gap_{i}"] = h + g, h * g, F.abs(h - g)
        out[f"ratio_{i}"] = g / F.when(F.abs(h) < floor, F.lit(floor)).otherwise(h)
    return out


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column per value; null is a value of its own, ``<column>_null``."""
    flags = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns({**flags, f"{column}_null": F.col(column).isNull().cast("int")})


def bias_share(panel: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """``(*by, n, mse, bias, bias_share)``: squared mean residual over the
    mean squared residual."""
    r = F.col(y) - F.col(p)
    out = panel.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r * r).alias("mse"), F.avg(r).alias("bias"))
    return out.withColumn("bias_share", F.col("bias") * F.col("bias") / F.when(F.col("mse") > 0, F.col("mse")))
