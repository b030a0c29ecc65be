"""Peptide names and sequence runs.

Names are parsed with built-in expressions; only the longest common run, which
has no expression of its own, is an Arrow function and runs on distinct values.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Residues, protecting ends and lysine methylations of peptide names.
ONE_LETTER = "ACDEFGHIKLMNPQRSTVWY"
THREE_LETTER = "Ala|Arg|Asn|Asp|Cys|Gln|Glu|Gly|His|Ile|Leu|Lys|Met|Phe|Pro|Ser|Thr|Trp|Tyr|Val"
N_ENDS, C_ENDS = "H|Ac|Bz|Boc|Fmoc", "NH2|NH_2|OH"


def peptide(name: Column) -> Column:
    """``struct(notation, n_end, c_end, sequence, modifications, parsed, note)``
    of a peptide name.

    A peptide has both ends written, ``Ac-...-NH2``.  One-letter names give
    their residues and, for each methylation such as ``(me3)`` or ``Kme3``, the
    position of the residue before it, from 1.  Three-letter names are told
    apart and not converted.  ``parsed`` is true for two or more of the twenty
    residues and nothing else; ``note`` says why not.
    """
    n_end = F.regexp_extract(name, rf"^\s*({N_ENDS})\s*-", 1)
    c_end = F.regexp_extract(name, rf"-\s*({C_ENDS})\s*$", 1)
    body = F.regexp_replace(F.regexp_replace(name, rf"^\s*({N_ENDS})\s*-", ""), rf"-\s*({C_ENDS})\s*$", "")
    ends = F.coalesce((n_end != "") & (c_end != ""), F.lit(False))
    three = ends & F.concat(F.lit("-"), body).rlike(rf"-({THREE_LETTER})(-|$)")
    one = ends & ~three
    # every methylation in brackets, then residue by residue
    marked = F.regexp_replace(F.regexp_replace(body, r"(?<=[A-Z])(me[123])(?=[A-Z]|$)", "($1)"), "[- ]", "")
    tokens = F.regexp_extract_all(F.when(one, marked), F.lit(r"(\(me[123]\)|.)"), F.lit(1))
    methylation = lambda t: F.length(t) > 1
    none = F.array().cast("array<struct<position:int,name:string>>")
    walked = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("n"), none.alias("found")),
        lambda at, t: F.when(
            methylation(t),
            F.struct(at["n"].alias("n"), F.concat(at["found"], F.array(F.struct(at["n"].alias("position"), F.substring(t, 2, 3).alias("name")))).alias("found")),
        ).otherwise(F.struct((at["n"] + 1).alias("n"), at["found"].alias("found"))),
        lambda at: at["found"],
    )
    sequence = F.array_join(F.filter(tokens, lambda t: ~methylation(t)), "")
    pure = F.coalesce(sequence.rlike(f"^[{ONE_LETTER}]{{2,}}$"), F.lit(False))
    note = (
        F.when(F.coalesce(F.trim(name) == "", F.lit(True)), "no_name")
        .when(~ends, "not_a_peptide")
        .when(three, "three_letter_not_converted")
        .when(~pure, "other_residues")
    )
    return F.struct(
        F.when(three, "three_letter").when(one, "one_letter").otherwise("not_a_peptide").alias("notation"),
        F.when(ends, n_end).alias("n_end"),
        F.when(ends, c_end).alias("c_end"),
        sequence.alias("sequence"),
        walked.alias("modifications"),
        pure.alias("parsed"),
        note.alias("note"),
    )


def positions_of(sequence: Column, residue: str) -> Column:
    """All positions, from 1, of a residue."""
    at = F.sequence(F.lit(1), F.length(sequence))
    found = F.filter(at, lambda i: F.substring(sequence, i, F.lit(1)) == residue)
    return F.when(F.length(sequence) > 0, found).otherwise(F.array().cast("array<int>"))


def longest_run(a: str | None, b: str | None) -> str:
    """The longest run two sequences share, the first of equals."""
    if not a or not b:
        return ""
    best, end, before = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = before[j - 1] + 1
                if row[j] > best:
                    best, end = row[j], i
        before = row
    return a[end - best : end]


@F.pandas_udf(T.StringType())
def common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_run(x, y) for x, y in zip(a, b, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def compatible_fold(names: pd.Series) -> pd.Series:
    """Compatibility form without regard to case, blanks trimmed."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold().strip())


@F.pandas_udf(T.DoubleType())
def rounded_to_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Correctly rounded decimals, as reports of the field print them."""
    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def ambiguous(df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """One row per key; keys whose rows disagree on the labels get none:
    ``(key, n_readings, *labels)`` with every label false."""
    readings = df.groupBy(key).agg(F.countDistinct(F.struct(*labels)).alias("n_readings"), *[F.min(c).alias(c) for c in labels])
    return readings.select(key, "n_readings", *[(F.col(c) & (F.col("n_readings") == 1)).alias(c) for c in labels])


def counter_ion_candidate(fragments: Column, ions: dict[str, int]) -> Column:
    """Whether all fragments but one are allowed ions that balance its charge.

    ``fragments`` is ``array<struct<key: string, charge: int, carbon: boolean>>``.
    """
    organic = F.filter(fragments, lambda f: f["carbon"])
    others = F.filter(fragments, lambda f: ~f["carbon"])
    allowed = F.forall(others, lambda f: f["key"].isin(*ions))
    balance = F.aggregate(fragments, F.lit(0), lambda a, f: a + f["charge"])
    return (F.size(organic) == 1) & (F.size(others) >= 1) & allowed & (balance == 0)
