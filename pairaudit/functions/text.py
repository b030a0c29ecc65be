"""Text expressions: strict parsers, ladders, reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two dialects of booleans, words of true and words of false.
MASK_WORDS = (("true", "1"), ("false", "0"))
TABLE_WORDS = (("1", "true", "yes", "y"), ("0", "false", "no", "n", ""))


def parse_bool(c: Column, words: tuple[Sequence[str], Sequence[str]] = TABLE_WORDS, strict: bool = True) -> Column:
    """Text as boolean, in lower case; other text raises (or is null when not
    strict).  Table cells are trimmed and a blank or null one is false; mask
    cells must be one of the four words as they are."""
    word = F.lower(c)
    if "" in words[1]:
        word = F.coalesce(F.trim(word), F.lit(""))
    other = F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(c, F.lit("null")))) if strict else F.lit(None)
    return F.when(word.isin(*words[0]), F.lit(True)).when(word.isin(*words[1]), F.lit(False)).otherwise(other.cast("boolean"))


def parse_index(c: Column) -> Column:
    """A canonical non-negative integer (no sign, no leading zero), or null."""
    return F.when(c.rlike("^(0|[1-9][0-9]*)$"), c.try_cast("bigint"))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def pattern_ladder(c: Column, ladder: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """First class whose pattern is found, case ignored; words and digits are
    those of Unicode."""
    low = F.lower(c)
    return first_match([(F.coalesce(low.rlike("(?U)" + pattern), F.lit(False)), label) for label, pattern in ladder], otherwise)


def join_reasons(*reasons: Column, sep: str = " | ") -> Column:
    """Non-empty reasons, joined."""
    return F.concat_ws(sep, *[F.when(F.trim(r) != "", r) for r in reasons])


def sorted_set_text(values: Column) -> Column:
    """A set as ``{a,b}`` in order."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(values)), ","), F.lit("}"))


def numeric_suffix(c: Column) -> Column:
    """The number a block id ends with, for natural order."""
    return F.regexp_extract(c, r"_(\d+)$", 1).try_cast("int")


def name_tokens(c: Column, sep: str = r"\|") -> Column:
    """Name variants: split, trimmed, lower case, distinct, in order."""
    parts = F.transform(F.split(c, sep), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))
