"""Several values packed in one text field, one value per row (problem 4).

The field is read by a small parsing expression grammar.  Alternatives are
ordered and the parser backtracks: a value that opens with a quotation mark is
first tried as a quoted value; when its mark is never closed, or what follows
the closing mark is not a separator, the attempt is given up and the same
position is read again as a bare value, with an error flag.

    field     <- sep* (value sep+)* value? sep*
    value     <- quoted / bare
    quoted    <- open (escape / !close any)* close &(blank* (separator / end))
    bare      <- (bracketed / !separator any)+
    bracketed <- '(' ... ')' / '[' ... ']' / '{' ... '}'     (balanced, one line)
    separator <- [|;\\t\\n...] / loose comma / loose slash / blank blank+

A comma or slash is *loose* when a blank, another separator or an end of the
field stands on at least one side of it; a tight one belongs to the name.

Defined results: null or blank fields give no rows; blank values (also quoted
ones) are left out and take no position; equal values each count; texts of any
length are parsed in one left-to-right pass; other columns of the input do not
take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HARD = frozenset("|;\t\n\r\v\f\x85\u2028\u2029")
BLANK = frozenset(" \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000")
SOFT = frozenset(",/")
CLOSERS = {'"': '"', "'": "'", "“": "”", "„": "”", "‘": "’", "«": "»"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
MARKS = frozenset(CLOSERS) | frozenset(CLOSERS.values()) | {"\\"}
EDGE = HARD | BLANK

OK, MALFORMED = "", "malformed_quote"


def _skip_blank(s: str, i: int) -> int:
    while i < len(s) and s[i] in BLANK:
        i += 1
    return i


def _separator(s: str, i: int) -> int:
    """Length of the separator at ``i``, 0 when there is none."""
    c = s[i]
    if c in HARD:
        return 1
    if c in SOFT:
        left = i == 0 or s[i - 1] in EDGE or s[i - 1] in SOFT
        right = i + 1 == len(s) or s[i + 1] in EDGE or s[i + 1] in SOFT
        return int(left or right)
    if c in BLANK:
        j = _skip_blank(s, i)
        return j - i if j - i > 1 else 0
    return 0


def _quoted(s: str, i: int) -> tuple[str, int] | None:
    """The quoted value that opens at ``i``, or None (backtrack)."""
    close = CLOSERS[s[i]]
    alike = close == s[i]
    out: list[str] = []
    j = i + 1
    while j < len(s):
        c = s[j]
        if c == "\\" and j + 1 < len(s) and s[j + 1] in MARKS:
            out.append(s[j + 1])
            j += 2
        elif c != close:
            out.append(c)
            j += 1
        else:
            after = _skip_blank(s, j + 1)
            if after == len(s) or s[after] in HARD or s[after] in SOFT or after - j > 2:
                return "".join(out), j + 1
            if alike and s[j + 1] == c:  # a doubled mark stands for one
                out.append(c)
                j += 2
            elif c == "'" or not alike:  # an apostrophe or prime inside
                out.append(c)
                j += 1
            else:
                return None
    return None


def _bracket_ends(s: str) -> dict[int, int]:
    """End of each balanced bracket by its start, found in one pass."""
    ends: dict[int, int] = {}
    stack: list[tuple[int, str]] = []
    for j, c in enumerate(s):
        if c in BRACKETS:
            stack.append((j, BRACKETS[c]))
        elif stack and c == stack[-1][1]:
            ends[stack.pop()[0]] = j + 1
        elif c in ")]}\n\r":
            stack.clear()
    return ends


def parse_packed(s: str | None) -> list[tuple[int, str, str]]:
    """``(position, value, flag)`` of every value in ``s``, positions from 1."""
    if s is None:
        return []
    found: list[tuple[int, str, str]] = []
    ends = _bracket_ends(s)
    never: set[str] = set()  # marks that nothing closes from here on
    i, n = 0, len(s)
    while i < n:
        if s[i] in BLANK:
            i += 1
            continue
        if k := _separator(s, i):
            i += k
            continue
        flag = OK
        if s[i] in CLOSERS:
            if s[i] not in never and (got := _quoted(s, i)) is not None:
                value, i = got
                # a tight comma or slash after a closed quotation separates too
                i = _skip_blank(s, i)
                if i < n and s[i] in SOFT:
                    i += 1
                if value := value.strip():
                    found.append((len(found) + 1, value, OK))
                continue
            flag = MALFORMED
            if s[i] != '"':  # its only attempt ran to the end of the field
                never.add(s[i])
        begin = i
        while i < n and not _separator(s, i):
            i = ends.get(i, i + 1)
        if value := s[begin:i].strip():
            found.append((len(found) + 1, value, flag))
    return found


def unpack_values(df: DataFrame, key: str, packed: str, order_by: str | None = None) -> DataFrame:
    """One row ``(key, pos, value, flag)`` per value packed in ``packed``.

    Rows that repeat a key count once: the row with the latest ``order_by``
    stands (the greatest text among equals; without ``order_by`` the greatest
    text).  Rows without a key are kept apart by their text.  The duplicates
    are combined before the shuffle, so a key of any weight costs one row per
    task.  ``pos`` is a bigint from 1; ``flag`` is empty or
    ``malformed_quote``.
    """
    rank = F.struct(F.col(order_by), F.col(packed)) if order_by else F.struct(F.col(packed))
    rows = (
        df.filter(F.col(packed).isNotNull())
        .groupBy(F.col(key).alias("__key"), F.when(F.col(key).isNull(), F.col(packed)).alias("__apart"))
        .agg(F.max(rank)[packed].alias("__packed"))
        .select("__key", "__packed")
    )
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("pos", T.LongType()),
            T.StructField("value", T.StringType()),
            T.StructField("flag", T.StringType()),
        ]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            pos: list[int] = []
            value: list[str] = []
            flag: list[str] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for p, v, f in parse_packed(text):
                    at.append(row)
                    pos.append(p)
                    value.append(v)
                    flag.append(f)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(pos, pa.int64()),
                    pa.array(value, pa.string()),
                    pa.array(flag, pa.string()),
                ],
                names=[key, "pos", "value", "flag"],
            )

    return rows.mapInArrow(parse, schema)
