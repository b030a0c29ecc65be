"""Deterministic and write-once outputs."""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDEFINED = "UNDEFINED"
#: Blanks around a cell belong to it; Spark's writer would cut them.
AS_IT_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


class OutputExists(FileExistsError):
    """The output is there already, or someone else's."""


def sorted_delimited(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], sep: str = ",", single: bool = True) -> None:
    """CSV of exactly ``columns`` in a fixed row order; extra columns fail.

    ``single`` makes one file, for results that fit one; else the parts are
    range-sorted and their names give the order.
    """
    if extra := [c for c in df.columns if c not in columns]:
        raise ValueError(f"columns without a place: {extra}")
    out = df.select(*columns)
    out = out.coalesce(1).sortWithinPartitions(*order) if single else out.orderBy(*order)
    out.write.mode("errorifexists").csv(path, sep=sep, header=True, emptyValue="", lineSep="\n", **AS_IT_IS)


def table_with_undefined(df: DataFrame, path: str) -> None:
    """TSV in which null is the word UNDEFINED and nested cells are JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    cells = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in df.columns]
    df.select(*cells).coalesce(1).write.mode("errorifexists").csv(path, sep="\t", header=True, nullValue=UNDEFINED, emptyValue="", **AS_IT_IS)


def round_trip_text(c):
    """The shortest text that reads back as the same double."""
    return c.cast("string")


def seventeen_digits(name: str):
    """Doubles as text of 17 significant digits, as C prints them."""

    @F.pandas_udf("string")
    def text(s):
        return s.map(lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else format(x, ".17g"))

    return text(F.col(name))


def json_text(value: Any) -> str:
    """Sorted JSON in which numbers that are not finite are null.

    Rows of a DataFrame go in as ``collect()`` returns them, alone or in a
    list.  The first pass writes constants such as NaN, which no JSON number
    looks like; reading it back turns just those into null.
    """
    rows = value if isinstance(value, list) else [value]
    named = [r.asDict(recursive=True) if isinstance(r, Row) else r for r in rows]
    loose = json.dumps(named if isinstance(value, list) else named[0])
    return json.dumps(json.loads(loose, parse_constant=lambda _: None), indent=2, sort_keys=True, allow_nan=False)


def write_json(path: str, value: Any) -> None:
    """JSON by a temporary file and a rename; NaN becomes null."""
    write_bytes(path, f"{json_text(value)}\n".encode())


def write_bytes(path: str, content: bytes) -> None:
    """All or nothing, flushed to the disk."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def claim(path: str, owner: str, kind: str = "output", binding: dict[str, Any] | None = None) -> Path:
    """A new directory for ``owner``; one of the same owner, kind and binding
    (the hashes of its inputs, say) may be resumed, and only if it holds
    nothing but regular files of its own."""
    target = Path(path)
    mark, wanted = target / "owner.json", {"owner": owner, "kind": kind, "binding": binding or {}}
    if target.exists():
        same = mark.exists() and json.loads(mark.read_text()) == json.loads(json_text(wanted))
        if not same or any(p.is_symlink() for p in target.rglob("*")):
            raise OutputExists(path)
        return target
    target.mkdir(parents=True)
    write_json(str(mark), wanted)
    return target


def manifest(df_hashes: DataFrame) -> DataFrame:
    """Outputs by name with size and hash, leaving Spark's own marks out."""
    return df_hashes.filter(~F.col("name").startswith("_") & ~F.col("name").startswith(".")).select("name", "bytes", "sha256")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: not a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for r in rows:
        lines.append("| " + " | ".join(UNDEFINED if v is None else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"
