from __future__ import annotations

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pairaudit.operators.packed_values import MALFORMED, parse_packed, unpack_values

CASES = [
    (None, []),
    ("", []),
    (" | ; ,\t\n", []),
    ('""|a', ["a"]),
    ("a||b;;c|;d| |e", ["a", "b", "c", "d", "e"]),
    ("2,6-di-O-methyl-x ,  α/β-y / z\tw\nv", ["2,6-di-O-methyl-x", "α/β-y", "z", "w", "v"]),
    ("5,11,17-tris, 4,4'-bis(a)-b/Na form", ["5,11,17-tris", "4,4'-bis(a)-b/Na form"]),
    ('"bowl, a; b | c";d', ["bowl, a; b | c", "d"]),
    ('"\\"open\\" H-3", "so ""x"" y"', ['"open" H-3', 'so "x" y']),
    ("'N,N'-dibutyl | dimer' | “RX1c'; s”", ["N,N'-dibutyl | dimer", "RX1c'; s"]),
    ("“\"open\" p 4”;x", ['"open" p 4', "x"]),
    ("host 9c'||No.9″|a b", ["host 9c'", "No.9″", "a b"]),
    ("a  b", ["a", "b"]),
    ("x;x;x", ["x", "x", "x"]),
    ("f (a; b) [c | d]; e", ["f (a; b) [c | d]", "e"]),
    ("f (a; b", ["f (a", "b"]),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_cases(text, values):
    found = parse_packed(text)
    assert [v for _, v, _ in found] == values
    assert [p for p, _, _ in found] == list(range(1, len(values) + 1))


def test_malformed_quotes_backtrack():
    assert parse_packed('"open | b') == [(1, '"open', MALFORMED), (2, "b", "")]
    assert parse_packed('"open" x | b') == [(1, '"open" x', MALFORMED), (2, "b", "")]
    assert parse_packed("'tis | b")[0][2] == MALFORMED


NAME = st.text(st.characters(codec="utf-8", exclude_characters="\\", exclude_categories=("Cs", "Zs", "Zl", "Zp", "Cc")), min_size=1, max_size=12)


@given(st.lists(NAME, min_size=1, max_size=8), st.sampled_from(["|", ";", "\t", "\n", " ; ", ", ", " / ", "||"]))
def test_quoted_round_trip(names, sep):
    packed = sep.join('"' + n.replace('"', '\\"') + '"' for n in names)
    assert [v for _, v, _ in parse_packed(packed)] == [n.strip() for n in names if n.strip()]


@given(st.text("'\"“”,;|/ ()[]ab\\\n", max_size=60))
def test_never_fails_and_numbers_densely(text):
    found = parse_packed(text)
    assert [p for p, _, _ in found] == list(range(1, len(found) + 1))
    assert all(v == v.strip() and v for _, v, _ in found)


@pytest.mark.parametrize("piece", ["'a|", "(", "“x;", "a, ", '"b""', "''"])
def test_long_fields_take_linear_time(piece):
    began = time.time()
    parse_packed(piece * 100_000)
    assert time.time() - began < 8


def test_operator(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    later = t + dt.timedelta(days=1)
    data = [(1, "a|b", t, "x"), (1, "a|b", later, "x"), (2, "old", t, "x"), (2, "new|c", later, "x"), (3, None, t, "x"), (None, "n", t, "x"), (None, "m", t, "x")]
    df = spark.createDataFrame(data, "host_id bigint, names string, loaded_at timestamp, value string")
    got = sorted((r.host_id or 0, r.pos, r.value) for r in unpack_values(df, "host_id", "names", "loaded_at").collect())
    assert got == [(0, 1, "m"), (0, 1, "n"), (1, 1, "a"), (1, 2, "b"), (2, 1, "new"), (2, 2, "c")]
    assert unpack_values(df.limit(0), "host_id", "names").collect() == []
