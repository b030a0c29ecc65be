from __future__ import annotations

import math
import random

import numpy as np

from pairaudit.operators import copy_diff
from pairaudit.operators.copy_diff import Field, diff_copies, ulp_distance

SCHEMA = "k string, i bigint, f bigint, h string, y double, loaded_at timestamp, difference string, extra int"
FIELDS = [Field("f"), Field("h", hexadecimal=True), Field("y", ulps=8, undefined_nan=True)]


def rows(spark, data):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    full = [(k, i, f, h, y, base + dt.timedelta(hours=t), "x", 1) for k, i, f, h, y, t in data]
    return spark.createDataFrame(full, SCHEMA)


def diff(spark, a, b, **kw):
    out = diff_copies(rows(spark, a), rows(spark, b), ["k", "i"], FIELDS, "loaded_at", ("a", "b"), **kw)
    return sorted((r.k or "", r.i if r.i is not None else -99, r.difference) for r in out.collect())


def test_fields_and_missing_keys(spark):
    x = 1.0
    for _ in range(9):
        x = math.nextafter(x, 2)
    a = [("p", 1, 1, "AB12", 1.0, 0), ("p", 2, None, "ab", None, 0), ("p", 3, 5, None, 1.0, 0), (None, 4, 1, "zz", 2.0, 0), ("q", 9, 1, "00", 0.0, 0)]
    b = [("p", 1, 1, "ab12", math.nextafter(1.0, 2), 0), ("p", 2, 0, "ab", float("nan"), 0), ("p", 3, 5, "0c", x, 0), (None, 4, 1, "ZZ", 2.0, 0), ("r", 9, 1, "00", -0.0, 0)]
    assert diff(spark, a, b) == [("p", 2, "f"), ("p", 3, "h"), ("p", 3, "y"), ("q", 9, "missing_in_b"), ("r", 9, "missing_in_a")]


def test_latest_copy_counts_and_repeats_count_once(spark):
    a = [("p", 1, 1, "ab", 1.0, 0), ("p", 1, 2, "ab", 1.0, 5), ("p", 1, 2, "ab", 1.0, 5)]
    b = [("p", 1, 2, "ab", 1.0, 1)] * 50
    assert diff(spark, a, b) == []


def test_empty_copies(spark):
    one = [("p", 1, 1, "ab", 1.0, 0)]
    assert diff(spark, [], []) == []
    assert diff(spark, one, []) == [("p", 1, "missing_in_b")]
    assert diff(spark, [], one) == [("p", 1, "missing_in_a")]


def test_many_buckets_against_brute_force(spark):
    rng = random.Random(7)
    keys = [(rng.choice("abc"), i) for i in range(400)]

    def value(k):
        return (*k, rng.choice([None, 1, 2]), rng.choice([None, "aa", "bb"]), rng.choice([None, float("nan"), 1.0, 2.0]), 0)

    a = [value(k) for k in keys if rng.random() < 0.9]
    b = [value(k) for k in keys if rng.random() < 0.9]
    left, right = ({(r[0], r[1]): r for r in side} for side in (a, b))
    want = []
    for k in set(left) | set(right):
        if k not in left:
            want.append((*k, "missing_in_a"))
        elif k not in right:
            want.append((*k, "missing_in_b"))
        else:
            x, y = left[k], right[k]
            num = lambda v: None if v is None or math.isnan(v) else v
            want += [(*k, n) for n, p, q in (("f", x[2], y[2]), ("h", x[3], y[3]), ("y", num(x[4]), num(y[4]))) if p != q]
    assert diff(spark, a, b, rows_per_bucket=30) == sorted(want)


def test_ulp_distance_crosses_zero_and_signs():
    tiny = 5e-324
    a = np.array([1.0, 0.0, -tiny, -1.0, 1.0])
    b = np.array([math.nextafter(1.0, 2), tiny, tiny, 1.0, -1.0])
    assert ulp_distance(a, b)[:3].tolist() == [1, 1, 2]
    assert (ulp_distance(a, b)[3:] > 1 << 60).all()


def test_keys_repeated_very_often(spark):
    """A third of all rows is one key: the latest of its rows counts."""
    rng = random.Random(5)
    many = [("hot", 1, rng.choice([1, 2, 3, None]), rng.choice(["aa", None]), rng.random(), rng.randint(0, 50)) for _ in range(400)]
    last = ("hot", 1, 7, "ab", 1.0, 60)
    rest = [("p", i, i, "cd", 0.5, 0) for i in range(800)]
    a, b = [*many[:200], last, *many[200:], *rest], [("hot", 1, 8, "AB", 1.0, 1), *rest[1:], *rest[1:40]]
    want = [("hot", 1, "f"), ("p", 0, "missing_in_b")]
    assert diff(spark, a, b, rows_per_bucket=20) == want
    assert diff(spark, a, b) == want
    assert diff(spark, b, a, rows_per_bucket=20) == [("hot", 1, "f"), ("p", 0, "missing_in_a")]


def test_more_buckets_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(copy_diff, "MOST_TASKS", 3)
    a = [("p", i, i, "ab", 1.0, 0) for i in range(300)]
    b = [("p", i, i + (i == 7), "ab", 1.0, 0) for i in range(1, 300)]
    assert diff(spark, a, b, rows_per_bucket=10) == [("p", 0, "missing_in_b"), ("p", 7, "f")]
