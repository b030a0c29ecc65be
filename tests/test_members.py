from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairaudit.operators import baselines, identity, rows, similarity, splits, verify


def test_number_rows_is_dense_and_ordered(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, 7.0, rng.random() * 50]), i) for i in range(2000)]
    df = spark.createDataFrame(data, "a double, b bigint")
    got = rows.number_rows(df, ["a", "b"]).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(2000))
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in got] == want
    assert rows.number_rows(df.limit(0), ["a"]).count() == 0


def test_number_rows_in_many_ranges(spark, monkeypatch):
    """One leading value for most rows, nulls, and repeated rows."""
    monkeypatch.setattr(rows, "ROWS_A_RANGE", 50)
    data = [(1 if i % 10 else None, i % 37, "x") for i in range(1000)]
    got = rows.number_rows(spark.createDataFrame(data, "a int, b int, row_range string"), ["a", "b"]).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(1000))
    assert [(r.a is not None, r.a, r.b) for r in got] == sorted(((a is not None, a, b) for a, b, _ in data), key=lambda t: (t[0], t[1] or 0, t[2]))


def test_dense_ids_follow_first_appearance(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("bbacab")], "row_index bigint, key string")
    got = {r.key: r.dense_id for r in rows.dense_ids(df, "key").collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def test_double_cold_roles(spark):
    grid = spark.createDataFrame([(0, 1, 1), (1, 1, 2), (2, 2, 1), (3, 2, 2)], "row_index bigint, host bigint, guest bigint")
    held = spark.createDataFrame([("0", "host", 1), ("0", "guest", 1)], "block string, axis string, key bigint")
    got = {r.row_index: r.role for r in splits.roles_from_held(grid, held.select("block"), held).collect()}
    assert got == {0: "test", 1: "neither", 2: "neither", 3: "train"}


def test_partition_faults_and_complement(spark):
    universe = spark.range(6).withColumnRenamed("id", "row_index")
    test = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (1, 3), (1, 4)], "block int, row_index bigint")
    assert sorted((r.row_index, r.n_blocks) for r in splits.partition_faults(test, universe).collect()) == [(1, 2), (5, 0)]
    assert sorted((r.block, r.row_index) for r in splits.complement(test, universe).collect()) == [(0, 2), (0, 3), (0, 4), (0, 5), (1, 0), (1, 5)]


def test_group_folds_are_balanced(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice([1, rng.randint(1, 60)]),) for _ in range(3000)], "g bigint")
    got = splits.group_folds(df, "g").collect()
    load = Counter()
    for r in got:
        load[r.fold] += r.n
    rest = [v for f, v in load.items() if f != next(r.fold for r in got if r.g == 1)]
    assert max(rest) - min(rest) < 100
    several = splits.group_folds(df, "g", groups_at_once=5)
    assert several.count() == len(got)


def test_small_groups_are_dealt_by_the_same_rule(spark):
    rows = [(f"g{i}",) for i in range(400) for _ in range(1 + i % 4)] + [("large",)] * 90 + [(None,)] * 3
    df = spark.createDataFrame(rows, "g string")
    whole, parts = (splits.group_folds(df, "g", groups_at_once=k).collect() for k in (100_000, 3))
    assert Counter(r.g for r in parts) == Counter(r.g for r in whole) == {g: 1 for g in {r[0] for r in rows}}
    assert Counter((r.n, r.fold) for r in parts) == Counter((r.n, r.fold) for r in whole)


@pytest.mark.parametrize(("h", "g", "p", "want"), [(1, 1, 1, 0), (1, 1, 0, 1), (1, 0, 0, 2), (0, 1, 0, 3), (0, 0, 0, 4), (0, 1, 1, None), (1, 0, 1, None), (0, 0, 1, None)])
def test_classes(spark, h, g, p, want):
    df = spark.createDataFrame([(bool(h), bool(g), bool(p))], "h boolean, g boolean, p boolean")
    out = df.select(identity.classify(F.col("h"), F.col("g"), F.col("p")))
    if want is None:
        with pytest.raises(Exception, match="seen pair"):
            out.collect()
    else:
        assert out.first()[0] == identity.CLASSES[want]


def test_retention(spark):
    df = spark.createDataFrame([(s, h, g) for s in ("host_cold", "guest_cold", "double_cold") for h in (True, False) for g in (True, False)], "s string, h boolean, g boolean")
    for r in df.select("*", identity.retained(F.col("s"), F.col("h"), F.col("g")).alias("k")).collect():
        want = {"host_cold": not r.h, "guest_cold": not r.g, "double_cold": not r.h and not r.g}[r.s]
        assert r.k == want


def test_null_panel_falls_back_to_the_mean(spark):
    data = [("b", "train", 1, 1, 1, 2.0), ("b", "train", 2, 1, 2, 4.0), ("b", "test", 3, 1, 9, 1.0), ("b", "test", 4, 8, 9, 1.0)]
    df = spark.createDataFrame(data, "block string, role string, row_index bigint, host bigint, guest bigint, y double")
    got = {(r.row_index, r.model): r.y_pred for r in baselines.null_panel(df, ["block"], {"host_mean": ["host"]}).collect()}
    assert got[(3, "host_mean")] == got[(4, "host_mean")] == got[(4, "additive")] == got[(4, "additive_sum")] == 3.0


def test_ridge_recovers_host_effects(spark):
    rng = random.Random(8)
    data = [("b", "test" if i % 5 == 0 else "train", i, i % 7, i % 11, (i % 7) * 1.0 + (i % 11) * 0.5 + rng.gauss(0, 0.05)) for i in range(1200)]
    df = spark.createDataFrame(data, "block string, role string, row_index bigint, host bigint, guest bigint, y double")
    out = baselines.oof_encoded_ridge(df, ["block"]).toPandas()
    assert np.corrcoef(out.y_true, out.y_pred)[0, 1] > 0.99


def test_top_similar_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    bits, words = similarity.with_words(df, "id", "v", 40)
    got = similarity.top_similar(bits.filter("id % 10 = 0"), bits, "id", words, 4, block=7)
    on = vectors > 0
    for q in (0, 150, 290):
        s = [((on[q] & on[j]).sum() / (on[q] | on[j]).sum(), -j) for j in range(300) if j != q]
        want = [(-j, v) for v, j in sorted(s, reverse=True)[:4]]
        mine = [(r.match, r.similarity) for r in got.filter(F.col("query") == q).orderBy("rank").collect()]
        assert mine == [(j, pytest.approx(v)) for j, v in want]
    assert similarity.top_similar(bits.limit(0), bits, "id", words, 4).count() == 0


def test_lookup_refuses_repeated_keys(spark):
    fact = spark.createDataFrame([(1,), (2,), (3,)], "k bigint")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    assert {r.k: r.v for r in verify.lookup(fact, dim, ["k"], ["v"]).collect()} == {1: "a", 2: "b", 3: None}
    with pytest.raises(Exception, match="repeated key"):
        verify.lookup(fact, dim.union(dim), ["k"], ["v"]).collect()


def test_checks_go_on_after_a_failure(spark):
    checks = verify.Checks()
    df = spark.createDataFrame([(1,), (1,)], "k bigint")
    checks.run("unique", lambda: verify.require_empty(verify.duplicate_keys(df, ["k"]), "repeated"))
    checks.run("set", lambda: verify.require_empty(verify.multiset_difference(df, df, ["k"]), "differ"))
    assert [r.status for r in checks.frame(spark).collect()] == ["FAIL", "PASS"]


def test_set_algebra(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id bigint") for x in ([1, 2, 2, 3], [2, 3, 4]))
    assert {r.id: r.side for r in verify.set_difference(a, b, "id").collect()} == {1: "removed", 2: "common", 3: "common", 4: "added"}
    assert [(r.pair, r.id) for r in verify.inclusion_faults([("a", a), ("b", b)], "id").collect()] == [("a in b", 1)]
    flags = {r.id: (r.a, r.b) for r in verify.membership_flags({"a": a, "b": b}, "id").collect()}
    assert flags == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (0, 1)}
    ordered = spark.createDataFrame([(0, 1), (1, 3), (2, 2)], "at bigint, r int")
    assert [r[0] for r in verify.out_of_order(ordered, [F.col("r")], "at").collect()] == [2]
