from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairaudit.functions import chem, sequences
from pairaudit.operators import models, resample, trees, verify


def test_average_linkage_finds_blocks():
    s = np.full((6, 6), 0.1)
    s[:3, :3] = s[3:, 3:] = 0.9
    np.fill_diagonal(s, 1)
    assert models.average_linkage(s, 2).tolist() == [0, 0, 0, 1, 1, 1]
    assert models.average_linkage(s, 6).tolist() == [0, 1, 2, 3, 4, 5]
    assert models.average_linkage(s, 1).tolist() == [0] * 6


def plain_linkage(similarity, n_clusters):
    d = 1.0 - similarity
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(len(d)), np.arange(len(d))
    for _ in range(len(d) - n_clusters):
        a, b = divmod(int(np.argmin(d)), len(d))
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[b], d[:, b] = np.inf, np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


def test_average_linkage_against_the_whole_matrix():
    rng = np.random.default_rng(6)
    for n in (2, 5, 30, 60):
        s = np.round(rng.random((n, n)), 1 if n == 30 else 6)
        s = (s + s.T) / 2
        for k in (1, 2, n // 2):
            assert models.average_linkage(s, k).tolist() == plain_linkage(s, k).tolist()


def test_cluster_entities(spark):
    df = spark.createDataFrame([(i, 0b111 << 8 * (i % 3) | (1 << 8 * (i % 3) + 3 if i % 2 else 0)) for i in range(24)], "k bigint, w0 bigint")
    for exemplars in (4000, 4):
        got = {r.k: r.cluster for r in models.cluster_entities(df, "k", ["w0"], n_clusters=3, exemplars=exemplars).collect()}
        assert len(got) == 24
        assert all(got[i] == got[i % 6] for i in got)
        if exemplars > 6:
            assert all(got[i] == got[i % 3] for i in got)
            assert len(set(got.values())) == 3
    assert models.cluster_entities(df.limit(0), "k", ["w0"]).count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 50, 3]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id bigint, a double, b double, c double")
    scaled = models.standardised(df, ["a", "b", "c"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = {r.query: (r.match, r.distance) for r in models.nearest(scaled.filter("id % 20 = 0"), scaled, "id", ["a", "b", "c"], block=3).collect()}
    assert sorted(got) == list(range(0, 200, 20))
    for q, (m, d) in got.items():
        all_d = np.sqrt(((z - z[q]) ** 2).sum(axis=1))
        all_d[q] = np.inf
        assert m == int(np.argmin(all_d))
        assert d == pytest.approx(all_d.min())


def test_best_so_far(spark):
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.0, 3.0, 3.5, 3.6])], "run string, step int, loss double")
    got = models.best_so_far(log, ["run"], "step", "loss", 2).orderBy("step").collect()
    assert [r.best for r in got] == [5.0, 4.0, 4.0, 4.0, 3.0, 3.0, 3.0]
    assert [r.stop for r in got] == [False, False, False, True, False, False, True]


def test_normal_wilcoxon_nears_the_exact_test(spark):
    rng = random.Random(2)
    data = [("m", round(rng.gauss(0.2, 1), 1)) for _ in range(14)]
    df = spark.createDataFrame(data, "model string, margin double")
    exact = resample.exact_wilcoxon(df, ["model"]).first()
    near = resample.normal_wilcoxon(df, ["model"]).first()
    assert (near.n, near.w) == (exact.n, exact.w)
    assert near.p_value == pytest.approx(exact.p_value, abs=0.03)


def test_metric_and_mapping_faults(spark):
    up = lambda x, n: x if not n else up(math.nextafter(x, 9), n - 1)
    stored = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.5), ("d", 0.5), ("d", 0.5), ("e", 1.0)], "u string, r2 double")
    again = spark.createDataFrame([("a", up(0.5, 8)), ("b", 0.1), ("c", up(0.5, 9)), ("d", 0.5), ("f", 1.0)], "u string, r2 double")
    got = {r.u: r.fault for r in verify.metric_faults(stored, again, ["u"], "r2").collect()}
    assert got == {"b": "definedness", "c": "value", "d": "repeated", "e": "not_recomputed", "f": "not_stored"}
    mapping = spark.createDataFrame([("1", "g"), ("2", "2"), ("3", "g"), ("5", "x")], "k string, grp string")
    ledger = spark.createDataFrame([("1", "g"), ("2", "h"), ("3", "h"), ("4", "g")], "k string, grp string")
    decisions = spark.createDataFrame([("g", False), ("h", True)], "grp string, reverted boolean")
    got = {r.k: r.fault for r in verify.mapping_faults(mapping, decisions, ledger, "k", "grp").collect()}
    assert got == {"3": "other_group", "4": "not_mapped", "5": "not_in_ledger"}


def test_membership_faults_and_branches(spark):
    rows = [("b", "train", 1), ("b", "test", 1), ("b", "test", 2), ("b", "test", 2), ("c", "train", 1)]
    df = spark.createDataFrame(rows, "block_id string, role string, row_index bigint")
    got = sorted(map(tuple, verify.membership_faults(df).collect()))
    assert got == [("b", "repeated", 1), ("b", "train_and_test", 1), ("c", "no_test", 1)]

    def run(b):
        if b == "bad":
            raise ValueError("broken")
        return df

    done, failed, status = verify.by_branch(["good", "bad"], run)
    assert (list(done), failed, status) == (["good"], {"bad": "broken"}, "PARTIAL")
    assert verify.environment_faults({"nothing-of-this-name": "1"}) == [("nothing-of-this-name", "1", "absent")]
    assert verify.fingerprint(df) == verify.fingerprint(df.orderBy("row_index", ascending=False))
    assert verify.fingerprint(df) != verify.fingerprint(df.filter("row_index = 1"))


def test_peptides(spark):
    names = ["Ac-ARTK(me3)Y-NH2", "H-ARTKme2QTA-OH", "H-Ala-Lys-OH", "ARTK", None, " ", "H-AXK-OH", "Boc - A R T K - NH_2", "H-K(me1)(me2)-OH", "H-A-OH"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.p for r in df.select(sequences.peptide(F.col("n")).alias("p")).collect()]
    seen = [(p.notation[:5], p.n_end, p.c_end, p.sequence, [tuple(m) for m in p.modifications or []], p.parsed, p.note) for p in got]
    assert seen == [
        ("one_l", "Ac", "NH2", "ARTKY", [(4, "me3")], True, None),
        ("one_l", "H", "OH", "ARTKQTA", [(4, "me2")], True, None),
        ("three", "H", "OH", None, [], False, "three_letter_not_converted"),
        ("not_a", None, None, None, [], False, "not_a_peptide"),
        ("not_a", None, None, None, [], False, "no_name"),
        ("not_a", None, None, None, [], False, "no_name"),
        ("one_l", "H", "OH", "AXK", [], False, "other_residues"),
        ("one_l", "Boc", "NH_2", "ARTK", [], True, None),
        ("one_l", "H", "OH", "K", [(1, "me1"), (1, "me2")], False, "other_residues"),
        ("one_l", "H", "OH", "A", [], False, "other_residues"),
    ]
    k = df.select(sequences.positions_of(F.lit("GKAKK"), "K"), sequences.positions_of(F.lit(""), "K")).first()
    assert tuple(k) == ([2, 4, 5], [])


def test_runs_and_folds(spark):
    assert sequences.longest_run("ARTKQTARKS", "GGTKQTAA") == "TKQTA"
    assert sequences.longest_run("", "A") == sequences.longest_run(None, None) == ""
    df = spark.createDataFrame([("ARTKQ", "TKQ", " Ｃafé ", 2.675), (None, "A", None, None)], "a string, b string, c string, x double")
    got = df.select(sequences.common_run("a", "b"), sequences.compatible_fold("c"), sequences.rounded_to_even("x", F.lit(2))).collect()
    assert tuple(got[0]) == ("TKQ", "café", 2.67)
    assert tuple(got[1]) == ("", None, None)


def test_ambiguous_labels_and_counter_ions(spark):
    df = spark.createDataFrame([(1, True, False), (1, True, False), (2, True, False), (2, False, False)], "k int, a boolean, b boolean")
    assert {r.k: (r.n_readings, r.a, r.b) for r in sequences.ambiguous(df, "k", ["a", "b"]).collect()} == {1: (1, True, False), 2: (2, False, False)}
    frag = "array<struct<key: string, charge: int, carbon: boolean>>"
    rows = [([("R", 1, True), ("Cl", -1, False)],), ([("R", 1, True), ("Cl", -1, False), ("Cl", -1, False)],), ([("R", 1, True), ("Au", -1, False)],), ([("R", 0, True)],)]
    out = spark.createDataFrame(rows, f"f {frag}").select(sequences.counter_ion_candidate(F.col("f"), {"Cl": -1, "Na": 1}))
    assert [r[0] for r in out.collect()] == [True, False, False, False]


def test_chemistry_is_optional(spark):
    df = spark.createDataFrame([("CCO",)], "s string")
    if not chem.available():
        with pytest.raises(ImportError):
            chem.with_heavy_atoms(df, "s")
        return
    assert chem.with_heavy_atoms(df, "s").first().heavy == 3


def slow_tree(x, w, y, depth, t):
    """One regression tree by trying every cut, for one test row."""
    mean, whole = (w * y).sum() / w.sum(), (w * y).sum() ** 2 / w.sum()
    part = lambda m: (w[m] * y[m]).sum() ** 2 / w[m].sum()
    cuts = [(part(x[:, f] <= c) + part(x[:, f] > c), f, c) for f in range(x.shape[1]) for c in np.unique(x[:, f])[:-1]]
    if depth == 0 or not cuts or max(cuts)[0] <= whole + 1e-12:
        return mean
    _, f, c = max(cuts, key=lambda k: (k[0], -k[1], -k[2]))
    side = (x[:, f] <= c) == (t[f] <= c)
    return slow_tree(x[side], w[side], y[side], depth - 1, t)


def test_tree_against_brute_force():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (60, 3))
    w, y = rng.integers(1, 5, 60).astype(float), rng.normal(size=60)
    test = rng.integers(0, 6, (40, 3))
    for depth in (1, 2, 4):
        got = trees._tree(x, w, w * y, test, 6, depth, 3, rng)
        assert np.allclose(got[1], [slow_tree(x, w, y, depth, t) for t in test])
        assert np.allclose(got[0], [slow_tree(x, w, y, depth, t) for t in x])


def test_cells_say_what_rows_say():
    """Boosting without subsampling on rows and on their cells is the same."""
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 4, (500, 2))
    y = rows[:, 0] * 2.0 - rows[:, 1] + rng.normal(size=500)
    cells, inverse = np.unique(rows, axis=0, return_inverse=True)
    n, total = np.bincount(inverse), np.bincount(inverse, y)
    model = trees.Boosted(rounds=30, subsample=1.0)
    assert np.allclose(model.fit_predict(rows, np.ones(500, dtype=int), y, cells, 4), model.fit_predict(cells, n, total, cells, 4))


def test_models_learn_each_block(spark):
    rng = random.Random(5)
    effect = {h: rng.uniform(-3, 3) for h in range(30)}
    rows = [(b, i, "test" if i % 4 == b else "train", h := rng.randrange(30), rng.choice("ab"), effect[h] * (1 if b == 0 else -1) + rng.gauss(0, 0.1)) for b in (0, 1) for i in range(1200)]
    rows += [(0, 5000, "test", 99, None, 1.0), (0, 5001, "train", 3, "a", None), (2, 1, "test", 1, "a", 0.5)]
    df = spark.createDataFrame(rows, "block_id int, row_index bigint, role string, host bigint, side string, y double")
    for model in (trees.Forest(trees=30), trees.Boosted(rounds=200)):
        out = trees.fit_blocks(df, ["host", "side"], model, "m").collect()
        assert len(out) == sum(r[2] == "test" for r in rows)
        assert [r.y_pred for r in out if r.block_id == 2] == [None]
        for b in (0, 1):
            y, p = zip(*[(r.y_true, r.y_pred) for r in out if r.block_id == b and r.row_index < 5000], strict=True)
            y, p = np.array(y), np.array(p)
            assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
        assert sorted(map(tuple, out), key=str) == sorted(map(tuple, trees.fit_blocks(df, ["host", "side"], model, "m").collect()), key=str)
    assert trees.fit_blocks(df.limit(0), ["host"], trees.Forest(), "m").count() == 0


def test_large_encodings_are_not_sent_to_all(spark):
    """Tables of as many rows as there are keys stay out of the driver's memory."""
    key = F.col("id") % 40_000
    df = spark.range(200_000).select(
        (F.col("id") % 2).cast("int").alias("block_id"),
        F.col("id").alias("row_index"),
        F.when(F.col("id") < 40_000, "test").otherwise("train").alias("role"),
        key.alias("host"),
        (key % 7 + F.col("id") % 3).cast("double").alias("y"),
    )
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "4m")
    try:
        out = trees.fit_blocks(df, ["host"], trees.Forest(trees=2, depth=4), "m").agg(F.count("*"), F.count("y_pred")).first()
    finally:
        spark.conf.unset(limit)
    assert tuple(out) == (40_000, 40_000)


def test_survey_sizes():
    forest, boosted = trees.Forest(), trees.Boosted()
    assert (forest.trees, boosted.rounds, boosted.depth, boosted.rate, boosted.subsample) == (300, 600, 6, 0.05, 0.8)
