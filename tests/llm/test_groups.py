from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairaudit.llm import cross_overlap, group_splits
from pairaudit.llm.components import connected_components
from pairaudit.session import Materialized

FOLDS = "split string, fold_index string, role string, row_index string, host_id string, guest_id string, canonical_host_sha256 string, canonical_guest_sha256 string, component string"


def folds(spark, rows):
    return spark.createDataFrame([("host_cold", str(f), role, str(r), h, g, hh, gh, "clash") for f, role, r, h, g, hh, gh in rows], FOLDS)


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def components(spark, edges):
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    return {r.node: r.component for r in connected_components(df, Materialized(spark, "t")).collect()}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    edges += [(9, 9), (1000, 1000)] + edges[:5]
    assert components(spark, edges) == union_find(edges)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(500, 600)]
    random.Random(1).shuffle(path)
    star = [(7, i) for i in range(1000, 1200)]
    got = components(spark, path + star)
    assert {got[i] for i in range(500, 601)} == {500}
    assert {got[i] for i in range(1000, 1200)} == {7}


def test_no_edges_and_nulls(spark):
    assert components(spark, []) == {}
    assert components(spark, [(None, 3), (4, None), (5, 6)]) == {5: 5, 6: 5}


ROWS = [
    (0, "train", 1, "5", "100", None, None),
    (0, " TEST ", 2, "6", "100", None, None),
    (1, "train", 1, "5", "100", None, None),
    (0, "train", 3, "6", "-1", None, None),
    (0, "train", 4, "8", "", None, None),
    (0, "train", 5, "9", None, None, None),
    (0, "neither", 6, "9", "100", None, None),  # ties nothing
    (0, "test", 7, None, "100", None, None),
    (0, "test", 8, None, None, None, None),
    (0, "train", 9, "10", "x", None, None),
]


def test_groups(spark):
    got = {r.row_index: r.group_host_id for r in group_splits.group_records(folds(spark, ROWS)).collect()}
    assert got == {1: 5, 2: 5, 3: 5, 4: 8, 5: 9, 7: 5, 8: None, 9: 10}
    assert group_splits.group_records(folds(spark, [])).count() == 0


def test_splits_keep_groups_together(spark):
    rng = random.Random(3)
    rows = [(f, rng.choice(["train", "test", "neither"]), r, str(r % 900), str(r // 2), None, None) for r in range(1500) for f in range(2)]
    out = group_splits.assign_splits(folds(spark, rows)).collect()
    assert len(out) == len({r.row_index for r in out}) == 1500
    by_group = {}
    for r in out:
        by_group.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by_group.values())
    share = Counter(r.split for r in out)
    assert abs(share["train"] / len(out) - 0.8) < 0.02
    assert abs(share["test"] / len(out) - 0.1) < 0.02
    again = group_splits.assign_splits(folds(spark, rows[::-1])).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_ranges_follow_the_records(spark):
    """Many single records, some groups of hundreds and one of a third."""
    groups = [(i, 1) for i in range(4000)] + [(10_000 + i, 150) for i in range(20)] + [(20_000, 3500)]
    df = spark.createDataFrame(groups, "group_id bigint, n bigint")
    three = (("a", 8), ("b", 1), ("c", 1))
    ranges = group_splits.fit_ranges(df, three, 1)
    got = {r.s: r.n for r in df.groupBy(ranges.split_of(F.col("group_id"), 1).alias("s")).agg(F.sum("n").alias("n")).collect()}
    whole = sum(n for _, n in groups)
    assert {s: round(n / whole, 2) for s, n in got.items()} == {"a": 0.8, "b": 0.1, "c": 0.1}
    assert set(ranges.dealt) == {g for g, n in groups if n > 1}


def test_ranges_of_odd_cases():
    two = (("a", 0.5), ("b", 0.5))
    assert group_splits.make_ranges({}, {}, two).dealt == {}
    one = group_splits.make_ranges({5: 100}, {}, two)
    assert one.dealt == {5: "a"}
    assert group_splits.make_ranges({5: 90}, {k: 1 for k in range(10)}, two).ends[0] == 0  # all the rest goes to b
    assert group_splits.make_ranges({}, {7: 10}, (("a", 1),)).ends[0] in (7, 8)


ENTRY = "branch string, layer string, axis string, identity_key string, parent_key string, uncertain boolean, missing boolean, code int"


def entries(spark, rows):
    return spark.createDataFrame([(b, layer, axis, k, p, False, m, 1) for b, layer, axis, k, p, m in rows], ENTRY)


def test_overlap_rules(spark):
    f = folds(
        spark,
        [
            (0, "test", 1, "1", "11", "AA", "bb"),
            (0, "train", 2, "2", "12", "aa", "BB"),  # same hashes
            (0, "Train ", 3, "3", "13", "cc", None),  # same parents in l2
            (0, "train", 4, "4", "14", None, None),  # parents missing
            (0, "neither", 5, "2", "12", "aa", "bb"),
            (1, "train", 1, "1", "11", "AA", "bb"),
            (1, "train", 2, "2", "12", "aa", "BB"),
            (1, "test", 3, "3", "13", "cc", None),
            (1, "test", 3, "3", "13", "cc", None),
            (2, "test", 6, "7", "-1", None, None),
            (2, "train", 7, "7", "-1", None, None),
        ],
    )
    e = entries(
        spark,
        [
            ("canonical", "l2", "host", "1", " P ", False), ("canonical", "l2", "host", "3", "P", False), ("canonical", "l2", "host", "3", "P  ", False),
            ("canonical", "l2", "guest", "11", "Q", False), ("canonical", "l2", "guest", "13", "Q", False),
            ("canonical", "l1", "host", "4", "P", False), ("canonical", "l1", "guest", "14", "Q", True), ("canonical", "l1", "guest", "11", " ", False),
            ("canonical", "l1", "host", "1", "P", False), ("released", "l2", "host", "2", "P", False), ("released", "l2", "guest", "12", "Q", False),
            ("canonical", "l2", "host", "7", "Z", False), ("canonical", "l2", "guest", "-1", "Z", False),
        ],
    )
    got = sorted(map(tuple, cross_overlap.cross_split_pairs(f, e).collect()))
    assert got == [(0, 1, 2, "exact"), (0, 1, 3, "near"), (1, 1, 3, "near")]
    records = spark.createDataFrame([(1, "s1"), (3, None)], "row_index bigint, source string").withColumn("loaded_at", F.current_timestamp())
    report = cross_overlap.overlap_report(f, e, records)
    assert sorted(map(tuple, report.collect()), key=str) == sorted([(0, "s1", "exact", 1, 1), (0, "s1", "near", 1, 1), (1, None, "near", 1, 1)], key=str)


def test_overlap_of_empty_tables(spark):
    f, e = folds(spark, ROWS), entries(spark, [])
    assert cross_overlap.cross_split_pairs(folds(spark, []), e).count() == 0
    assert cross_overlap.cross_split_pairs(f, e).count() == 0


def test_overlap_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(f, rng.choice(["train", "train", "test", "neither"]), r, str(r % 23), str(r % 17), rng.choice(["h1", "h2", "h3", None]) if r % 3 else f"x{r % 23}", f"g{r % 17}" if r % 5 else None) for r in range(120) for f in range(2)]
    ents = [("canonical", layer, axis, str(i), rng.choice(["A", "B", "C", "D", "E", None, " "]), rng.random() < 0.1) for layer in ("l1", "l2") for axis, n in (("host", 23), ("guest", 17)) for i in range(n)]
    key = {(layer, axis, i): p for _, layer, axis, i, p, gone in ents if not gone and (p or "").strip()}
    want = set()
    for f, ra, a, ha, ga, hha, gha in rows:
        for f2, rb, b, hb, gb, hhb, ghb in rows:
            if f != f2 or ra != "test" or rb != "train" or a == b:
                continue
            exact = None not in (hha, gha, hhb, ghb) and (hha, gha) == (hhb, ghb)
            near = any(
                None not in (ks := [key.get((layer, x, i)) for x, i in (("host", ha), ("host", hb), ("guest", ga), ("guest", gb))]) and ks[0] == ks[1] and ks[2] == ks[3]
                for layer in ("l1", "l2")
            )
            if exact or near:
                want.add((f, min(a, b), max(a, b), "exact" if exact else "near"))
    got = {tuple(r) for r in cross_overlap.cross_split_pairs(folds(spark, rows), entries(spark, ents)).collect()}
    assert got == want
    assert want


def test_all_keys_of_repeated_entries_count(spark):
    f = folds(spark, [(0, "test", 1, "1", "1", None, None), (0, "train", 2, "2", "2", None, None), (0, "train", 3, "3", "3", None, None)])
    ents = [("canonical", "l1", axis, i, k, False) for axis in ("host", "guest") for i, ks in (("1", "AZ"), ("2", "BZ"), ("3", "C")) for k in ks]
    got = sorted(map(tuple, cross_overlap.cross_split_pairs(f, entries(spark, ents)).collect()))
    assert got == [(0, 1, 2, "near")]


def key_text(rng, n=12):
    return "".join(rng.choice(["C", "N", "O", "C(F)", "C(O)", "c1cc", "=O", "Br"]) for _ in range(n))


def test_segments_find_every_pair_within_the_radius():
    rng = np.random.default_rng(4)
    a = rng.random((300, cross_overlap.BITS)) < 0.5
    for radius in (0, 1, 3, 7):
        flips = np.zeros_like(a)
        for row in flips:
            row[rng.choice(cross_overlap.BITS, radius, replace=False)] = True
        shared = cross_overlap.segments(a, radius) == cross_overlap.segments(a ^ flips, radius)
        assert shared.any(axis=1).all()


def test_fingerprints_of_equal_and_alike_texts():
    rng = random.Random(2)
    hosts, guests = [key_text(rng) for _ in range(50)], [key_text(rng) for _ in range(50)]
    bits = cross_overlap.fingerprints(hosts + hosts, guests + guests)
    assert (bits[:50] == bits[50:]).all()
    edited = cross_overlap.fingerprints([h + "C" for h in hosts], guests)
    other = cross_overlap.fingerprints(hosts[::-1], guests[1:] + guests[:1])
    assert (bits[:50] ^ edited).sum(axis=1).mean() < (bits[:50] ^ other).sum(axis=1).mean() / 2
    long = ["x" * 300_000, "", "é"]
    assert (cross_overlap.fingerprints(long, long) == np.concatenate([cross_overlap.fingerprints([t], [t]) for t in long])).all()
    assert len(cross_overlap.fingerprints([], [])) == 0


def test_alike_keys_within_the_radius(spark):
    """Below similarity 1 all pairs within radius and similarity are found."""
    rng = random.Random(8)
    base = [key_text(rng, 60) for _ in range(12)]
    texts = {i: t if i < 12 else t[:k] + rng.choice("NOS") + t[k + 1 :] for i, (t, k) in enumerate([(b, rng.randrange(100)) for b in base * 3])}
    rows = [(0, "test" if i < 12 else "train", i, str(i), "7", None, None) for i in texts]
    ents = [("canonical", "l1", "host", str(i), t, False) for i, t in texts.items()] + [("canonical", "l1", "guest", "7", "G", False)]
    radius = 23
    got = {tuple(r)[1:3] for r in cross_overlap.cross_split_pairs(folds(spark, rows), entries(spark, ents), radius=radius, least_similarity=0.8).collect()}
    bits = cross_overlap.fingerprints(list(texts.values()), ["G"] * len(texts))
    near = {(a, b) for a in range(12) for b in range(12, 36) if (bits[a] ^ bits[b]).sum() <= radius and a == b % 12}
    planted = {(b % 12, b) for b in range(12, 36)}
    assert near <= got
    assert all(a == b % 12 for a, b in got)
    assert len(got & planted) >= 0.9 * len(planted)


def test_many_folds_and_records_in_two_roles(spark):
    rng = random.Random(21)
    rows = [(f, rng.choice(["train", "test"]), r, str(rng.randrange(4)), str(rng.randrange(3)), None, None) for f in range(70) for r in range(6) for _ in range(2)]
    ents = [("canonical", "l1", axis, str(i), "AB"[i % 2], False) for axis, n in (("host", 4), ("guest", 3)) for i in range(n)]
    want = set()
    for f, ra, a, ha, ga, _, _ in rows:
        for f2, rb, b, hb, gb, _, _ in rows:
            if f == f2 and ra == "test" and rb == "train" and a != b and int(ha) % 2 == int(hb) % 2 and int(ga) % 2 == int(gb) % 2:
                want.add((f, min(a, b), max(a, b), "near"))
    f, e = folds(spark, rows), entries(spark, ents)
    assert {tuple(r) for r in cross_overlap.cross_split_pairs(f, e).collect()} == want
    tests = {(f, r) for f, role, r, *_ in rows if role == "test"}
    ends = Counter((f, r) for f, a, b, _ in want for r in (a, b) if (f, r) in tests)
    records = spark.createDataFrame([(r, f"s{r % 2}") for r in range(6)], "row_index bigint, source string").withColumn("loaded_at", F.current_timestamp())
    report = {(r.fold_index, r.source): (r.n_records, r.n_pairs) for r in cross_overlap.overlap_report(f, e, records).collect()}
    expected = {}
    for (fold, row), n in ends.items():
        k = (fold, f"s{row % 2}")
        expected[k] = (expected.get(k, (0, 0))[0] + 1, expected.get(k, (0, 0))[1] + n)
    assert report == expected
