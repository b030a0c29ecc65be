from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from pairaudit.operators import bloom
from pairaudit.operators.orphans import Parent, find_orphans

T0 = dt.datetime(2024, 3, 31)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def refs(spark, data):
    return spark.createDataFrame([(*k, a, b, day(at), day(at), "clash") for k, a, b, at in data], "k string, i bigint, host bigint, guest bigint, loaded_at timestamp, produced_at timestamp, ref_field string")


def parents(spark, data):
    return spark.createDataFrame([(k, day(a), day(b), 1) for k, a, b in data], "id bigint, loaded_at timestamp, deleted_at timestamp, ref int")


def found(spark, r, hosts, guests, **kw):
    ps = [Parent("host", parents(spark, hosts), "id"), Parent("guest", parents(spark, guests), "id")]
    out = find_orphans(refs(spark, r), ["k", "i"], ps, **kw)
    return sorted((x.k, x.i, x.ref_field, x.reason, x.period) for x in out.collect())


def test_reasons(spark):
    hosts = [(1, 0, None), (2, 0, 5), (3, 5, None), (3, 9, None)]
    data = [(("a", 1), 1, None, 1), (("a", 2), 2, -1, 5), (("a", 3), 2, 7, 4), (("a", 4), 3, 7, 4), (("a", 5), 3, 7, 6), (("a", 6), 9, 7, 0)]
    got = found(spark, data, hosts, [(7, 0, None)])
    assert got == [("a", 2, "host", "deleted", "2024-04"), ("a", 4, "host", "late", "2024-04"), ("a", 6, "host", "missing", "2024-03")]


def test_repeats_empty_and_untimed(spark):
    data = [(("a", 1), 9, None, 3), (("a", 1), 9, None, 40), (("a", 2), 1, None, None)]
    assert found(spark, data, [(1, 0, 1)], []) == [("a", 1, "host", "missing", "2024-04")]
    assert found(spark, data[:1], [], []) == [("a", 1, "host", "missing", "2024-04")]
    assert found(spark, [], [(1, 0, None)], []) == []


def test_against_brute_force_with_a_full_filter(spark):
    rng = random.Random(3)
    hosts = [(i, rng.randint(0, 9), rng.choice([None, None, rng.randint(0, 9)])) for i in range(0, 300, 2)]
    data = [(("a", i), rng.randint(0, 320), rng.randint(-1, 5), rng.randint(0, 9)) for i in range(500)]
    known = {k: (a, b) for k, a, b in hosts}
    want = []
    for (k, i), h, g, at in data:
        period = day(at).strftime("%Y-%m")
        if h not in known:
            want.append((k, i, "host", "missing", period))
        elif known[h][1] is not None and known[h][1] <= at:
            want.append((k, i, "host", "deleted", period))
        elif known[h][0] > at:
            want.append((k, i, "host", "late", period))
        if g >= 0:
            want.append((k, i, "guest", "missing", period))
    assert found(spark, data, hosts, []) == sorted(want)
    # filters beyond the bound of what is broadcast
    assert found(spark, data, hosts, [], max_words=1) == sorted(want)
    assert found(spark, data, hosts, [], max_words=1, parent_rows=100_000) == sorted(want)


def test_bloom_never_hides_a_key(spark):
    keys = spark.range(5000).withColumn("id", F.xxhash64("id"))
    n = bloom.words_for(5000)
    words = bloom.build(keys, "id", n)
    assert words.count() <= n
    assert bloom.probe(keys, "id", words, n).filter("NOT maybe").count() == 0
    assert bloom.probe(keys, "id", words, n, max_words=1).filter("NOT maybe").count() == 0
    others = spark.range(10_000, 30_000).withColumn("id", F.xxhash64("id"))
    assert bloom.probe(others, "id", words, n).filter("maybe").count() < 20_000 * 0.05
