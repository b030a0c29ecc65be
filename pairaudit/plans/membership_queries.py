"""Queries on splits, leakage, identity layers and set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairaudit.operators import identity, rows, splits, verify
from pairaudit.plans.common import (
    BLOCKS_SQL,
    FOLDS_SQL,
    PAIRS_SQL,
    PANEL_SQL,
    RECORDS_SQL,
    folds,
    pair_blocks,
    pairs,
    panel,
    r6,
    records,
)
from pairaudit.sources.catalog import table


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers over a total order, dense ids by first appearance."""
    order = ["guest", "host", "cond2", "source", "cond1", "y"]
    numbered = rows.number_rows(pairs(spark, sf_dir), order)
    hosts = rows.dense_ids(numbered, "host", name="host_code").select("host", "host_code")
    guests = rows.dense_ids(numbered, "guest", name="guest_code").select("guest", "guest_code")
    return numbered.join(hosts, "host").join(guests, "guest").select("row_index", "host", "guest", "host_code", "guest_code", r6("y").alias("y"))


def random_fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random folds: how many test rows have host, guest or pair in train."""
    base = pairs(spark, sf_dir).withColumn("pair", F.col("host") * 10_000_000 + F.col("guest"))
    key = F.col("guest") * 31 + F.col("host") * 17 + F.col("cond2")
    folded = splits.with_blocks(base.withColumn("fold", splits.hash_fold(key, 5)), 5)
    roles = folded.withColumn("role", F.when(F.col("fold") == F.col("block"), "test").otherwise("train"))
    out = splits.leakage(roles, ["block"], ["host", "guest", "pair"])
    return out.select("block", "entity", "n_test", "n_seen", r6("share").alias("share"))


def fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The released folds: known hosts and guests of test rows in train."""
    used = folds(spark, sf_dir).filter("role IN ('train', 'test')")
    out = splits.leakage(used, ["fold"], ["host", "guest"])
    return out.select("fold", "entity", "n_test", "n_seen", r6("share").alias("share"))


def double_cold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = pair_blocks(spark, sf_dir).groupBy("block", "role")
    return counted.agg(F.count("*").alias("n"), F.countDistinct("host").alias("n_hosts"), r6(F.avg("y")).alias("mean_y"))


def double_cold_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.admissible(pair_blocks(spark, sf_dir))


def double_cold_by_held_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from listed held keys: the double_cold blocks of the panel."""
    tests = panel(spark, sf_dir).filter("split = 'double_cold'").select(F.col("block_id").alias("block"), "host_id", "guest_id").distinct()
    axis = F.explode(F.array(F.struct(F.lit("host").alias("axis"), F.col("host_id").alias("key")), F.struct(F.lit("guest").alias("axis"), F.col("guest_id").alias("key"))))
    held = tests.select("block", axis.alias("x")).select("block", "x.*").filter("key >= 0").distinct()
    universe = folds(spark, sf_dir).groupBy("row_index").agg(F.max("host").alias("host"), F.max("guest").alias("guest"))
    roles = splits.roles_from_held(universe, tests.select("block").distinct(), held)
    return roles.groupBy("block", "role").agg(F.count("*").alias("n"), F.sum("row_index").alias("checksum"))


def within_condition_double_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = pair_blocks(spark, sf_dir, 4).groupBy("cond1", "block", "role")
    return counted.agg(F.count("*").alias("n"), r6(F.avg("y")).alias("mean_y"))


def family_cold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one family out; small families are flagged."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    families = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    of_host = families.select(F.col("s_suppkey").alias("host"), F.col("r_name").alias("family"))
    # counts per family first: a left-out family is the difference to the total
    per = pairs(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), F.sum("y").alias("s")).join(of_host, "host")
    fam = per.groupBy("family").agg(F.sum("n").alias("n_test"), F.count("*").alias("n_hosts"), F.sum("s").alias("s_test"))
    total = fam.agg(F.sum("n_test").alias("n"), F.sum("s_test").alias("s")).first()
    small = (F.col("n_hosts") < 5) | (F.col("n_test") < 80)
    n_train = F.lit(total["n"]) - F.col("n_test")
    return fam.select(
        "family", "n_test", n_train.alias("n_train"), "n_hosts",
        F.round((F.lit(total["s"]) - F.col("s_test")) / F.when(n_train > 0, n_train), 4).alias("mean_train"),
        F.when(small, "NO_CONCLUSION_small").otherwise("OK").alias("flag"),
    )


def family_cold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records(spark, sf_dir).filter("y IS NOT NULL AND family IS NOT NULL")
    names = kept.groupBy("family").agg(F.count("*").alias("n_test"), F.countDistinct("host_name").alias("n_hosts"), r6(F.avg("y")).alias("mean_test"))
    small = (F.col("n_hosts") < 5) | (F.col("n_test") < 80)
    return names.withColumn("flag", F.when(small, "NO_CONCLUSION_small").otherwise("OK"))


def source_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as test against all others, and what is shared."""
    seen = pairs(spark, sf_dir).groupBy("guest", "source").agg(F.count("*").alias("n"))
    spread = seen.groupBy("guest").agg(F.count("*").alias("k"))
    out = seen.join(spread, "guest").groupBy("source")
    return out.agg(F.sum("n").alias("n_test"), F.count("*").alias("n_guests"), F.count_if(F.col("k") > 1).alias("n_shared"))


def complement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the folds that are not test in exactly one fold."""
    all_rows = folds(spark, sf_dir)
    tests = all_rows.filter("role = 'test'").select("fold", "row_index").distinct()
    return splits.partition_faults(tests, all_rows)


def complement_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train as the complement of test, against the listed train rows."""
    all_rows = folds(spark, sf_dir)
    tests = all_rows.filter("role = 'test'").select(F.col("fold").alias("block"), "row_index")
    rebuilt = splits.complement(tests, all_rows)
    listed = all_rows.filter("role = 'train'").select(F.col("fold").alias("block"), "row_index").distinct().withColumn("listed", F.lit(1))
    both = rebuilt.join(listed, ["block", "row_index"], "left")
    return both.groupBy("block").agg(F.count("*").alias("n_complement"), F.count("listed").alias("n_listed"))


def inner_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = folds(spark, sf_dir).filter("role = 'train'").select("fold", "row_index").distinct()
    marked = splits.inner_validation(train, ["fold"], "row_index")
    return marked.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("validation").alias("n_validation"), F.sum(F.when(F.col("validation"), F.col("row_index"))).alias("checksum"))


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = folds(spark, sf_dir).select("row_index", "host").distinct()
    return splits.group_folds(kept, "host")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "identity_entry").filter("branch = 'canonical' AND NOT missing")
    key = F.trim("parent_key")
    usable = entries.select("layer", "axis", F.col("identity_key").cast("bigint").alias("id"), key.alias("key"), "uncertain").filter("key <> ''")
    return usable.groupBy("layer", "axis", "id").agg(F.min("key").alias("parent"), F.max("uncertain").alias("uncertain"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = folds(spark, sf_dir).filter("role IN ('train', 'test')")
    return identity.annotate(used, _layers(spark, sf_dir))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.seen_flags(_annotated(spark, sf_dir), ["split", "fold"])


def seen_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).groupBy("fold", "layer", "class").agg(F.count("*").alias("n"), F.count_if("retained").alias("n_retained"))


def retention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _flags(spark, sf_dir).select("fold", "row_index", "layer", "host_seen", "guest_seen", "pair_seen", "class", "retained")
    return out.filter("NOT retained")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.coverage(_flags(spark, sf_dir), ["split", "layer"])


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.crosstab(_flags(spark, sf_dir), ["split", "layer"])


def identity_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.blockers(_annotated(spark, sf_dir), ["fold", "role"])


def level_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guests that the strict layer and the fragment layer merge otherwise."""
    layers = _layers(spark, sf_dir).filter("axis = 'guest'")
    merged = layers.groupBy("layer", "parent").agg(F.count("*").alias("n")).filter("n > 1")
    groups = layers.join(merged, ["layer", "parent"], "left_semi")
    strict = groups.filter("layer = 'v1_strict_exact'")
    loose = groups.filter("layer = 'v1_fragment_parent_operational'")
    return verify.set_difference(strict, loose, "id").groupBy("side").agg(F.count("*").alias("n"), F.sum("id").alias("checksum"))


def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the tables that know them, one flag a table."""
    sets = {
        "in_folds": folds(spark, sf_dir).select("row_index"),
        "in_records": table(spark, sf_dir, "clean_condition").select("row_index"),
        "in_predictions": table(spark, sf_dir, "predictions").select("row_index"),
    }
    flags = verify.membership_flags(sets, "row_index")
    return flags.groupBy(*sets).agg(F.count("*").alias("n"), F.sum("row_index").alias("checksum"))


def subset_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of double_cold tests in those of host_cold tests in the folds."""
    rows_ = panel(spark, sf_dir)
    chain = [
        ("double_cold", rows_.filter("split = 'double_cold'").select("row_index")),
        ("host_cold", rows_.filter("split = 'host_cold'").select("row_index")),
        ("folds", folds(spark, sf_dir).select("row_index")),
    ]
    return verify.inclusion_faults(chain, "row_index")


def conjunctive_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose host and guest are both test somewhere."""
    used = folds(spark, sf_dir)
    tests = used.filter("role = 'test'")
    both = used.join(tests.select("host").distinct(), "host", "left_semi").join(tests.select("guest").distinct(), "guest", "left_semi")
    return both.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("row_index").alias("checksum"))


QUERIES = {
    f.__name__: f
    for f in (
        pair_rows, random_fold_leakage, fold_leakage, double_cold_roles, double_cold_admissible, double_cold_by_held_sets,
        within_condition_double_cold, family_cold_roles, family_cold_records, source_disjoint, complement_check,
        complement_train, inner_validation, group_folds, seen_classes, retention_mask, coverage, crosstab,
        identity_blockers, level_diff, membership_flags, subset_chain, conjunctive_semi,
    )
}

_LAYERS_SQL = """layers AS (
  SELECT layer, axis, CAST(identity_key AS BIGINT) AS id, min(trim(parent_key)) AS parent, bool_or(uncertain) AS uncertain
  FROM identity_entry WHERE branch = 'canonical' AND NOT missing AND trim(parent_key) <> '' GROUP BY ALL)"""
_ANNOTATED_SQL = (
    FOLDS_SQL
    + ", "
    + _LAYERS_SQL
    + """, annotated AS (
  SELECT f.*, l.layer, h.parent AS ph, g.parent AS pg,
         coalesce(h.uncertain, false) OR coalesce(g.uncertain, false) AS uncertain
  FROM folds f CROSS JOIN (SELECT DISTINCT layer FROM layers) l
  LEFT JOIN layers h ON h.axis = 'host' AND h.layer = l.layer AND h.id = f.host
  LEFT JOIN layers g ON g.axis = 'guest' AND g.layer = l.layer AND g.id = f.guest
  WHERE role IN ('train', 'test'))"""
)
_FLAGS_SQL = (
    _ANNOTATED_SQL
    + """, tr AS (SELECT * FROM annotated WHERE role = 'train'),
flags AS (SELECT *, CASE WHEN p THEN 'same_pair_seen' WHEN h AND g THEN 'both_seen_pair_unseen' WHEN h THEN 'host_only_seen'
                         WHEN g THEN 'guest_only_seen' ELSE 'neither_seen' END AS class, NOT h AS retained
  FROM (SELECT a.*, coalesce((fold, layer, ph) IN (SELECT (fold, layer, ph) FROM tr WHERE ph IS NOT NULL), false) AND ph IS NOT NULL AS h,
           coalesce((fold, layer, pg) IN (SELECT (fold, layer, pg) FROM tr WHERE pg IS NOT NULL), false) AND pg IS NOT NULL AS g,
           coalesce((fold, layer, ph, pg) IN (SELECT (fold, layer, ph, pg) FROM tr WHERE ph IS NOT NULL AND pg IS NOT NULL), false)
             AND ph IS NOT NULL AND pg IS NOT NULL AS p
        FROM annotated a WHERE role = 'test'))"""
)
_CLASSES = ", ".join(f"('{c}')" for c in identity.CLASSES)

ORACLE = {
    "group_folds": "WITH RECURSIVE "
    + FOLDS_SQL
    + """, g AS (SELECT host, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, host NULLS FIRST) AS place
      FROM (SELECT DISTINCT row_index, host FROM folds) GROUP BY host),
    dealt AS (
      SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS host, CAST(0 AS BIGINT) AS n, 0 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
      UNION ALL
      SELECT g.place, g.host, g.n, CAST(list_position(loads, list_min(loads)) AS INTEGER),
        list_transform(range(1, 6), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END)
      FROM dealt JOIN g ON g.place = dealt.place + 1)
    SELECT host, n, fold - 1 AS fold FROM dealt WHERE place > 0""",
    "pair_rows": "WITH "
    + PAIRS_SQL
    + """, n AS (SELECT *, row_number() OVER (ORDER BY guest, host, cond2, source, cond1, y) - 1 AS row_index FROM pairs),
    h AS (SELECT host, row_number() OVER (ORDER BY min(row_index)) - 1 AS host_code FROM n GROUP BY host),
    g AS (SELECT guest, row_number() OVER (ORDER BY min(row_index)) - 1 AS guest_code FROM n GROUP BY guest)
    SELECT row_index, host, guest, host_code, guest_code, round(y, 6) AS y FROM n JOIN h USING (host) JOIN g USING (guest)""",
    "random_fold_leakage": "WITH "
    + PAIRS_SQL
    + """, f AS (SELECT *, (guest * 31 + host * 17 + cond2) * 7919 % 65537 % 5 AS fold, host * 10000000 + guest AS pair FROM pairs),
    k AS (SELECT fold, 'host' AS entity, host AS key FROM f UNION ALL SELECT fold, 'guest', guest FROM f
          UNION ALL SELECT fold, 'pair', pair FROM f),
    c AS (SELECT entity, key, fold, count(*) AS n FROM k GROUP BY ALL),
    t AS (SELECT *, count(*) OVER (PARTITION BY entity, key) AS folds FROM c)
    SELECT CAST(fold AS INTEGER) AS block, entity, CAST(sum(n) AS BIGINT) AS n_test,
      CAST(coalesce(sum(n) FILTER (WHERE folds > 1), 0) AS BIGINT) AS n_seen,
      round(coalesce(sum(n) FILTER (WHERE folds > 1), 0) / sum(n), 6) AS share FROM t GROUP BY fold, entity""",
    "fold_leakage": "WITH "
    + FOLDS_SQL
    + """, u AS (SELECT fold, role, 'host' AS entity, host AS key FROM folds UNION ALL SELECT fold, role, 'guest', guest FROM folds),
    s AS (SELECT fold, entity, key, count(*) FILTER (WHERE role = 'test') AS t, count(*) FILTER (WHERE role = 'train') AS r
          FROM u WHERE key IS NOT NULL AND role IN ('train', 'test') GROUP BY ALL)
    SELECT fold, entity, CAST(sum(t) AS BIGINT) AS n_test, CAST(coalesce(sum(t) FILTER (WHERE r > 0), 0) AS BIGINT) AS n_seen,
      round(coalesce(sum(t) FILTER (WHERE r > 0), 0) / sum(t), 6) AS share FROM s GROUP BY fold, entity""",
    "double_cold_roles": "WITH "
    + BLOCKS_SQL
    + """ SELECT block, role, count(*) AS n, count(DISTINCT host) AS n_hosts, round(avg(y), 6) AS mean_y
    FROM pair_blocks GROUP BY block, role""",
    "double_cold_admissible": "WITH "
    + BLOCKS_SQL
    + """ SELECT *, n_test >= 25 AND n_targets >= 2 AND n_train >= 50 AS admissible FROM (
    SELECT block, count(*) FILTER (WHERE role = 'test') AS n_test, count(*) FILTER (WHERE role = 'train') AS n_train,
           count(DISTINCT y) FILTER (WHERE role = 'test') AS n_targets FROM pair_blocks GROUP BY block)""",
    "double_cold_by_held_sets": "WITH "
    + PANEL_SQL
    + ", "
    + FOLDS_SQL
    + """, t AS (SELECT DISTINCT block_id AS block, host_id, guest_id FROM panel WHERE split = 'double_cold'),
    u AS (SELECT row_index, max(host) AS host, max(guest) AS guest FROM folds GROUP BY 1),
    h AS (SELECT DISTINCT block, host_id AS host, true AS hh FROM t WHERE host_id >= 0),
    g AS (SELECT DISTINCT block, guest_id AS guest, true AS gg FROM t WHERE guest_id >= 0)
    SELECT block, CASE WHEN hh AND gg THEN 'test' WHEN hh IS NULL AND gg IS NULL THEN 'train' ELSE 'neither' END AS role,
      count(*) AS n, CAST(sum(row_index) AS BIGINT) AS checksum
    FROM (SELECT b.block, u.* FROM u CROSS JOIN (SELECT DISTINCT block FROM t) b) x
    LEFT JOIN h USING (block, host) LEFT JOIN g USING (block, guest) GROUP BY 1, 2""",
    "within_condition_double_cold": "WITH "
    + BLOCKS_SQL
    + """ SELECT cond1, block, role, count(*) AS n, round(avg(y), 6) AS mean_y FROM pair_blocks WHERE block < 4
    GROUP BY cond1, block, role""",
    "family_cold_roles": "WITH "
    + PAIRS_SQL
    + """, f AS (SELECT p.*, r_name AS family FROM pairs p JOIN supplier ON s_suppkey = host
      JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    a AS (SELECT family, count(*) AS n_test, count(DISTINCT host) AS n_hosts, sum(y) AS s FROM f GROUP BY family)
    SELECT family, n_test, CAST((SELECT count(*) FROM f) - n_test AS BIGINT) AS n_train, n_hosts,
      round(((SELECT sum(y) FROM f) - s) / ((SELECT count(*) FROM f) - n_test), 4) AS mean_train,
      CASE WHEN n_hosts < 5 OR n_test < 80 THEN 'NO_CONCLUSION_small' ELSE 'OK' END AS flag FROM a""",
    "family_cold_records": "WITH "
    + RECORDS_SQL
    + """ SELECT family, count(*) AS n_test, count(DISTINCT host_name) AS n_hosts, round(avg(y), 6) AS mean_test,
      CASE WHEN count(DISTINCT host_name) < 5 OR count(*) < 80 THEN 'NO_CONCLUSION_small' ELSE 'OK' END AS flag
    FROM records WHERE y IS NOT NULL AND family IS NOT NULL GROUP BY family""",
    "source_disjoint": "WITH "
    + PAIRS_SQL
    + """, s AS (SELECT guest, source, count(*) AS n FROM pairs GROUP BY 1, 2),
    k AS (SELECT *, count(*) OVER (PARTITION BY guest) AS k FROM s)
    SELECT source, CAST(sum(n) AS BIGINT) AS n_test, count(*) AS n_guests, count(*) FILTER (WHERE k > 1) AS n_shared
    FROM k GROUP BY source""",
    "complement_check": "WITH "
    + FOLDS_SQL
    + """, t AS (SELECT row_index, count(DISTINCT fold) FILTER (WHERE role = 'test') AS n_blocks FROM folds GROUP BY 1)
    SELECT row_index, n_blocks FROM t WHERE n_blocks <> 1""",
    "complement_train": "WITH "
    + FOLDS_SQL
    + """, b AS (SELECT DISTINCT fold AS block FROM folds WHERE role = 'test'), u AS (SELECT DISTINCT row_index FROM folds),
    c AS (SELECT block, row_index FROM b CROSS JOIN u WHERE (block, row_index) NOT IN (SELECT (fold, row_index) FROM folds WHERE role = 'test'))
    SELECT block, count(*) AS n_complement,
      count(*) FILTER (WHERE (block, row_index) IN (SELECT (fold, row_index) FROM folds WHERE role = 'train')) AS n_listed
    FROM c GROUP BY block""",
    "inner_validation": "WITH "
    + FOLDS_SQL
    + """, t AS (SELECT DISTINCT fold, row_index FROM folds WHERE role = 'train'),
    r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY row_index * 48271 % 2147483647 % 1048576, row_index) AS k,
            greatest(20, floor(0.15 * count(*) OVER (PARTITION BY fold))) AS want FROM t)
    SELECT fold, count(*) AS n, count(*) FILTER (WHERE k <= want) AS n_validation,
      CAST(sum(row_index) FILTER (WHERE k <= want) AS BIGINT) AS checksum FROM r GROUP BY fold""",
    "seen_classes": "WITH "
    + _FLAGS_SQL
    + """ SELECT fold, layer, class, count(*) AS n, count(*) FILTER (WHERE retained) AS n_retained FROM flags GROUP BY 1, 2, 3""",
    "retention_mask": "WITH "
    + _FLAGS_SQL
    + """ SELECT fold, row_index, layer, h AS host_seen, g AS guest_seen, p AS pair_seen, class, retained FROM flags WHERE NOT retained""",
    "coverage": "WITH "
    + _FLAGS_SQL
    + """ SELECT split, layer, count(*) AS appearances, count(DISTINCT row_index) AS unique_rows,
      count(*) FILTER (WHERE retained) AS retained_appearances,
      count(DISTINCT row_index) FILTER (WHERE retained) AS retained_unique_rows,
      count(*) FILTER (WHERE uncertain) AS uncertain_appearances FROM flags GROUP BY 1, 2""",
    "crosstab": "WITH "
    + _FLAGS_SQL
    + f""", grid AS (SELECT * FROM (SELECT DISTINCT split, layer FROM flags)
        CROSS JOIN (VALUES {_CLASSES}) c(class) CROSS JOIN (VALUES (false), (true)) u(uncertain))
    SELECT split, layer, class, uncertain, count(f.row_index) AS n
    FROM grid LEFT JOIN flags f USING (split, layer, class, uncertain) GROUP BY 1, 2, 3, 4""",
    "identity_blockers": "WITH "
    + _ANNOTATED_SQL
    + """ SELECT fold, role, layer, axis, count(*) AS n_rows, count(DISTINCT key) AS n_keys FROM (
      SELECT fold, role, layer, 'host' AS axis, host AS key FROM annotated WHERE ph IS NULL
      UNION ALL SELECT fold, role, layer, 'guest', guest FROM annotated WHERE pg IS NULL) GROUP BY 1, 2, 3, 4""",
    "level_diff": "WITH "
    + _LAYERS_SQL
    + """, m AS (SELECT *, count(*) OVER (PARTITION BY layer, parent) AS n FROM layers WHERE axis = 'guest'),
    a AS (SELECT DISTINCT id, true AS x FROM m WHERE n > 1 AND layer = 'v1_strict_exact'),
    b AS (SELECT DISTINCT id, true AS y FROM m WHERE n > 1 AND layer = 'v1_fragment_parent_operational')
    SELECT CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'common' END AS side, count(*) AS n,
      CAST(sum(id) AS BIGINT) AS checksum FROM a FULL JOIN b USING (id) GROUP BY 1""",
    "membership_flags": """SELECT in_folds, in_records, in_predictions, count(*) AS n, CAST(sum(row_index) AS BIGINT) AS checksum FROM (
      SELECT row_index, max(CAST(t = 'f' AS INTEGER)) AS in_folds, max(CAST(t = 'r' AS INTEGER)) AS in_records,
             max(CAST(t = 'p' AS INTEGER)) AS in_predictions FROM (
        SELECT CAST(row_index AS BIGINT) AS row_index, 'f' AS t FROM folds_host_canonical
        UNION ALL SELECT row_index, 'r' FROM clean_condition UNION ALL SELECT row_index, 'p' FROM predictions)
      GROUP BY row_index) GROUP BY 1, 2, 3""",
    "subset_chain": "WITH "
    + PANEL_SQL
    + ", "
    + FOLDS_SQL
    + """, d AS (SELECT DISTINCT row_index FROM panel WHERE split = 'double_cold'),
    h AS (SELECT DISTINCT row_index FROM panel WHERE split = 'host_cold')
    SELECT 'double_cold in host_cold' AS pair, row_index FROM d ANTI JOIN h USING (row_index)
    UNION ALL SELECT 'host_cold in folds', row_index FROM h ANTI JOIN folds USING (row_index)""",
    "conjunctive_semi": "WITH "
    + FOLDS_SQL
    + """ SELECT fold, role, count(*) AS n, CAST(sum(row_index) AS BIGINT) AS checksum FROM folds
    WHERE host IN (SELECT host FROM folds WHERE role = 'test')
      AND guest IN (SELECT guest FROM folds WHERE role = 'test' AND guest IS NOT NULL) GROUP BY 1, 2""",
}
